import random

import numpy as np
import pytest

from dupscan.llm import licenses as L
from dupscan.llm.license_texts import TEMPLATES

TEXTS = {name: text for name, (_, text) in TEMPLATES.items()}


@pytest.fixture(scope="module")
def index():
    return L.Index(TEXTS)


def _brute(text):
    """Templates whose containment in some stretch of a text, a quarter longer than they are, is high enough."""
    words, out = L._words(text), set()
    for name, t in TEXTS.items():
        own = L._words(t)
        width = min(L.SHINGLE, len(own))
        own = set(L._shingles(own, width).tolist())
        s = L._shingles(words, width).tolist()
        n = len(own) + 2 * (len(own) // 4 + 1)
        if any(len(own & set(s[i : i + n])) >= L.CONTAINMENT * len(own) for i in range(max(1, len(s) - n + 1))):
            out.add(name)
    return out


def test_probability():
    assert L.collision_probability(1) == 1 and L.collision_probability(2 / 3) > 0.99 and L.collision_probability(0) == 0
    assert [L.window_of(s) for s in (1, 2, 3, 4, 7, 8, 100)] == [1, 1, 1, 2, 2, 4, 32]


def test_exact_copies_are_found_where_they_are(index):
    rng = random.Random(1)
    filler = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    for name, text in TEXTS.items():
        before = rng.randint(0, 50)
        found = {m[0]: m for m in index.scan([L._words(f"{filler(before)}\n{text.upper()} {filler(20)}")])[0]}
        assert found[name][1:] == (before, len(L._words(text)), 1.0)


def test_near_copies_are_found(index):
    """Notices with some words changed, added and left out, inside other text, that still hold CONTAINMENT of their shingles."""
    rng, tried, caught = random.Random(5), 0, 0
    filler = lambda n: "".join(rng.choices("abcdefghij ", k=8 * n)).split()
    for name, text in TEXTS.items():
        own = set(L._shingles(L._words(text), L.SHINGLE).tolist())
        for _ in range(12 if len(own) >= 12 else 0):
            words = text.split()
            for _ in range(rng.randint(1, max(1, len(words) // 25))):
                k = rng.randrange(len(words))
                words[k : k + rng.randint(0, 1)] = rng.choice([["changed"], []])
            near = L._words(" ".join(words))
            if len(own & set(L._shingles(near, L.SHINGLE).tolist())) < L.CONTAINMENT * len(own):
                continue
            tried += 1
            caught += name in {m[0] for m in index.scan([L._words(" ".join([*filler(30), *words, *filler(30)]))])[0]}
    assert tried > 150 and caught >= 0.99 * tried


def test_versions_of_a_notice_are_kept_apart(index):
    for name, text in TEXTS.items():
        found = L.closest(index.scan([L._words(f"some words before it, {text} and some behind")])[0])
        assert name in {m[0] for m in found}
        if "notice" in name:
            assert {TEMPLATES[m[0]][0] for m in found} == {TEMPLATES[name][0]}
        if name.startswith("tag-"):
            assert {TEMPLATES[m[0]][0] for m in found} == {TEMPLATES[name][0]}


def test_as_brute_force(index):
    rng = random.Random(2)
    names = list(TEXTS)
    for _ in range(60):
        words = "".join(rng.choices("abcdefghij ", k=300)).split()
        for name in rng.sample(names, rng.randint(0, 3)):
            own = TEXTS[name].split()
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = "changed"
            if rng.random() < 0.3:
                own = own[: rng.randint(1, len(own))]
            words += ["//", *own, *"".join(rng.choices("klmnop ", k=40)).split()]
        text = " ".join(words)
        assert {m[0] for m in index.scan([L._words(text)])[0]} == _brute(text)


def test_long_texts_are_scanned_in_runs(index, monkeypatch):
    monkeypatch.setattr(L, "RUN", 500)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(5000)]
    for at in range(4900, 0, -330):
        words[at:at] = TEXTS["isc"].split()
    text = " ".join(words)
    texts = ["", text, None, TEXTS["isc"], TEXTS["mit-short"], text, "none"]
    found = list(L.scan_texts(index, texts))
    assert found == [index.scan([L._words(t)])[0] for t in texts]
    assert list(map(len, found)) == [0, 15, 0, 1, 1, 15, 0]


def test_rows(spark):
    rows = [(1, "x Released under the MIT License.", "t"), (1, "x Released under the MIT License.", "t"), (2, None, "t"), (3, "", "t"), (None, "Copyright 2001 X. All rights reserved. ALL RIGHTS RESERVED", "t"), (5, "all rights", "t")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, template string")
    out = sorted(map(tuple, L.scan(df, TEXTS).collect()), key=str)
    assert out == [(1, "mit-short", 1, 5, 1.0)] * 2 + [(None, "all-rights-reserved", 3, 3, 1.0), (None, "all-rights-reserved", 6, 3, 1.0)]
    assert L.scan(df.limit(0), TEXTS).collect() == [] and L.scan(df, {"none": " ."}).collect() == []


def test_nothing_in_random_text(index):
    assert index.scan([np.random.default_rng(0).integers(0, 1 << 60, 100_000).astype(np.uint64)]) == [[]]
