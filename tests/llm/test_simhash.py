import random

import numpy as np
import pytest
import xxhash

from dupscan.llm import simhash
from dupscan.llm.common import connected_components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


TEXTS = [None, "", " \t\n", "one", "one two", "A b C d", "a B c D", "x" * 5000, "été naïve ſ K word", "word " * 3000]


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice(["ab", "cd", "É", "f g", "hi"]) for _ in range(rng.randrange(40))) for _ in range(50)]
    for t in texts:
        assert simhash.fingerprint(t) % 2**64 == brute_fingerprint(t)


def test_long_text_in_chunks_equals_whole(monkeypatch):
    text = " ".join(str(i % 97) for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "word_chunks", lambda b: (b.split()[i : i + 7] for i in range(0, 5000, 7)))
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("k", [4, 5, 6])
def test_blocks_find_every_pair(spark, monkeypatch, k):
    rng = np.random.default_rng(k)
    base = rng.integers(-(2**63), 2**63, 60)
    fps = set(map(int, base))
    for b in base[:40]:
        for _ in range(12):
            flip = 0
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                flip |= 1 << int(bit)
            fps.add(int(np.int64(np.uint64(b.view(np.uint64) ^ np.uint64(flip)))))
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "blocks_for", lambda n: k)
    monkeypatch.setattr(simhash, "TILE", 16)
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    got = {r.node: r.component for r in connected_components(simhash.hamming_links(df)).collect()}
    u = np.array(fps, np.int64).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None]) <= 3
    want = brute_components(fps, [(fps[i], fps[j]) for i, j in zip(*np.nonzero(np.triu(near, 1)))])
    linked = {f for i, f in enumerate(fps) if near[i].sum() > 1}
    assert got == {f: c for f, c in want.items() if f in linked}


def test_rows_ties_nulls_and_extra_columns(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, "one", "y", 2), (None, "one two", "z", 3), (None, "all alone here now", "z", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string, fp int")
    out = simhash.near_duplicates(df)
    assert out.columns == ["doc_id", "fp", "component_id"]
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in out.collect()), key=str)
    fps = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    distinct = sorted({f for _, f in fps})
    comp = brute_components(distinct, [(a, b) for a in distinct for b in distinct if a < b and bin(a ^ b).count("1") <= 3])
    low = {}
    for i, f in fps:
        if i is not None:
            low[comp[f]] = min(i, low.get(comp[f], i))
    assert got == sorted(((i, f, low.get(comp[f])) for i, f in fps), key=str)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5), (None, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(60)}
