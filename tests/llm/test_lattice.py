import zlib
from collections import Counter
from math import exp, inf, isclose, log, log10

import numpy as np
import public_tokenizers
import pytest

from dupscan.llm import lattice
from dupscan.llm.common import crc_part

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", "   \n", "The the THE cat", "the cat sat on the mat, the end", "élève déjà là  x", "y" * 3000, "a " * 700, "the cat sat on the mat, the end", "zq\x1cx\x85 \xa0 nul\0l"] + [f"word{i % 7} of the text number {i}" for i in range(40)]


@pytest.fixture(scope="module")
def model():
    return lattice.Model(*lattice.load_pieces(PATH))


def _sum(model, word):
    """Probability of a word by listing what its pieces can be, without logs."""
    known = {b: i for i, b in enumerate(model.pieces.bodies)}
    ways = [exp(model.bare)]
    for j in range(1, len(word) + 1):
        p = 0.0
        for i in range(j):
            k = known.get(word[i:j])
            if k is not None:
                p += ways[i] * exp(model.inner[k]) + (exp(model.first[k]) if not i else 0)
        ways.append(p)
    return ways[-1] * exp(model.stop)


def _paths(word):
    """All segmentations of a word."""
    return [[word]] + [[word[:i], *rest] for i in range(1, len(word)) for rest in _paths(word[i:])]


def _uses(model, word):
    """Expected uses of (side, piece) in a word, by all of its segmentations."""
    known = {b: i for i, b in enumerate(model.pieces.bodies)}
    found, total = Counter(), 0.0
    for path in _paths(word):
        if all(p in known for p in path):
            for bare in (True, False):
                logs = [model.inner[known[p]] if bare or i else model.first[known[p]] for i, p in enumerate(path)]
                weight = exp(sum(logs) + bare * model.bare)
                total += weight
                for i, p in enumerate(path):
                    found["inner" if bare or i else "first", known[p]] += weight
                found["first", len(known)] += bare * weight
    return {k: v / total for k, v in found.items() if v}


def test_lattice_is_the_sum_over_segmentations(model):
    words = [b"the", b"a", b"unlikely", "élève".encode(), b"xqzxqz", b"\x00\xff", b"t" * 40]
    assert np.allclose(np.exp(model.score(words)), [_sum(model, w) for w in words], rtol=1e-9)
    long = b"the" * 1000
    assert isclose(model.score([long])[0], model._long(long) + model.stop)
    assert isclose(model._alpha(model.pieces.find(np.frombuffer(b"thethe", np.uint8)[:, None]), 1)[6, 0], model._long(b"thethe"))
    assert model.pieces.longest == max(map(len, model.pieces.bodies)) > 16  # none is left out


def test_long_words_one_by_one(model, monkeypatch):
    words = [b"the" * 9, b"onerthst", b"t", b"-" * 70, "\u00e9l\u00e8ve".encode() * 5]
    weights = np.array([1, 5, 2, 3, 1])
    want, used = model.score(words), model.expected(words, weights)
    monkeypatch.setattr(lattice, "LONG_WORD", 0)
    monkeypatch.setattr(lattice, "CHUNK", 7)
    assert np.allclose(model.score(words), want) and all(np.allclose(a, b, atol=1e-9) for a, b in zip(model.expected(words, weights), used, strict=True))


def test_pieces_and_probabilities_add_up(model):
    assert isclose(np.exp(model.inner).sum(), 1) and isclose(np.exp(model.first).sum(), 1)
    inner, first = model.expected([b"the", b"thee", b"x" * 5000], np.array([1, 2, 1]))
    assert isclose(first.sum(), 4) and isclose(inner[-1], 4)


def test_expected_uses_by_all_segmentations(model):
    words, weights = [b"there", b"on", b"qzthe"], np.array([3, 1, 2])
    inner, first = model.expected(words, weights)
    want = Counter()
    for w, x in zip(words, weights, strict=True):
        for k, v in _uses(model, w).items():
            want[k] += x * v
    want["inner", len(inner) - 1] += 6
    for side, got in (("inner", inner), ("first", first)):
        assert {i for i in np.flatnonzero(got)} == {k for s, k in want if s == side}
        assert all(isclose(got[k], v) for (s, k), v in want.items() if s == side)


def test_fitting_raises_the_likelihood(model):
    words = [b"thonerst", b"erstthon", b"onerthst"]
    weights = np.array([3, 3, 3])
    used = [np.log(x + 1e-9) for x in model.expected(words, weights)]
    better = lattice.Model(model.pieces, *(lattice._normal(x) for x in used))
    assert better.score(words).sum() > model.score(words).sum()


def test_long_words_keep_their_probability(model):
    scores = model.score([b"qz" * 100, b"qz" * 1000, b"qz" * 4000])
    logs = lattice._word_logs(scores, np.zeros(3), 0.5, 100, 0.2)
    assert np.allclose(logs, scores + log(0.2)) and logs[1] < -690 and logs[2] < 2 * logs[1]
    assert np.allclose(lattice._word_logs(np.log([0.1, 0.2]), np.array([0.0, 3]), 0.5, 10, 0.2), np.log([0.02, 0.25 + 0.04]))


def _fitted(model, counts, ends):
    """One step of expectation maximisation, in the driver."""
    n = len(model.pieces.bodies)
    used = [np.zeros(n + 1), np.zeros(n + 2)]
    for w, c in counts.items():
        for x, y in zip(used, model.expected([w], np.array([c])), strict=True):
            x += y
    used[1][-1] = ends
    with np.errstate(divide="ignore"):
        return lattice.Model(model.pieces, *(lattice._normal(np.log(u + lattice.PRIOR * np.exp(p))) for u, p in zip(used, (model.inner, model.first), strict=True)))


def test_rows(spark, model):
    from pyspark.sql import functions as F

    docs = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "x"), (None, "the null id", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, c string").repartition(3)
    out = lattice.score_texts(df, crc_part(F.col("doc_id"), 10) != 0, PATH, rounds=1).collect()
    assert len(out) == len(docs)
    split = lambda t: (t or "").encode().lower().split()
    train = Counter()
    for i, t, _ in docs:
        if zlib.crc32(b"" if i is None else str(i).encode()) % 10:
            train.update([*split(t), b""])
    n, v = sum(train.values()), len(train)
    assert {r.train_tokens for r in out} == {n}
    got = Counter((r.doc_id, r.n_tokens, r.n_known) for r in out)
    assert got == Counter((i, len(split(t)) + 1, sum(train[w] > 0 for w in [*split(t), b""])) for i, t, _ in docs)
    fitted = _fitted(model, {w: c for w, c in train.items() if w}, train[b""])
    once, twice = sum(c == 1 for c in train.values()), sum(c == 2 for c in train.values())
    d = max(0.1, min(0.9, once / (once + 2 * twice)))
    by = {r.doc_id: r for r in out}
    for i, t, _ in docs:
        base = sum(log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*split(t), b""])
        assert isclose(by[i].base_score, base, rel_tol=1e-9)
        words = split(t)
        logs = {w: x for w, x in zip(words, fitted.score(words).tolist(), strict=True)} | {b"": fitted.end}
        short = [w for w in words if len(w) < 50]
        assert np.allclose([logs[w] for w in short], [log(_sum(fitted, w)) for w in short])
        assert isclose(by[i].score, sum(logs[w] for w in [*words, b""]) / log(10), rel_tol=1e-9)
        mixed = sum(np.logaddexp(log((train[w] - d) / n) if train[w] else -inf, log(d * v / n) + logs[w]) for w in [*words, b""])
        assert isclose(by[i].word_score, mixed / log(10), rel_tol=1e-9)


def test_places_above_what_one_holds(spark, monkeypatch):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a " * 10 + "b c c"), (2, "c")], "doc_id bigint, text string").coalesce(1)
    want = lattice.score_texts(df, F.lit(True), PATH, rounds=1).collect()
    big = spark.createDataFrame([(1, "a " * 200_000)], "doc_id bigint, text string")
    (row,) = lattice.score_texts(big, F.lit(True), PATH, rounds=1).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (200_001, 200_001, 200_001) and len(want) == 2


def test_no_rows_and_nothing_to_learn_from(spark):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert lattice.score_texts(empty, F.lit(True), PATH, rounds=1).collect() == []
    (row,) = lattice.score_texts(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), F.lit(False), PATH, rounds=1).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.base_score == 0 and row.score < 0
