import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dupscan.llm import toxicity
from dupscan.llm.common import crc_part


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows, labels = random.Random(3), [], []
    words = ["ab", "cade", "the", "of", "ringel", "tono", "alpha", "beta"]
    for i in range(600):
        text, bad = " ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))), i % 5 == 0
        if bad:
            text += " You VERMIN " + text
        rows.append((i, text, "s"))
        if i % 3:
            labels.append((i, int(bad)))
    labels += [(1, None), (labels[0][0], labels[0][1]), (None, 1), (99999, 1)]
    rows += [(1000, None, "s"), (1001, "", "s"), (None, "vermin", "s"), (None, "alpha", "s"), (7, rows[7][1], "s"), (1002, "alpha " * 40000, "s")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_accuracy_and_edge_rows(corpus):
    docs, labels = corpus
    held = crc_part(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, labels, ~held)
    got = docs.select("doc_id", "text", held.alias("held"), toxicity.scored(model, F.col("text")).alias("p")).collect()
    assert len(got) == docs.count() and all(0 <= r.p <= 1 for r in got)
    held_rows = [r for r in got if r.held and r.text and len(r.text) > 20]
    assert sum((r.p >= 0.5) == ("vermin" in r.text.lower()) for r in held_rows) >= 0.97 * len(held_rows) > 90
    assert {r.held for r in got} == {True, False}


def test_forced_shuffle_join_gives_the_same_model(corpus, monkeypatch):
    docs, labels = corpus
    one = toxicity.train(docs, labels, F.lit(True))
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", -1)
    two = toxicity.train(docs, labels, F.lit(True))
    assert np.array_equal(one.buckets, two.buckets) and np.allclose(one.weights, two.weights)


def _plain_grams(text):
    """Buckets of all n-grams of a text, one by one."""
    import re

    m, full = int(toxicity._MULTIPLIER), 2**64 - 1
    chars = re.sub(r"[\t\n\x0b\f\r ]+", " ", f" {text or ''} ")
    chars = [ord(c) + 32 * ("A" <= c <= "Z") for c in chars]
    out = []
    for k, n in enumerate(toxicity.ORDERS):
        for i in range(len(chars) - n + 1):
            h = 0
            for c in chars[i : i + n]:
                h = ((h ^ c) * m) & full
                h ^= h >> 31
            out.append((((h * m) & full) >> 46) + k * toxicity.BUCKETS)
    return out


@pytest.mark.parametrize("chunk", [1, 2, 5, 64, 100, 1 << 20])
def test_grams_are_those_of_the_whole_once_each(monkeypatch, chunk):
    monkeypatch.setattr(toxicity, "CHUNK", chunk)
    rng = random.Random(1)
    for text in (None, "", " ", "a", "ab", "\n a\tB  ", "日本語のテキスト é", *("".join(rng.choice("ab C\n\té🙂") for _ in range(n)) for n in (5, 64, 100, 128, 333))):
        got = [int(x) for g in toxicity.grams(text) for x in g]
        assert sorted(got) == sorted(_plain_grams(text))


def test_a_long_text_scores_as_it_does_whole(corpus, monkeypatch):
    docs, labels = corpus
    model = toxicity.train(docs, labels, F.lit(True))
    text = " ".join(["You vermin of the", "alpha"] * 2000)
    whole = model.score(text)
    monkeypatch.setattr(toxicity, "CHUNK", 100)
    assert model.score(text) == whole


def test_model_and_scores_by_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES", 60)
    docs, labels = corpus
    model = toxicity.train(docs, labels, F.lit(True))
    label = {}
    for r in labels.where("toxic is not null and doc_id is not null").collect():
        label[r.doc_id] = max(r.toxic, label.get(r.doc_id, 0))
    rows = [(r.doc_id, r.text, label[r.doc_id]) for r in docs.select("doc_id", "text").collect() if r.doc_id in label]
    n = [sum(y == side for *_, y in rows) for side in (0, 1)]
    counts = {}
    for _, text, y in rows:
        for g in set(_plain_grams(text)):
            counts.setdefault(g, [0, 0])[y] += 1
    total = n[0] + n[1]
    chi = lambda b, a: (a * (n[0] - b) - b * (n[1] - a)) ** 2 * float(total) / ((a + b) * (total - a - b + 1) * float(n[1]) * float(n[0]))
    best = sorted((-chi(*c), g) for g, c in counts.items() if sum(c) >= toxicity.RARE)[:60]
    kept = sorted(g for _, g in best)
    assert model.buckets.tolist() == kept
    ratio = np.log([(counts[g][1] + 1) / (n[1] + 2) for g in kept]) - np.log([(counts[g][0] + 1) / (n[0] + 2) for g in kept])

    def values(text):
        all_ = _plain_grams(text)
        return np.sqrt([all_.count(g) * toxicity.DENSE / max(len(all_) / len(toxicity.ORDERS), toxicity.DENSE) for g in kept])

    distinct = sorted({(i, t): y for i, t, y in rows}.items(), key=str)
    x, y = np.array([ratio * values(t) for (_, t), _ in distinct]), np.array([y for _, y in distinct], float)
    # the penalised likelihood has one maximum: its gradient is 0 there
    w = model.weights / ratio
    bias = model.bias + np.log(y.sum() / (len(y) - y.sum())) - np.log(n[1] / n[0])
    p = 1 / (1 + np.exp(-(x @ w + bias)))
    assert np.abs(x.T @ (y - p) - w).max() < 1e-3 and abs((y - p).sum()) < 1e-3
    for _, text, _ in rows[:20]:
        z = float(values(text) @ (ratio * w)) + model.bias
        assert abs(model.score(text) - 1 / (1 + np.exp(-z))) < 1e-9


def test_rows_that_agree_are_fitted_once(spark, corpus):
    docs, labels = corpus
    label = labels.where("doc_id is not null and toxic is not null")
    one = toxicity.train(docs, label, F.lit(True))
    many = toxicity.train(docs, label.union(label), F.lit(True))
    assert np.array_equal(one.buckets, many.buckets) and np.allclose(one.weights, many.weights) and one.bias == many.bias


def test_one_class_or_no_labels(spark, corpus):
    docs, labels = corpus
    for part in (labels.where("toxic = 0"), labels.where("false")):
        model = toxicity.train(docs, part, F.lit(True))
        assert 0 <= model.score("x") <= 1 and model.score("x") == model.score(None)
    assert toxicity.train(docs.where("false"), labels, F.lit(True)).score("x") == 0.5
