import random
from collections import defaultdict

import pytest

from dupscan.llm import mixing


def water_fill(sizes, weights, most):
    """Share by weight, cut at the caps, reshare the excess among those below, until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def rows_for(seed, sources):
    rng, rows = random.Random(seed), []
    for s, n in sources.items():
        for _ in range(n):
            rows.append((len(rows), " ".join(["w"] * rng.choice([1, 3, 10, 40])), s, "x"))
    return rows


SCHEMA = "doc_id bigint, text string, source string, target string"


@pytest.mark.parametrize("seed,sources", [(1, {"b": 700, "a": 3, None: 40, "é": 5, "z": 1}), (2, {"x": 1}), (3, {"a": 2, "b": 2000})])
def test_targets_and_rounding(spark, seed, sources):
    rows = rows_for(seed, sources)
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes, taken, target, most, shares = defaultdict(int), defaultdict(int), {}, defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source], most[r.source] = r.target, max(most[r.source], r.size)
        shares.setdefault(r.source, []).append(r.copies)
    want = water_fill(sizes, (5, 2, 1), 3)
    assert target == pytest.approx(want) and sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s, t in want.items():
        assert abs(taken[s] - t) <= most[s] + 1e-6
        assert set(shares[s]) <= {int(t / sizes[s] + 1e-9), int(t / sizes[s] + 1e-9) + 1, round(t / sizes[s])} and max(shares[s]) <= 3


def test_expectations_are_kept(spark):
    """Over many sources alike, a document is taken as often as its expectation says."""
    units = spark.createDataFrame([(f"s{i}", k + 1000 * i, float(w)) for i in range(300) for k, w in enumerate((1, 2, 30))], "source string, key bigint, w double")
    targets = spark.createDataFrame([(f"s{i}", 33, 3, 33 * 0.4) for i in range(300)], "source string, source_size bigint, n bigint, target double")
    sums = defaultdict(int)
    for r in mixing.copies(units, targets).collect():
        sums[r.key % 1000] += r.copies
    assert all(abs(sums[k] / 300 - 0.4) < 0.1 for k in range(3))


def test_nulls_empty_texts_repeats(spark):
    rows = [(1, None, "a", "x"), (2, "", "a", "x"), (None, "a b c", None, "x"), (None, "a b c", None, "x"), (3, "one two", "a", "x"), (3, "one two", "a", "x"), (4, "w " * 50000, "b", "x")]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and all(r.copies == 0 for r in got if r.size == 0)
    assert len({r.copies for r in got if r.doc_id == 3}) == 1
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r.copies for r in mixing.mix(spark.createDataFrame([(1, None, "a", "x")], SCHEMA)).collect()] == [0]
