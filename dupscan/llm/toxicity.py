"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

1. Counts. Over all labelled training rows: in how many texts of either class each hashed n-gram occurs. Texts are
   counted where they lie, and each task passes on sums for a fixed number of buckets. The smoothed log-ratio of the
   two classes' shares is a feature's scale.
2. Weights. The FEATURES n-grams whose occurrence depends most on the class (chi-square over all training rows) stay.
   A logistic regression with an L2 penalty is fitted on at most SAMPLE distinct training rows of each class (those of smallest hash).
   A feature's value in a text is the root of how densely the n-gram occurs in it (so that what long texts hold by chance
   weighs little), scaled by the feature's log-count ratio. The intercept is then set right for the classes' real shares.
3. Scores. Every whole text is scored where it lies, in one pass over its characters.

N-grams run over the characters (code points) of the text with A-Z lower-cased and runs of white space as one space, and a
space at either end. Nothing but the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupscan.llm.common import scratch

#: Lengths of the n-grams, in characters.
ORDERS = (3, 4, 5, 6)
#: Hash buckets of each length.
BUCKETS = 1 << 18
#: N-grams that the linear model keeps.
FEATURES = 1024
#: Characters of text in which one occurrence is density 1; shorter texts count as so long.
DENSE = 500
#: Distinct training rows of each class, at most, on which the weights are fitted.
SAMPLE = 4000
#: Training texts in which an n-gram occurs at least, if it is to be kept.
RARE = 3
#: Labelled rows up to which the labels are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Characters of a text that are worked off at once.
CHUNK = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _folded(part: str) -> np.ndarray:
    """Code points, A-Z in lower case, white space as spaces."""
    c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    c[(c >= 65) & (c <= 90)] += 32
    c[(c >= 9) & (c <= 13)] = 32
    return c


def grams(text: str | None) -> Iterator[np.ndarray]:
    """The hashed n-grams of a text, each as often as it occurs, as bucket + number of the length * BUCKETS, in bounded chunks."""
    text, longest = text or "", max(ORDERS)
    before = np.array([32], np.uint32)  # up to longest - 1 characters of what has been worked off
    seen = 0  # of these, how many are not new
    for at in range(0, len(text) + 1, CHUNK):
        part = _folded(text[at : at + CHUNK])
        if at + CHUNK > len(text):
            part = np.r_[part, np.uint32(32)]
        space = part == 32
        part = part[~(space & np.r_[before[-1] == 32, space[:-1]])]
        b = np.concatenate([before, part]).astype(np.uint64)
        h = np.zeros(len(b), np.uint64)
        for n in range(1, longest + 1):
            if len(b) < n:
                break
            h = (h[: len(b) - n + 1] ^ b[n - 1 :]) * _MULTIPLIER
            h ^= h >> np.uint64(31)
            if n in ORDERS:
                new = h[max(0, seen - n + 1) :]  # those that end in what is new
                yield ((new * _MULTIPLIER) >> np.uint64(46)).astype(np.int32) + np.int32(ORDERS.index(n) * BUCKETS)
        before = b[-(longest - 1) :].astype(np.uint32)
        seen = len(before)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either class in which each bucket occurs, over the rows of a task."""
    total = BUCKETS * len(ORDERS)
    counts, last = np.zeros((2, total), np.int32), np.full(total, -1, np.int32)
    seen, number = np.zeros(2, np.int64), 0
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for g in grams(text):
                g = g[last[g] != number]
                last[g] = number
                place = np.arange(len(g), dtype=np.int32)
                slot = counts[label]
                # of equal buckets only the one written last counts
                first = _SLOTS.setdefault(total, np.zeros(total, np.int32))
                first[g] = place
                slot[g[first[g] == place]] += 1
            seen[label] += 1
            number += 1
    some = np.flatnonzero(counts.any(0))
    for at in range(0, len(some), 1 << 16):
        part = some[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(counts[1, part].astype(np.int64)), pa.array(counts[0, part].astype(np.int64))], ["bucket", "pos", "neg"])
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([seen[1]], pa.int64()), pa.array([seen[0]], pa.int64())], ["bucket", "pos", "neg"])


_SLOTS: dict[int, np.ndarray] = {}
_PLACES: dict[bytes, np.ndarray] = {}


@dataclass(frozen=True)
class Model:
    """The kept buckets, sorted, each one's scale times weight, and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float

    def values(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, roots of densities) of the kept features that occur in a text."""
        key = self.buckets.tobytes()
        if key not in _PLACES:
            _PLACES.clear()
            _PLACES[key] = np.full(BUCKETS * len(ORDERS), -1, np.int16)
            _PLACES[key][self.buckets] = np.arange(len(self.buckets))
        counts, total = np.zeros(len(self.buckets)), 0
        for g in grams(text):
            hit = _PLACES[key][g]
            counts += np.bincount(hit[hit >= 0], minlength=len(counts))
            total += len(g)
        found = np.flatnonzero(counts)
        return found, np.sqrt(counts[found] * DENSE / max(total / len(ORDERS), DENSE))

    def score(self, text: str | None) -> float:
        found, values = self.values(text)
        z = float((self.weights[found] * values).sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 12) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps; the intercept, last, has no penalty."""
    x = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the labelled documents; of several labels of an id the highest counts, null ones don't."""
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if labels.count() <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return docs.select("doc_id", "text").join(known, "doc_id")


def train(docs: DataFrame, labels: DataFrame, training: Column) -> Model:
    """Learn from the labelled rows for which training (of doc_id) holds; with one class or none, a constant score.

    Null and empty texts count as texts without n-grams but one space; rows that agree in id and text are counted as often as they
    occur and fitted once; of several labels of an id the highest counts. Ties in the choice of n-grams go to the lower bucket,
    of rows to the lower hash. Empty tables give a constant score. Other columns of docs and labels are not read.
    """
    rows = labelled(docs, labels.where(training)).select("doc_id", "text", F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic"))
    counted = scratch(rows.select("text", "toxic").mapInArrow(_count, "bucket int, pos bigint, neg bigint").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "counts")
    of = counted.where("bucket = -1").first()
    n1, n0 = (of.pos or 0, of.neg or 0) if of else (0, 0)
    if not n1 or not n0:
        return Model(np.empty(0, np.int64), np.empty(0), log((n1 + 0.5) / (n0 + 0.5)) if n1 or n0 else 0.0)
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    n = float(n1 + n0)
    chi = (a * (n0 - b) - b * (n1 - a)) ** 2 * n / ((a + b) * (n - a - b + 1) * float(n1) * float(n0))
    kept = counted.where(f"bucket >= 0 and pos + neg >= {RARE}").withColumn("chi", chi).orderBy(F.desc("chi"), "bucket").limit(FEATURES).collect()
    kept.sort(key=lambda r: r.bucket)
    if not kept:
        return Model(np.empty(0, np.int64), np.empty(0), log((n1 + 0.5) / (n0 + 0.5)))
    pos, neg = (np.array([getattr(r, k) for r in kept], float) for k in ("pos", "neg"))
    ratio = np.log((pos + 1) / (n1 + 2)) - np.log((neg + 1) / (n0 + 2))
    bare = Model(np.array([r.bucket for r in kept]), np.zeros(len(kept)), 0.0)
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    keys = scratch(keyed.select("key", "toxic").distinct(), "keys")
    # the last key of each class that is sampled; a key has one row, so both bounds hold however often rows repeat
    last = [keys.where(F.col("toxic") == side).orderBy("key").limit(SAMPLE).agg(F.max("key")).first()[0] for side in (0, 1)]
    chosen = keyed.where(F.col("key") <= F.when(F.col("toxic") == 1, F.lit(last[1])).otherwise(F.lit(last[0]))).select("key", "toxic", "text").dropDuplicates(["key"])
    found = chosen.select(F.arrow_udf(_packed_values(bare), "binary")("text").alias("found"), "toxic", "key").collect()
    found.sort(key=lambda r: r.key)
    x, y = np.zeros((len(found), len(kept))), np.array([r.toxic for r in found], float)
    for i, r in enumerate(found):
        v = np.frombuffer(r.found, _VALUE)
        x[i, v["number"]] = ratio[v["number"]] * v["value"]
    weights, bias = _fit(x, y)
    bias -= log(max(y.sum(), 0.5) / max(len(y) - y.sum(), 0.5)) - log(n1 / n0)
    return Model(bare.buckets, weights * ratio, bias)


_VALUE = np.dtype([("number", "<i2"), ("value", "<f4")])


def _packed_values(model: Model):
    def packed(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            found, values = model.values(t.as_py())
            v = np.empty(len(found), _VALUE)
            v["number"], v["value"] = found, values
            out.append(v.tobytes())
        return pa.array(out, pa.binary())

    return packed


def scored(model: Model, text: Column) -> Column:
    """Probability of toxicity of a text column; null and empty texts get the intercept's."""

    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return F.arrow_udf(score, "double")(text)
