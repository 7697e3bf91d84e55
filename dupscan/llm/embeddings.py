"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with a scale of their own; the norm of what is lost is kept. For a pair, the integer
product and the two norms bound the true cosine from both sides: pairs whose upper bound is under the threshold are
done, those whose lower bound reaches it are links, and only the others are computed again in double precision.

A tile product is one matrix product of the codes, times the scales, in single precision. Its rounding error and the largest
loss of the tile, both added up, discard nearly all pairs in one comparison; what is left gets exact integer products and
bounds of its own.

Equal vectors are one; all others are compared at every size: they are cut into tiles that meet two by two, and each meeting
passes on counts and a spanning forest. The number of meetings grows with the square of the distinct vectors, and the copies
of a vector that are shuffled with their number over the tile's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupscan.llm.common import connected_components, local_components, scratch

#: Cosine from which two vectors link.
THRESHOLD = 0.95
#: Vectors of a tile at most, and bytes of it in double precision, which for long vectors makes it smaller.
TILE, TILE_BYTES = 8192, 32 << 20
#: Tiles into which vectors are cut at least, so that their meetings are many tasks, but not below LEAST vectors each.
TILES, LEAST = 12, 1024
#: Vectors of a part of a tile that is multiplied at once.
PART = 512
#: Lengths of vectors up to whose number their list is broadcast; beyond it it is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Slack for the rounding of double arithmetic in the bounds.
EPSILON = 1e-9


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _Tile:
    """Vectors, quantised, with what the bounds need."""

    def __init__(self, u: np.ndarray, n: np.ndarray, node: np.ndarray):
        self.u, self.n, self.node = u, n, node
        scale = np.abs(u).max(1) / 127
        q = np.rint(u / scale[:, None])
        self.q, self.scale = q.astype(np.int8), scale
        self.lost = np.linalg.norm(u - q * scale[:, None], axis=1)
        self.norm = np.linalg.norm(q, axis=1) * scale
        self.near = (q * scale[:, None]).astype(np.float32)


def _rounding(dim: int) -> float:
    """Bound of the error of a single-precision product of two vectors of norm 1.1 at most, in any order of summation."""
    return (dim + 3) * 2.0**-24 * 1.3


def _links(a: _Tile, b: _Tile, rows: slice, cols: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of the links of some rows of two tiles."""
    dim = a.q.shape[1]
    lost_a, lost_b = a.lost[rows].max(), b.lost[cols].max()
    most = lost_a * (b.norm[cols].max() + lost_b) + a.norm[rows].max() * lost_b + EPSILON + _rounding(dim)
    product = a.near[rows] @ b.near[cols].T
    i, j = np.divmod(np.flatnonzero(product.ravel() >= np.float32(threshold - most - 1e-6)), product.shape[1])
    i, j = i + rows.start, j + cols.start
    keep = []
    for at in range(0, len(i), 1 << 14):
        x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        near = np.einsum("ij,ij->i", a.q[x].astype(np.int32), b.q[y].astype(np.int32)) * a.scale[x] * b.scale[y]
        slack = a.lost[x] * (b.norm[y] + b.lost[y]) + a.norm[x] * b.lost[y] + EPSILON
        hit = near - slack >= threshold
        again = np.flatnonzero((near + slack >= threshold) & ~hit)
        hit[again] = np.einsum("ij,ij->i", a.u[x[again]], b.u[y[again]]) >= threshold
        keep.append(hit)
    kept = np.concatenate(keep) if keep else np.empty(0, bool)
    return i[kept], j[kept]


def _meet(tile: _Tile, own: np.ndarray, low: int, high: int, threshold: float) -> pa.RecordBatch:
    """Counts and spanning links of one tile with itself, or of two tiles with each other."""
    m = len(own)
    label, count = np.arange(m), np.zeros(m, np.int64)
    parts = [[slice(r, min(r + PART, end)) for r in range(begin, end, PART)] for begin, end in ((np.searchsorted(own, x), np.searchsorted(own, x, "right")) for x in (low, high))]
    for k, rows in enumerate(parts[0]):
        ends = []
        for cols in parts[1][k if low == high else 0 :]:
            i, j = _links(tile, tile, rows, cols, threshold)
            if rows == cols:
                i, j = i[i < j], j[i < j]
            if len(i):
                count += np.bincount(i, tile.n[j], m).astype(np.int64) + np.bincount(j, tile.n[i], m).astype(np.int64)
                ends.append((label[i], label[j]))
        if ends:  # a forest so far is all that is kept of the links
            a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
            label = local_components(a, b, m)[label]
    some, far = np.flatnonzero(count), np.flatnonzero(label != np.arange(m))
    left = pa.array(np.r_[tile.node[some], tile.node[far]])
    right = pa.array(np.r_[np.zeros(len(some), np.int64), tile.node[label[far]]], mask=np.r_[np.ones(len(some), bool), np.zeros(len(far), bool)])
    return pa.RecordBatch.from_arrays([left, right, pa.array(np.r_[count[some], np.zeros(len(far), np.int64)])], ["a", "b", "links"])


def _meetings(threshold: float):
    """Rows sorted by their meeting, which batches may cut; a meeting is complete before it is worked off."""
    keys = ("dim", "low", "high")

    def done(rows: pa.Table) -> pa.RecordBatch:
        dim, low, high = (rows.column(k)[0].as_py() for k in keys)
        flat = pa.concat_arrays([c.flatten() for c in rows.column("vector").chunks]).to_numpy(zero_copy_only=False)
        tile = _Tile(_unit(flat, dim), rows.column("n").to_numpy(), rows.column("node").to_numpy())
        return _meet(tile, rows.column("own").to_numpy(), low, high, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, key = [], None
        for batch in batches:
            if not len(batch):
                continue
            g = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys], 1)
            cuts = np.r_[np.flatnonzero(np.r_[True, (g[1:] != g[:-1]).any(1)]), len(g)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if key is not None and tuple(g[a]) != key:
                    yield done(pa.Table.from_batches(open_))
                    open_ = []
                key = tuple(g[a])
                open_.append(batch.slice(a, b - a))
        if open_:
            yield done(pa.Table.from_batches(open_))

    return run


def _links_of(distinct: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links): counts of links (b null) and spanning links (a, b) of distinct vectors (node, vector, n)."""
    rows = distinct.select("node", "vector", "n", F.size("vector").alias("dim"))
    size = F.least(F.lit(TILE), F.greatest(F.lit(LEAST), F.col("count") / TILES), F.lit(TILE_BYTES) / (8 * F.col("dim")))
    tiles = scratch(rows.groupBy("dim").count().select("dim", F.ceil(F.col("count") / size).cast("int").alias("tiles")), "tiles")
    if tiles.count() <= BROADCAST_ROWS:
        tiles = F.broadcast(tiles)
    rows = rows.join(tiles, "dim").withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    group = ["dim", "low", "high"]
    rows = rows.select("dim", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "n", "vector")
    return rows.repartition(*group).sortWithinPartitions(*group, "own").mapInArrow(_meetings(threshold), "a bigint, b bigint, links bigint")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of vectors: (id, n_links, component_id, kept).

    n_links counts the other rows linked directly; component_id is the smallest non-null id that links reach, the row's
    own included. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and
    vectors of different lengths never link. Repeated rows link with each other. kept: the id is the component's. Other
    columns of vectors are not read. An empty table gives an empty result.
    """
    v = F.col("vector")
    good = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("node", F.when(v.isNotNull() & F.coalesce(good, F.lit(False)), F.xxhash64(F.size(v), v)))
    named = scratch(rows.select("vec_id", "node"), "rows")
    distinct = scratch(rows.where("node is not null").groupBy("node", "vector").agg(F.count("*").alias("n"), F.min("vec_id").alias("first")), "vectors")
    found = scratch(_links_of(distinct, threshold), "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    parts = scratch(connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "p"), "parts")
    few = distinct.select("node", "n", "first")
    lowest = few.join(parts, F.col("node") == F.col("p")).groupBy("component").agg(F.min("first").alias("lowest"))
    of = scratch(parts.join(lowest, "component").select("p", "lowest"), "lowest")
    labels = few.join(of, F.col("node") == F.col("p"), "left").join(counts, F.col("node") == F.col("a"), "left")
    labels = scratch(labels.select(F.col("node").alias("k"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("lowest", "first").alias("component_id")), "labels")
    out = named.join(labels, F.col("node") == F.col("k"), "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
