"""Matches of images: pairs, and the owner of each image.

An image belongs to the smallest id among those it matches, so an owner is a minimum, and every strategy can
pre-aggregate: no plan has to list all pairs of a group of copies.

* exact: at threshold 0 two tensors match iff their low nibbles agree, so owners come from an equi-join on the nibbles
  of every allowed turn of the later image with the first image of each key.
* tiles: at other thresholds, images of a bucket (folder group and unordered dimensions) are cut into tiles that meet two
  by two in a NumPy kernel. Owners are looked for in rounds, among ever longer runs of ever greater ids: an image that has
  matched takes no part in later rounds, as all ids there are greater.
* sum_bucket: images of equal pixel sums match at 0 whatever their pixels; others as by tiles.

In a pair the later image is turned, never the earlier one: the relation isn't symmetric.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupscan.functions.tensors import nibbles, rot90, true_near, wrapped_near

#: Images of a tile, and bytes of its tensors, which for large ones makes it smaller. Where that makes more than MANY tiles of a
#: bucket, they are up to LARGE times as large.
TILE, TILE_BYTES, MANY, LARGE = 2048, 64 << 20, 16, 8
#: Earlier and later images of a tile that are compared at once.
PARTS = (2048, 1024)
#: Bytes of tensors that are compared before pairs that are over the threshold already are left.
CUT = 512
#: Images of a bucket that the first round for owners takes as earlier ones at least; each round ends at GROWTH times the images.
FIRST, GROWTH = 2048, 4
#: Quarter turns of the later image that are tried: as in the original semantics, and as documented.
TURNS = (0, 1, 2)
ALL_TURNS = (0, 1, 2, 3)

PAIR_SCHEMA = "id_a bigint, id_b bigint, mse double"


def bucketed(images: DataFrame, same_dim: bool) -> DataFrame:
    """(file_id, group_id, lo, hi, tensor, px_sum) of the decoded images; lo and hi are 0 if dimensions don't count."""
    lo, hi = (F.least("width", "height"), F.greatest("width", "height")) if same_dim else (F.lit(0), F.lit(0))
    return images.where("tensor is not null").select("file_id", "group_id", lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), "tensor", "px_sum")


_BUCKET = ("group_id", "lo", "hi")


def _stack(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1) if raw else np.empty((0, 0), np.uint8)


def _side(width: int) -> int:
    """px of a tensor of so many bytes: 3 channels, else 1."""
    for channels in (3, 1, 4):
        px = math.isqrt(width // channels)
        if px * px * channels == width:
            return px
    raise ValueError(f"{width} bytes are no square image")


def exact_keys(images: DataFrame, turns: tuple[int, ...] = TURNS, same_dim: bool = True, whole: bool = False) -> DataFrame:
    """(file_id, group_id, lo, hi, turn, key): an image's key at each turn; whole: the bytes themselves, unturned."""
    names = ["file_id", *_BUCKET]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            t = _stack(batch.column("tensor"))
            for turn in (0,) if whole else turns:
                k = t if whole else nibbles(rot90(t, _side(t.shape[1]), turn) if turn else t)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.full(len(k), turn, np.int32)), pa.array([x.tobytes() for x in k], pa.binary())], [*names, "turn", "key"])

    return bucketed(images, same_dim).mapInArrow(keys, "file_id bigint, group_id int, lo int, hi int, turn int, key binary")


def owners_by_key(keyed: DataFrame) -> DataFrame:
    """Owners of rows as of exact_keys: the first image whose key at turn 0 is one of the later image's keys."""
    first = keyed.where("turn = 0").groupBy(*_BUCKET, "key").agg(F.min("file_id").alias("id_a"))
    found = keyed.join(first, [*_BUCKET, "key"]).where("id_a < file_id")
    return found.groupBy(F.col("file_id").alias("id_b")).agg(F.min("id_a").alias("id_a")).select("id_a", "id_b", F.lit(0.0).alias("mse"))


def exact_owners(images: DataFrame, turns: tuple[int, ...] = TURNS, same_dim: bool = True, whole: bool = False) -> DataFrame:
    """Owners at threshold 0: (id_a, id_b, mse = 0), one row for each image that has one."""
    return owners_by_key(exact_keys(images, turns, same_dim, whole))


def exact_pairs(images: DataFrame, turns: tuple[int, ...] = TURNS, same_dim: bool = True) -> DataFrame:
    """All pairs at threshold 0; as many as groups of copies have pairs, so meant for groups known to be small."""
    keyed = exact_keys(images, turns, same_dim)
    one = keyed.where("turn = 0").select(*_BUCKET, "key", F.col("file_id").alias("id_a"))
    found = keyed.select(*_BUCKET, "key", F.col("file_id").alias("id_b")).join(one, [*_BUCKET, "key"]).where("id_a < id_b")
    return found.select("id_a", "id_b").distinct().withColumn("mse", F.lit(0.0))


def close_pairs(a: np.ndarray, turned: list[np.ndarray], threshold: float, metric: str = "wrapped") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, mean cost) of the pairs of rows of a and b within the threshold, in order; turned: b at each turn that is tried.

    A filter leaves few pairs to be looked at byte by byte. Costs only grow as more bytes are compared, so a pair is left once
    it is over.
    """
    near, size = wrapped_near if metric == "wrapped" else true_near, a.shape[1]
    found = []
    for b in turned:
        # one more, as the mean is compared, which is rounded
        i, j = near(a[:, :CUT], b[:, :CUT], threshold * size + 1)
        total = np.zeros(len(i), np.int64)
        for at in range(0, size, CUT):
            if not len(i):
                break
            for k in range(0, len(i), 1 << 14):
                x, y = a[i[k : k + (1 << 14)], at : at + CUT], b[j[k : k + (1 << 14)], at : at + CUT]
                d = x - y if metric == "wrapped" else x.astype(np.int32) - y
                total[k : k + (1 << 14)] += (d * d).sum(1, dtype=np.int64)
            keep = total / size <= threshold
            i, j, total = i[keep], j[keep], total[keep]
        found.append((i, j, total))
    i, j, total = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((total, j, i))
    i, j, total = i[order], j[order], total[order]
    first = np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])][: len(i)]
    return i[first], j[first], total[first] / size


def _first_of(x: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the matches (x, y, m) those of the smallest x of each y."""
    order = np.lexsort((x, y))
    x, y, m = x[order], y[order], m[order]
    new = np.r_[True, y[1:] != y[:-1]][: len(y)]
    return x[new], y[new], m[new]


def _kernel(threshold: float, turns: tuple[int, ...], metric: str, owners: bool, sums: bool):
    """Rows sorted by meeting (group_id, lo, hi, low, high): compares them; yields pairs, or an owner an image.

    For pairs own is the tile of a row, low or high, and either can be the earlier image. For owners it is 0 for those that are
    looked at as earlier images and 1 for the later ones.
    """
    keys = (*_BUCKET, "low", "high")

    def close(a: np.ndarray, turned: list[np.ndarray], s_a: np.ndarray, s_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y, m = close_pairs(a, turned, threshold, metric)
        if sums:
            equal = s_a[:, None] == s_b[None]
            m = np.where(equal[x, y], 0.0, m)
            equal[x, y] = False
            u, v = np.nonzero(equal)
            x, y, m = np.r_[x, u], np.r_[y, v], np.r_[m, np.zeros(len(u))]
        return x, y, m

    def meeting(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.sort_by("file_id")
        ids, own, px_sum = (rows.column(c).to_numpy() for c in ("file_id", "own", "px_sum"))
        t = _stack(rows.column("tensor"))
        side = _side(t.shape[1])
        low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
        turned = [rot90(t, side, k) if k else t for k in turns]

        def matches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Positions and costs of matches of an image of a with a later one of b; both ascend."""
            a, b = a[ids[a] < ids[b[-1]]] if len(b) else a[:0], b[ids[b] > ids[a[0]]] if len(a) else b[:0]
            if not len(a) or not len(b):
                return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            x, y, m = close(t[a], [z[b] for z in turned], px_sum[a], px_sum[b])
            x, y = a[x], b[y]
            later = ids[x] < ids[y]
            return x[later], y[later], m[later]

        def batch(x: np.ndarray, y: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y]), pa.array(m)], ["id_a", "id_b", "mse"])

        if owners:
            first, second, i, step = np.flatnonzero(own == 0), np.flatnonzero(own == 1), 0, 64
            while i < len(first) and len(second):
                second = second[ids[second] > ids[first[i]]]
                found = [_first_of(*matches(first[i : i + step], second[j : j + PARTS[1]])) for j in range(0, len(second), PARTS[1])]
                for x, y, m in found:
                    if len(x):
                        yield batch(x, y, m)
                second = np.setdiff1d(second, np.concatenate([y for _, y, _ in found]), assume_unique=True) if found else second
                i, step = i + step, min(2 * step, PARTS[0])
            return
        left, right = (np.flatnonzero(own == x) for x in (low, high))
        for first, second in ((left, right),) if low == high else ((left, right), (right, left)):
            for i in range(0, len(first), PARTS[0]):
                for j in range(0, len(second), PARTS[1]):
                    x, y, m = matches(first[i : i + PARTS[0]], second[j : j + PARTS[1]])
                    if len(x):
                        yield batch(x, y, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, last = [], None
        for batch in batches:
            if not len(batch):
                continue
            g = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in keys], 1)
            cuts = [*np.flatnonzero(np.r_[True, (g[1:] != g[:-1]).any(1)]), len(g)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if rest and tuple(g[x]) != last:
                    yield from meeting(pa.Table.from_batches(rest))
                    rest = []
                last = tuple(g[x])
                rest.append(batch.slice(x, y - x))
        if rest:
            yield from meeting(pa.Table.from_batches(rest))

    return run


def _size(times: int = 1):
    """Images of a tile, of which the column bytes has the bytes."""
    return F.greatest(F.lit(1), F.least(F.lit(TILE * times), F.lit(TILE_BYTES) / F.greatest(F.lit(1), F.col("bytes")))).cast("int")


def _dealt(met: DataFrame, meetings: int) -> DataFrame:
    """Rows of one meeting in one partition, next to each other.

    Without a number adaptive execution would put all meetings into few partitions, as rows are small.
    """
    keys, cores = [*_BUCKET, "low", "high"], met.sparkSession.sparkContext.defaultParallelism
    return met.repartition(max(1, min(4 * meetings, max(16 * cores, meetings // 4))), *keys).sortWithinPartitions(*keys)


def _meetings(images: DataFrame, same_dim: bool) -> DataFrame:
    rows = bucketed(images, same_dim).where("file_id is not null")
    # one row a bucket; what is joined to the images is a count, and adaptive execution splits a hot bucket
    per = rows.groupBy(*_BUCKET).agg(F.count("*").alias("n"), F.max(F.octet_length("tensor")).alias("bytes"))
    n = F.col("n")
    tiles = per.select(*_BUCKET, F.greatest(F.ceil(n / _size(LARGE)), F.least(F.ceil(n / _size()), F.lit(MANY))).cast("int").alias("tiles")).persist()
    meetings = tiles.agg(F.expr("coalesce(sum(bigint(tiles) * (tiles + 1) div 2), 0)")).first()[0]
    rows = rows.join(tiles, [*_BUCKET]).withColumn("own", F.pmod(F.xxhash64("file_id"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    met = rows.select(*_BUCKET, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "file_id", "px_sum", "tensor")
    return _dealt(met, meetings)


def _facing(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Meetings of each tile of the earlier images with each tile of the later ones."""
    cores = earlier.sparkSession.sparkContext.defaultParallelism
    size = F.max(F.octet_length("tensor")).alias("bytes")
    a = earlier.groupBy(*_BUCKET).agg(F.count("*").alias("a"), size)
    b = later.groupBy(*_BUCKET).agg(F.count("*").alias("b"))
    # later images are spread over the cores, however few
    spread = F.least(F.ceil(F.col("b") / F.least(_size(), F.lit(PARTS[1]))), F.lit(2 * cores))
    tiles = a.join(b, [*_BUCKET]).select(*_BUCKET, F.ceil(F.col("a") / _size(LARGE)).cast("int").alias("of_a"), F.greatest(F.ceil(F.col("b") / _size(LARGE)), spread).cast("int").alias("of_b")).persist()
    meetings = tiles.agg(F.expr("coalesce(sum(bigint(of_a) * of_b), 0)")).first()[0]

    def dealt(rows: DataFrame, role: int, mine: str, own: str, others: str, other: str) -> DataFrame:
        rows = rows.join(tiles, [*_BUCKET]).withColumn(mine, F.pmod(F.xxhash64("file_id"), F.col(own)).cast("int"))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1)))
        return rows.select(*_BUCKET, "low", "high", F.lit(role).alias("own"), "file_id", "px_sum", "tensor")

    return _dealt(dealt(earlier, 0, "low", "of_a", "of_b", "high").unionAll(dealt(later, 1, "high", "of_b", "of_a", "low")), meetings)


def tile_pairs(images: DataFrame, threshold: float, turns: tuple[int, ...] = TURNS, same_dim: bool = True, metric: str = "wrapped", sums: bool = False) -> DataFrame:
    """All pairs within the threshold (inclusive)."""
    return _meetings(images, same_dim).mapInArrow(_kernel(threshold, turns, metric, False, sums), PAIR_SCHEMA)


def _held(df: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(kept, rows, number): df persisted and computed, and its rows under a plan of one node.

    The plan of a round contains those before it several times. The rows are still computed again if an executor is lost.
    """
    spark, kept = df.sparkSession, df.persist()
    n = kept.count()
    rows = spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False)
    return kept, DataFrame(rows, spark), n


def tile_owners(images: DataFrame, threshold: float, turns: tuple[int, ...] = TURNS, same_dim: bool = True, metric: str = "wrapped", sums: bool = False) -> DataFrame:
    """Owners within the threshold (inclusive).

    Every round runs here. Its owners, three numbers each, stay persisted.
    """
    first, rows, _ = _held(bucketed(images, same_dim).where("file_id is not null"))
    most = rows.groupBy(*_BUCKET).count().agg(F.max("count")).first()[0] or 0
    shares: list[float] = []
    while most * (share := (shares[0] if shares else 1.0) / GROWTH) >= FIRST:
        shares.insert(0, share)
    # wherever a cut lies, owners are the same: its share of the images need not be exact
    if shares:
        cuts = rows.groupBy(*_BUCKET).agg(F.percentile_approx("file_id", shares, 100_000).alias("cuts"))
        _, cuts, _ = _held(cuts)
        rows = rows.join(cuts, [*_BUCKET]).withColumn("round", F.size(F.filter("cuts", lambda c: c < F.col("file_id")))).drop("cuts")
    else:
        rows = rows.withColumn("round", F.lit(0))
    kept, later, out = None, rows, None
    for k in range(len(shares) + 1):
        met = _facing(rows.where(F.col("round") == k), later)
        _, found, _ = _held(least_owner(met.mapInArrow(_kernel(threshold, turns, metric, True, sums), PAIR_SCHEMA)))
        out = found if out is None else out.unionAll(found)
        if k == len(shares):
            break
        old, rest = kept, later.where(F.col("round") > k).join(found.select(F.col("id_b").alias("file_id")), "file_id", "left_anti")
        kept, later, left = _held(rest.select(*later.columns))
        if old:
            old.unpersist()
        if not left:
            break
    for x in (first, kept):
        if x:
            x.unpersist()
    return out


def least_owner(pairs: DataFrame) -> DataFrame:
    """Of pairs, each later image's with the smallest id."""
    return pairs.groupBy("id_b").agg(F.min(F.struct("id_a", "mse")).alias("m")).select("m.id_a", "id_b", "m.mse")


def sum_owners(images: DataFrame, same_dim: bool = True) -> DataFrame:
    """Owners by equal pixel sums: (id_a, id_b, mse = 0)."""
    rows = bucketed(images, same_dim).drop("tensor")
    first = rows.groupBy(*_BUCKET, "px_sum").agg(F.min("file_id").alias("id_a"))
    return rows.join(first, [*_BUCKET, "px_sum"]).where("id_a < file_id").select("id_a", F.col("file_id").alias("id_b"), F.lit(0.0).alias("mse"))


def owners(images: DataFrame, similarity: float = 0, rotate: bool = True, same_dim: bool = True, metric: str = "wrapped", algorithm: str = "classic", all_turns: bool = False, compat_batch: bool = False) -> DataFrame:
    """(id_a, id_b, mse): each image that matches an earlier one, with the smallest such id.

    metric: "wrapped" (squares modulo 256) or "exact" (true mean squared error). algorithm: "classic" or "sum_bucket".
    all_turns: also try 270 degrees. compat_batch: with sum_bucket, the image of the largest id matches nothing.
    """
    if metric not in ("wrapped", "exact") or algorithm not in ("classic", "sum_bucket"):
        raise ValueError("metric is wrapped or exact, algorithm classic or sum_bucket")
    turns = (ALL_TURNS if all_turns else TURNS) if rotate else (0,)
    if algorithm == "sum_bucket":
        found = sum_owners(images, same_dim) if not similarity > 0 else tile_owners(images, similarity, turns, same_dim, metric, sums=True)
        if compat_batch:
            last = images.where("tensor is not null").agg(F.max("file_id")).first()[0]
            found = found.where(F.col("id_b") != F.lit(last)) if last is not None else found
        return found
    if math.isnan(similarity):
        return exact_owners(images, (0,), same_dim, whole=True)
    if similarity == 0 and metric == "wrapped":
        return exact_owners(images, turns, same_dim)
    return tile_owners(images, similarity, turns, same_dim, metric)
