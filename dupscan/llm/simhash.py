"""SimHash near-duplicates by pivot distance tables.

A pair of fingerprints at Hamming distance h differs by at most h in its distance to any third fingerprint. Each
fingerprint therefore gets a table of distances to PIVOTS reference fingerprints (rows of a Walsh matrix: by
Parseval's identity a pair whose coordinates all differ by 3 or less has few differing bits, so the filter is
sharp). Pairs whose largest coordinate difference exceeds the limit are discarded, the others verified.

Which pairs are looked at at all is settled by exact keys: with the 64 bits cut into k blocks, fingerprints that
differ in at most 3 bits agree on some k - 3 whole blocks. k grows with the number of distinct fingerprints, which
only keeps the buckets small: any k finds the same pairs. Buckets above TILE rows are cut into tiles that meet two
by two, so no task holds a hot bucket, and a tile passes on a spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupscan.llm.common import connected_components, files_for, local_components, scratch, word_chunks

#: Fingerprints link at this many differing bits or fewer.
MAX_BITS = 3
#: Number of reference fingerprints.
PIVOTS = 16
#: Rows of a bucket that are compared in one task.
TILE = 2048


def _walsh(n: int) -> np.ndarray:
    """n balanced, mutually uncorrelated 64-bit patterns."""
    rows = [1, 2, 4, 8, 16, 32, 63, 21, 42, 51, 12, 27, 45, 54, 7, 56, 35, 28, 14, 49, 11, 22, 44, 25]
    return np.array([sum((bin(r & j).count("1") & 1) << j for j in range(64)) for r in rows[:n]], np.uint64)


REFERENCES = _walsh(PIVOTS)


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash, signed, of the word shingles of a text (A-Z lower-cased); 0 if it has no words.

    Shingles are counted with repeats and hashed with XXH64 (seed 42); a bit is set if it is set in over half of them. A
    text of fewer words than width is one shingle.
    """
    from xxhash import xxh64_intdigest

    ones, n, last = np.zeros(64, np.int64), 0, []
    for words in word_chunks((text or "").encode().lower()):
        words = last + words
        if len(words) >= width:
            h = np.fromiter(map(xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)), repeat(42)), np.uint64)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(h)
        last = words[-(width - 1) :] if width > 1 else []
    if not n and last:
        h = np.array([xxh64_intdigest(b" ".join(last), 42)], np.uint64)
        ones, n = np.unpackbits(h.view(np.uint8), bitorder="little").astype(np.int64), 1
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(x.as_py()) for x in texts], pa.int64())


def simhash64(text: Column | str) -> Column:
    """The fingerprint of a text column, as a long; a null text counts as empty."""
    return F.arrow_udf(_fingerprints, "bigint")(text)


def hex64(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def block_masks(k: int) -> list[int]:
    """Signed masks of every choice of k - MAX_BITS of k blocks."""
    edges = [64 * i // k for i in range(k + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(blocks, k - MAX_BITS))]


def blocks_for(n: int) -> int:
    """Blocks such that n distinct fingerprints share a key with a handful of others on average."""
    for k in range(MAX_BITS + 1, 17):
        if n <= 4 << (64 * (k - MAX_BITS) // k):
            return k
    return 17


def _survivors(fp: np.ndarray, i: np.ndarray, j: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of candidate pairs, those that no pivot discards and whose distance is within the limit."""
    for p in range(PIVOTS):
        keep = np.abs(table[p, i] - table[p, j]) <= MAX_BITS
        i, j = i[keep], j[keep]
    keep = np.bitwise_count(fp[i] ^ fp[j]) <= MAX_BITS
    return i[keep], j[keep]


def linked(fp: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions i, j) among fingerprints of the same group; equal groups must be adjacent."""
    table = np.stack([np.bitwise_count(fp ^ p).astype(np.int8) for p in REFERENCES])
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(fp)])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    # small groups together: row against the row s places below it
    small = np.repeat(sizes <= 64, sizes)
    rank_end = np.repeat(starts + sizes, sizes)
    at = np.flatnonzero(small)
    s = 1
    while len(at):
        at = at[at + s < rank_end[at]]
        out.append(_survivors(fp, at, at + s, table))
        s += 1
    for a, n in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        for r in range(a, a + n, 256):
            rows = np.arange(r, min(r + 256, a + n))
            near = np.abs(table[0, rows][:, None] - table[0, a : a + n][None]) <= MAX_BITS
            near &= np.abs(table[1, rows][:, None] - table[1, a : a + n][None]) <= MAX_BITS
            i, j = np.nonzero(near)
            i, j = i + r, j + a
            keep = i < j
            out.append(_survivors(fp, i[keep], j[keep], table))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (at, at)


def _forest(fp: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
    """Spanning links of the rows: each linked fingerprint with the first of its local component."""
    i, j = linked(fp.view(np.uint64), group)
    ends, inverse = np.unique(np.concatenate([fp[i], fp[j]]), return_inverse=True)
    label = local_components(inverse[: len(i)], inverse[len(i) :], len(ends))
    far = label != np.arange(len(ends))
    return pa.RecordBatch.from_arrays([pa.array(ends[far]), pa.array(ends[label[far]])], ["a", "b"])


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their group, which batches may cut; a group is complete before it is compared."""
    rest_fp, rest_g = np.empty(0, np.int64), np.empty((0, 4), np.int64)
    for batch in batches:
        fp = np.concatenate([rest_fp, batch.column("fp").to_numpy()])
        g = np.concatenate([rest_g, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("t", "key", "low", "high")], 1)])
        if not len(fp):
            continue
        new = np.r_[True, (g[1:] != g[:-1]).any(1)]
        cut = np.flatnonzero(new)[-1]
        if cut:
            yield _forest(fp[:cut], np.cumsum(new[:cut]))
        rest_fp, rest_g = fp[cut:], g[cut:]
    if len(rest_fp):
        yield _forest(rest_fp, np.zeros(len(rest_fp), np.int64))


def hamming_links(distinct: DataFrame, fp: str = "fp", n: int | None = None) -> DataFrame:
    """(a, b): links that span every component of distinct fingerprints at MAX_BITS bits or fewer."""
    n = distinct.count() if n is None else n
    masks = block_masks(blocks_for(n))
    keys = F.array(*[F.struct(F.lit(t).cast("short").alias("t"), F.col(fp).bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(masks)])
    rows = distinct.select(F.col(fp).alias("fp"), F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    tiles = F.ceil(F.col("count") / TILE).cast("int")
    full = scratch(rows.groupBy("t", "key").count().where("count > 1").select("t", "key", tiles.alias("tiles")), "buckets", files_for(distinct.sparkSession, n * len(masks) // 2))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    met = rows.join(full, ["t", "key"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    group = ["t", "key", "low", "high"]
    met = met.select("t", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    return met.repartition(*group).sortWithinPartitions(*group).mapInArrow(_bucket_links, "a bigint, b bigint")


def components(marked: DataFrame) -> DataFrame:
    """(fp, component_id) of fingerprints as of near_duplicates; marked: rows (doc_id, fp), fp the fingerprint."""
    spark = marked.sparkSession
    distinct = scratch(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct", files_for(spark, marked.count()))
    n = distinct.count()
    files, links = files_for(spark, n), n * len(block_masks(blocks_for(n)))
    parts = scratch(connected_components(hamming_links(distinct, n=n), rows=links).select(F.col("node").alias("fp"), "component"), "parts", files)
    firsts = scratch(distinct.join(parts, "fp").groupBy("component").agg(F.min("first").alias("lowest")), "firsts", files)
    named = parts.join(firsts, "component").select("fp", "lowest")
    return scratch(distinct.join(named, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id")), "labels", files)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (id, fp, component_id).

    component_id is the smallest non-null id of the documents that can be reached over links, the row itself
    included (null where all of them are null). Null texts count as empty; texts without words have fingerprint 0
    and are linked like any other; repeated rows are kept, each with the same result. Other columns of docs are not
    read. An empty table gives an empty result.
    """
    marked = scratch(docs.select(F.col(id_col).alias("doc_id"), simhash64(F.col(text_col)).alias("fp")), "fp")
    out = marked.join(components(marked), "fp")
    return out.select(F.col("doc_id").alias(id_col), "fp", "component_id")
