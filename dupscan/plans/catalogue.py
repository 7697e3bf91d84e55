"""The queries of the driver, by name, with their SQL.

The driver's tables hold no images. embeddings (64 numbers a row) are 8 x 8 tensors of one channel, their label the folder;
planted adds to each turned and shifted copies under ids of their own. documents give exact copies (equal texts), with
source as folder and paths made of their ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dupscan.functions import tensors
from dupscan.operators import grouping, matching, stats
from dupscan.sources import listing

PX = 8
#: Distance of the ids of planted copies.
STEP = 10_000_000
#: Thresholds that a fraction of the pairs of random tensors meets.
WRAPPED, TURNED, TRUE = 63.75, 66.0, 330.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- tables

_T = "t AS (SELECT vec_id AS id, label AS grp, list_transform(embedding, lambda x: greatest(0, least(255, CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS INTEGER)))) AS t FROM embeddings)"
_ROT90 = "list_transform(range(64), lambda i: {t}[1 + (i % 8) * 8 + 7 - i // 8])"
_ROT180 = "list_transform(range(64), lambda i: {t}[64 - i])"
_ROT270 = "list_transform(range(64), lambda i: {t}[1 + (7 - i % 8) * 8 + i // 8])"
_VARIANTS = ["t", _ROT90.format(t="t"), _ROT180.format(t="t"), _ROT270.format(t="t"), "list_transform(t, lambda x: (x + 16) % 256)", "list_transform(t, lambda x: (x + 1) % 256)"]
_P = f"{_T}, p AS (" + " UNION ALL ".join(f"SELECT id + {STEP * k} AS id, grp, {v} AS t FROM t" for k, v in enumerate(_VARIANTS)) + ")"
_MSE = "CAST(list_sum(list_transform(range(1, 65), lambda i: (({a}[i] - {b}[i]) * ({a}[i] - {b}[i])) % 256)) AS DOUBLE) / 64"
_MSE_TRUE = "CAST(list_sum(list_transform(range(1, 65), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))) AS DOUBLE) / 64"
_LEAST = f"least({_MSE.format(a='{a}', b='{b}')}, {_MSE.format(a='{a}', b='{b}90')}, {_MSE.format(a='{a}', b='{b}180')})"
_R = "r AS (SELECT id, grp, t, {r90} AS t90, {r180} AS t180 FROM {of})".format(r90=_ROT90.format(t="t"), r180=_ROT180.format(t="t"), of="{of}")
_NIBBLES = "list_transform({t}, lambda x: x % 16)"
_D = "d AS (SELECT doc_id AS id, source AS grp, text, n_chars, source || '/doc_' || doc_id || '.' || CASE doc_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'JPG' WHEN 2 THEN 'txt' WHEN 3 THEN 'jpeg' ELSE 'pdf' END AS path FROM documents)"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, grp, t array<int>)."""
    rows = _read(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("grp"), tensors.quantised(F.col("embedding")).alias("t"))


def planted(rows: DataFrame) -> DataFrame:
    """Tensors with five variants of each: turned by 90, 180 and 270 degrees, plus 16, plus 1 (modulo 256)."""
    t = F.col("t")
    shifted = lambda by: F.transform(t, lambda x: (x + by) % 256)
    variants = [t, *(tensors.turned(t, PX, 1, k) for k in (1, 2, 3)), shifted(16), shifted(1)]
    each = F.explode(F.array(*[F.struct((F.col("id") + STEP * k).alias("id"), v.alias("t")) for k, v in enumerate(variants)]))
    return rows.select("grp", each.alias("v")).select("v.id", "grp", "v.t")


def as_images(rows: DataFrame, in_folder: bool = False) -> DataFrame:
    """Tensors as a collection of images of one size."""
    group = F.col("grp") if in_folder else F.lit(0)
    return rows.select(F.col("id").alias("file_id"), group.cast("int").alias("group_id"), F.concat(F.lit("img_"), F.col("id")).alias("path"), F.lit(PX).alias("width"), F.lit(PX).alias("height"), tensors.packed(F.col("t")).alias("tensor"), tensors.array_sum(F.col("t")).alias("px_sum"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, grp, text, n_chars, path)."""
    ext = F.element_at(F.array(*map(F.lit, ("png", "JPG", "txt", "jpeg", "pdf"))), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id"), F.lit("."), ext)
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("grp"), "text", "n_chars", path.alias("path"))


def document_images(docs: DataFrame) -> DataFrame:
    """Documents as images: width + height stands for n_chars, the source is the folder."""
    return docs.select(F.col("id").alias("file_id"), F.col("grp").alias("group_id"), "path", F.col("n_chars").alias("width"), F.lit(0).alias("height"))


def document_owners(docs: DataFrame, in_folder: bool = False) -> DataFrame:
    group = F.col("grp") if in_folder else F.lit("")
    keyed = docs.select(F.col("id").alias("file_id"), group.alias("group_id"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("turn"), F.col("text").alias("key"))
    return matching.owners_by_key(keyed)


# ---- tensors


@query(f"WITH {_T} SELECT id, CAST(list_sum(t) AS BIGINT) AS px_sum, list_min(t) AS px_min, list_max(t) AS px_max FROM t")
def tensor_build(spark, sf_dir):
    rows = embedding_tensors(spark, sf_dir)
    return rows.select("id", tensors.array_sum(F.col("t")).alias("px_sum"), F.array_min("t").alias("px_min"), F.array_max("t").alias("px_max"))


@query(f"WITH {_T}, r AS (SELECT id, {_ROT90.format(t='t')} AS u FROM t) SELECT id, CAST(list_sum(list_transform(range(64), lambda i: i * u[i + 1])) AS BIGINT) AS checksum FROM r")
def tensor_rot90_checksum(spark, sf_dir):
    rows = embedding_tensors(spark, sf_dir).select("id", tensors.turned(F.col("t"), PX).alias("u"))
    return rows.select("id", tensors.array_sum(F.transform("u", lambda x, i: x * i)).alias("checksum"))


def _png(width: int, rows: bytes) -> bytes:
    """An 8-bit grey PNG of the rows."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + rows[i : i + width] for i in range(0, len(rows), width))
    head = struct.pack(">IIBBBBB", width, len(rows) // width, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@query(f"WITH {_T} SELECT id, CAST(3 * list_sum(t) AS BIGINT) AS px_sum, 8 AS width, 8 AS height FROM t")
def png_roundtrip(spark, sf_dir):
    """Every tensor as a grey PNG file's bytes, decoded again to RGB."""
    from dupscan.sources.decode import decode_image, to_tensor

    def back(raw: pa.Array) -> pa.Array:
        found = [to_tensor(decode_image(_png(PX, x.as_py())), PX) for x in raw]
        return pa.array([{"width": w, "height": h, "px_sum": s} for w, h, _, s in found], pa.struct([("width", pa.int32()), ("height", pa.int32()), ("px_sum", pa.int64())]))

    kind = "struct<width: int, height: int, px_sum: bigint>"
    rows = embedding_tensors(spark, sf_dir).select("id", F.arrow_udf(back, kind)(tensors.packed(F.col("t"))).alias("v"))
    return rows.select("id", "v.px_sum", "v.width", "v.height")


# ---- pairs


@query("SELECT CAST(count(*) AS BIGINT) AS pairs FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id")
def pair_count_union(spark, sf_dir):
    n = F.count("*")
    return _read(spark, sf_dir, "embeddings").agg(F.expr("count(*) * (count(*) - 1) div 2").alias("pairs"), n.alias("n")).select("pairs")


@query("SELECT a.label AS grp, CAST(count(*) AS BIGINT) AS pairs FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1")
def pair_count_in_folder(spark, sf_dir):
    per = _read(spark, sf_dir, "embeddings").where("label is not null").groupBy(F.col("label").alias("grp")).agg(F.expr("count(*) * (count(*) - 1) div 2").alias("pairs"))
    return per.where("pairs > 0")


@query(f"WITH {_T} SELECT id_a, id_b, mse FROM (SELECT a.id AS id_a, b.id AS id_b, {_MSE.format(a='a.t', b='b.t')} AS mse FROM t a JOIN t b ON a.id < b.id) WHERE mse <= {WRAPPED}")
def mse_wrapped_pairs(spark, sf_dir):
    return matching.tile_pairs(as_images(embedding_tensors(spark, sf_dir)), WRAPPED, (0,))


@query(f"WITH {_T}, {_R.format(of='t')} SELECT id_a, id_b, mse FROM (SELECT a.id AS id_a, b.id AS id_b, {_LEAST.format(a='a.t', b='b.t')} AS mse FROM t a JOIN r b ON a.id < b.id) WHERE mse <= {WRAPPED}")
def mse_rotate_pairs(spark, sf_dir):
    return matching.tile_pairs(as_images(embedding_tensors(spark, sf_dir)), WRAPPED)


@query(f"WITH {_T} SELECT id_a, id_b, mse FROM (SELECT a.id AS id_a, b.id AS id_b, {_MSE_TRUE.format(a='a.t', b='b.t')} AS mse FROM t a JOIN t b ON a.id < b.id) WHERE mse <= {TRUE}")
def mse_true_pairs(spark, sf_dir):
    return matching.tile_pairs(as_images(embedding_tensors(spark, sf_dir)), TRUE, (0,), metric="exact")


def _wrapped(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: ((x - y) * (x - y)) % 256), F.lit(0).cast("long"), lambda s, x: s + x) / F.lit(float(PX * PX))


@query(
    f"WITH {_T}, q AS (SELECT id, t, {_ROT90.format(t='t')} AS u FROM t), v AS (SELECT id, t, u, {_ROT90.format(t='u')} AS u90, {_ROT180.format(t='u')} AS u180, "
    f"{_ROT90.format(t='t')} AS t90, {_ROT180.format(t='t')} AS t180 FROM q) SELECT id, {_LEAST.format(a='t', b='u')} AS mse_ab, {_LEAST.format(a='u', b='t')} AS mse_ba FROM v"
)
def mse_rotate_asymmetry(spark, sf_dir):
    """A tensor against its quarter turn, and the other way round: only the second finds it."""
    rows = embedding_tensors(spark, sf_dir).select("id", "t", tensors.turned(F.col("t"), PX).alias("u"))
    turns = lambda c: [tensors.turned(F.col(c), PX, 1, k) for k in matching.TURNS]
    best = lambda a, b: F.least(*[_wrapped(F.col(a), x) for x in turns(b)])
    return rows.select("id", best("t", "u").alias("mse_ab"), best("u", "t").alias("mse_ba"))


@query(
    "WITH d AS (SELECT doc_id AS id, 100 + doc_id % 7 AS w, 100 + n_chars % 5 AS h FROM documents), k AS (SELECT id, least(w, h) AS lo, greatest(w, h) AS hi FROM d) "
    "SELECT CAST(a.lo AS INTEGER) AS lo, CAST(a.hi AS INTEGER) AS hi, CAST(count(*) AS BIGINT) AS pairs FROM k a JOIN k b ON a.lo = b.lo AND a.hi = b.hi AND a.id < b.id GROUP BY 1, 2"
)
def same_dim_gate(spark, sf_dir):
    """Pairs that share their dimensions in either order, by the buckets that searches compare within."""
    w, h = 100 + F.col("doc_id") % 7, 100 + F.col("n_chars") % 5
    rows = _read(spark, sf_dir, "documents").where("doc_id is not null and n_chars is not null")
    images = rows.select(F.col("doc_id").alias("file_id"), F.lit(0).alias("group_id"), w.alias("width"), h.alias("height"), F.lit(b"").alias("tensor"), F.lit(0).alias("px_sum"))
    return matching.bucketed(images, same_dim=True).groupBy("lo", "hi").agg(F.expr("count(*) * (count(*) - 1) div 2").alias("pairs")).where("pairs > 0")


# ---- exact matches


def _exact_sql(of: str, turns: int, folder: bool) -> str:
    keys = " UNION ALL ".join(f"SELECT id, grp, {_NIBBLES.format(t=c)} AS k FROM r" for c in ("t", "t90", "t180")[:turns])
    same = "AND a.grp = b.grp" if folder else ""
    return f"WITH {_P}, {_R.format(of=of)}, k AS ({keys}) SELECT min(a.id) AS id_a, b.id AS id_b, CAST(0 AS DOUBLE) AS mse FROM k b JOIN (SELECT id, grp, {_NIBBLES.format(t='t')} AS k FROM r) a ON a.k = b.k AND a.id < b.id {same} GROUP BY b.id"


@query(_exact_sql("p", 1, False))
def exact_dups_mod16(spark, sf_dir):
    return matching.owners(as_images(planted(embedding_tensors(spark, sf_dir))), 0, rotate=False)


@query(_exact_sql("p", 3, False))
def exact_dups_rotated(spark, sf_dir):
    return matching.owners(as_images(planted(embedding_tensors(spark, sf_dir))), 0)


@query(_exact_sql("p", 3, True))
def exact_dups_in_folder(spark, sf_dir):
    return matching.owners(as_images(planted(embedding_tensors(spark, sf_dir)), in_folder=True), 0)


# ---- the algorithm by pixel sums

_SUMS = f"WITH {_P}, s AS (SELECT id, t, CAST(list_sum(t) AS BIGINT) AS px_sum FROM p)"


@query(f"{_SUMS} SELECT a.px_sum, CAST(count(*) AS BIGINT) AS pairs FROM s a JOIN s b ON a.px_sum = b.px_sum AND a.id < b.id GROUP BY 1")
def sum_bucket_pairs(spark, sf_dir):
    rows = as_images(planted(embedding_tensors(spark, sf_dir)))
    return rows.groupBy("px_sum").agg(F.expr("count(*) * (count(*) - 1) div 2").alias("pairs")).where("pairs > 0")


@query(
    f"{_SUMS}, o AS (SELECT min(a.id) AS id_a, b.id AS id_b FROM s a JOIN s b ON a.px_sum = b.px_sum AND a.id < b.id GROUP BY b.id), {_R.format(of='p')} "
    f"SELECT o.id_a, o.id_b FROM o JOIN r a ON a.id = o.id_a JOIN r b ON b.id = o.id_b WHERE {_LEAST.format(a='a.t', b='b.t')} > 0"
)
def sum_bucket_false_positives(spark, sf_dir):
    """Matches by pixel sums of tensors that differ at all three turns."""
    images = as_images(planted(embedding_tensors(spark, sf_dir)))
    keyed = matching.exact_keys(images)
    own = matching.owners(images, 0, algorithm="sum_bucket").select("id_a", "id_b")
    first = keyed.where("turn = 0").select(F.col("file_id").alias("id_a"), F.col("key").alias("key_a"))
    later = keyed.groupBy(F.col("file_id").alias("id_b")).agg(F.collect_list("key").alias("keys"))  # three keys a row
    met = own.join(first, "id_a").join(later, "id_b")
    return met.where(~F.array_contains("keys", F.col("key_a"))).select("id_a", "id_b")


@query(f"{_SUMS} SELECT min(a.id) AS id_a, b.id AS id_b, CAST(0 AS DOUBLE) AS mse FROM s a JOIN s b ON a.px_sum = b.px_sum AND a.id < b.id WHERE b.id < (SELECT max(id) FROM s) GROUP BY b.id")
def sum_bucket_last_id(spark, sf_dir):
    return matching.owners(as_images(planted(embedding_tensors(spark, sf_dir))), 0, algorithm="sum_bucket", compat_batch=True)


@query(
    f"WITH {_T}, s AS (SELECT id, t, CAST(list_sum(t) AS BIGINT) AS px_sum FROM t), {_R.format(of='t')}, m AS (SELECT a.id AS id_a, b.id AS id_b, "
    f"CASE WHEN a.px_sum = (SELECT px_sum FROM s WHERE s.id = b.id) THEN 0 ELSE {_LEAST.format(a='a.t', b='b.t')} END AS mse FROM s a JOIN r b ON a.id < b.id) "
    f"SELECT min(id_a) AS id_a, id_b, CAST(arg_min(mse, id_a) AS DOUBLE) AS mse FROM m WHERE mse <= {TURNED} GROUP BY id_b"
)
def sum_bucket_similar(spark, sf_dir):
    """The algorithm by pixel sums above threshold 0: equal sums match whatever the pixels, others by their error."""
    return matching.owners(as_images(embedding_tensors(spark, sf_dir)), TURNED, algorithm="sum_bucket")


# ---- groups


def _greedy_sql(folder: bool) -> str:
    same = "AND a.grp = b.grp" if folder else ""
    return (
        f"WITH {_T}, {_R.format(of='t')}, m AS (SELECT a.id AS id_a, b.id AS id_b, {_LEAST.format(a='a.t', b='b.t')} AS mse FROM t a JOIN r b ON a.id < b.id {same}) "
        f"SELECT min(id_a) AS id_a, id_b, arg_min(mse, id_a) AS mse FROM m WHERE mse <= {TURNED} GROUP BY id_b"
    )


@query(_greedy_sql(False))
def greedy_groups(spark, sf_dir):
    return matching.owners(as_images(embedding_tensors(spark, sf_dir)), TURNED)


@query(_greedy_sql(True))
def greedy_groups_in_folder(spark, sf_dir):
    return matching.owners(as_images(embedding_tensors(spark, sf_dir), in_folder=True), TURNED)


def _owned_docs_sql(folder: bool) -> str:
    same = "AND a.grp = b.grp" if folder else ""
    return f"WITH {_D}, o AS (SELECT min(a.id) AS id_a, b.id AS id_b FROM d a JOIN d b ON a.text = b.text AND a.id < b.id {same} GROUP BY b.id)"


def _worse_sql(folder: bool) -> str:
    return (
        f"{_owned_docs_sql(folder)}, m AS (SELECT id_a, id_b AS id FROM o UNION SELECT id_a, id_a FROM o), "
        "k AS (SELECT path, row_number() OVER (PARTITION BY id_a ORDER BY n_chars DESC, path DESC) AS rn FROM m JOIN d USING (id)) SELECT DISTINCT path FROM k WHERE rn > 1"
    )


@query(_worse_sql(False))
def lower_quality(spark, sf_dir):
    docs = document_files(spark, sf_dir)
    return grouping.lower_quality(document_owners(docs), document_images(docs))


@query(_worse_sql(True))
def lower_quality_in_folder(spark, sf_dir):
    docs = document_files(spark, sf_dir)
    return grouping.lower_quality(document_owners(docs, True), document_images(docs))


@query(
    f"{_owned_docs_sql(True)}, f AS (SELECT grp, arg_min(path, id) AS first FROM d GROUP BY grp) "
    "SELECT regexp_replace(f.first, '/[^/]*$', '') AS folder, o.id_a, a.path AS path_a, o.id_b, b.path AS path_b FROM o JOIN d a ON a.id = o.id_a JOIN d b ON b.id = o.id_b JOIN f ON f.grp = a.grp"
)
def named_groups_in_folder(spark, sf_dir):
    docs = document_files(spark, sf_dir)
    images = document_images(docs).withColumn("tensor", F.lit(b""))
    return grouping.named_groups(document_owners(docs, True), images, in_folder=True).drop("mse")


@query(f"WITH {_D}, f AS (SELECT grp, arg_min(path, id) AS first FROM d GROUP BY grp) SELECT grp AS group_id, regexp_replace(first, '/[^/]*$', '') AS folder FROM f")
def folder_label(spark, sf_dir):
    return grouping.folder_labels(document_images(document_files(spark, sf_dir)).withColumn("tensor", F.lit(b"")))


_NESTED = "to_json(list(struct_pack(path := b.path, mse := 0.0::DOUBLE) ORDER BY o.id_b))::VARCHAR AS matches FROM o JOIN d a ON a.id = o.id_a JOIN d b ON b.id = o.id_b"


@query(f"{_owned_docs_sql(False)} SELECT o.id_a, a.path AS path_a, {_NESTED} GROUP BY o.id_a, a.path")
def result_nested_json(spark, sf_dir):
    docs = document_files(spark, sf_dir)
    return grouping.nested_json(grouping.named_groups(document_owners(docs), document_images(docs))).drop("folder")


@query(
    f"{_owned_docs_sql(True)}, f AS (SELECT grp, regexp_replace(arg_min(path, id), '/[^/]*$', '') AS folder FROM d GROUP BY grp) "
    f"SELECT f.folder, o.id_a, a.path AS path_a, {_NESTED} JOIN f ON f.grp = a.grp GROUP BY f.folder, o.id_a, a.path"
)
def result_nested_json_in_folder(spark, sf_dir):
    docs = document_files(spark, sf_dir)
    images = document_images(docs).withColumn("tensor", F.lit(b""))
    return grouping.nested_json(grouping.named_groups(document_owners(docs, True), images, in_folder=True))


@query(
    f"WITH {_T}, {_R.format(of='t')}, m AS (SELECT a.id AS id_a, b.id AS id_b, {_LEAST.format(a='a.t', b='b.t')} AS mse FROM t a JOIN r b ON a.id < b.id), "
    f"o AS (SELECT id_b, arg_min(mse, id_a) AS mse FROM m WHERE mse <= {TURNED} GROUP BY id_b) SELECT CAST(count(*) FILTER (mse = 0) AS BIGINT) AS duplicates, CAST(count(*) FILTER (mse > 0) AS BIGINT) AS similar FROM o"
)
def match_counts(spark, sf_dir):
    return grouping.counts(matching.owners(as_images(embedding_tensors(spark, sf_dir)), TURNED), TURNED)


@query(_exact_sql("p", 3, False).replace("SELECT min(a.id) AS id_a, b.id AS id_b", "SELECT (SELECT count(*) FROM p) AS files_searched, CAST(count(DISTINCT b.id) AS BIGINT) AS duplicates, CAST(0 AS BIGINT) AS similar").replace(", CAST(0 AS DOUBLE) AS mse FROM", " FROM").replace(" GROUP BY b.id", ""))
def search_stats(spark, sf_dir):
    images = as_images(planted(embedding_tensors(spark, sf_dir)))
    found = grouping.counts(matching.owners(images, 0), 0)
    return images.agg(F.count("*").alias("files_searched")).crossJoin(found)  # one row each


# ---- files

_IS_IMAGE = "regexp_replace(lower(path), '^.*\\.', '') IN (" + ", ".join(f"'{x}'" for x in listing.EXTENSIONS) + ")"


@query(f"WITH {_D} SELECT path, regexp_replace(lower(path), '^.*\\.', '') AS ext FROM d WHERE {_IS_IMAGE}")
def extension_filter(spark, sf_dir):
    return document_files(spark, sf_dir).where(listing.is_image(F.col("path"))).select("path", listing.extension(F.col("path")).alias("ext"))


@query(f"WITH {_D} SELECT DISTINCT path, '{listing.UNSUPPORTED}' AS reason FROM d WHERE NOT ({_IS_IMAGE})")
def skipped_files(spark, sf_dir):
    return document_files(spark, sf_dir).where(~listing.is_image(F.col("path"))).select("path", F.lit(listing.UNSUPPORTED).alias("reason")).distinct()


@query(f"WITH {_D} SELECT CAST(count(*) AS BIGINT) AS total_files, CAST(count(*) FILTER (NOT ({_IS_IMAGE})) AS BIGINT) AS invalid_count FROM d")
def build_stats(spark, sf_dir):
    docs = document_files(spark, sf_dir).select("path")
    images = docs.where(listing.is_image(F.col("path"))).withColumn("tensor", F.lit(b""))
    return stats.build_counts(images, skipped_files(spark, sf_dir))


@query(f"WITH {_D} SELECT path, CAST(row_number() OVER (ORDER BY path, id) - 1 AS BIGINT) AS file_id FROM d WHERE {_IS_IMAGE}")
def file_numbering(spark, sf_dir):
    rows = document_files(spark, sf_dir).where(listing.is_image(F.col("path"))).select("path", "id")
    return listing.numbered(rows, "path", "id").select("path", "file_id")
