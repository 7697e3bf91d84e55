"""Quality rules by the hashed n-gram log-likelihood ratio of trusted text and raw corpus, in SQL functions only.

Tokens are the runs of letters, digits and underscores and the runs of other visible characters of the lower-cased
text. Unigrams and bigrams are hashed into BUCKETS; two multinomials over the buckets, one of trusted documents and
one of all, are counted over the whole corpus (each task sums its own, so at most BUCKETS rows a task are shuffled).
A document's verdict is the mean, over its n-grams, of the log-ratio of the two: at least THRESHOLD is kept.

Scoring is narrow: the ratios, BUCKETS numbers, are a constant of the plan, and every document is judged where it lies.
"""

from __future__ import annotations

import json
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dupscan.llm.common import words_column

#: Hash buckets of the two multinomials.
BUCKETS = 10_000
#: Added to the count of every bucket, in units of its share if all were alike.
SMOOTHING = 1.0
#: Mean log-ratio from which a document is kept.
THRESHOLD = -0.25
#: Trusted ids up to which they are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Words of a window of the repetition rule.
WINDOW = 8
_TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+"


def _pmod(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def token_hashes(text: Column) -> Column:
    """array<bigint>: the hashed tokens of a text."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_TOKEN), F.lit(0))
    return F.transform(tokens, lambda t: F.xxhash64(t))


def ngram_buckets(h: Column) -> Column:
    """array<int>: buckets of the unigrams and bigrams of hashed tokens (the last one's partner is nothing)."""
    pairs = F.zip_with(h, F.slice(h, F.lit(2), F.greatest(F.size(h), F.lit(1))), lambda a, b: _pmod(F.xxhash64(a, b)))
    return F.concat(F.transform(h, _pmod), pairs)


def fit(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """Log-ratio of each bucket, trusted documents (their ids are in trusted) against all documents.

    Without any trusted text every ratio is 0. Null ids are never trusted.
    """
    ids = trusted.select(F.col(id_col).alias("trusted_id")).where("trusted_id is not null").distinct()
    if trusted.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(ids, F.col("doc_id") == F.col("trusted_id"), "left")
    rows = rows.select(F.col("trusted_id").isNotNull().alias("good"), token_hashes(F.col("text")).alias("h"))
    rows = rows.select("good", F.explode(ngram_buckets(F.col("h"))).alias("bucket"))
    found = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("good").alias("good")).collect()
    raw, good = [0] * BUCKETS, [0] * BUCKETS
    for r in found:
        raw[r.bucket], good[r.bucket] = r.n, r.good
    n, m = sum(raw), sum(good)
    if not m:
        return [0.0] * BUCKETS
    # the smoothing mass is spread as the raw corpus is, so a bucket without evidence has ratio 0
    return [log(((g + SMOOTHING * (r + 1) * BUCKETS / (n + BUCKETS)) / (m + SMOOTHING * BUCKETS)) / ((r + 1) / (n + BUCKETS))) for r, g in zip(raw, good, strict=True)]


def mean_ratio(hashes: Column, ratios: list[float]) -> Column:
    """Mean log-ratio over the n-grams of a text whose token hashes are given; 0 if there are none."""
    table = F.from_json(F.lit(json.dumps([round(x, 4) for x in ratios])), "array<double>")
    total = F.aggregate(ngram_buckets(hashes), F.lit(0.0), lambda s, x: s + F.get(table, x))
    return F.when(F.size(hashes) > 0, total / (2 * F.size(hashes))).otherwise(F.lit(0.0))


def _covered(starts: Column) -> Column:
    """Words in the union of the windows that begin at the sorted positions."""
    first = F.struct(F.lit(-WINDOW).cast("int").alias("at"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(x.alias("at"), (s["n"] + F.least(F.lit(WINDOW), x - s["at"])).cast("long").alias("n"))
    return F.aggregate(starts, first, step, lambda s: s["n"])


def base_columns(text: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """Two projections, the second over the columns of the first: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    plain = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(plain, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = {"_words": words_column(text), "_lines": lines, "n_symbols": F.regexp_count(plain, F.lit(r"[#*$%&|<>]")).cast("long")}
    h = F.transform("_words", lambda w: F.xxhash64(w))
    return first, {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.col("n_symbols"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_h": h,
    }


def repeat_words(h: Column) -> tuple[Column, Column]:
    """(window hashes, f): f of the window hashes' column is the number of words in repeated windows."""
    windows = F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>"))

    def count(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        near = F.zip_with(ordered, F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), ordered), lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), b["h"].alias("p")))
        near = F.zip_with(near, F.slice(ordered, F.lit(2), F.size(ordered)), lambda a, b: F.struct(a["i"].alias("i"), (F.coalesce(a["h"] == a["p"], F.lit(False)) | F.coalesce(a["h"] == b["h"], F.lit(False))).alias("twice")))
        starts = F.array_sort(F.transform(F.filter(near, lambda x: x["twice"] & x["i"].isNotNull()), lambda x: x["i"]))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_covered(starts))

    return windows, count


def judge(docs: DataFrame, ratios: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_ratio and kept.

    base_failed: under 20 words, or over 30 % of them in repeated windows. kept: not base_failed, and log_ratio at least
    threshold. Null and empty texts have no words and fail. Rows are judged one by one: repeated rows alike, ties at the
    threshold kept; columns of docs of these names are replaced.
    """
    new = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ratio", "kept"}
    old = [c for c in docs.columns if c not in new]
    first, second = base_columns(F.col(text_col))
    rows = docs.select(*old, *(c.alias(k) for k, c in first.items()), token_hashes(F.col(text_col)).alias("_t"))
    rows = rows.select(*old, *(c.alias(k) for k, c in second.items()), mean_ratio(F.col("_t"), ratios).alias("log_ratio"))
    windows, count = repeat_words(F.col("_h"))
    rows = rows.withColumn("_w", windows).withColumn("n_repeat_words", count(F.col("_w")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold))
    return rows.select(*old, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ratio", "kept")


def kept_rows(judged: DataFrame) -> DataFrame:
    """The rows of judge that are kept, without its columns.

    The optimizer would copy the rules into a filter below them, once for each use of a column; it does not move a filter
    past a number that depends on where a row is.
    """
    rows = judged.withColumn("_place", F.monotonically_increasing_id())
    return rows.where(F.col("kept") & (F.col("_place") >= 0)).drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ratio", "kept", "_place")
