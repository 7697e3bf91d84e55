"""A training-data pipeline: quality rules, near-duplicates, repeated passages, mixing, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupscan.llm import bpe, mixing, passages, q_bpe, q_quality, quality, simhash
from dupscan.llm.common import scratch

#: What every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(rows: DataFrame) -> DataFrame:
    return rows.select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the quality rules; trusted ones are those that labels marks as good.

    Null and empty texts fail the rules and go. Rows are judged one by one, so repeated rows stay or go together, and
    documents at the threshold stay. Other columns of docs are not read. An empty table gives an empty one.
    """
    docs = _documents(docs)
    ratios = quality.fit(docs, q_quality.trusted(spark, sf_dir))
    return _documents(quality.kept_rows(quality.judge(docs, ratios)))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    Null texts count as empty ones, which are alike. Rows without an id stay; where rows share an id, one stays for each
    fingerprint that leads its group under that id, whichever of them it is. Other columns of docs are not read. An empty table
    gives an empty one. Texts are read once: they are written with their fingerprints.
    """
    docs = _documents(docs)
    marked = scratch(docs.where("doc_id is not null").withColumn("fp", simhash.simhash64(F.col("text"))), "marked")
    kept = simhash.components(marked.select("doc_id", "fp")).select(F.col("fp").alias("_first"), F.col("component_id").alias("_id"))
    found = marked.join(kept, (F.col("doc_id") == F.col("_id")) & (F.col("fp") == F.col("_first"))).dropDuplicates(["doc_id", "fp"])
    return _documents(found).unionByName(docs.where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that other documents have first; those of which no word is left go.

    n_chars is counted anew where words went. Null and empty texts have no passages and stay as they are. Rows that agree in id and
    text are one document and are cut alike. Other columns of docs are not read. An empty table gives an empty one.
    """
    docs = _documents(docs)
    cut = passages.cut_passages(docs, passages.find_passages(docs))
    cut = cut.withColumn("n_chars", F.when(F.col("cut_words") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return _documents(cut.where((F.col("cut_words") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them.

    Null and empty texts have no words and are never taken. A null source is a source of its own, null ids are ids like others.
    Rows that agree in id, source and size are one unit of the rounding and are taken alike. Other columns of docs are not
    read. An empty table gives an empty one.
    """
    docs = _documents(docs)
    counted = mixing.mix(docs).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies")).where("copies > 0")
    counted = counted.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "copies")
    sized = docs.withColumn("_words", mixing.count_words(F.col("text")))
    taken = sized.join(counted, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_words") == F.col("_size")))
    return _documents(taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens, ids_sha256, decoded_sha256): token ids of every document, digests of them and of the bytes they decode to.

    Null and empty texts have no ids. Repeated rows are encoded as often as they occur. Other columns of docs are not read. An
    empty table gives an empty one.
    """
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(q_bpe.RANKS), public_tokenizers.PATTERN, decoded_col="decoded", packed_col="packed")
    return coded.select("doc_id", "lang", "source", "ids", *q_bpe.digest_columns())


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("encode_texts", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: SQL cannot express the SimHash, passage and tokenizer stages.
ORACLE_SQL = None
