"""Query of the byte-level BPE operator."""

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dupscan.llm import bpe
from dupscan.llm.common import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def digest_columns() -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256 of the columns packed and decoded."""
    n = F.expr("octet_length(packed) div 4").cast("long")
    return [n.alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]


def digests(docs: DataFrame, *keep: str) -> DataFrame:
    coded = bpe.encode(docs.select(*keep, "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ids_col=None, decoded_col="decoded", packed_col="packed")
    return coded.select(*keep, *digest_columns())


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), "doc_id")


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
