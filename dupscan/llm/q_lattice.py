"""Query of the language-model scores."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupscan.llm import lattice
from dupscan.llm.common import crc_part, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_part(F.col("doc_id"), 10) == 0
    out = lattice.score_texts(table(spark, sf_dir, "documents"), ~held_out, public_tokenizers.path(VOCABULARY))
    return out.withColumn("held_out", held_out)


QUERIES = {"op5_lm_scoring": op5_lm_scoring}
