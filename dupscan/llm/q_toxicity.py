"""Query of the toxicity classifier."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupscan.llm import toxicity
from dupscan.llm.common import crc_part, table


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_part(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = docs.select("doc_id", held_out.alias("held_out"), toxicity.scored(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op2_toxicity": op2_toxicity}
