"""Query of the SimHash operator."""

from pyspark.sql import DataFrame, SparkSession

from dupscan.llm import simhash
from dupscan.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex64(rows["fp"]).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
