"""Query of the substring deduplication."""

from pyspark.sql import DataFrame, SparkSession

from dupscan.llm import passages
from dupscan.llm.common import table


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
