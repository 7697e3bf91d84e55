"""Query of the mixing operator."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupscan.llm import mixing
from dupscan.llm.common import table


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes and targets of op3 alone, which SQL can express."""
    return op3_mixing(spark, sf_dir).drop("taken")


QUERIES = {"op3_mixing": op3_mixing, "mixing_targets": mixing_targets}
ORACLE_SQL = {
    "mixing_targets": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
        weighed AS (SELECT source, source_size, 3.0::DOUBLE * source_size AS cap, [5, 2, 1][(rank - 1) % 3 + 1]::DOUBLE AS weight FROM per),
        filled AS (SELECT *, ((SELECT sum(source_size) FROM per)
            - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
        found AS (SELECT coalesce((SELECT level FROM filled WHERE level * weight <= cap ORDER BY cap / weight, source NULLS FIRST LIMIT 1), 'infinity'::DOUBLE) AS level)
        SELECT d.doc_id, d.size, f.source_size, least(f.cap, (SELECT level FROM found) * f.weight) AS target
        FROM d JOIN filled f ON d.source IS NOT DISTINCT FROM f.source
    """,
}
