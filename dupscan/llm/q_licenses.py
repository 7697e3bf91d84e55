"""Query of the license scan."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupscan.llm import licenses
from dupscan.llm.common import table
from dupscan.llm.license_texts import TEMPLATES


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"), {name: text for name, (_, text) in TEMPLATES.items()}, closest_only=True)
    of = F.create_map(*[F.lit(x) for name, (license_, _) in TEMPLATES.items() for x in (name, license_)])
    return found.withColumn("license", F.element_at(of, F.col("template")))


QUERIES = {"op9_license_scan": op9_license_scan}
