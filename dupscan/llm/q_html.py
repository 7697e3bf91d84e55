"""Query of the HTML extraction."""

from pyspark.sql import DataFrame, SparkSession

from dupscan.llm import html
from dupscan.llm.common import table


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {"op10_html_extraction": op10_html_extraction}
