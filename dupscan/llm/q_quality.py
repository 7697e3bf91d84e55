"""Query of the quality rules."""

from pyspark.sql import DataFrame, SparkSession

from dupscan.llm import quality
from dupscan.llm.common import table


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that labels marks as good."""
    return table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.fit(docs, trusted(spark, sf_dir))).drop("text")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op6 alone, which SQL can express."""
    # none of them depends on the ratios, so none are fitted
    rows = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), [0.0] * quality.BUCKETS)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {"op6_quality_rules": op6_quality_rules, "quality_base": quality_base}
ORACLE_SQL = {
    "quality_base": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
        windows AS (SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS k FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
        twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM windows) WHERE n > 1),
        steps AS (SELECT rid, least(8, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -8)) AS step FROM twice),
        repeated AS (SELECT rid, sum(step) AS n FROM steps GROUP BY rid),
        b AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
            length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
            (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
            FROM w LEFT JOIN repeated r ON w.rid = r.rid)
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b
    """,
}
