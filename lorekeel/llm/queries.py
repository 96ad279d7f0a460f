"""Queries of the operators in this package, named pN_... after their problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeel.llm import batchdedup, boilerplate, groups, leakage, lookalike, mixing, names, neardup, repeated
from lorekeel.session import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each non-blank line of a body that isn't story."""
    return boilerplate.boilerplate_lines(read_table(spark, sf_dir, "articles"))


def p1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The story of each article."""
    return boilerplate.main_text(read_table(spark, sf_dir, "articles"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each occurrence of a line repeated within its source."""
    return repeated.repeated_lines(read_table(spark, sf_dir, "articles"))


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles without those lines."""
    articles = read_table(spark, sf_dir, "articles")
    return repeated.without_lines(articles, repeated.repeated_lines(articles)).select("document_id", "source", "body")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person or organization that each unresolved mention names."""
    return names.link_mentions(*(read_table(spark, sf_dir, t) for t in ("provenance", "entities", "entity_aliases")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article that an earlier one is near to, with the earliest such article."""
    return batchdedup.first_known(read_table(spark, sf_dir, "articles"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of articles whose stories share at least half of their runs of three words."""
    return neardup.near_duplicate_pairs(read_table(spark, sf_dir, "articles"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per article: its class of equal stories and the number of near articles of other classes."""
    return neardup.near_duplicate_groups(read_table(spark, sf_dir, "articles"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every entity linked to another one."""
    return groups.entity_groups(read_table(spark, sf_dir, "entities"), read_table(spark, sf_dir, "entity_matches"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and the documents that share thirteen consecutive words with their prompts."""
    return leakage.leaked_runs(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p8_paraphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and documents with a passage that says what the prompt says."""
    return leakage.paraphrases(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mixture at the target shares: documents and how often each is taken."""
    return mixing.mixture(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that mixture reaches."""
    return mixing.mixture(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))[1]


def p9_million(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached by a mixture of a million tokens, to which sources give what they can within their caps."""
    return mixing.mixture(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"), 1_000_000)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents whose texts differ but look the same."""
    return lookalike.lookalike_pairs(read_table(spark, sf_dir, "documents"))


def p10_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one form of its text."""
    return lookalike.canonical(read_table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "canonical")


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


# Lines in their compared form, by article.
_LINES = r"""
lines AS (
  SELECT document_id, source, CAST(no - 1 AS INTEGER) AS line_no,
         regexp_replace(trim(regexp_replace(lower(l), '\s+', ' ', 'g')), '[0-9]+', '0', 'g') AS form
  FROM (SELECT document_id, source, unnest(string_split(body, chr(10))) AS l, generate_subscripts(string_split(body, chr(10)), 1) AS no FROM articles)
)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p7_found": """
WITH RECURSIVE raw AS (
  SELECT entity_id AS x, merged_into AS y FROM entities UNION ALL SELECT left_id, right_id FROM entity_matches
), both_ways AS (
  SELECT x, y FROM raw WHERE x <> y UNION SELECT y, x FROM raw WHERE x <> y
), reach(x, y) AS (
  SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x
)
SELECT r.x AS entity_id, least(r.x, min(r.y)) AS group_id
FROM reach r
WHERE r.x IN (SELECT entity_id FROM entities) AND r.y IN (SELECT entity_id FROM entities) AND r.x <> r.y
GROUP BY r.x
""",
        "p2_found": f"""
WITH {_LINES},
often AS (
  SELECT source, form FROM lines WHERE form <> '' GROUP BY source, form
  HAVING count(DISTINCT document_id) >= 5
     AND count(DISTINCT document_id) * 20 >= (SELECT count(*) FROM articles a WHERE a.source = lines.source)
)
SELECT document_id, line_no FROM lines JOIN often USING (source, form)
""",
    }
