"""The engine's model over the driver's tables, as DataFrames and as the same views in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str, status: bool = True) -> DataFrame:
    """documents: institution = lang, rule = source, label = doc_id, title = first line, status from labels.quality.

    Without status no label is joined, which would ship whole texts for each route that reads them.
    """
    if not status:
        return _articles(table(spark, sf_dir, "documents"))
    d, q = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return _articles(d.join(q, "doc_id", "left"), F.when(F.col("quality") == 1, "active").when(F.col("quality") == 0, "repealed").otherwise("").alias("status"))


def _articles(d: DataFrame, *status: Column) -> DataFrame:
    line = F.substring_index("text", "\n", 1)
    month = F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0")
    return d.select(
        "doc_id", F.concat("source", F.lit("#"), F.col("doc_id").cast("string")).alias("id"), F.lit("article").alias("kind"), F.col("lang").alias("institution"), F.col("source").alias("rule"),
        F.col("doc_id").cast("string").alias("label"), line.alias("title"), F.col("text").alias("body"), *status,
        F.concat(F.lit("2025-"), month, F.lit("-01")).alias("effective"),
    )


ARTICLES = """articles AS (
  SELECT d.doc_id, source || '#' || d.doc_id AS id, 'article' AS kind, lang AS institution, source AS rule, d.doc_id::VARCHAR AS label, string_split(text, chr(10))[1] AS title, text AS body,
    CASE WHEN quality = 1 THEN 'active' WHEN quality = 0 THEN 'repealed' ELSE '' END AS status, '2025-' || lpad((d.doc_id % 12 + 1)::VARCHAR, 2, '0') || '-01' AS effective
  FROM documents d LEFT JOIN (SELECT doc_id, quality FROM labels) l ON l.doc_id = d.doc_id
)"""


def annexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages: the text of each page as an annex 별표<page_id> of the rule named by its host."""
    p = table(spark, sf_dir, "pages")
    text = F.btrim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    return p.select(
        "page_id", F.concat(F.lit("page#"), F.col("page_id").cast("string")).alias("id"), F.lit("annex").alias("kind"), F.lit("web").alias("institution"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("rule"),
        F.concat(F.lit("별표"), F.col("page_id").cast("string")).alias("label"), F.lit("").alias("title"), text.alias("body"), F.lit("active").alias("status"), F.lit("2025-06-01").alias("effective"), F.contains("html", F.lit("<table")).alias("table_structured"),
    )


ANNEXES = r"""annexes AS (
  SELECT page_id, 'page#' || page_id AS id, 'annex' AS kind, 'web' AS institution, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS rule, '별표' || page_id AS label, '' AS title,
    trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS body, 'active' AS status, '2025-06-01' AS effective, contains(html, '<table') AS table_structured
  FROM pages
)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark: the whole text of an item as a question."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))


QUESTIONS = """questions AS (SELECT item_id AS query_id, text AS q FROM benchmark)"""

#: Terms of a question, as functions.text.query_terms makes them of text without Korean endings.
TERMS = r"""words AS (SELECT query_id, q, w, i FROM (SELECT query_id, q, unnest(string_split_regex(q, '\s+')) AS w, unnest(range(len(string_split_regex(q, '\s+')))) AS i FROM questions) WHERE w <> ''),
terms AS (
  SELECT query_id, t, min(p) AS p FROM (
    SELECT query_id, regexp_replace(w, '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g') AS t, 2 * i AS p FROM words
    UNION ALL SELECT query_id, regexp_replace(regexp_replace(w, '[?!.,:;，。]+$', ''), '[상의은는이가을를:,，]+$', '') AS t, 2 * i + 1 AS p FROM words
  ) WHERE length(t) >= 2 GROUP BY query_id, t
)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star schema as a typed graph: orders cite customers, customers and suppliers lead to nations, nations to regions."""
    t = lambda n: table(spark, sf_dir, n)
    e = lambda df, a, x, b, y, k: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"), F.lit(k).alias("kind"))
    return (
        e(t("orders"), "order:", "o_orderkey", "customer:", "o_custkey", "Cites")
        .union(e(t("customer"), "customer:", "c_custkey", "nation:", "c_nationkey", "ApplyMutatis"))
        .union(e(t("supplier"), "supplier:", "s_suppkey", "nation:", "s_nationkey", "Delegates"))
        .union(e(t("nation"), "nation:", "n_nationkey", "region:", "n_regionkey", "Delegates"))
    )


EDGES = """edges AS (
  SELECT 'order:' || o_orderkey AS src, 'customer:' || o_custkey AS dst, 'Cites' AS kind FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'ApplyMutatis' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'Delegates' FROM supplier
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'Delegates' FROM nation
)"""
