"""Quality, verification, evaluation, logs and the message store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def coverage(owners: DataFrame, items: DataFrame, excluded: DataFrame) -> DataFrame:
    """Pages (document, page) that should be covered, those that are, and the percentage; 100 if none should be."""
    keys = ["document", "page"]
    eligible = owners.select(*keys).distinct().join(excluded.select(*keys).distinct(), keys, "left_anti")
    covered = items.select(*keys).distinct().withColumn("hit", F.lit(1))
    out = eligible.join(covered, keys, "left").groupBy("document").agg(F.count("*").alias("eligible"), F.count("hit").alias("covered"))
    every = owners.select("document").union(excluded.select("document")).distinct()
    out = every.join(out, "document", "left").select("document", F.coalesce("eligible", F.lit(0)).alias("eligible"), F.coalesce("covered", F.lit(0)).alias("covered"))
    return out.withColumn("percent", F.when(F.col("eligible") == 0, 100.0).otherwise(F.round(100.0 * F.col("covered") / F.col("eligible"), 2)))


def suspicious(rules: DataFrame, articles: DataFrame, pages: int = 10, few: int = 3) -> DataFrame:
    """Rules of many pages with few articles or none."""
    n = articles.groupBy("rule").agg(F.count("*").alias("n_articles"))
    out = rules.join(n, "rule", "left").withColumn("n_articles", F.coalesce("n_articles", F.lit(0)))
    return out.filter((F.col("end_page") - F.col("start_page") + 1 >= pages) & (F.col("n_articles") <= few))


def unresolved(refs: DataFrame, docs: DataFrame) -> DataFrame:
    return refs.join(docs.select(F.col("id").alias("dst")), "dst", "left_anti")


def skipped_headings(headings: DataFrame, emitted: DataFrame) -> DataFrame:
    """Second and later occurrences of a key in a rule, if the key was emitted."""
    n = F.row_number().over(Window.partitionBy("rule", "key").orderBy("position"))
    return headings.withColumn("occurrence", n).filter("occurrence > 1").join(emitted.select("rule", "key").distinct(), ["rule", "key"], "left_semi")


def token_overlap(pairs: DataFrame, expected: str, actual: str) -> DataFrame:
    """Share of the expected words (with repeats) that the actual text has: (pair_id, overlap)."""
    count = lambda c, n: pairs.select("pair_id", F.explode(F.filter(X.tokens(c), lambda t: F.length(t) > 1)).alias("t")).groupBy("pair_id", "t").agg(F.count("*").alias(n))
    both = count(expected, "want").join(count(actual, "have"), ["pair_id", "t"], "left")
    share = both.groupBy("pair_id").agg((F.sum(F.least("want", F.coalesce("have", F.lit(0)))) / F.sum("want")).alias("overlap"))
    return pairs.select("pair_id").join(share, "pair_id", "left").select("pair_id", F.coalesce("overlap", F.lit(1.0)).alias("overlap"))


def verdict(score: Column) -> Column:
    return F.when(score >= 0.9, "match").when(score >= 0.6, "partial").otherwise("mismatch")


def verdict_summary(cases: DataFrame) -> DataFrame:
    return cases.groupBy("institution").pivot("status", ["match", "partial", "mismatch"]).count().na.fill(0)


def best_page(scores: DataFrame) -> DataFrame:
    """The page of each item with the highest score, the lowest page of several, and how far it is from the recorded one."""
    best = scores.groupBy("item_id", "recorded").agg(F.min(F.struct((-F.col("score")).alias("s"), "page")).alias("b"))
    return best.select("item_id", "recorded", F.col("b.page").alias("actual"), (F.col("recorded") - F.col("b.page")).alias("distance"))


def eval_hits(golden: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """One row a question of golden (query_id, expect): whether one of its first k hits is expected.

    A bare expected id matches the local part of a hit's id; one with an institution has to match whole.
    """
    local = F.when(F.col("id").contains("/"), F.substring(F.col("id"), F.instr("id", F.lit("/")) + 1, F.length("id"))).otherwise(F.col("id"))
    some = hits.filter(F.col("rank") < k).select("query_id", F.explode(F.array(F.col("id"), local)).alias("want")).distinct()
    want = golden.select("query_id", F.explode("expect").alias("want"))
    ok = want.join(some, ["query_id", "want"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(True))
    return golden.select("query_id").join(ok, "query_id", "left").select("query_id", F.coalesce("hit", F.lit(False)).alias("hit"))


def nearest_rank(df: DataFrame, value: str, percent: int) -> DataFrame:
    """Nearest-rank percentile; 0 without rows."""
    return df.agg(F.coalesce(F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {value})"), F.lit(0)).alias("value"))


def top_questions(log: DataFrame) -> DataFrame:
    """Questions by normal form: count, first wording, misses; most frequent first, then first seen. log: ord, question, miss."""
    keyed = log.withColumn("key", X.normalize_question("question")).filter("key != ''")
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"), F.min_by("question", "ord").alias("example"), F.count_if(F.coalesce("miss", F.lit(False))).alias("misses"))


def reason_counts(diagnostics: DataFrame, unnamed: str = "미지정") -> DataFrame:
    reason = F.coalesce(X.blank_to_null("reason"), F.lit(unnamed))
    return diagnostics.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def consented(log: DataFrame, consent: Column, local_mode: str = "labor") -> DataFrame:
    """Rows that may be shared: with consent, and not of the mode that stays local."""
    return log.filter(F.coalesce(consent, F.lit(False)) & (F.coalesce(F.col("mode"), F.lit("")) != local_mode))


def date_bucket(days: Column) -> Column:
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days <= 7, "last 7 days").otherwise("earlier")


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key of a table and its changes; of several with one version the greatest by its other columns."""
    every = current.unionByName(changes)
    w = Window.partitionBy(key).orderBy(F.col(version).desc(), *[F.col(c).desc() for c in every.columns if c not in (key, version)])
    return every.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def live(conversations: DataFrame) -> DataFrame:
    return conversations.filter("deleted_at is null").orderBy(F.col("updated_at").desc(), "id")


def soft_delete(conversations: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Marks live rows as deleted; others stay as they are."""
    hit = ids.select("id").distinct().withColumn("_d", F.lit(True))
    out = conversations.join(hit, "id", "left")
    return out.withColumn("deleted_at", F.when(F.col("_d") & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at"))).drop("_d")


def citations_in_context(cited: Column, context: Column) -> tuple[Column, Column]:
    """(citations that the context holds, whether it holds all; none cited counts as all)."""
    return F.array_intersect(cited, context), F.forall(cited, lambda c: F.array_contains(context, c))
