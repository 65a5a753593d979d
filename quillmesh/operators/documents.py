"""Document tables: neighbours, summaries, page owners, lookups, namespaces and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def neighbors(docs: DataFrame) -> DataFrame:
    """prev_id and next_id within a rule, in the natural order of articles."""
    key = X.article_order("label")
    w = Window.partitionBy("institution", "rule").orderBy(key["n"], key["m"], key["label"])
    return docs.select("id", "institution", "rule", "label", F.lag("id").over(w).alias("prev_id"), F.lead("id").over(w).alias("next_id"))


def rule_summaries(docs: DataFrame) -> DataFrame:
    return docs.groupBy("institution", "rule").agg(F.count("*").alias("article_count"), F.max("effective").alias("effective")).withColumn("slug", X.slugify("rule"))


def modal_effective(docs: DataFrame) -> DataFrame:
    """The commonest date of each institution, the earliest of several; 'unknown' without any."""
    n = docs.groupBy("institution", "effective").agg(F.count("*").alias("n")).filter("effective is not null and effective != ''")
    best = n.groupBy("institution").agg(F.min(F.struct((-F.col("n")).alias("n"), "effective")).alias("b"))
    return docs.select("institution").distinct().join(best, "institution", "left").select("institution", F.coalesce("b.effective", F.lit("unknown")).alias("effective"))


def page_owners(docs: DataFrame) -> DataFrame:
    """(page, owner_ids): sorted ids of the documents whose page pair covers a page."""
    each = docs.select("id", F.explode(X.expand_pages(F.col("pages"))).alias("page"))
    return each.groupBy("page").agg(F.array_sort(F.collect_set("id")).alias("owner_ids"))


def source_page(asked: DataFrame, pages: DataFrame, owners: DataFrame, packs: DataFrame) -> DataFrame:
    """Pages asked for (query_id, institution, page) with text and owners, or the reason there is none."""
    many = packs.count() > 1
    has = pages.select("institution").distinct().withColumn("has_pages", F.lit(True))
    out = asked.join(packs.select("institution", F.lit(True).alias("known")), "institution", "left").join(has, "institution", "left")
    out = out.join(pages.select("institution", "page", "text"), ["institution", "page"], "left").join(owners, "page", "left")
    blank = F.lit(many) & F.coalesce(F.col("institution"), F.lit("")).eqNullSafe("")
    error = F.when(blank, "institution required").when(F.col("known").isNull(), "unknown institution").when(F.col("has_pages").isNull(), "no source pages").when(F.col("text").isNull(), "page not found")
    return out.select("query_id", "institution", "page", "text", F.coalesce("owner_ids", F.array().cast("array<string>")).alias("owner_ids"), error.alias("error"))


def get_by_id(asked: DataFrame, docs: DataFrame, packs: DataFrame) -> DataFrame:
    """Documents asked for (query_id, id); what is missing still comes with its pack's dates."""
    d = docs.select("id", "title", F.col("effective").alias("own"), F.col("status"))
    out = asked.join(d, "id", "left").crossJoin(F.broadcast(packs.limit(1).select(F.col("effective").alias("pack_date"))))  # one row
    return out.select("query_id", "id", F.col("own").isNotNull().alias("found"), "title", F.coalesce("own", "pack_date").alias("effective"), "status")


def resolve_ids(asked: DataFrame, packs: DataFrame, default: str) -> DataFrame:
    """Splits inst/local ids where inst is loaded and local holds a '#'; others belong to the default pack."""
    head, tail = F.substring_index("id", "/", 1), F.substring(F.col("id"), F.instr("id", F.lit("/")) + 1, F.length("id"))
    out = asked.withColumn("_h", F.when(F.col("id").contains("/") & tail.contains("#"), head)).withColumn("_t", tail)
    out = out.join(F.broadcast(packs.select(F.col("institution").alias("_h"), F.lit(True).alias("_k"))), "_h", "left")
    known = F.coalesce("_k", F.lit(False))
    return out.select("query_id", F.when(known, F.col("_h")).otherwise(default).alias("institution"), F.when(known, F.col("_t")).otherwise(F.col("id")).alias("local_id"))


def namespaced(docs: DataFrame, many: bool) -> DataFrame:
    """Ids and links with their institution in front, where several packs are loaded."""
    if not many:
        return docs
    pre = lambda c: F.concat(F.col("institution"), F.lit("/"), c)
    out = docs
    for c in ("id", "prev_id", "next_id"):
        if c in docs.columns:
            out = out.withColumn(c, pre(F.col(c)))
    if "refs" in docs.columns:
        out = out.withColumn("refs", F.transform("refs", lambda r: F.struct(pre(r["target"]).alias("target"), r["kind"].alias("kind"))))
    return out


def legal_basis(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.inline("legal_basis"))


def hit_meta(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Freshness of each query's hits as a map from id."""
    rows = hits.join(docs.select("id", "effective"), "id")
    meta = F.struct("effective", F.col("effective").alias("amended"))
    return rows.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("id", meta)))).alias("meta"))


def annex_title(label: Column, title: Column, body: Column) -> Column:
    """Label and title; without a title the first line of the body that is neither heading, table nor label."""
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.btrim(x)), lambda x: (x != "") & ~x.rlike(r"^(##|\||\[별표|<별표)"))
    first = F.get(lines, F.lit(0))
    return F.when(F.btrim(F.coalesce(title, F.lit(""))) != "", F.concat(label, F.lit(" "), F.btrim(title))).when(first.isNotNull(), F.concat(label, F.lit(" "), first)).otherwise(label)


def context_blocks(hits: DataFrame, docs: DataFrame, annexes: DataFrame | None = None) -> DataFrame:
    """Hits with their text for a prompt. Annexes are left out unless given."""
    some = docs.select("id", "title", "body")
    if annexes is not None:
        some = some.unionByName(annexes.select("id", "title", "body"))
    return hits.join(some, "id")
