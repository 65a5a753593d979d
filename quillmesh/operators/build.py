"""Composites: page estimates, build and quality gates, verification runs, vector tables, pack states, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.python import similarity
from . import audit as A
from . import extract as E
from . import graph as G
from . import sequence as S


def estimate_pages(articles: DataFrame) -> DataFrame:
    """Adds first_page and last_page of articles (rule, text_before, text_through, text, start_page, end_page) from line counts.

    For texts without page spans: lines are taken to be spread evenly over the rule's pages. A rule's only article has them all.
    """
    lines = lambda c: F.length(c) - F.length(F.replace(F.col(c), F.lit("\n"), F.lit("")))
    pages = F.greatest(F.lit(1), F.col("end_page") - F.col("start_page") + 1)
    each = F.greatest(F.lit(1), F.floor(lines("text") / pages))
    alone = F.count("*").over(Window.partitionBy("rule")) == 1
    first = F.least("end_page", F.col("start_page") + F.floor(lines("text_before") / each))
    last = F.least("end_page", F.col("start_page") + F.floor(F.greatest(lines("text_before"), lines("text_through")) / each))
    out = articles.withColumn("first_page", F.when(alone, F.col("start_page")).otherwise(first).cast("int"))
    return out.withColumn("last_page", F.when(alone, F.col("end_page")).otherwise(F.greatest("first_page", last)).cast("int"))


def build_rules(pages: DataFrame, effective: str | None = None, footers: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """From page texts (document, page, text) to documents, with the build's gates: a document without rules or articles fails.

    rules: entries of the contents; parts: articles and annexes with id; no_articles: rules without any; ambiguous_basis: first
    articles (제1조) without a legal basis; table_review: articles whose tables need a look; skipped: repeated headings;
    coverage: pages that parts cover, without those of the contents; suspicious: long rules with few articles.
    """
    rules = E.toc_entries(pages)
    _gate(pages, rules, "rules")
    texts = E.rule_texts(rules, pages, footers)
    names = rules.groupBy("document").agg(F.array_sort(F.collect_set("rule")).alias("known"))
    parts = E.parse_rules(texts.join(names, "document"), effective=effective).withColumn("id", F.concat(X.slugify("rule"), F.lit("#"), "label"))
    articles = parts.filter("kind = 'article'")
    _gate(pages, articles, "articles")
    by = ["document", "code"]
    place = F.struct("document", "code").alias("rule")
    key = X.article_key(F.regexp_extract("h", E.ARTICLE, 1), F.regexp_extract("h", E.ARTICLE, 2))
    heads = texts.select(place, F.posexplode(F.regexp_extract_all("text", F.lit(E.ARTICLE), F.lit(0))).alias("position", "h")).withColumn("key", key)
    each = lambda df, a, b: df.select("document", F.explode(F.sequence(a, b)).alias("page"))
    contents = each(E.toc_range(pages, E.toc_lines(pages)), F.col("start"), F.col("end"))
    return {
        "rules": rules, "parts": parts, "no_articles": rules.join(articles.select(*by).distinct(), by, "left_anti"),
        "ambiguous_basis": articles.filter((F.col("label") == "제1조") & (F.size("legal_basis") == 0)), "table_review": articles.filter(X.table_sensitive("body")),
        "skipped": A.skipped_headings(heads, articles.select(place, F.col("label").alias("key"))).select("rule.*", "key", "position"),
        "coverage": A.coverage(each(rules, F.col("start_page"), F.col("end_page")), each(parts, F.get("pages", F.lit(0)), F.get("pages", F.lit(1))), contents),
        "suspicious": A.suspicious(rules.withColumn("rule", place), articles.select(place)).select("rule.*", "start_page", "end_page", "n_articles"),
    }


def _gate(pages: DataFrame, made: DataFrame, what: str) -> None:
    lost = pages.select("document").distinct().join(made.select("document").distinct(), "document", "left_anti").agg(F.count("*").alias("n"), F.min("document").alias("one")).head()
    if lost["n"] or not made.limit(1).count():
        raise ValueError(f"0 {what}: {lost['n']} documents, {lost['one']}")


def build_graph(docs: DataFrame) -> dict[str, DataFrame]:
    """nodes (id, kind, unresolved_ref) and edges of a pack: containment, references, legal bases, placeholders."""
    edges = G.dedup_edges(G.containment_edges(docs).unionByName(G.document_edges(docs)))
    rule = F.concat(F.lit("rule:"), "institution", F.lit("/"), "rule")
    known = docs.select("id", F.initcap("kind").alias("kind"))
    top = docs.select(F.concat(F.lit("institution:"), "institution").alias("id"), F.lit("Institution").alias("kind")).union(docs.select(rule, F.lit("Rule"))).distinct()
    nodes = known.unionByName(top).withColumn("unresolved_ref", F.lit(False)).unionByName(G.external_nodes(edges, docs))
    return {"nodes": nodes, "edges": edges.select("src", "dst", "kind")}


def quality_gate(docs: DataFrame, nodes: DataFrame, edges: DataFrame, max_unresolved: int | None = None) -> dict:
    """The counts of a pack's report; raises if the graph is broken or, with a limit, too many references lead nowhere."""
    n = G.graph_quality(nodes, edges).head().asDict()
    refs = edges.filter(F.col("kind").isin("Cites", "ApplyMutatis", "Delegates", "ExceptWhen"))
    lost = A.unresolved(refs, docs)
    d = docs.agg(F.count("*").alias("n_documents"), F.count_if(X.is_active("status")).alias("n_active"), F.count_if(F.size("pages") > 0).alias("n_with_pages"), F.count_if(F.size("refs") > 0).alias("n_with_refs"), F.count_if(F.size("legal_basis") > 0).alias("n_with_basis"), F.countDistinct("rule").alias("n_rules")).head().asDict()
    u = lost.agg(F.count("*").alias("external_ref_nodes"), F.countDistinct("dst").alias("external_ref_nodes_distinct")).head().asDict()
    report = n | d | u
    for key in ("n_broken", "n_orphans"):
        if report[key]:
            raise ValueError(f"{key}: {report[key]}")
    if not report["n_documents"]:
        raise ValueError("no documents")
    if max_unresolved is not None and report["external_ref_nodes"] > max_unresolved:
        raise ValueError(f"unresolved references: {report['external_ref_nodes']}")
    return report


def qa_report(rules: DataFrame, parts: DataFrame) -> DataFrame:
    """One row a rule in the order of its contents: articles, annexes, and the share of texts whose tables need a look."""
    n = parts.groupBy("rule").agg(F.count_if(F.col("kind") == "article").alias("n_articles"), F.count_if(F.col("kind") == "annex").alias("n_annexes"), F.round(F.avg(X.table_sensitive("body").cast("int")), 4).alias("table_rate"))
    out = rules.join(n, "rule", "left")
    return out.select("rule", "start_page", "end_page", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_articles", "n_annexes")], F.coalesce("table_rate", F.lit(0.0)).alias("table_rate")).orderBy("start_page", "rule")


def verify_extraction(items: DataFrame, pages: DataFrame, n: int = 40, seed: int = 20260708) -> DataFrame:
    """Sampled items against the text of their pages: score, verdict, and for mismatches the page that fits best.

    items: item_id, institution, rule, body, first_page, last_page; pages: page, text. The sample is balanced over rules.
    """
    some = S.balanced_sample(items.filter(X.blank_to_null("body").isNotNull()), "rule", "item_id", n, seed)
    inside = some.select("item_id", "first_page", "last_page").join(pages, F.col("page").between(F.col("first_page"), F.col("last_page")))
    text = S.fold(inside, "item_id", "page", "text", "\n")
    scored = some.join(text, "item_id", "left").withColumn("score", F.round(similarity(F.col("body"), F.col("folded")), 4))
    scored = scored.withColumn("status", A.verdict(F.col("score")))
    # A stated sample against all pages: n rows at most.
    wrong = scored.filter("status = 'mismatch'").select("item_id", F.col("first_page").alias("recorded"), "body")
    tried = pages.crossJoin(F.broadcast(wrong)).select("item_id", "recorded", "page", similarity(F.col("body"), F.col("text")).alias("score"))
    return scored.select("item_id", "institution", "rule", "score", "status").join(A.best_page(tried).select("item_id", "actual", "distance"), "item_id", "left")


def vector_rows(docs: DataFrame) -> DataFrame:
    """(id, kind, text, text_hash) of what is embedded: rule, title and body."""
    text = F.concat(F.concat_ws(" ", "rule", "title"), F.lit("\n"), "body")
    return docs.select("id", "kind", text.alias("text"), F.sha2(text, 256).alias("text_hash"))


def cache_key(manifest_files: DataFrame, model: str, version: int = 1) -> str:
    """Digest of the cache's version, the model and all file digests (aggregated, one row)."""
    files = manifest_files.agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(":", "path", "sha256")))), 256).alias("h")).head()["h"]
    return manifest_files.sparkSession.range(1).select(F.sha2(F.lit(f"{version}|{model}|{files}"), 256).alias("k")).head()["k"]


def refresh_vectors(docs: DataFrame, cached: DataFrame, embed) -> DataFrame:
    """Vectors (id, text_hash, embedding) of all documents: those cached for an unchanged text, and new ones from embed(text).

    embed takes a Column of texts, so any pandas function can stand behind it; only new and changed texts reach it.
    """
    rows = vector_rows(docs)
    kept = cached.join(rows.select("id", "text_hash"), ["id", "text_hash"], "left_semi")
    new = rows.join(cached.select("id", "text_hash"), ["id", "text_hash"], "left_anti")
    made = new.select("id", "text_hash", embed(F.col("text")).alias("embedding"))
    empty = F.size("embedding") == 0
    made = made.withColumn("embedding", F.when(empty, F.raise_error(F.concat(F.lit("no embedding: "), F.col("id")))).otherwise(F.col("embedding")))
    return kept.select("id", "text_hash", "embedding").unionByName(made)


def pack_status(packs: DataFrame) -> DataFrame:
    """One row over all packs (institution, installed, stale, vectors_enabled, vectors_ready)."""
    ready = ~F.col("vectors_enabled") | F.col("vectors_ready")
    return packs.agg(F.count("*").alias("n_packs"), F.coalesce(F.bool_and("installed"), F.lit(False)).alias("installed"), F.coalesce(F.bool_or("stale"), F.lit(True)).alias("stale"), F.coalesce(F.bool_or("vectors_enabled") & F.bool_and(ready), F.lit(False)).alias("model_ready"))


def freshness(docs: DataFrame, packs: DataFrame) -> DataFrame:
    """Dates of each document, or its pack's where it has none; source_url only where there is one."""
    p = packs.select("institution", F.col("effective").alias("pack_date"), "source_commit", "source_url")
    extra = F.when(F.col("source_url").isNotNull(), F.create_map(F.lit("source_url"), F.col("source_url"))).otherwise(F.create_map().cast("map<string,string>"))
    out = docs.join(p, "institution", "left")
    return out.select("id", F.coalesce("effective", "pack_date").alias("effective"), F.coalesce("amended", "pack_date").alias("amended"), "source_commit", extra.alias("extra"))


def error_rows(failed: DataFrame) -> DataFrame:
    """One SearchError row for each institution with a failing variant: the message of the first. failed: query_id, institution, variant_no, error."""
    some = failed.filter("error is not null")
    return some.groupBy("query_id", "institution").agg(F.min_by("error", "variant_no").alias("error")).withColumn("match_status", F.lit("SearchError"))


def export_markdown(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """(id, text): each conversation as Markdown, its messages in order."""
    line = F.concat(F.lit("## "), "role", F.lit("\n\n"), "content")
    body = messages.select(F.col("conversation_id").alias("id"), "created_at", line.alias("part"))
    folded = S.fold(body, "id", "created_at", "part", "\n\n")
    return conversations.join(folded, "id", "left").select("id", F.concat(F.lit("# "), F.coalesce(X.blank_to_null("title"), F.lit("새 대화")), F.lit("\n\n"), F.coalesce("folded", F.lit(""))).alias("text"))


def trace_context(traces: DataFrame, messages: DataFrame) -> DataFrame:
    """Each trace with its answer and the question before it."""
    w = Window.partitionBy("conversation_id").orderBy("created_at").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("content")), ignorenulls=True).over(w)
    m = messages.select(F.col("id").alias("message_id"), F.col("content").alias("answer"), asked.alias("question"))
    return traces.join(m, "message_id", "left")


def telemetry(settings: DataFrame) -> DataFrame:
    """One row of settings (key, value): consent as a real boolean, blank folder as null."""
    one = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    raw = settings.agg(one("telemetry_consent").alias("c"), one("install_id").alias("install_id"), one("shared_dir").alias("d"))
    return raw.select(F.when(F.col("c") == "true", True).when(F.col("c") == "false", False).alias("consent"), "install_id", X.blank_to_null("d").alias("shared_dir"))


def page_windows(pages: DataFrame, size: Column) -> DataFrame:
    """Pages of a rulebook in windows of `size` for display."""
    n = F.row_number().over(Window.partitionBy("document").orderBy("page")) - 1
    return pages.withColumn("window", F.floor(n / size))


def pack_for(packs: DataFrame, wanted: str | None = None) -> str | None:
    """The institution asked for if its pack is loaded; without one, the default: the only pack, or the first by name."""
    names = packs.select("institution").distinct()
    if wanted and wanted.strip():
        return wanted.strip() if names.filter(F.col("institution") == wanted.strip()).limit(1).count() else None
    return names.agg(F.min("institution").alias("one")).head()["one"]
