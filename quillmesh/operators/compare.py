"""Side-by-side comparison of institutions: variants, match classes, and the body budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import retrieval as R

#: Ordered: a higher class wins.
STATUS = ("SearchError", "PackNotLoaded", "NoMatchFound", "SemanticCandidate", "LexicalMatch", "ExactMatch")
PROVISION_CAP, RESPONSE_CAP = 4000, 24000
MAX_INSTITUTIONS, MAX_VARIANTS = 12, 5
FIELDS = ("rule", "title", "label", "body")


def variants(topic: str, more: list[str] | None = None) -> list[str]:
    """The topic first, then other spellings; equal ones (without regard to case) once."""
    topic = (topic or "").strip()
    if not topic:
        raise ValueError("a topic is needed")
    if len(more or []) > MAX_VARIANTS:
        raise ValueError(f"at most {MAX_VARIANTS} variants")
    seen: dict[str, str] = {}
    for v in (topic, *(more or [])):
        if v.strip():
            seen.setdefault(v.strip().lower(), v.strip())
    return list(seen.values())


def institutions(asked: list[str] | None, loaded: list[str]) -> list[str]:
    """Institutions in the order asked for, equal aliases once; all loaded ones, sorted, if none are asked for."""
    if asked is None:
        return sorted(loaded)
    if len(asked) > MAX_INSTITUTIONS:
        raise ValueError(f"at most {MAX_INSTITUTIONS} institutions")
    out: dict[str, str] = {}
    for a in asked:
        key = "".join(c for c in a.strip().lower() if c not in "-_· ")
        if key:
            out.setdefault(key, a.strip())
    return list(out.values())


def classify(topic: Column, variant: Column, pinned: Column) -> tuple[Column, Column]:
    """(class as its place in STATUS, evidence fields) of a document for a topic and the variant that found it."""
    low = {f: F.lower(F.coalesce(F.col(f), F.lit(""))) for f in FIELDS}
    names = [F.lit("article" if f == "label" else f) for f in FIELDS]
    of = lambda test: F.filter(F.array(*[F.when(test(low[f]), n) for f, n in zip(FIELDS, names, strict=True)]), lambda x: x.isNotNull())
    t, v, terms = F.lower(topic), F.lower(variant), X.lexical_terms(variant)
    anywhere = lambda term: low["rule"].contains(term) | low["title"].contains(term) | low["label"].contains(term) | low["body"].contains(term)
    exact = pinned | (t != "") & (low["rule"].contains(t) | low["title"].contains(t) | low["label"].contains(t) | low["body"].contains(t))
    lexical = (F.size(terms) > 0) & F.forall(terms, anywhere)
    full = of(lambda value: (v != "") & value.contains(v))
    partial = of(lambda value: F.exists(terms, lambda term: value.contains(term)))
    return F.when(exact, 5).when(lexical, 4).otherwise(3), F.when(F.size(full) > 0, full).otherwise(partial)


def body_budget(rows: DataFrame, group: str, order: str, provision: int = PROVISION_CAP, response: int = RESPONSE_CAP) -> DataFrame:
    """Adds body_state and the cut body: `provision` characters each and `response` in all, spent in output order."""
    need = F.least(F.length("body"), F.lit(provision))
    before = F.coalesce(F.sum(need).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    allowed = F.greatest(F.lit(0), F.least(need, F.lit(response) - before))
    rows = rows.withColumn("_left", F.lit(response) - before).withColumn("_allowed", allowed)
    state = F.when(F.col("body").isNull() | (F.col("_left") <= 0), "omitted").when(F.col("_allowed") == F.length("body"), "full").otherwise("truncated")
    cut = F.when(state != "omitted", F.expr("substring(body, 1, cast(_allowed as int))"))
    return rows.withColumn("body_state", state).withColumn("body", cut).drop("_left", "_allowed")


def compare(docs: DataFrame, topics: DataFrame, top_k: int = 3) -> DataFrame:
    """Best active provisions of each institution for topics (query_id, topic, variant_no, q; the topic itself is variant 0).

    One row a provision: query_id, institution, rank, id, score, match, variant_no. Each institution is ranked by itself, with
    2 * top_k hits for each variant; of several variants that find a document the best score counts, then the earlier one.
    """
    k = 2 * min(10, max(1, top_k))
    q = topics.withColumn("query_key", F.concat_ws("|", "query_id", "variant_no"))
    keyed = q.select(F.col("query_key").alias("query_id"), "q")
    hits = R.bm25(docs, R.query_tokens(R.with_terms(keyed)), {"title": 2.0, "body": 1.0})
    hits = R.ranked(hits.join(docs.select("id", "institution"), "id"), k, ("query_id", "institution"))
    found = hits.withColumnRenamed("query_id", "query_key").join(q.select("query_key", F.col("query_id"), "topic", "variant_no", "q"), "query_key")
    found = found.join(docs.select("id", "rule", "label", "title", "body", "status"), "id").filter(X.is_active("status"))
    match, evidence = classify(F.col("topic"), F.col("q"), F.lit(False))
    found = found.withColumn("match_no", match).withColumn("evidence", evidence)
    best = Window.partitionBy("query_id", "institution", "id").orderBy(F.round("score", 9).desc(), "variant_no")
    one = found.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n", "rank")
    out = R.ranked(one, min(10, max(1, top_k)), ("query_id", "institution"))
    return out.select("query_id", "institution", "rank", "id", "score", F.get(F.array(*[F.lit(s) for s in STATUS]), F.col("match_no")).alias("match"), "match_no", "evidence", "variant_no", "body")


def statuses(found: DataFrame, asked: DataFrame, loaded: DataFrame) -> DataFrame:
    """One row for each institution asked for: its best class; NoMatchFound says only that this query found nothing."""
    best = found.groupBy("query_id", "institution").agg(F.max("match_no").alias("best"))
    rows = asked.join(loaded.select("institution", F.lit(True).alias("loaded")), "institution", "left").join(best, ["query_id", "institution"], "left")
    no = F.when(F.col("loaded").isNull(), 1).otherwise(F.coalesce("best", F.lit(2)))
    return rows.select("query_id", "institution", F.get(F.array(*[F.lit(s) for s in STATUS]), no).alias("match_status"))
