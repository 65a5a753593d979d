"""Queries of retrieval, fusion and comparison, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit as A
from ..operators import compare as C
from ..operators import retrieval as R
from ..registry import query
from .views import ANNEXES, ARTICLES, QUESTIONS, TERMS, annexes, articles, questions, table

K = 5
_ACTIVE = "status NOT SIMILAR TO '.*(superseded|repealed|inactive|replaced|abolished).*'"

#: BM25 over title (2) and body (1) of `articles` for the tokens of `terms`.
BM25 = r"""tok AS (SELECT DISTINCT query_id, tok AS term FROM (SELECT query_id, unnest(string_split_regex(t, '[^\p{L}\p{N}]+')) AS tok FROM terms) WHERE tok <> ''),
fields AS (SELECT id, 'title' AS f, 2.0 AS boost, list_filter(string_split_regex(title, '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ts FROM articles
  UNION ALL SELECT id, 'body', 1.0, list_filter(string_split_regex(body, '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM articles),
stats AS (SELECT f, count(*) AS n, avg(len(ts)) AS avgdl FROM fields GROUP BY f),
post AS (SELECT f, boost, id, term, dl, count(*) AS tf FROM (SELECT f, boost, id, len(ts) AS dl, unnest(ts) AS term FROM fields) WHERE term IN (SELECT term FROM tok) GROUP BY ALL),
df AS (SELECT f, term, count(*) AS df FROM post GROUP BY f, term),
bm25 AS (SELECT query_id, id, sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM post JOIN df USING (f, term) JOIN stats USING (f) JOIN tok USING (term) GROUP BY query_id, id),
bm25_route AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM bm25 QUALIFY rank < 20)"""
LEXICAL = """lex AS (SELECT query_id, id, sum(CASE WHEN contains(rule, t) THEN 3.0 ELSE 0 END + CASE WHEN contains(title, t) THEN 2.0 ELSE 0 END + CASE WHEN contains(label, t) THEN 1.5 ELSE 0 END + CASE WHEN contains(body, t) THEN 1.0 ELSE 0 END)::DOUBLE AS score
  FROM articles, terms GROUP BY query_id, id HAVING score > 0),
lexical_route AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM lex QUALIFY rank < 20)"""
HYBRID = """rrf AS (SELECT query_id, id, sum(part) AS score FROM (SELECT query_id, id, 1.0 / (60 + rank + 1) AS part FROM bm25_route UNION ALL SELECT query_id, id, 1.0 / (60 + rank + 1) FROM lexical_route) GROUP BY query_id, id),
hybrid AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM rrf QUALIFY rank < 5)"""
_BASE = f"WITH {ARTICLES}, {QUESTIONS}, {TERMS}"
_OUT = "SELECT query_id, id, round(score, 6) AS score, rank::BIGINT AS rank FROM"


def out(df: DataFrame, *more: str) -> DataFrame:
    return df.select("query_id", "id", F.round("score", 6).alias("score"), "rank", *more)


def titled(hits: DataFrame, titles: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Hits with the titles of their documents; hits are k a query at most and go to the titles while they are few, as first lines may be whole texts."""
    few = queries.count() * k <= R.BROADCAST_TERMS
    return titles.join(F.broadcast(hits) if few else hits, "id")


def _views(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return articles(spark, sf), questions(spark, sf)


@query(f"WITH {QUESTIONS}, {TERMS} SELECT query_id, string_agg(t, '|' ORDER BY p) AS terms, count(*)::BIGINT AS n FROM terms GROUP BY query_id")
def query_terms(spark, sf):
    """Search terms of each question."""
    return questions(spark, sf).select("query_id", X.query_terms("q").alias("t")).select("query_id", F.array_join("t", "|").alias("terms"), F.size("t").cast("long").alias("n"))


@query(f"{_BASE}, {BM25} {_OUT} bm25_route")
def search_bm25(spark, sf):
    """BM25 over title and body, the best 4k."""
    return out(R.bm25_route(*_views(spark, sf), K))


@query(f"{_BASE}, {BM25}, f AS (SELECT r.query_id, r.id, r.score FROM bm25_route r JOIN articles a USING (id) WHERE a.status = 'active') {_OUT} (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM f)")
def post_filter_topk(spark, sf):
    """The filter comes after the cut."""
    return out(R.bm25_route(*_views(spark, sf), K, F.col("status") == "active"))


@query(f"{_BASE}, {LEXICAL} {_OUT} lexical_route")
def search_lexical(spark, sf):
    """Weighted substring scores."""
    return out(R.lexical_route(*_views(spark, sf), K))


@query(f"{_BASE}, {LEXICAL.replace('FROM articles, terms', 'FROM (SELECT * FROM articles WHERE status = ' + chr(39) + 'active' + chr(39) + ') a, terms')} {_OUT} lexical_route")
def pre_filter_topk(spark, sf):
    """The filter comes first."""
    return out(R.lexical_route(*_views(spark, sf), K, R.matches(status="active", rule=" ")))


def _rule_questions(spark, sf):
    """Questions that name a rule: the source of a document, with an ending that rule names have."""
    d = articles(spark, sf, status=False).withColumn("rule", F.concat("rule", F.lit("규정")))
    q = d.filter(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), F.concat("rule", F.lit(" "), "title").alias("q"))
    return d, q


@query(rf"""WITH {ARTICLES}, d AS (SELECT id, rule || '규정' AS rule, doc_id FROM articles), n AS (SELECT count(*) AS n FROM d), q AS (SELECT doc_id AS query_id, rule FROM d WHERE doc_id % 50 = 0),
df AS (SELECT rule, count(*) AS df FROM d GROUP BY rule),
s AS (SELECT query_id, d.id, 3.0 * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2) AS score FROM q JOIN d USING (rule) JOIN df USING (rule), n)
{_OUT} (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) - 1 AS rank FROM s QUALIFY rank < 20)""")
def search_rule_route(spark, sf):
    """Rule names by BM25 for questions that hold one."""
    return out(R.rule_route(*_rule_questions(spark, sf), K))


_VEC = """q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, 'v' || vec_id AS id, list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[]))) AS score FROM embeddings, q{w}),
vector_route AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM s WHERE score IS NOT NULL QUALIFY rank < 20)"""


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    v = e.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), "embedding", "label")
    return v, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query(f"WITH {_VEC.format(w='')} {_OUT} vector_route")
def search_vector(spark, sf):
    """Exact cosine against all vectors."""
    return out(R.vector_route(*_vectors(spark, sf), K))


@query(f"WITH {_VEC.format(w=' WHERE label = 1')} {_OUT} vector_route")
def search_vector_filtered(spark, sf):
    """The filter comes first."""
    return out(R.vector_route(*_vectors(spark, sf), K, F.col("label") == 1))


@query(f"{_BASE}, {BM25}, {LEXICAL}, {HYBRID} {_OUT} hybrid")
def rrf_fuse(spark, sf):
    """Reciprocal-rank fusion of two routes."""
    d, q = _views(spark, sf)
    return out(R.fuse([(R.bm25_route(d, q, K), 1.0), (R.lexical_route(d, q, K), 1.0)], K))


@query(f"""{_BASE}, {BM25}, {LEXICAL}, rrf AS (SELECT query_id, id, sum(part) AS score FROM (SELECT query_id, id, 0.5 / (20 + rank + 1) AS part FROM bm25_route UNION ALL SELECT query_id, id, 2.0 / (20 + rank + 1) FROM lexical_route) GROUP BY query_id, id)
{_OUT} (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM rrf QUALIFY rank < 5)""")
def rrf_weighted(spark, sf):
    """Weights, another constant, and a route of no weight."""
    d, q = _views(spark, sf)
    b = R.bm25_route(d, q, K)
    return out(R.fuse([(b, 0.0), (b, 0.5), (R.lexical_route(d, q, K), 2.0)], K, rrf_k=20))


@query(f"{_BASE}, {BM25}, {LEXICAL}, {HYBRID} SELECT query_id, id, round(score, 6) AS score, rank::BIGINT AS rank, title FROM hybrid JOIN articles USING (id)")
def search_hybrid_topk(spark, sf):
    """3.1: hybrid search over documents, with their titles. The flagship."""
    d, q = _views(spark, sf)
    none = d.filter(F.lit(False))
    hits = R.search(d, none, q, K)["hits"]
    return out(titled(hits, d.select("id", "title"), q, K), "title")


def _full_pack(spark, sf):
    """All that search() takes: articles 제N조, annexes, questions (whole items, and those that name articles, annexes and rules), vectors.

    A document's vector is that of embeddings with its number; a question that names an article has the article's own.
    """
    a = articles(spark, sf, status=False).withColumn("rule", F.concat("rule", F.lit("규정"))).withColumn("label", F.concat(F.lit("제"), F.col("doc_id").cast("string"), F.lit("조"))).withColumn("id", F.concat("rule", F.lit("#"), "label"))
    x = annexes(spark, sf)
    some, named = a.filter("doc_id % 50 = 0"), x.filter("page_id % 50 = 0")
    qa = some.select((F.col("doc_id") + 1000000000).alias("query_id"), F.concat("rule", F.lit("상 "), "label", F.lit("는 무엇인가?")).alias("q"))
    qx = named.select((F.col("page_id") + 2000000000).alias("query_id"), F.concat("rule", F.lit(" 별표 "), F.col("page_id").cast("string"), F.lit(" 기준")).alias("q"))
    qr = some.select((F.col("doc_id") + 3000000000).alias("query_id"), F.concat("rule", F.lit(" 목적")).alias("q"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    vectors = a.select("doc_id", "id").join(e, "doc_id").select("id", "embedding")
    asked = some.select("doc_id").join(e, "doc_id").select((F.col("doc_id") + 1000000000).alias("query_id"), F.col("embedding").alias("query_vector"))
    return a, x, questions(spark, sf).union(qa).union(qx).union(qr), (vectors, asked)


@query()
def search_hybrid_full(spark, sf):
    """3.1: hybrid search of the full pack, articles and annexes, by all routes and pins."""
    a, x, q, vectors = _full_pack(spark, sf)
    titles = a.select("id", "title").union(x.select("id", "title"))
    return out(titled(R.search(a, x, q, K, vectors=vectors)["hits"], titles, q, K), "title", "pinned")


def _refs(spark, sf):
    """Articles labelled 제N조 and annexes, and questions that point at some of them."""
    a = articles(spark, sf).withColumn("label", F.concat(F.lit("제"), F.col("doc_id").cast("string"), F.lit("조"))).withColumn("id", F.concat("rule", F.lit("#"), "label"))
    x = annexes(spark, sf)
    qa = a.select(F.col("doc_id").alias("query_id"), F.concat(F.col("rule"), F.lit("상 "), F.col("label"), F.lit("는 무엇인가?")).alias("q"))
    missing = a.select((F.col("doc_id") + 1000000000).alias("query_id"), F.concat(F.col("rule"), F.lit(" 제999999조는?")).alias("q"))
    qx = x.select((F.col("page_id") + 2000000000).alias("query_id"), F.concat(F.col("rule"), F.lit(" 별표 "), F.col("page_id").cast("string"), F.lit(" 기준")).alias("q"))
    return a, x, qa.union(missing).union(qx)


_PINS = f"""WITH {ARTICLES}, {ANNEXES}, a AS (SELECT doc_id, rule || '#제' || doc_id || '조' AS id FROM articles),
pins AS (SELECT doc_id AS query_id, id FROM a UNION ALL SELECT page_id + 2000000000, id FROM annexes)"""


@query(f"{_PINS} SELECT query_id, id FROM pins")
def pin_direct(spark, sf):
    """Documents that a question names; an article that isn't there leaves no pin."""
    return R.pins(*_refs(spark, sf))


@query(f"""{_PINS}, hits AS (SELECT query_id, 'page#' || r AS id, r AS rank FROM pins CROSS JOIN (VALUES (0), (1), (2)) t(r)),
u AS (SELECT query_id, id, -1 AS rank, TRUE AS pinned FROM pins UNION ALL SELECT h.query_id, h.id, h.rank, FALSE FROM hits h LEFT JOIN pins p ON p.query_id = h.query_id AND p.id = h.id WHERE p.id IS NULL)
SELECT query_id, id, pinned, (row_number() OVER (PARTITION BY query_id ORDER BY rank, id) - 1)::BIGINT AS rank FROM u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, id) <= 3""")
def pin_merge(spark, sf):
    """The pin first, then the other hits."""
    a, x, q = _refs(spark, sf)
    p = R.pins(a, x, q)
    hits = p.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("rank")).select("query_id", F.concat(F.lit("page#"), F.col("rank").cast("string")).alias("id"), F.col("rank").cast("long").alias("rank"), F.lit(1.0).alias("score"))
    return R.merge_pinned(p, hits, 3).select("query_id", "id", "pinned", "rank")


@query(f"WITH {ANNEXES} SELECT page_id AS query_id, id, CASE WHEN page_id % 2 = 0 THEN 110.0 ELSE 100.0 END::DOUBLE AS score, 0::BIGINT AS rank FROM annexes")
def annex_reference_route(spark, sf):
    """Annexes by their label; more if the rule is named before it."""
    x = annexes(spark, sf)
    q = x.select(F.col("page_id").alias("query_id"), F.when(F.col("page_id") % 2 == 0, F.concat(F.col("rule"), F.lit(" "), F.col("label"))).otherwise(F.concat(F.lit("지급 "), F.col("label"))).alias("q"))
    return out(R.annex_route(x, q, K))


@query(f"""{_BASE}, {BM25}, r AS (SELECT query_id, institution, id, row_number() OVER (PARTITION BY query_id, institution ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM bm25 JOIN articles USING (id) QUALIFY rank < 5),
s AS (SELECT query_id, institution || '/' || id AS id, 1.0 / (60 + rank + 1) AS score FROM r)
{_OUT} (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM s QUALIFY rank < 5)""")
def multi_pack_merge(spark, sf):
    """Each institution ranked by itself, then fused once more."""
    d, q = _views(spark, sf)
    hits = R.bm25(d, R.query_tokens(R.with_terms(q)), {"title": 2.0, "body": 1.0}).join(d.select("id", "institution"), "id")
    return out(R.merge_packs(R.ranked(hits, K, ("query_id", "institution")), K))


@query("""WITH q AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 3 = 0 THEN 'rules of ' || source ELSE 'rules of all' END AS q FROM documents), packs AS (SELECT DISTINCT source AS institution FROM documents),
n AS (SELECT query_id, institution FROM q JOIN packs ON contains(replace(q, ' ', ''), institution)) SELECT * FROM n UNION ALL SELECT query_id, institution FROM q, packs WHERE query_id NOT IN (SELECT query_id FROM n)""")
def pack_routing(spark, sf):
    """institutions that a question names by an alias; all if it names none."""
    d = table(spark, sf, "documents")
    q = d.select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("rules of "), "source")).otherwise("rules of all").alias("q"))
    return R.route_packs(d.select(F.col("source").alias("institution")).distinct().withColumn("aliases", F.array("institution")), q)


@query(f"""{_BASE}, {BM25}, h AS (SELECT query_id, institution, id, score, row_number() OVER (PARTITION BY query_id, institution ORDER BY round(score, 9) DESC, id) - 1 AS r FROM bm25 JOIN articles USING (id) QUALIFY r < 6),
lt AS (SELECT query_id, list(DISTINCT regexp_replace(lower(w), '^[!-/:-@\\[-`{{-~]+|[!-/:-@\\[-`{{-~]+$', '', 'g')) AS ts, any_value(lower(q)) AS q FROM words GROUP BY query_id),
c AS (SELECT h.*, lower(rule || chr(1) || title || chr(1) || label || chr(1) || body) AS x, lt.q AS lq, list_filter(ts, lambda t: t <> '') AS ts FROM h JOIN articles a USING (id) JOIN lt USING (query_id) WHERE {_ACTIVE.replace('status', 'a.status')}),
m AS (SELECT *, CASE WHEN contains(x, lq) THEN 'ExactMatch' WHEN len(list_filter(ts, lambda t: NOT contains(x, t))) = 0 AND len(ts) > 0 THEN 'LexicalMatch' ELSE 'SemanticCandidate' END AS match FROM c)
SELECT query_id, institution, id, match, (row_number() OVER (PARTITION BY query_id, institution ORDER BY round(score, 9) DESC, id) - 1)::BIGINT AS rank, round(score, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY query_id, institution ORDER BY round(score, 9) DESC, id) <= 3""")
def compare_rules(spark, sf):
    """The best active documents of each institution with their class of match."""
    d, q = _views(spark, sf)
    topics = q.select("query_id", F.col("q").alias("topic"), F.lit(0).alias("variant_no"), "q")
    return C.compare(d, topics).select("query_id", "institution", "id", "match", "rank", F.round("score", 6).alias("score"))


@query(f"""{_BASE}, {BM25}, h AS (SELECT query_id, id, rank FROM bm25_route WHERE rank < 10), b AS (SELECT query_id, rank, length(body) AS n, least(length(body), 4000) AS need, body FROM h JOIN articles USING (id)),
c AS (SELECT *, coalesce(sum(need) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM b),
e AS (SELECT *, greatest(0, least(need, 24000 - spent)) AS allowed FROM c)
SELECT query_id, rank::BIGINT AS rank, CASE WHEN spent >= 24000 THEN 'omitted' WHEN allowed = n THEN 'full' ELSE 'truncated' END AS body_state, (CASE WHEN spent < 24000 THEN length(substring(body, 1, allowed::INT)) END)::BIGINT AS n_chars FROM e""")
def body_budget(spark, sf):
    """Character limits for each body and for the response."""
    d, q = _views(spark, sf)
    hits = R.bm25_route(d, q, K).filter("rank < 10").join(d.select("id", "body"), "id")
    return C.body_budget(hits, "query_id", "rank").select("query_id", "rank", "body_state", F.length("body").cast("long").alias("n_chars"))


@query()
def snippet(spark, sf):
    """The window with most terms, for final hits."""
    d, q = _views(spark, sf)
    return R.snippets(R.bm25_route(d, q, K).filter("rank < 5"), d, q).select("query_id", "id", "snippet")


def _golden(spark, sf):
    """Questions with the documents that hold their whole item."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    hits = R.occurrences(articles(spark, sf).select("id", "body"), [(("body",), 1.0)], b.select("item"))
    found = hits.join(b, F.col("pattern") == F.col("item")).groupBy("query_id").agg(F.collect_list("id").alias("expect"))
    return b.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("expect", F.array().cast("array<string>")).alias("expect"))


_EVAL = """e AS (SELECT b.item_id AS query_id, a.id FROM benchmark b JOIN articles a ON contains(a.body, b.text)), ok AS (SELECT DISTINCT query_id FROM e JOIN {hits} h USING (query_id, id))"""


@query(f"{_BASE}, {BM25}, {_EVAL.format(hits='(SELECT * FROM bm25_route WHERE rank < 5)')} SELECT item_id AS query_id, item_id IN (SELECT query_id FROM ok) AS hit FROM benchmark")
def eval_hits(spark, sf):
    """hit@5 of each golden question."""
    return A.eval_hits(_golden(spark, sf), R.bm25_route(*_views(spark, sf), K), K)


@query(f"""{_BASE}, {BM25}, {LEXICAL}, e AS (SELECT b.item_id AS query_id, a.id FROM benchmark b JOIN articles a ON contains(a.body, b.text)),
grid AS (SELECT k, w FROM unnest([20, 60, 100]) t(k), unnest([0.5, 1.0, 2.0]) u(w)),
rrf AS (SELECT k, w, query_id, id, sum(part) AS score FROM (SELECT k, w, query_id, id, 1.0 / (k + rank + 1) AS part FROM bm25_route, grid UNION ALL SELECT k, w, query_id, id, w / (k + rank + 1) FROM lexical_route, grid) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY k, w, query_id ORDER BY round(score, 9) DESC, id) AS r FROM rrf QUALIFY r <= 5),
ok AS (SELECT DISTINCT k, w, query_id FROM top JOIN e USING (query_id, id))
SELECT k::INTEGER AS rrf_k, w::DOUBLE AS weight, count(ok.query_id)::BIGINT AS hits FROM grid LEFT JOIN ok USING (k, w) GROUP BY k, w""")
def sweep_grid(spark, sf):
    """P10: hits for each constant and weight, with the parameters as a dimension of one plan."""
    d, q = _views(spark, sf)
    grid = spark.createDataFrame([(k, w) for k in (20, 60, 100) for w in (0.5, 1.0, 2.0)], "rrf_k int, weight double")
    part = lambda r, w, o: r.crossJoin(F.broadcast(grid)).select("rrf_k", "weight", "query_id", "id", F.lit(o).alias("o"), (w / (F.col("rrf_k") + F.col("rank") + 1)).alias("p"))  # noqa: E731  nine rows
    rows = part(R.bm25_route(d, q, K), F.lit(1.0), 0).union(part(R.lexical_route(d, q, K), F.col("weight"), 1))
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("o", "p"))), F.lit(0.0), lambda s, x: s + x["p"])
    top = R.ranked(rows.groupBy("rrf_k", "weight", "query_id", "id").agg(total.alias("score")), K, ("rrf_k", "weight", "query_id"))
    want = _golden(spark, sf).select("query_id", F.explode("expect").alias("id"))
    ok = top.join(want, ["query_id", "id"], "left_semi").select("rrf_k", "weight", "query_id").distinct().groupBy("rrf_k", "weight").agg(F.count("*").alias("hits"))
    return grid.join(ok, ["rrf_k", "weight"], "left").select("rrf_k", "weight", F.coalesce("hits", F.lit(0)).alias("hits"))

