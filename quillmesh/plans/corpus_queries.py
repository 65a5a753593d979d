"""Queries of documents, graph, sequences, extraction, verification, logs and store, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.python import similarity
from ..operators import audit as A
from ..operators import documents as D
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import sequence as S
from ..registry import query
from ..sources.shared import shared_folder
from .views import ANNEXES, ARTICLES, EDGES, annexes, articles, edges, table

_A = f"WITH {ARTICLES}"


@query(f"{_A} SELECT institution, rule, count(*)::BIGINT AS article_count, max(effective) AS effective, rule AS slug FROM articles GROUP BY institution, rule")
def rule_summaries(spark, sf):
    """A1: documents and latest date of each rule."""
    return D.rule_summaries(articles(spark, sf))


@query(f"{_A}, n AS (SELECT institution, effective, count(*) AS n FROM articles GROUP BY ALL) SELECT institution, effective FROM n QUALIFY row_number() OVER (PARTITION BY institution ORDER BY n DESC, effective) = 1")
def modal_effective(spark, sf):
    """A3: the commonest date, the earliest of several."""
    return D.modal_effective(articles(spark, sf))


_PAGED = """p AS (SELECT 's' || l_suppkey AS id, min(l_linenumber) AS a, max(l_linenumber) AS b FROM lineitem GROUP BY l_suppkey)"""


def _paged(spark, sf):
    x = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"))
    return x.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("id"), F.array("a", "b").alias("pages"))


@query(f"WITH {_PAGED}, e AS (SELECT DISTINCT id, unnest(range(a, b + 1)) AS page FROM p) SELECT page::INTEGER AS page, string_agg(id, ',' ORDER BY id) AS owners FROM e GROUP BY page")
def page_owners(spark, sf):
    """Which documents cover a page."""
    return D.page_owners(_paged(spark, sf)).select("page", F.array_join("owner_ids", ",").alias("owners"))


@query("""WITH pages_ AS (SELECT lang AS institution, (doc_id % 1000)::INTEGER AS page, min(text) AS text FROM documents WHERE lang <> 'es' GROUP BY ALL),
q AS (SELECT doc_id AS query_id, CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'xx' WHEN 2 THEN 'es' ELSE lang END AS institution, (doc_id % 1000 + CASE WHEN doc_id % 7 = 0 THEN 5000 ELSE 0 END)::INTEGER AS page FROM documents)
SELECT query_id, q.institution, q.page, length(text)::BIGINT AS n_chars, CASE WHEN q.institution = '' THEN 'institution required' WHEN q.institution = 'xx' THEN 'unknown institution' WHEN q.institution = 'es' THEN 'no source pages' WHEN text IS NULL THEN 'page not found' END AS error
FROM q LEFT JOIN pages_ p ON p.institution = q.institution AND p.page = q.page""")
def source_page(spark, sf):
    """page lookups with their four kinds of failure."""
    d = table(spark, sf, "documents")
    pages = d.filter("lang != 'es'").groupBy(F.col("lang").alias("institution"), (F.col("doc_id") % 1000).cast("int").alias("page")).agg(F.min("text").alias("text"))
    m = F.col("doc_id") % 5
    inst = F.when(m == 0, "").when(m == 1, "xx").when(m == 2, "es").otherwise(F.col("lang"))
    q = d.select(F.col("doc_id").alias("query_id"), inst.alias("institution"), (F.col("doc_id") % 1000 + F.when(F.col("doc_id") % 7 == 0, 5000).otherwise(0)).cast("int").alias("page"))
    owners = spark.createDataFrame([], "page int, owner_ids array<string>")
    out = D.source_page(q, pages, owners, d.select(F.col("lang").alias("institution")).distinct())
    return out.select("query_id", "institution", "page", F.length("text").cast("long").alias("n_chars"), "error")


@query(f"{_A}, q AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 3 = 0 THEN 'none#' || doc_id ELSE id END AS id FROM articles) SELECT query_id, q.id, a.id IS NOT NULL AS found, title, coalesce(effective, '2026-01-01') AS effective, status FROM q LEFT JOIN articles a ON a.id = q.id")
def get_by_id(spark, sf):
    """Documents by id; what is missing keeps its pack's date."""
    a = articles(spark, sf)
    q = a.select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("none#"), "label")).otherwise(F.col("id")).alias("id"))
    return D.get_by_id(q, a, spark.createDataFrame([("2026-01-01",)], "effective string"))


@query(f"{_A}, q AS (SELECT doc_id AS query_id, CASE doc_id % 3 WHEN 0 THEN institution || '/' || id WHEN 1 THEN 'zz/' || id ELSE institution || '/x' END AS id FROM articles) SELECT query_id, CASE WHEN query_id % 3 = 0 THEN string_split(id, '/')[1] ELSE 'en' END AS institution, CASE WHEN query_id % 3 = 0 THEN substring(id, strpos(id, '/') + 1) ELSE id END AS local_id FROM q")
def resolve_ids(spark, sf):
    """ids with an institution in front."""
    a = articles(spark, sf)
    m = F.col("doc_id") % 3
    q = a.select(F.col("doc_id").alias("query_id"), F.when(m == 0, F.concat("institution", F.lit("/"), "id")).when(m == 1, F.concat(F.lit("zz/"), "id")).otherwise(F.concat("institution", F.lit("/x"))).alias("id"))
    return D.resolve_ids(q, a.select("institution").distinct(), "en")


@query(f"{_A} SELECT id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM articles WINDOW w AS (PARTITION BY institution, rule ORDER BY doc_id, label)")
def neighbors(spark, sf):
    """Previous and next document of a rule in natural order."""
    return D.neighbors(articles(spark, sf)).select("id", "prev_id", "next_id")


_LABELS = "'제' || doc_id % 30 + 1 || '조' || CASE WHEN doc_id % 3 = 0 THEN '의' || doc_id % 7 + 1 ELSE '' END"


@query(f"SELECT doc_id, {_LABELS} AS label, (row_number() OVER (PARTITION BY source ORDER BY doc_id % 30 + 1, CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 + 1 ELSE 0 END, {_LABELS}, doc_id))::BIGINT AS place FROM documents")
def natural_order(spark, sf):
    """제19조 < 제19조의2 < 제20조."""
    from pyspark.sql import Window

    d = table(spark, sf, "documents")
    s = lambda c: c.cast("string")
    label = F.concat(F.lit("제"), s(F.col("doc_id") % 30 + 1), F.lit("조"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("의"), s(F.col("doc_id") % 7 + 1))).otherwise(""))
    d = d.select("doc_id", "source", label.alias("label"))
    key = X.article_order("label")
    place = F.row_number().over(Window.partitionBy("source").orderBy(key["n"], key["m"], key["label"], "doc_id")).cast("long")
    return d.select("doc_id", "label", place.alias("place"))


@query(f"{_A} SELECT status, count(*)::BIGINT AS n FROM articles WHERE status <> 'repealed' AND institution = 'en' GROUP BY status")
def active_filter(spark, sf):
    """filters on equality and status; blank values don't count."""
    a = articles(spark, sf).filter(X.is_active("status") & R.matches(institution="en", rule="  "))
    return a.groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT 'order:' || o_orderkey AS id, 'law' || l_linenumber AS law, l_partkey::VARCHAR AS article FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def legal_basis_explode(spark, sf):
    """F8: the legal bases of documents, one row each."""
    li = table(spark, sf, "lineitem")
    item = F.struct(F.concat(F.lit("law"), F.col("l_linenumber").cast("string")).alias("law"), F.col("l_partkey").cast("string").alias("article"))
    docs = li.groupBy("l_orderkey").agg(F.collect_list(item).alias("legal_basis")).select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("id"), "legal_basis")
    known = table(spark, sf, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"))
    return D.legal_basis(docs.join(known, "id"))


# Graph

@query(f"WITH {EDGES} SELECT kind, count(*)::BIGINT AS n, count(DISTINCT src)::BIGINT AS n_src, count(DISTINCT dst)::BIGINT AS n_dst FROM edges GROUP BY kind")
def ref_graph(spark, sf):
    """Typed edges by kind."""
    return edges(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"))


def _starts(spark, sf):
    e = edges(spark, sf)
    return e, e.filter("kind = 'ApplyMutatis'").select(F.col("src").alias("id")).union(e.filter("kind = 'Delegates'").select("dst")).distinct()


_STARTS = "starts AS (SELECT src AS id FROM edges WHERE kind = 'ApplyMutatis' UNION SELECT dst FROM edges WHERE kind = 'Delegates')"
_CLOSURE = "reach AS (SELECT id, id AS reached FROM starts UNION SELECT r.id, e.dst FROM reach r JOIN edges e ON e.src = r.reached AND e.kind IN ('Delegates', 'ApplyMutatis')), closure AS (SELECT * FROM reach WHERE id <> reached)"


@query(f"WITH {EDGES}, {_STARTS} SELECT DISTINCT id, src AS neighbor FROM starts JOIN edges ON dst = id WHERE kind IN ('Cites', 'ApplyMutatis', 'Delegates', 'LegalBasis')")
def reverse_neighbors(spark, sf):
    """What points at a node."""
    return G.reverse_neighbors(*_starts(spark, sf))


@query(f"WITH RECURSIVE {EDGES}, {_STARTS}, {_CLOSURE} SELECT id, reached FROM closure")
def forward_closure(spark, sf):
    """Everything a node leads to by delegation."""
    return G.forward_closure(*_starts(spark, sf))


@query(f"""WITH RECURSIVE {EDGES}, {_STARTS}, {_CLOSURE}, rev AS (SELECT DISTINCT id, src AS x FROM starts JOIN edges ON dst = id),
al AS (SELECT id, x FROM rev UNION SELECT id, reached FROM closure)
SELECT id, (SELECT count(*) FROM rev r WHERE r.id = s.id)::BIGINT AS n_reverse, coalesce((SELECT string_agg(reached, ',' ORDER BY reached) FROM closure c WHERE c.id = s.id), '') AS chain, (SELECT count(*) FROM al a WHERE a.id = s.id)::BIGINT AS n_affected FROM starts s""")
def impact(spark, sf):
    """Citing nodes, delegation chain, and their union."""
    out = G.impact(*_starts(spark, sf))
    return out.select("id", F.size("reverse_citations").cast("long").alias("n_reverse"), F.array_join("delegation_chain", ",").alias("chain"), F.size("affected").cast("long").alias("n_affected"))


@query(f"""WITH {EDGES}, nodes AS (SELECT 'customer:' || c_custkey AS id FROM customer UNION SELECT 'nation:' || n_nationkey FROM nation UNION SELECT 'supplier:' || s_suppkey FROM supplier)
SELECT (SELECT count(*) FROM nodes)::BIGINT AS n_nodes, count(*)::BIGINT AS n_edges, count_if(kind = 'Cites')::BIGINT AS n_cites, count_if(kind = 'ApplyMutatis')::BIGINT AS n_applymutatis, count_if(kind = 'Delegates')::BIGINT AS n_delegates, 0::BIGINT AS n_exceptwhen, 0::BIGINT AS n_legalbasis,
 (SELECT count(*) FROM (SELECT DISTINCT * FROM edges WHERE src NOT IN (SELECT id FROM nodes) OR dst NOT IN (SELECT id FROM nodes)))::BIGINT AS n_broken, (SELECT count(*) FROM nodes WHERE id NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges))::BIGINT AS n_orphans FROM edges""")
def graph_quality(spark, sf):
    """Counts of a graph, broken edges and orphans."""
    node = lambda n, p, c: table(spark, sf, n).select(F.concat(F.lit(p), F.col(c).cast("string")).alias("id"))
    nodes = node("customer", "customer:", "c_custkey").union(node("nation", "nation:", "n_nationkey")).union(node("supplier", "supplier:", "s_suppkey"))
    return G.graph_quality(nodes, edges(spark, sf))


@query("SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, 'Cites' AS kind, min(l_orderkey * 10 + l_linenumber)::BIGINT AS place FROM lineitem GROUP BY ALL")
def edge_dedup(spark, sf):
    """T4: one edge for each (src, dst, kind), the first inserted."""
    li = table(spark, sf, "lineitem")
    e = li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), F.lit("Cites").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return G.dedup_edges(e)


@query("SELECT 'order:' || o_orderkey AS src, 'customer:' || o_custkey AS dst FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def unresolved_refs(spark, sf):
    """References without a target."""
    e = edges(spark, sf).filter("kind = 'Cites'")
    c = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    return A.unresolved(e, c).select("src", "dst")


@query("""WITH d AS (SELECT 'order:' || o_orderkey AS src, 'part:' || o_custkey AS x, o_orderkey FROM orders)
SELECT DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN '근로기준법#제' || o_orderkey % 9 || '조' ELSE '규정#제' || o_orderkey % 9 || '조' END AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'LawArticle' ELSE 'Article' END AS kind, TRUE AS unresolved_ref FROM d""")
def external_nodes(spark, sf):
    """Placeholder nodes for targets without a document."""
    o = table(spark, sf, "orders")
    name = F.when(F.col("o_orderkey") % 2 == 0, "근로기준법").otherwise("규정")
    target = F.concat(name, F.lit("#제"), (F.col("o_orderkey") % 9).cast("string"), F.lit("조"))
    docs = o.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("id"), F.array(F.struct(target.alias("target"), F.lit("준용").alias("kind"))).alias("refs"), F.array().cast("array<struct<law:string,article:string>>").alias("legal_basis"))
    return G.external_nodes(G.document_edges(docs), docs)


# Sequences

@query("""WITH d AS (SELECT DISTINCT l_suppkey AS k, date_diff('day', TIMESTAMP '1992-01-01', l_shipdate)::INTEGER AS v FROM lineitem), g AS (SELECT k, v, v - row_number() OVER (PARTITION BY k ORDER BY v) AS g FROM d)
SELECT k, min(v) AS first, max(v) AS last FROM g GROUP BY k, g""")
def gaps_islands(spark, sf):
    """Runs of consecutive days."""
    days = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.datediff("l_shipdate", F.lit("1992-01-01")).alias("v"))
    return S.islands(days, "k", "v")


@query("SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) = 1")
def first_occurrence(spark, sf):
    """The first row of each key."""
    return S.first_occurrence(table(spark, sf, "lineitem"), ["l_suppkey", "l_partkey"], ["l_orderkey", "l_linenumber"]).select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")


@query("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) > 1 THEN lang || '-' || row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) ELSE lang END AS label FROM documents")
def numbered_repeats(spark, sf):
    """Repeated labels get a number."""
    return S.numbered_repeats(table(spark, sf, "documents").select("doc_id", "source", F.col("lang").alias("label")), ["source"], ["doc_id"], "label").select("doc_id", "label")


@query("""WITH e AS (SELECT l_orderkey AS document, l_linenumber AS line, l_linenumber * 3 + (l_partkey % 3)::INTEGER AS start FROM lineitem)
SELECT document, line, start, greatest(start, coalesce(lead(start) OVER (PARTITION BY document ORDER BY line, start) - 1, 40)) AS end_page FROM e""")
def toc_end_page(spark, sf):
    """Where an entry of a table of contents ends."""
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") * 3 + (F.col("l_partkey") % 3).cast("int")).alias("start"), F.lit(40).alias("last"))
    return S.toc_end_pages(e, "document", "start", ["line", "start"], "last").select("document", "line", "start", "end_page")


@query("""WITH g AS (SELECT l_suppkey AS document, l_linenumber AS page, l_returnflag AS profile, count(*) AS n FROM lineitem GROUP BY ALL),
full_ AS (SELECT d.document, p.page::INTEGER AS page, f.profile, coalesce(g.n, 0) AS n FROM (SELECT DISTINCT document FROM g) d, unnest(range(1, 8)) p(page), (SELECT DISTINCT profile FROM g) f LEFT JOIN g ON g.document = d.document AND g.page = p.page AND g.profile = f.profile),
c AS (SELECT *, sum(n) OVER (PARTITION BY document, profile ORDER BY page) AS upto FROM full_),
r AS (SELECT a.document, a.profile, a.page AS s, b.page AS e, b.upto - a.upto + a.n AS total FROM c a JOIN c b ON a.document = b.document AND a.profile = b.profile AND a.page <= b.page)
SELECT document, s AS start, e AS "end", total::BIGINT AS total FROM r WHERE total > 0 QUALIFY row_number() OVER (PARTITION BY document ORDER BY total DESC, e - s, s DESC) = 1""")
def toc_range_search(spark, sf):
    """The page range and profile with most matches."""
    li = table(spark, sf, "lineitem")
    g = li.groupBy(F.col("l_suppkey").alias("document"), F.col("l_linenumber").alias("page"), F.col("l_returnflag").alias("profile")).agg(F.count("*").alias("n"))
    grid = li.select(F.col("l_suppkey").alias("document")).distinct().withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(7)))).crossJoin(F.broadcast(li.select(F.col("l_returnflag").alias("profile")).distinct()))  # three flags
    g = grid.join(g, ["document", "page", "profile"], "left").na.fill(0, ["n"])
    return S.best_range(g, "document", "page", "profile", "n")


@query("""WITH p AS (SELECT conv_id, turn, text, length(text) AS n FROM conversations WHERE length(text) > 0) SELECT conv_id, turn, coalesce(sum(n + 1) OVER w, 0)::BIGINT AS start, (coalesce(sum(n + 1) OVER w, 0) + n)::BIGINT AS "end" FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def page_spans(spark, sf):
    """Character spans of parts joined by a separator."""
    return S.spans(table(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


_INTERVALS = """a AS (SELECT user_id AS k, event_id, date_diff('second', TIMESTAMP '2020-01-01', ts)::BIGINT AS a_start, a_start + 86400 AS a_end FROM events WHERE event_type = 'purchase'),
b AS (SELECT user_id AS k, event_id AS other, date_diff('second', TIMESTAMP '2020-01-01', ts)::BIGINT AS b_start, b_start + 43200 AS b_end FROM events WHERE event_type = 'view')"""


def _seconds(at="ts"):
    return F.unix_timestamp(F.col(at)) - F.unix_timestamp(F.lit("2020-01-01 00:00:00").cast("timestamp"))


@query(f"WITH {_INTERVALS} SELECT event_id, other FROM a JOIN b ON a.k = b.k AND b_start < a_end AND b_end > a_start")
def interval_overlap(spark, sf):
    """Overlapping intervals of a key, met in cells."""
    e = table(spark, sf, "events").withColumn("s", _seconds())
    a = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("k"), "event_id", F.col("s").alias("a_start"), (F.col("s") + 86400).alias("a_end"))
    b = e.filter("event_type = 'view'").select(F.col("user_id").alias("k"), F.col("event_id").alias("other"), F.col("s").alias("b_start"), (F.col("s") + 43200).alias("b_end"))
    return S.overlapping(a, b, "k", 86400).select("event_id", "other")


@query("""WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), m AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase')
SELECT event_id, (SELECT min(m.ts) FROM m WHERE m.user_id = e.user_id AND m.ts > e.ts) AS next_mark FROM e""")
def asof_next(spark, sf):
    """The next mark after each event, by one sort."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    out = S.next_after(e.filter("event_type = 'click'").drop("event_type"), e.filter("event_type = 'purchase'").select("user_id", "ts"), "user_id", "ts")
    return out.select("event_id", "next_mark")


@query("""WITH p AS (SELECT l_orderkey AS document, l_linenumber AS page, (l_partkey % 5)::INTEGER AS printed FROM lineitem), m AS (SELECT document, printed, min(page) AS physical FROM p GROUP BY ALL)
SELECT p.document, p.page, coalesce(physical, p.page) AS start_page FROM p LEFT JOIN m ON m.document = p.document AND m.printed = p.page""")
def printed_page_map(spark, sf):
    """Printed to physical pages, with the page itself where there is no match."""
    p = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("page"), (F.col("l_partkey") % 5).cast("int").alias("printed"))
    m = p.groupBy("document", F.col("printed").alias("page")).agg(F.min("page").alias("physical"))
    return p.select("document", "page").join(m, ["document", "page"], "left").select("document", "page", F.coalesce("physical", "page").alias("start_page"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), h AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, ls FROM l)
SELECT doc_id, i::BIGINT AS section, length(ls[i])::BIGINT AS n_chars, left(ls[i], 20) AS head FROM h WHERE length(ls[i]) > 0""")
def slice_bodies(spark, sf):
    """A text cut at its headings (here: lines)."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return d.filter("line != ''").select("doc_id", (F.col("i") + 1).cast("long").alias("section"), F.length("line").cast("long").alias("n_chars"), F.left("line", F.lit(20)).alias("head"))


# Extraction and scalars

_DATED = "'개정 ' || year(o_orderdate) || '. ' || month(o_orderdate) || '. ' || day(o_orderdate) || '., 시행 1999. 13. 45., ' || year(o_orderdate) || '.1.2.'"


@query(f"SELECT o_orderkey, strftime(greatest(o_orderdate::DATE, make_date(year(o_orderdate), 1, 2)), '%Y-%m-%d') AS latest FROM orders")
def latest_date(spark, sf):
    """The latest valid date of a text."""
    o = table(spark, sf, "orders")
    d = F.col("o_orderdate")
    text = F.concat(F.lit("개정 "), F.year(d), F.lit(". "), F.month(d), F.lit(". "), F.day(d), F.lit("., 시행 1999. 13. 45., "), F.year(d), F.lit(".1.2."))
    return o.select("o_orderkey", X.latest_date(text).alias("latest"))


def _rule_texts(spark, sf):
    """Documents as texts of rules: a first article with a legal basis in front, a second one behind."""
    return table(spark, sf, "documents").select(F.col("source").alias("document"), F.col("doc_id").cast("string").alias("code"), F.concat(F.col("source"), F.lit("규정")).alias("rule"), F.lit(1).alias("start_page"), F.lit(1).alias("end_page"), F.concat(F.lit("제1조(목적) 「근로기준법」 제60조에 따라 "), F.col("source"), F.lit("규정 제2조의3을 준용한다. "), F.col("text"), F.lit("\n제2조(용어) 별표 1에 따른다.")).alias("text"), F.array(F.struct(F.lit(1).alias("page"), F.lit(0).alias("start"), F.lit(100000).alias("end"))).alias("spans"))


@query()
def extract_refs(spark, sf):
    """References of texts."""
    from ..operators.extract import parse_rules

    out = parse_rules(_rule_texts(spark, sf))
    return out.select("code", "kind", "label", "title", F.array_join(F.transform("refs", lambda r: F.concat(r["target"], F.lit(":"), r["kind"])), ";").alias("refs"))


@query()
def extract_legal_basis(spark, sf):
    """The legal bases of parsed texts, one row each."""
    from ..operators.extract import parse_rules

    return D.legal_basis(parse_rules(_rule_texts(spark, sf)).withColumn("id", F.concat("code", F.lit("#"), "label")))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN left(sha256('!!!'), 12) ELSE regexp_replace(regexp_replace(source || ' ' || lang || ' / A-1. rules!', '\\s+', '', 'g'), '[^A-Za-z0-9_.-]+', '', 'g') END AS slug FROM documents")
def slugify(spark, sf):
    """Names without spaces and signs."""
    name = F.when(F.col("doc_id") % 10 == 0, "!!!").otherwise(F.concat("source", F.lit(" "), "lang", F.lit(" / A-1. rules!")))
    return table(spark, sf, "documents").select("doc_id", X.slugify(name).alias("slug"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM conversations WHERE role = 'user'")
def normalize_question(spark, sf):
    """The normal form of a question."""
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn", X.normalize_question("text").alias("key"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS picked FROM events")
def json_pick(spark, sf):
    """The text that a streamed JSON line carries."""
    e = table(spark, sf, "events")
    line = F.concat(F.lit('{"delta":{"content":"'), F.get_json_object("props", "$.k"), F.lit('"}}'))
    return e.select("event_id", X.json_delta(line).alias("picked"))


@query("""WITH c AS (SELECT conv_id, turn, 'See [규정' || conv_id || '#제' || turn || '조] and [규정#제3조의2], [규정#제3조의2].' AS t FROM conversations)
SELECT conv_id, turn, '규정' || conv_id || '#제' || turn || '조|규정#제3조의2' AS cited FROM c""")
def citations_extract(spark, sf):
    """Citations of an answer, each once."""
    c = table(spark, sf, "conversations")
    s = lambda x: F.col(x).cast("string")
    text = F.concat(F.lit("See [규정"), s("conv_id"), F.lit("#제"), s("turn"), F.lit("조] and [규정#제3조의2], [규정#제3조의2]."))
    return c.select("conv_id", "turn", F.array_join(X.citation_labels(text), "|").alias("cited"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE '' END AS kept, o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 AND o_orderkey % 3 = 1 AS complete
FROM (SELECT o_orderkey FROM orders)""")
def csr_flag(spark, sf):
    """Citations that the context holds, and whether it holds all; none counts as all."""
    o = table(spark, sf, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    cited = F.when(k % 3 == 0, F.when(k % 2 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))).when(k % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    context = F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("c")))
    kept, complete = A.citations_in_context(cited, context)
    return o.select("o_orderkey", F.array_join(kept, ",").alias("kept"), complete.alias("complete"))


@query(r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: length(trim(l)) BETWEEN 1 AND 4)) >= 10 OR contains(text, 'No.') AS sensitive, len(list_filter(string_split_regex(text, '\n{2,}'), lambda p: trim(p, E' \n\t') <> ''))::BIGINT AS n_paragraphs, CASE WHEN length(text) > 42 THEN left(text, 42) || '…' ELSE text END AS preview FROM documents")
def text_marks(spark, sf):
    """Signs of tables, paragraphs and previews."""
    return table(spark, sf, "documents").select("doc_id", X.table_sensitive("text").alias("sensitive"), F.size(X.paragraphs("text")).cast("long").alias("n_paragraphs"), X.preview("text").alias("preview"))


# Quality, verification, evaluation

@query("""WITH o AS (SELECT DISTINCT l_suppkey AS document, l_partkey % 50 AS page FROM lineitem), x AS (SELECT document, page FROM o WHERE page < 3), e AS (SELECT * FROM o EXCEPT SELECT * FROM x), c AS (SELECT DISTINCT l_suppkey AS document, l_partkey % 50 AS page FROM lineitem WHERE l_quantity > 25)
SELECT e.document, count(*)::BIGINT AS eligible, count(c.page)::BIGINT AS covered, round(100.0 * count(c.page) / count(*), 2)::DOUBLE AS percent FROM e LEFT JOIN c USING (document, page) GROUP BY e.document""")
def coverage(spark, sf):
    """Pages that items cover."""
    o = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("document"), (F.col("l_partkey") % 50).alias("page"), "l_quantity")
    return A.coverage(o, o.filter("l_quantity > 25"), o.filter("page < 3").select("document", "page"))


@query("""WITH r AS (SELECT source AS rule, min(doc_id) AS a, min(doc_id) + 12 AS b FROM documents GROUP BY source), n AS (SELECT source AS rule, count(*) AS n FROM documents WHERE lang = 'es' GROUP BY source)
SELECT r.rule, coalesce(n, 0)::BIGINT AS n_articles FROM r LEFT JOIN n USING (rule) WHERE coalesce(n, 0) <= 12""")
def suspicious(spark, sf):
    """Long rules with few articles."""
    d = table(spark, sf, "documents")
    rules = d.groupBy(F.col("source").alias("rule")).agg(F.min("doc_id").alias("start_page"), (F.min("doc_id") + 12).alias("end_page"))
    return A.suspicious(rules, d.filter("lang = 'es'").select(F.col("source").alias("rule")), few=12).select("rule", "n_articles")


@query("""WITH h AS (SELECT source AS rule, lang AS key, doc_id AS position FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY rule, key ORDER BY position) AS occurrence FROM h)
SELECT rule, key, position, occurrence::BIGINT AS occurrence FROM n WHERE occurrence > 1 AND key <> 'fr'""")
def skipped_headings(spark, sf):
    """Second and later headings of a key that was emitted."""
    h = table(spark, sf, "documents").select(F.col("source").alias("rule"), F.col("lang").alias("key"), F.col("doc_id").alias("position"))
    return A.skipped_headings(h, h.filter("key != 'fr'")).select("rule", "key", "position", F.col("occurrence").cast("long").alias("occurrence"))


_PAIR_SQL = r"""p AS (SELECT a.doc_id AS pair_id, a.text AS e, b.text AS x FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
te AS (SELECT pair_id, t, count(*) AS n FROM (SELECT pair_id, unnest(string_split_regex(e, '[^\p{L}\p{N}]+')) AS t FROM p) WHERE length(t) > 1 GROUP BY ALL),
tx AS (SELECT pair_id, t, count(*) AS n FROM (SELECT pair_id, unnest(string_split_regex(x, '[^\p{L}\p{N}]+')) AS t FROM p) WHERE length(t) > 1 GROUP BY ALL),
ov AS (SELECT te.pair_id, sum(least(te.n, coalesce(tx.n, 0))) / sum(te.n) AS o FROM te LEFT JOIN tx USING (pair_id, t) GROUP BY te.pair_id)"""


def _pairs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("expected")).join(d.select((F.col("doc_id") - 1).alias("pair_id"), F.col("text").alias("actual")), "pair_id")


@query(f"WITH {_PAIR_SQL} SELECT p.pair_id, round(coalesce(o, 1.0), 6)::DOUBLE AS overlap FROM p LEFT JOIN ov USING (pair_id)")
def token_overlap(spark, sf):
    """Share of expected words that another text has, repeats counted."""
    return A.token_overlap(_pairs(spark, sf), "expected", "actual").select("pair_id", F.round("overlap", 6).alias("overlap"))


@query()
def similarity_score(spark, sf):
    """Similarity of a question and its answer, and the verdict."""
    c = S.previous_by_role(table(spark, sf, "conversations"), "conv_id", "turn").filter("role = 'assistant' and previous is not null")
    s = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), similarity(F.col("previous"), F.col("text")).alias("score"))
    return s.select("pair_id", F.round("score", 4).alias("score"), A.verdict(F.col("score")).alias("status"))


@query(f"WITH {_PAIR_SQL}, s AS (SELECT p.pair_id, lang AS institution, CASE WHEN coalesce(o, 1.0) >= 0.9 THEN 'match' WHEN coalesce(o, 1.0) >= 0.6 THEN 'partial' ELSE 'mismatch' END AS status FROM p LEFT JOIN ov USING (pair_id) JOIN documents d ON d.doc_id = p.pair_id) SELECT institution, count_if(status = 'match')::BIGINT AS match, count_if(status = 'partial')::BIGINT AS partial, count_if(status = 'mismatch')::BIGINT AS mismatch FROM s GROUP BY institution")
def verify_summary(spark, sf):
    """A10: verdicts of each institution, zeros kept."""
    o = A.token_overlap(_pairs(spark, sf), "expected", "actual")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("pair_id"), F.col("lang").alias("institution"))
    return A.verdict_summary(o.join(d, "pair_id").select("institution", A.verdict(F.col("overlap")).alias("status")))


@query("""WITH s AS (SELECT l_orderkey AS item_id, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS recorded, l_linenumber AS page, l_quantity AS score FROM lineitem)
SELECT item_id, recorded, page AS actual, recorded - page AS distance FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, page) = 1""")
def page_diagnosis(spark, sf):
    """The page that fits best, and how far it is from the recorded one."""
    li = table(spark, sf, "lineitem")
    last = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("recorded"))
    s = li.join(last, "l_orderkey").select(F.col("l_orderkey").alias("item_id"), "recorded", F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("score"))
    return A.best_page(s)


@query()
def balanced_sample(spark, sf):
    """Round-robin sample over rules."""
    return S.balanced_sample(articles(spark, sf), "rule", "id", 40).select("rule", "id", "turn")


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def p95_nearest_rank(spark, sf):
    """Nearest-rank percentile."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


# Integrity, logs, store

@query("""WITH f AS (SELECT 'doc/' || doc_id || '.md' AS path, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 0), m AS (SELECT 'doc/' || doc_id || '.md' AS path, CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE upper(sha256(text)) END AS h FROM documents WHERE doc_id % 17 <> 0 UNION ALL SELECT '../evil', 'x')
SELECT coalesce(f.path, m.path) AS path, CASE WHEN m.path = '../evil' THEN 'unsafe' WHEN m.path IS NULL THEN 'unlisted' WHEN f.path IS NULL THEN 'missing' WHEN lower(f.h) <> lower(m.h) THEN 'mismatch' ELSE 'ok' END AS state FROM f FULL JOIN m ON f.path = m.path""")
def manifest_verify(spark, sf):
    """Files against a manifest."""
    from ..sources.packs import verify

    d = table(spark, sf, "documents")
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md"))
    files = d.filter("doc_id % 11 != 0").select(path.alias("path"), F.sha2("text", 256).alias("sha256"))
    listed = d.filter("doc_id % 17 != 0").select(path.alias("path"), F.when(F.col("doc_id") % 13 == 0, "x").otherwise(F.upper(F.sha2("text", 256))).alias("sha256"))
    return verify(files, listed.union(spark.createDataFrame([("../evil", "x")], "path string, sha256 string")))


@query("SELECT sha256(text) AS hash, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_hash(spark, sf):
    """Documents with equal digests."""
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


_QLOG = r"q AS (SELECT conv_id * 1000 + turn AS ord, text AS question, conv_id % 4 = 0 AS miss, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM conversations WHERE role = 'user')"


def _qlog(spark, sf):
    c = table(spark, sf, "conversations").filter("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.col("text").alias("question"), (F.col("conv_id") % 4 == 0).alias("miss"))


@query(f"WITH {_QLOG} SELECT key, count(*)::BIGINT AS n, min(ord)::BIGINT AS first_ord, arg_min(question, ord) AS example, count_if(miss)::BIGINT AS misses FROM q WHERE key <> '' GROUP BY key")
def qlog_top(spark, sf):
    """Questions by normal form."""
    return A.top_questions(_qlog(spark, sf))


@query(f"WITH {_QLOG} SELECT key, count_if(miss)::BIGINT AS misses FROM q WHERE key <> '' GROUP BY key HAVING count_if(miss) > 0")
def qlog_miss(spark, sf):
    """Questions that found nothing."""
    return A.top_questions(_qlog(spark, sf)).filter("misses > 0").select("key", "misses")


@query("SELECT coalesce(nullif(trim(CASE WHEN event_id % 7 = 0 THEN ' ' ELSE event_type END), ''), '미지정') AS reason, count(*)::BIGINT AS n, min(event_id) AS first_ord FROM events GROUP BY 1")
def reason_counts(spark, sf):
    """Diagnostics by reason."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("ord"), F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.col("event_type")).alias("reason"))
    return A.reason_counts(e)


@query("SELECT event_id FROM events WHERE value > 50 AND event_type <> 'error'")
def consent_gate(spark, sf):
    """Log rows that may be shared."""
    e = table(spark, sf, "events").withColumn("mode", F.when(F.col("event_type") == "error", "labor").otherwise("general"))
    return A.consented(e, F.col("value") > 50).select("event_id")


@query("SELECT conv_id AS id, max(turn)::BIGINT AS updated_at FROM conversations WHERE conv_id % 9 <> 0 GROUP BY conv_id")
def conversations_list(spark, sf):
    """conversations that aren't deleted."""
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("updated_at")).withColumn("deleted_at", F.lit(None).cast("string"))
    return A.live(A.soft_delete(c, c.filter("id % 9 = 0"), F.lit("2026-01-01"))).select("id", "updated_at")


@query("SELECT conv_id, turn, (SELECT p.text FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn AND p.role = 'user' ORDER BY p.turn DESC LIMIT 1) AS previous FROM conversations c WHERE role = 'assistant'")
def previous_user(spark, sf):
    """the question before an answer."""
    return S.previous_by_role(table(spark, sf, "conversations"), "conv_id", "turn").filter("role = 'assistant'").select("conv_id", "turn", "previous")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS folded FROM conversations GROUP BY conv_id")
def conv_fold(spark, sf):
    """X30, 2.12: parts of a message in order, as one text."""
    return S.fold(table(spark, sf, "conversations"), "conv_id", "turn", "text")


@query("SELECT event_id, CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d <= 7 THEN 'last 7 days' ELSE 'earlier' END AS bucket FROM (SELECT event_id, date_diff('day', ts::DATE, (SELECT max(ts) FROM events)::DATE) AS d FROM events)")
def date_buckets(spark, sf):
    """How long ago, by calendar day."""
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.crossJoin(F.broadcast(last)).select("event_id", A.date_bucket(F.datediff("last", "ts")).alias("bucket"))  # one row


@query("SELECT user_id AS key, arg_max(event_type, event_id) AS value, max(event_id) AS version FROM events GROUP BY user_id")
def settings_upsert(spark, sf):
    """the latest value of each key."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("version"))
    return A.upsert(e.filter("version % 2 = 0"), e.filter("version % 2 = 1"), "key", "version")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 20")
def traces_recent(spark, sf):
    """the 20 latest traces (the list's own limit)."""
    return table(spark, sf, "events").orderBy(F.col("ts").desc(), "event_id").limit(20).select("event_id", "user_id")


@query("SELECT 'v' || vec_id AS id, label FROM embeddings WHERE vec_id % 3 = 0 OR label = 2")
def vector_cache_delta(spark, sf):
    """Vectors that are new or whose text changed."""
    e = table(spark, sf, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), "label", "vec_id")
    cached = e.filter("vec_id % 3 != 0").select("id", F.when(F.col("label") == 2, -1).otherwise(F.col("label")).alias("label"))
    return e.select("id", "label").join(cached, ["id", "label"], "left_anti")


@query("SELECT conv_id, turn, octet_length(encode(text))::BIGINT AS n_bytes FROM conversations")
def context_bytes(spark, sf):
    """UTF-8 bytes of a context."""
    return table(spark, sf, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("n_bytes"))


@query(f"WITH {ANNEXES} SELECT id, label || CASE WHEN body = '' THEN '' ELSE ' ' || body END AS title FROM annexes WHERE NOT regexp_matches(body, '^(##|\\||\\[별표|<별표)')")
def annex_titles(spark, sf):
    """Titles of annexes without one of their own."""
    x = annexes(spark, sf)
    return x.filter(~F.col("body").rlike(r"^(##|\||\[별표|<별표)")).select("id", D.annex_title(F.col("label"), F.col("title"), F.col("body")).alias("title"))


@query(f"WITH {_QLOG} SELECT key, count(*)::BIGINT AS n, count_if(miss)::BIGINT AS misses FROM q WHERE key <> '' GROUP BY key")
def log_stream_counts(spark, sf):
    """S17, 2.12: question counts from a file stream, all that is there."""
    from ..streaming import logs

    root = shared_folder(spark, "stream")
    q = table(spark, sf, "conversations").filter("role = 'user'").select(F.col("conv_id").cast("string").alias("ts"), F.col("text").alias("question"), (F.col("conv_id") % 4 == 0).alias("miss"))
    q.write.json(f"{root}/in")
    stream = spark.readStream.schema("ts string, question string, miss boolean").json(f"{root}/in")
    keyed = stream.select("miss", X.normalize_question("question").alias("key")).filter("key != ''")
    return logs.run_once(logs.counts(keyed), root).select("key", "n", "misses")


# Sources and sinks: what is written is read back


@query(rf"{_A} SELECT id, 'article' AS kind, institution, rule, label, coalesce(title, '') AS title, effective, effective AS amended, status, regexp_replace(coalesce(body, ''), '^\n+', '') AS body, '민법' AS law, '제' || (doc_id % 7 + 1) || '조' AS article, rule || '#제1조' AS target, [doc_id % 5 + 1, doc_id % 5 + 2]::INTEGER[]::VARCHAR AS pages FROM articles")
def markdown_round_trip(spark, sf):
    """Documents as Markdown with frontmatter, parsed again."""
    from ..sources import packs

    d = articles(spark, sf)
    first = (F.col("doc_id") % 5 + 1).cast("int")
    basis = F.array(F.struct(F.lit("민법").alias("law"), F.concat(F.lit("제"), (F.col("doc_id") % 7 + 1).cast("string"), F.lit("조")).alias("article"), F.lit(None).cast("string").alias("mst")))
    refs = F.array(F.struct(F.concat("rule", F.lit("#제1조")).alias("target"), F.lit("인용").alias("kind")))
    full = d.select("*", F.col("effective").alias("amended"), F.lit(None).cast("string").alias("supersedes"), basis.alias("legal_basis"), refs.alias("refs"), F.array(first, first + 1).alias("pages"))
    full = full.withColumn("body", F.coalesce("body", F.lit("")))
    parsed = packs.parse_documents(packs.render_markdown(full).select(F.col("id").alias("path"), "text"))
    one = parsed.withColumn("law", F.col("legal_basis")[0]["law"]).withColumn("article", F.col("legal_basis")[0]["article"]).withColumn("target", F.col("refs")[0]["target"])
    listed = F.concat(F.lit("["), F.array_join(F.transform("pages", lambda p: p.cast("string")), ", "), F.lit("]"))
    return one.select("id", "kind", "institution", "rule", "label", "title", "effective", "amended", "status", "body", "law", "article", "target", listed.alias("pages"))


@query(rf"WITH {ANNEXES} SELECT rule || '#' || label AS id, 'annex' AS kind, institution, rule, label, title, effective, status, body, table_structured FROM annexes")
def annex_round_trip(spark, sf):
    """Annexes as Markdown with frontmatter, parsed again."""
    from ..sources import packs

    x = annexes(spark, sf).withColumn("pages", F.array(F.col("page_id").cast("int")))
    parsed = packs.parse_documents(packs.render_annexes(x).select(F.col("id").alias("path"), "text"))
    return parsed.select("id", "kind", "institution", "rule", "label", "title", "effective", "status", "body", "table_structured")


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark, sf):
    """Rows appended to JSON lines in the shared folder in two parts, read back."""
    from ..sources import packs

    c, path = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), shared_folder(spark, "jsonl")
    packs.write_jsonl(c.filter("turn % 2 = 0"), path)
    packs.write_jsonl(c.filter("turn % 2 = 1"), path, mode="append")
    return packs.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")


@query("WITH p AS (SELECT DISTINCT source AS institution FROM documents) SELECT institution, unnest(list_distinct([institution, '재단법인 ' || institution, ' ' || institution])) AS alias FROM p")
def institution_aliases(spark, sf):
    """names that an institution goes by, with and without what people leave out."""
    p = table(spark, sf, "documents").select(F.col("source").alias("institution")).distinct()
    return p.select("institution", F.explode(X.aliases(F.col("institution"), F.concat(F.lit("재단법인 "), "institution"), ("재단법인",))).alias("alias"))


@query("WITH h AS (SELECT l_orderkey AS query_id, l_partkey AS id, count(*) FROM lineitem GROUP BY ALL) SELECT query_id, 'p' || id AS id, p_brand AS effective FROM h JOIN part ON p_partkey = id")
def hit_freshness(spark, sf):
    """the dates of each query's hits as one map, shown row by row."""
    hits = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id")).distinct()
    docs = table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("effective"))
    return D.hit_meta(hits, docs).select("query_id", F.explode("meta").alias("id", "m")).select("query_id", "id", "m.effective")


@query(f"{_A}, h AS (SELECT id, doc_id % 10 AS query_id FROM articles) SELECT query_id, id, title, body FROM h JOIN articles USING (id)")
def hit_context(spark, sf):
    """Hits with their title and text, as a prompt takes them."""
    d = articles(spark, sf)
    return D.context_blocks(d.select("id", (F.col("doc_id") % 10).alias("query_id")), d).select("query_id", "id", "title", "body")


@query("SELECT event_id, event_type || CASE WHEN contains(event_type, 'notice') THEN '' ELSE chr(10) || chr(10) || 'notice' END AS text, right(event_type, 3) AS tail, regexp_matches(event_type, '^[a-z0-9]+(-[a-z0-9]+)*$') AS slug, TRUE AS dated FROM events")
def notices_and_checks(spark, sf):
    """A notice appended once, the last characters, and the validators of names and dates."""
    e = table(spark, sf, "events")
    return e.select("event_id", X.append_once(X.append_once("event_type", "notice"), "notice").alias("text"), X.last_chars("event_type", 3).alias("tail"), X.is_slug("event_type").alias("slug"), X.is_date(F.date_format("ts", "yyyy-MM-dd")).alias("dated"))
