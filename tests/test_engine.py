"""Goldens of the retrieval model on small tables, and invariants of ranking."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import python as P
from quillmesh.functions import text as X
from quillmesh.operators import audit as A
from quillmesh.operators import compare as C
from quillmesh.operators import documents as D
from quillmesh.operators import extract as E
from quillmesh.operators import graph as G
from quillmesh.operators import retrieval as R
from quillmesh.operators import sequence as S
from quillmesh.sources import packs
from quillmesh.streaming import logs


def values(spark, column, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


# Scalars


def test_slugs(spark):
    assert values(spark, lambda c: X.slugify(P.nfc(c)), " 여비 지급 규칙 ", "안전 · 보건 관리규칙", "A/B: ABC Rules!", "é 규정", "!!!") == ["여비지급규칙", "안전·보건관리규칙", "ABABCRules", "é규정", "e84c538e7fe2"]


def test_query_terms(spark):
    (got,) = values(spark, X.query_terms, "여비지급규칙은 어떤 목적으로 제정되었는가?")
    assert got == ["여비지급규칙은", "여비지급규칙", "어떤", "목적으로", "목적", "제정되었는가", "제정되었"]
    assert values(spark, lambda c: X.rule_terms(X.query_terms(c)), "인사규정 제3조", "교통비 출장") == [["인사규정"], []]


def test_direct_references(spark):
    got = values(spark, X.direct_article, "인사관리규정상 제19조의2는 무엇인가?", "인사관리규정 제19조의는?", "출장규정 제13조는?", "교통비")
    assert [tuple(g) if g else None for g in got] == [("인사관리규정", "제19조의2"), None, ("출장규정", "제13조"), None]
    got = values(spark, X.direct_annex, "인사 규정 별표 1 알려줘", "규칙 별지 제3호", "없음")
    assert [tuple(g) if g else None for g in got] == [("인사 규정 ", "별표1"), ("규칙 ", "별지제3호"), None]


def test_article_order(spark):
    labels = ["제20조", "제19조의2", "제19조", "별표1-2", "제3조"]
    df = spark.createDataFrame([(x,) for x in labels], "x string")
    k = X.article_order("x")
    assert [r.x for r in df.orderBy(k["n"], k["m"], k["label"]).collect()] == ["제3조", "별표1-2", "제19조", "제19조의2", "제20조"]


def test_text_functions(spark):
    assert values(spark, X.latest_date, "2020. 1. 5. 개정 2021.13.40. 그리고 2019.12.31", "없음") == ["2020-01-05", None]
    assert values(spark, X.normalize_question, " 연차 휴가는?  며칠! ") == ["연차 휴가는 며칠"]
    assert values(spark, X.json_delta, '{"delta":{"content":"안녕"}}', '{"choices":[{"delta":{"content":"하세요"}}]}', "plain", '{"done":true}') == ["안녕", "하세요", "plain", None]
    assert values(spark, X.citation_labels, "보라 [인사관리규정#제35조의2] [x]") == [["인사관리규정#제35조의2"]]
    assert values(spark, X.is_active, "", "active", "Repealed", "폐지됨") == [True, True, False, False]
    assert values(spark, X.printed_page, "머리\n- 12 -\n본문", "본문만\n둘", "7\nx") == [12, None, 7]
    assert values(spark, lambda c: X.clean_page(c, ("연구원",)), "본문\n- 3 -\n연구원\n끝 ") == ["본문\n끝"]
    assert values(spark, X.comparable_heading, "제1편 인사 규정", "II - 여비·규정") == ["인사규정", "여비규정"]
    assert values(spark, lambda c: X.append_once(X.append_once(c, "N"), "N"), "a") == ["a\n\nN"]
    assert values(spark, X.safe_path, "a/b.md", "../x", "/x", "", "a/../b") == [True, False, False, False, False]
    assert values(spark, lambda c: P.compact(c), "ＡＢ ｃ　１") == ["ABc1"]
    rows = F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit(""), F.lit(" ")), F.array(F.lit("x\ny")))
    assert values(spark, lambda c: X.table_markdown(rows), "") == ["| a | b\\|c |\n| --- | --- |\n| x<br>y |  |"]


def test_snippet_and_similarity(spark):
    body = "가" * 200 + "교통비 기준" + "나" * 200
    s = P.snippet_of(body, ["교통비", "기준"])
    assert len(s) == 120 and s.startswith("가" * 41 + "교통비 기준")
    assert P.snippet_of("짧은 글", ["없음"]) == "짧은 글"
    pairs = spark.createDataFrame([("", "x"), (None, None), ("a b", "x a  b y"), ("hello world", "bye moon"), ("one two three", "three two"), ("abcd efgh", "abce efgx")], "e string, a string")
    got = [r.s for r in pairs.select(P.similarity(F.col("e"), F.col("a")).alias("s")).collect()]
    assert got[:3] == [1, 1, 1] and got[3] < 0.6 and got[4] == pytest.approx(2 / 3) and got[5] == pytest.approx(14 / 18)
    assert [r.s for r in spark.createDataFrame([("ab-c1",), ("-a",), ("A",), (None,)], "x string").select(X.is_slug("x").alias("s")).collect()] == [True, False, False, False]
    assert [r.s for r in spark.createDataFrame([("2024-02-29",), ("2023-02-29",), ("2024-1-1",), (None,)], "x string").select(X.is_date("x").alias("s")).collect()] == [True, False, False, False]


# Retrieval

ARTICLES = [
    ("복무규정#제18조", "north", "복무규정", "제18조", "연차휴가", "① 직원의 연차휴가는 근로기준법에 따른다.", "active"),
    ("출장규정#제12조", "north", "출장규정", "제12조", "교통비", "① 국내 출장자에게는 교통비를 지급한다.", "active"),
    ("출장규정#제13조", "north", "출장규정", "제13조", "숙박비", "① 숙박비는 출장지와 교통비 지급 기준을 고려하여 지급한다.", ""),
    ("출장규정#제14조", "north", "출장규정", "제14조", "일비", "① 일비를 지급한다.", "repealed"),
]
ANNEXES = [("인사규정#별표1", "north", "인사규정", "별표1", "", "승진 기준표", "active"), ("지원규칙#별표1", "north", "지원규칙", "별표1", "", "지원 기준", "active")]
COLUMNS = "id string, institution string, rule string, label string, title string, body string, status string"


@pytest.fixture(scope="module")
def corpus(spark):
    make = lambda rows: spark.createDataFrame(rows, COLUMNS).withColumn("effective", F.lit("2026-02-27"))
    return make(ARTICLES), make(ANNEXES)


def ask(spark, *questions):
    return spark.createDataFrame([(i, q) for i, q in enumerate(questions)], "query_id int, q string")


def test_search_goldens(spark, corpus):
    docs, annexes = corpus
    got = R.search(docs, annexes, ask(spark, "교통비 출장", "숙박비 기준", "출장규정 제13조는 무엇인가?", "인사 규정 별표 1", " "), 3)["hits"]
    first = {r.query_id: r.id for r in got.filter("rank = 0").collect()}
    assert first == {0: "출장규정#제12조", 1: "출장규정#제13조", 2: "출장규정#제13조", 3: "인사규정#별표1"}
    assert max(r["count"] for r in got.groupBy("query_id").count().collect()) <= 3


def test_pin_by_rule_filter_and_absent_article(spark, corpus):
    docs, annexes = corpus
    pins = R.pins(docs, annexes, ask(spark, "제18조는 무엇인가?"), R.matches(rule="복무규정"), rule="복무규정")
    assert [r.id for r in pins.collect()] == ["복무규정#제18조"]
    assert R.pins(docs, annexes, ask(spark, "출장규정 제99조와 별표 1")).count() == 0


def test_filters_before_and_after_the_cut(spark, corpus):
    docs, _ = corpus
    many = docs.unionByName(docs.filter("label = '제12조'").crossJoin(spark.range(40)).select(F.concat(F.lit("z"), F.monotonically_increasing_id().cast("string")).alias("id"), "institution", "rule", "label", "title", "body", "status", "effective"))
    q = ask(spark, "숙박비는 교통비")
    where = F.col("label") == "제14조"
    assert R.bm25_route(many, ask(spark, "교통비"), 1, where).count() == 0
    assert R.lexical_route(many, ask(spark, "출장규정"), 1, where).count() == 1
    assert R.lexical_route(many, q, 2).count() == 8


def test_fusion(spark):
    a = spark.createDataFrame([(0, "x", 0), (0, "y", 1)], "query_id int, id string, rank long")
    b = spark.createDataFrame([(0, "y", 0), (0, "z", 1)], "query_id int, id string, rank long")
    got = R.fuse([(a, 1.0), (b, 2.0), (a, 0.0)], 5).collect()
    assert [r.id for r in sorted(got, key=lambda r: r["rank"])] == ["y", "z", "x"]
    assert {r.id: round(r.score, 6) for r in got}["y"] == round(1 / 62 + 2 / 61, 6)


def test_vectors(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", [1.0])], "id string, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, query_vector array<float>")
    assert [(r.id, r.score) for r in R.vector_route(v, q, 5).orderBy("rank").collect()] == [("a", 1.0), ("b", 0.0)]


def test_pack_routing_and_merge(spark):
    packs_ = spark.createDataFrame([("north", ["north", "한빛연구원"]), ("south", ["south", "한국테크노파크", "테크노파크"])], "institution string, aliases array<string>")
    got = {(r.query_id, r.institution) for r in R.route_packs(packs_, ask(spark, "테크노 파크 인사", "연차")).collect()}
    assert got == {(0, "south"), (1, "north"), (1, "south")}
    alias = F.array_join(X.aliases(F.lit("south"), F.lit("한국테크노파크")), "|").alias("a")
    assert spark.range(1).select(alias).head().a == "south|한국테크노파크|테크노파크"


def test_results_do_not_depend_on_partitions(spark, corpus):
    docs, annexes = corpus
    q = ask(spark, "교통비 출장", "지급 기준")
    runs = [sorted(map(tuple, R.search(docs.repartition(n), annexes, q, 3)["hits"].select("query_id", "rank", "id").collect())) for n in (1, 7)]
    assert runs[0] == runs[1]


# Comparison


def test_variants_and_institutions():
    assert C.variants(" 연차 ", ["연차", "휴가", "휴가 "]) == ["연차", "휴가"]
    assert C.institutions(["south", "s-outh", " "], ["north", "south"]) == ["south"] and C.institutions(None, ["b", "a"]) == ["a", "b"]
    for bad in (lambda: C.variants(" "), lambda: C.institutions(["x"] * 13, []), lambda: C.variants("a", ["b"] * 6)):
        with pytest.raises(ValueError):
            bad()


def test_match_classes(spark, corpus):
    docs, _ = corpus
    for topic, want in (("연차휴가", ("ExactMatch", ["title", "body"])), ("교통비 숙박비", ("LexicalMatch", ["title", "body"])), ("zzz", ("SemanticCandidate", []))):
        m, e = C.classify(F.lit(topic), F.lit(topic), F.lit(False))
        row = docs.filter(F.col("label") == ("제18조" if topic == "연차휴가" else "제13조")).select(m.alias("m"), e.alias("e")).head()
        assert (C.STATUS[row.m], row.e) == want
    found = C.compare(docs, spark.createDataFrame([(0, "일비 지급", 0, "일비 지급")], "query_id int, topic string, variant_no int, q string"))
    assert "출장규정#제14조" not in {r.id for r in found.collect()}
    asked = spark.createDataFrame([(0, "north"), (0, "nope")], "query_id int, institution string")
    got = {r.institution: r.match_status for r in C.statuses(found.filter(F.lit(False)), asked, docs.select("institution").distinct()).collect()}
    assert got == {"north": "NoMatchFound", "nope": "PackNotLoaded"}


def test_body_budget(spark):
    rows = spark.createDataFrame([(0, i, "x" * 5000) for i in range(7)] + [(1, 0, "x" * 4001), (1, 1, "x" * 4000), (2, 0, None)], "q int, r int, body string")
    got = {(r.q, r.r): (r.body_state, len(r.body or "")) for r in C.body_budget(rows, "q", "r").collect()}
    assert [got[0, i] for i in range(7)] == [("truncated", 4000)] * 6 + [("omitted", 0)]
    assert got[1, 0] == ("truncated", 4000) and got[1, 1] == ("full", 4000) and got[2, 0] == ("omitted", 0)


# Documents and graph


def test_neighbors_and_modal_date(spark, corpus):
    docs = spark.createDataFrame([("r#" + x, "i", "r", x, d) for x, d in (("제20조", "2026-02-27"), ("제19조", "2026-02-27"), ("제19조의2", "2025-01-01"))], "id string, institution string, rule string, label string, effective string")
    assert {r.id: (r.prev_id, r.next_id) for r in D.neighbors(docs).collect()} == {"r#제19조": (None, "r#제19조의2"), "r#제19조의2": ("r#제19조", "r#제20조"), "r#제20조": ("r#제19조의2", None)}
    assert D.modal_effective(docs).head().effective == "2026-02-27"


def test_impact(spark):
    docs = spark.createDataFrame([("출장규정#제12조", [("복무규정#제18조", "준용")]), ("출장규정#제13조", [("출장규정#제12조", "인용")]), ("복무규정#제18조", [("출장규정#제12조", "단서예외")])], "id string, refs array<struct<target:string,kind:string>>")
    e = G.document_edges(docs.withColumn("legal_basis", F.array().cast("array<struct<law:string,article:string>>")))
    row = G.impact(e, spark.createDataFrame([("출장규정#제12조",)], "id string")).head()
    assert (row.reverse_citations, row.delegation_chain, row.affected) == (["출장규정#제13조"], ["복무규정#제18조"], ["복무규정#제18조", "출장규정#제13조"])
    loop = spark.createDataFrame([("a", "b", "Delegates"), ("b", "a", "Delegates"), ("b", "c", "ApplyMutatis")], "src string, dst string, kind string")
    assert {r.reached for r in G.forward_closure(loop, spark.createDataFrame([("a",)], "id string")).collect()} == {"b", "c"}


# Sequences and audit


def test_coverage_and_suspicious(spark):
    pages = lambda xs: spark.createDataFrame([("d", x) for x in xs], "document string, page int")
    row = A.coverage(pages([10, 11, 12, 13]), pages([11, 13]), pages([10])).head()
    assert (row.eligible, row.covered, row.percent) == (3, 2, 66.67)
    assert A.coverage(pages([10]), pages([]), pages([10])).head().percent == 100.0
    rules = spark.createDataFrame([("long", 1, 39), ("short", 1, 3)], "rule string, start_page int, end_page int")
    assert [r.rule for r in A.suspicious(rules, spark.createDataFrame([("short",)], "rule string")).collect()] == ["long"]


def test_best_page_and_percentile(spark):
    s = spark.createDataFrame([("i", 5, 2, 0.4), ("i", 5, 3, 0.9), ("i", 5, 4, 0.9)], "item_id string, recorded int, page int, score double")
    row = A.best_page(s).head()
    assert (row.actual, row.distance) == (3, 2)
    assert A.nearest_rank(spark.range(1, 12).withColumn("v", F.col("id")), "v", 95).head().value == 11
    assert A.nearest_rank(spark.range(0).withColumn("v", F.col("id")), "v", 95).head().value == 0


def test_as_of_and_samples(spark):
    e = spark.createDataFrame([("k", 1), ("k", 5), ("k", 9)], "k string, at int")
    m = spark.createDataFrame([("k", 5), ("k", 7)], "k string, at int")
    assert {r["at"]: r.next_mark for r in S.next_after(e, m, "k", "at").collect()} == {1: 5, 5: 7, 9: None}
    d = spark.createDataFrame([(f"g{i % 3}", f"x{i}") for i in range(30)], "g string, x string")
    got = S.balanced_sample(d, "g", "x", 7).groupBy("g").count().collect()
    assert sorted(r["count"] for r in got) == [2, 2, 3]


def test_upsert_and_soft_delete(spark):
    a = spark.createDataFrame([("k", "old", 1), ("j", "x", 1)], "key string, value string, version int")
    b = spark.createDataFrame([("k", "new", 2)], "key string, value string, version int")
    assert {r.key: r.value for r in A.upsert(a, b, "key", "version").collect()} == {"k": "new", "j": "x"}
    c = spark.createDataFrame([("1", None), ("2", "t0"), ("3", None)], "id string, deleted_at string")
    got = A.soft_delete(c, spark.createDataFrame([("1",), ("2",)], "id string"), F.lit("t1"))
    assert {r.id: r.deleted_at for r in got.collect()} == {"1": "t1", "2": "t0", "3": None}


# Extraction


def test_contents_profiles(spark):
    pages = spark.createDataFrame([
        ("a", 3, "I - 1 정관 ······ 7\nI - 2 인사규정 ...... 9"), ("a", 7, "- 1 -"), ("a", 12, "x"),
        ("b", 2, "복무규정 ······ 5\n여비규정 ····· 8"), ("b", 10, "x"),
        ("c", 1, "1. 정관 ····· 141\n2. 규칙 ····· 150"), ("c", 152, "- 141 -"), ("c", 160, "- 150 -"),
        ("d", 1, "1. 정관 / 3\n2. 규칙 / 6"), ("d", 9, "x"),
    ], "document string, page int, text string")
    got = {}
    for r in E.toc_entries(pages).orderBy("document", "start_page").collect():
        got.setdefault(r.document, []).append((r.code, r.rule, r.start_page, r.end_page, r.profile))
    assert got["a"] == [("I - 1", "정관", 7, 8, "roman-dotted"), ("I - 2", "인사규정", 9, 12, "roman-dotted")]
    assert [x[1:4] for x in got["b"]] == [("복무규정", 5, 7), ("여비규정", 8, 10)]
    assert [x[1:4] for x in got["c"]] == [("정관", 152, 159), ("규칙", 160, 160)] and got["c"][0][0] == "numbered-dotted-001"
    assert [x[4] for x in got["d"]] == ["numbered-slash"] * 2


def test_articles_annexes_and_references(spark):
    text = "여비규정\n제1조(목적) 「근로기준법」 제60조에 따라 정한다.\n제2조(용어) 인사규정 제3조의2를 준용하며 별표 1에 따른다.\n제2조(중복) x\n[별표 1] 지급표\n내용\n<별지 제3호 서식> 신청서\n칸"
    articles, annexes = E.article_parts(text)
    assert [(a["label"], a["title"]) for a in articles] == [("제1조", "목적"), ("제2조", "용어")]
    assert [(a["label"], a["title"]) for a in annexes] == [("별표1", "지급표"), ("별지제3호", "신청서")]
    assert E.refs_of(articles[0]["body"], "여비규정", "제1조") == [("근로기준법#제60조", "인용")]
    assert E.refs_of(articles[1]["body"], "여비규정", "제2조", ("인사규정",)) == [("인사규정#제3조의2", "준용"), ("여비규정#별표1", "인용")]
    assert E.article_parts("제1조 별표\n별표 1에 따라 정한다.")[1] == []
    df = spark.createDataFrame([("제1조(목적) 「근로기준법」 제60조의2에 근거한다", "목적"), ("제5조 「민법」 제1조", "기타")], "body string, title string")
    got = [[tuple(b) for b in r.b] for r in df.select(E.legal_basis(F.col("body"), F.col("title"), F.lit(True)).alias("b")).collect()]
    assert got == [[("근로기준법", "제60조의2")], []]


# Packs

ARTICLE = """---
institution: "north"
rule: "복무규정"
article: "제18조"
title: "연차휴가"
effective: "2026-02-27"
amended: "2026-02-27"
status: "active"
supersedes: null
legal_basis:
  - law: "근로기준법"
    article: "제60조"
    mst: "265959"
refs:
  - target: "복무규정#별표1"
    type: "준용"
pages: [3, 4]
---

① 직원의 연차휴가는 근로기준법에 따른다.
"""


def test_pack_round_trip_and_tampering(spark, tmp_path):
    root = tmp_path / "pack"
    for name, text in {"articles/a.md": ARTICLE, "annexes/b.md": '---\ntype: annex\ninstitution: "north"\nrule: "복무규정"\nannex: "별표1"\ntitle: ""\neffective: "2026-01-01"\nstatus: ""\ntable_structured: true\npages: [350, 350]\n---\n표\n', "pages/0350.txt": "쪽", "graph/edges.jsonl": '{"src":"a","dst":"b","kind":"Cites","meta":{}}\n'}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    path = f"file://{root}"
    manifest = packs.manifest_of(spark, path, {"institution": "north"})
    (root / "manifest.json").write_text(json.dumps(manifest))
    pack = packs.open_pack(spark, path)
    a = pack["articles"].head()
    assert (a.id, a.title, a.pages, a.supersedes, a.annex_refs) == ("복무규정#제18조", "연차휴가", [3, 4], None, ["복무규정#별표1"])
    assert [tuple(b) for b in a.legal_basis] == [("근로기준법", "제60조", "265959")] and a.body.startswith("① 직원의") and a.body.endswith("\n")
    assert pack["annexes"].head().table_structured and pack["edges"].count() == 1 and pack["nodes"].count() == 0
    owners = D.page_owners(pack["articles"].select("id", "pages").union(pack["annexes"].select("id", "pages")))
    assert {r.page: r.owner_ids for r in owners.collect()} == {3: ["복무규정#제18조"], 4: ["복무규정#제18조"], 350: ["복무규정#별표1"]}
    again = tmp_path / "again"
    again.mkdir()
    (again / "a.md").write_text(packs.render_markdown(pack["articles"]).head().text)
    b = packs.read_documents(spark, f"file://{again}").head()
    assert (b.id, b.legal_basis, b.refs, b.body) == (a.id, a.legal_basis, a.refs, a.body)
    for change, word in ((lambda: (root / "articles/a.md").write_text(ARTICLE + "x"), "mismatch"), (lambda: (root / "extra.txt").write_text("x"), "unlisted"), (lambda: shutil.rmtree(root / "pages"), "missing")):
        change()
        with pytest.raises(ValueError, match=word):
            packs.open_pack(spark, path)
    (root / "manifest.json").write_text(json.dumps(manifest | {"schema_version": 2}))
    with pytest.raises(ValueError, match="schema_version"):
        packs.read_manifest(spark, path)


def test_broken_frontmatter_fails(spark, tmp_path):
    for i, text in enumerate(("no head", "---\nrule: x\n")):
        d = tmp_path / str(i)
        d.mkdir()
        (d / "a.md").write_text(text)
        with pytest.raises(Exception, match="no frontmatter"):
            packs.read_documents(spark, f"file://{d}").collect()
    assert packs.read_documents(spark, f"file://{tmp_path}/none").count() == 0 and packs.read_pages(spark, f"file://{tmp_path}/none") is None


def test_logs_batch_and_stream(spark, tmp_path):
    rows = [{"ts": "t", "question": "연차 휴가?", "mode": "g", "miss": True}, {"ts": "t", "question": " 연차  휴가", "search_miss": True}, {"ts": "t", "question": " "}]
    (tmp_path / "qlog-1.jsonl").write_text("\n".join(map(json.dumps, rows)))
    path = f"file://{tmp_path}"
    top = A.top_questions(packs.read_qlogs(spark, path)).collect()
    assert [(r.key, r.n, r.example, r.misses) for r in top] == [("연차 휴가", 2, "연차 휴가?", 2)]
    got = logs.run_once(logs.counts(logs.question_stream(spark, path)), f"{path}/run").collect()
    assert [(r.key, r.n, r.misses) for r in got] == [("연차 휴가", 2, 2)]
    events = spark.createDataFrame([(f"2026-01-01 00:0{m}:00", "a") for m in (0, 1, 6)], "at string, k string").withColumn("at", F.to_timestamp("at"))
    assert sorted(r.n for r in logs.windowed(events, "at", "k", "5 minutes", "1 hour").collect()) == [1, 2]
    assert sorted(r.n for r in logs.sessions(events, "at", "k", "3 minutes", "1 hour").collect()) == [1, 2]


def test_eval(spark):
    golden = spark.createDataFrame([(0, ["r#1"]), (1, ["x/r#2"]), (2, [])], "query_id int, expect array<string>")
    hits = spark.createDataFrame([(0, "x/r#1", 0), (1, "y/r#2", 0), (1, "r#2", 1)], "query_id int, id string, rank int")
    assert {r.query_id: r.hit for r in A.eval_hits(golden, hits).collect()} == {0: True, 1: False, 2: False}


def test_registry_and_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


# Composites


def test_graph_gate_and_estimates(spark, corpus):
    from quillmesh.operators import build

    rows = [("r#1", "article", "i", "r", "active", [("r#2", "준용"), ("민법#제1조", "인용")], [("민법", "제1조", None)], [1, 2]), ("r#2", "article", "i", "r", "", [], [], [])]
    docs = spark.createDataFrame(rows, "id string, kind string, institution string, rule string, status string, refs array<struct<target:string,kind:string>>, legal_basis array<struct<law:string,article:string,mst:string>>, pages array<int>")
    g = build.build_graph(docs)
    assert {(r.id, r.kind, r.unresolved_ref) for r in g["nodes"].collect()} == {("r#1", "Article", False), ("r#2", "Article", False), ("institution:i", "Institution", False), ("rule:i/r", "Rule", False), ("민법#제1조", "LawArticle", True)}
    report = build.quality_gate(docs, g["nodes"], g["edges"])
    assert (report["n_documents"], report["external_ref_nodes"], report["n_broken"], report["n_with_basis"]) == (2, 1, 0, 1)
    with pytest.raises(ValueError, match="unresolved"):
        build.quality_gate(docs, g["nodes"], g["edges"], max_unresolved=0)
    with pytest.raises(ValueError, match="n_broken"):
        build.quality_gate(docs, g["nodes"].filter("kind != 'Rule'"), g["edges"])
    text = "\n".join("abcdefghij")
    a = spark.createDataFrame([("r", "", text[:9], text, 1, 2), ("r", text[:10], text, text, 1, 2), ("s", "", "x", "x", 3, 5)], "rule string, text_before string, text_through string, text string, start_page int, end_page int")
    assert sorted((r.rule, r.first_page, r.last_page) for r in build.estimate_pages(a).collect()) == [("r", 1, 2), ("r", 2, 2), ("s", 3, 5)]


def test_verification_run(spark):
    from quillmesh.operators import build

    pages = spark.createDataFrame([(i, f"쪽 {i} " + " ".join(f"낱말{i}x{k}" for k in range(30))) for i in range(1, 8)], "page int, text string")
    body = lambda i: " ".join(f"낱말{i}x{k}" for k in range(5, 20))
    items = spark.createDataFrame([("ok", "i", "r", body(2), 2, 2), ("off", "i", "r", body(5), 3, 3), ("blank", "i", "r", " ", 1, 1)], "item_id string, institution string, rule string, body string, first_page int, last_page int")
    got = {r.item_id: (r.status, r.actual, r.distance) for r in build.verify_extraction(items, pages).collect()}
    assert got == {"ok": ("match", None, None), "off": ("mismatch", 5, -2)}


def test_vector_refresh_embeds_only_what_changed(spark):
    from quillmesh.operators import build

    docs = spark.createDataFrame([("a", "article", "r", "t", "x"), ("b", "article", "r", "t", "y")], "id string, kind string, rule string, title string, body string")
    embed = lambda text: F.array(F.length(text).cast("float"))
    first = build.refresh_vectors(docs, spark.createDataFrame([], "id string, text_hash string, embedding array<float>"), embed)
    marked = first.withColumn("embedding", F.array(F.lit(-1.0).cast("float")))
    changed = docs.withColumn("body", F.when(F.col("id") == "b", "longer").otherwise(F.col("body")))
    assert {r.id: r.embedding for r in build.refresh_vectors(changed, marked, embed).collect()} == {"a": [-1.0], "b": [10.0]}
    with pytest.raises(Exception, match="no embedding"):
        build.refresh_vectors(docs, first.filter(F.lit(False)), lambda t: F.array().cast("array<float>")).collect()


def test_states_and_exports(spark):
    from quillmesh.operators import build

    p = spark.createDataFrame([("a", True, False, True, True), ("b", True, True, False, False)], "institution string, installed boolean, stale boolean, vectors_enabled boolean, vectors_ready boolean")
    row = build.pack_status(p).head()
    assert (row.installed, row.stale, row.model_ready) == (True, True, True)
    row = build.pack_status(p.filter(F.lit(False))).head()
    assert (row.installed, row.stale, row.model_ready) == (False, True, False)
    c = spark.createDataFrame([("1", " ")], "id string, title string")
    m = spark.createDataFrame([("m2", "1", "assistant", "b", "t2"), ("m1", "1", "user", "a", "t1")], "id string, conversation_id string, role string, content string, created_at string")
    assert build.export_markdown(c, m).head().text == "# 새 대화\n\n## user\n\na\n\n## assistant\n\nb"
    assert build.trace_context(spark.createDataFrame([("m2",)], "message_id string"), m).head().question == "a"
    row = build.telemetry(spark.createDataFrame([("telemetry_consent", "yes"), ("shared_dir", " ")], "key string, value string")).head()
    assert (row.consent, row.shared_dir) == (None, None)
    e = spark.createDataFrame([(0, "a", 1, "late"), (0, "a", 0, "first"), (0, "b", 0, None)], "query_id int, institution string, variant_no int, error string")
    assert [(r.institution, r.error) for r in build.error_rows(e).collect()] == [("a", "first")]


def test_archives_and_bare_folders(spark, tmp_path):
    import io
    import tarfile

    import zstandard

    from quillmesh.sources import archives

    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sub/a.md").write_text(ARTICLE)
    archives.pack(f"{tmp_path}/in", f"{tmp_path}/x.tar.zst")
    assert archives.unpack(f"{tmp_path}/x.tar.zst", f"{tmp_path}/out") == ["sub/a.md"]
    pack = archives.resolve(spark, f"file://{tmp_path}/out", "north")
    assert (pack["manifest"]["effective_date"], pack["manifest"]["source_commit"], pack["articles"].count()) == ("2026-02-27", "bare-dir", 1)
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        info = tarfile.TarInfo("../evil")
        tar.addfile(info, io.BytesIO(b""))
    (tmp_path / "evil.tar.zst").write_bytes(zstandard.ZstdCompressor().compress(raw.getvalue()))
    with pytest.raises(ValueError, match="unsafe"):
        archives.unpack(f"{tmp_path}/evil.tar.zst", f"{tmp_path}/out2")
    files = spark.createDataFrame([("p", "---\nrule: 복무규정\n  x: y\npages: [1, 2]\n---\n본문  글"), ("q", "그냥")], "path string, text string")
    got = {r.path: (r.rule, r.pages, r.body) for r in archives.lenient_head(files, ("rule",)).collect()}
    assert got == {"p": ("복무규정", [1, 2], "본문 글"), "q": (None, [], "그냥")}
