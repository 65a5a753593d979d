"""Parsed rules keep their dates, legal bases and pages; the build driver chains contents, texts and articles."""

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import build
from quillmesh.operators import extract as E

TEXT = "[별표 1] 서식 2030. 1. 1.\n여비규정\n제정 2020. 1. 2. 개정 2021. 13. 45.\n제1조(목적) 「근로기준법」 제60조의2에 따라 정하고 「민법」 제1조\n제2조(용어) 2029. 1. 1. 말한다. [개정\n2022. 3. 4.]\n제3조(기타) 「상법」 제3조\n제3조(중복) x\n[별표 1] 지급표\n「형법」 제9조"
COLUMNS = "document string, code string, rule string, start_page int, end_page int, text string, spans array<struct<page:int,start:int,end:int>>"


def test_dates_and_legal_bases_of_parsed_texts(spark):
    texts = spark.createDataFrame([("d", "c", "여비규정", 3, 6, TEXT.split("여비규정\n", 1)[1], None), ("d", "e", "정관", 1, 1, "제1조(설치) 「가법」 제2조", None)], COLUMNS)
    got = {(r.code, r.kind, r.label): (r.amended, [tuple(b) for b in r.legal_basis]) for r in E.parse_rules(texts, effective="2000-01-01").collect()}
    assert got == {
        ("c", "article", "제1조"): ("2020-01-02", [("근로기준법", "제60조의2"), ("민법", "제1조")]), ("c", "article", "제2조"): ("2022-03-04", []), ("c", "article", "제3조"): ("2020-01-02", []),
        ("c", "annex", "별표1"): (None, []), ("e", "article", "제1조"): ("2000-01-01", [("가법", "제2조")]),
    }


def test_dates_of_annexes_before_the_first_article_do_not_count():
    assert [a["amended"] for a in E.article_parts("제정 2020. 1. 2.\n[별표 1] 2030. 1. 1.\n제1조 x")[0]] == ["2020-01-02"]


def test_pages_are_estimated_without_spans(spark):
    text = "\n".join(["머리", "제1조 a", "b", "c", "제2조 d", "e", "f", "g", "제3조 h", "i"])
    rows = [("d", "c", "규정", 1, 3, text, []), ("d", "one", "정관", 2, 5, "제1조 a\nb", None)]
    got = {(r.code, r.label): r.pages for r in E.parse_rules(spark.createDataFrame(rows, COLUMNS)).collect()}
    parts = E.article_parts(text)[0]
    table = spark.createDataFrame([(p["label"], "규정", text[: p["start"]], text[: p["end"]], text, 1, 3) for p in parts], "label string, rule string, text_before string, text_through string, text string, start_page int, end_page int")
    assert {("c", r.label): [r.first_page, r.last_page] for r in build.estimate_pages(table).collect()} | {("one", "제1조"): [2, 5]} == got
    assert len({tuple(p) for k, p in got.items() if k[0] == "c"}) > 1


PAGES = [
    ("d", 1, "1. 정관 ····· 2\n2. 여비규정 ····· 3"), ("d", 2, "정관\n제1조(목적) 「민법」 제32조에 따라 설립한다.\n- 2 -"),
    ("d", 3, "여비규정\n제정 2020. 1. 2.\n제1조(목적) 및 정관 제1조에 따른다.\n- 3 -"), ("d", 4, "제2조(용어) x\n제2조(중복) y\n[별표 1] 표\n- 4 -"),
]


def test_build_driver_and_its_gates(spark):
    pages = spark.createDataFrame(PAGES, "document string, page int, text string")
    b = build.build_rules(pages, "2019-01-01")
    got = {r.id: (r.amended, r.pages, [tuple(x) for x in r.legal_basis], [t.target for t in r.refs]) for r in b["parts"].collect()}
    assert got == {
        "정관#제1조": ("2019-01-01", [2, 2], [("민법", "제32조")], ["민법#제32조"]), "여비규정#제1조": ("2020-01-02", [3, 3], [], ["정관#제1조"]),
        "여비규정#제2조": ("2020-01-02", [4, 4], [], []), "여비규정#별표1": (None, [4, 4], [], []),
    }
    assert [r.id for r in b["ambiguous_basis"].collect()] == ["여비규정#제1조"] and [r.key for r in b["skipped"].collect()] == ["제2조"]
    assert (b["coverage"].head().eligible, b["coverage"].head().covered) == (3, 3) and b["no_articles"].count() == b["suspicious"].count() == 0
    with pytest.raises(ValueError, match="0 rules"):
        build.build_rules(pages.withColumn("text", F.lit("x")))
    with pytest.raises(ValueError, match="0 articles"):
        build.build_rules(pages.withColumn("text", F.when(F.col("page") == 1, F.col("text")).otherwise("x")))


def test_legal_bases_of_documents_are_registered(spark):
    from quillmesh import registry

    registry.load()
    got = registry.QUERIES["extract_legal_basis"](spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert got.filter("law = '근로기준법' and article = '제60조' and id like '%#제1조'").count() == n
