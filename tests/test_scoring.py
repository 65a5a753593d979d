"""Routes rank classes of queries where documents are read: no pair of a query and a document travels, and results are those of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import text as X
from quillmesh.operators import retrieval as R
from quillmesh.operators import scoring
from quillmesh.plans import search_queries as Q

WORDS = ["가나", "다라마", "바사", "아자차", "카타", "파하", "ab", "abc", "bca"]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def many(spark):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    docs = [(f"d{i}" if i else None, f"r{i % 3}규정", str(i), text(i % 4) or None, text(i % 23)) for i in range(300)]
    asked = [(i, f"r{i % 4}규정 {text(i % 3)} " + (f"{i} " if i % 5 else "") + ("가나" if i % 2 else "")) for i in range(60)] + [(60, "zz")]
    return spark.createDataFrame(docs, "id string, rule string, label string, title string, body string").repartition(5), spark.createDataFrame(asked, "query_id int, q string")


@pytest.mark.parametrize(("shared", "rows"), [(1, 10**6), (9, 10**6), (9, 70), (10**6, 10**6)])
def test_routes_find_what_all_pairs_give(many, monkeypatch, shared, rows):
    monkeypatch.setattr(scoring, "SHARED", shared)
    monkeypatch.setattr(scoring, "ASKED", rows)
    docs, asked = many
    got = lambda df: sorted((r.query_id, r["rank"], r.id or "", round(r.score, 6)) for r in df.collect())
    terms = R.with_terms(asked)
    assert got(R.bm25_route(docs, asked, 2)) == got(R.ranked(R.bm25(docs, R.query_tokens(terms), {"title": 2.0, "body": 1.0}), 8))
    assert got(R.rule_route(docs, asked, 2)) == got(R.ranked(R.bm25(docs, R.query_tokens(terms, X.rule_terms(F.col("terms"))), {"rule": 3.0}), 8))
    held = lambda c, w: F.when(F.contains(F.coalesce(c, F.lit("")), F.col("t")), w).otherwise(0.0)
    pairs = docs.crossJoin(terms.select("query_id", F.explode("terms").alias("t"))).groupBy("query_id", "id").agg(F.sum(held(F.col("rule"), 3.0) + held(F.col("title"), 2.0) + held(F.col("label"), 1.5) + held(F.col("body"), 1.0)).alias("score"))
    assert got(R.lexical_route(docs, asked, 2)) == got(R.ranked(pairs.filter("score > 0"), 8))
    assert R.bm25_route(docs, asked, 0).count() == R.lexical_route(docs, asked, 0).count() == 0


def test_f1_routes_of_the_full_search_ship_no_pairs_and_no_texts(spark, many):
    docs, asked = many
    assert "Join" not in plan(R.bm25_route(docs, asked, 5)) and "Join" not in plan(R.lexical_route(docs, asked, 5))
    assert "Join" not in plan(Q._full_pack(spark, "/root/testdata/sf0.001")[0])
    got = R.search(docs, docs.limit(0).withColumn("kind", F.lit("annex")), asked, 2)["retrieval"]
    assert "MapInArrow" not in plan(got) and got.count()


def test_f2_questions_of_one_rule_are_ranked_once(spark):
    docs = spark.range(4000).select(F.format_string("d%04d", "id").alias("id"), F.when(F.col("id") < 3000, "가규정").otherwise("나규정").alias("rule"))
    asked = spark.range(2000).select(F.col("id").alias("query_id"), F.when(F.col("id") < 1500, "가규정").otherwise("나규정").alias("q"))
    route = R.rule_route(docs, asked, 2)
    assert "Join" not in plan(route)  # 5 million pairs by a join before
    rows = route.collect()
    assert len(rows) == 16000
    assert all(r.id == f"d{r['rank'] + (0 if r.query_id < 1500 else 3000):04d}" for r in rows)
    assert "labels" not in "".join(f for d in Q._rule_questions(spark, "/root/testdata/sf0.001") for f in d.inputFiles())
