"""Queries over whole benchmark items as questions against brute force in Python, on the smallest driver tables."""

import math
import os
import re
import string
from collections import Counter

import pytest

from quillmesh import registry
from quillmesh.plans.views import articles, table

SF = "/root/testdata/sf0.001"
registry.load()


@pytest.fixture(scope="module")
def model(spark):
    """(documents by id, terms of each whole item)."""
    if not os.path.isdir(SF):
        pytest.skip("no driver tables here")
    docs = {r.id: r for r in articles(spark, SF).collect()}
    return docs, {r.item_id: terms(r.text) for r in table(spark, SF, "benchmark").collect()}


def terms(q):
    both = [t for w in q.split() for t in (w.strip(string.punctuation), re.sub("[상의은는이가을를:,，]+$", "", re.sub("[?!.,:;，。]+$", "", w)))]
    return list(dict.fromkeys(t for t in both if len(t) >= 2))


def tokens(text):
    return re.findall(r"[^\W_]+", text)


def best(scores, k):
    return sorted(((round(s, 9), i) for i, s in scores.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]


def bm25(docs, ts):
    out, wanted = Counter(), {x for t in ts for x in tokens(t)}
    for boost, field in ((2.0, "title"), (1.0, "body")):
        split = {i: Counter(tokens(d[field] or "")) for i, d in docs.items()}
        mean = sum(sum(c.values()) for c in split.values()) / len(split)
        for t in wanted:
            df = sum(t in c for c in split.values())
            for i, c in split.items():
                if t in c:
                    out[i] += boost * math.log(1 + (len(split) - df + 0.5) / (df + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean))
    return out


def lexical(docs, ts):
    return {i: sum(w for t in ts for f, w in (("rule", 3.0), ("title", 2.0), ("label", 1.5), ("body", 1.0)) if t in (d[f] or "")) for i, d in docs.items()}


def rows(spark, name):
    out = {}
    for r in registry.QUERIES[name](spark, SF).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in out.items()}


def test_terms_of_whole_items(spark, model):
    got = {r.query_id: r.terms.split("|") for r in registry.QUERIES["query_terms"](spark, SF).collect()}
    assert got == model[1] and min(map(len, got.values())) > 12


def test_bm25_asks_the_whole_item(spark, model):
    docs, asked = model
    got = rows(spark, "search_bm25")
    for q in list(asked)[:8]:
        want = best(bm25(docs, asked[q]), 20)
        assert [i for i, _ in got[q]] == [i for _, i in want]
        assert [s for _, s in got[q]] == pytest.approx([s for s, _ in want], abs=2e-6)


def test_lexical_and_fusion_ask_the_whole_item(spark, model):
    docs, asked = model
    got, fused = rows(spark, "search_lexical"), rows(spark, "rrf_fuse")
    for q in list(asked)[:8]:
        routes = best(bm25(docs, asked[q]), 20), best(lexical(docs, asked[q]), 20)
        assert got[q] == [(i, s) for s, i in routes[1]]
        score = Counter()
        for r in routes:
            for n, (_, i) in enumerate(r):
                score[i] += 1 / (61 + n)
        assert [i for i, _ in fused[q]] == [i for _, i in best(score, 5)]


def test_titles_are_whole_first_lines(spark, model):
    lines = {r.doc_id: (r.text or "").split("\n")[0] for r in table(spark, SF, "documents").collect()}
    assert {d.doc_id: d.title or "" for d in model[0].values()} == lines and max(map(len, lines.values())) > 80
    hits = registry.QUERIES["search_hybrid_topk"](spark, SF).collect()
    assert all(r.title == model[0][r.id].title for r in hits) and any(len(r.title) > 80 for r in hits)


def test_a_filter_holds_for_vectors_too(spark, model):
    """Hybrid search with vectors and a filter never returns what the filter drops."""
    from pyspark.sql import functions as F

    from quillmesh.operators import retrieval as R

    d = articles(spark, SF)
    e = table(spark, SF, "embeddings")
    vectors = d.select("id", "doc_id").join(e, F.col("doc_id") == F.col("vec_id")).select("id", "embedding")
    q = spark.createDataFrame([(i, "zzz") for i in range(3)], "query_id long, q string")
    asked = e.filter("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    got = R.search(d, d.filter(F.lit(False)), q, 5, where=F.col("status") == "active", vectors=(vectors, asked))["hits"].collect()
    by_id = {r["vec_id"]: r["embedding"] for r in e.collect()}
    ids = {r["id"]: r["doc_id"] for r in d.filter("status = 'active'").collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for n in range(3):
        want = sorted(((-round(cos(by_id[n], by_id[k]), 9), i) for i, k in ids.items() if k in by_id))[:5]
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == n] == [i for _, i in want]
