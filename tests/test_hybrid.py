"""The full hybrid search gives hits from annexes and pins, and each of its routes finds something."""

import os

import pytest

from quillmesh.operators import retrieval as R
from quillmesh.plans import search_queries as Q

SF = "/root/testdata/sf0.001"


def test_all_routes_and_pins_take_part(spark):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables here")
    a, x, q, vectors = Q._full_pack(spark, SF)
    ids = {r.doc_id: r.id for r in a.select("doc_id", "id").collect()}
    hits = Q.search_hybrid_full(spark, SF).collect()
    pinned = {r.query_id: r.id for r in hits if r.pinned}
    assert all(pinned[k] == (ids[k - 1000000000] if k < 2000000000 else f"page#{k - 2000000000}") for k in (r.query_id for r in q.collect()) if 1000000000 <= k < 3000000000)
    assert any(k < 2000000000 for k in pinned) and any(k >= 2000000000 for k in pinned)
    assert any(r.id.startswith("page#") and not r.pinned for r in hits)
    assert R.annex_route(x, q, 5).count() and R.rule_route(a, q, 5).filter("query_id >= 3000000000").count() and R.vector_route(*vectors, 5).count()
