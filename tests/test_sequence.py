"""Range search of documents with and without matches."""

from quillmesh.operators import sequence as S


def test_range_without_matches_falls_back(spark):
    rows = [("a", 1, 0, 0), ("a", 2, 0, 3), ("a", 3, 0, 2), ("none", 1, 0, 0), ("none", 2, 0, 0), ("late", 31, 0, 9)]
    counts = spark.createDataFrame(rows, "document string, page int, profile int, n long")
    got = {r.document: (r.start, r.end, r.total) for r in S.best_range(counts, "document", "page", "profile", "n").collect()}
    assert got == {"a": (2, 3, 5), "none": (3, 5, 0), "late": (3, 5, 0)}
