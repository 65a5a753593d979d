"""Ranked retrieval: postings and BM25, lexical, rule-name, annex and vector routes, pins, and rank fusion.

Queries are a DataFrame (query_id, q), so one question and a hundred thousand share a plan. Documents carry id, institution,
rule, label, title, body, status, effective, kind. Scores are rounded to nine places before they are compared, so that the
last bit of a logarithm never settles a tie; ties go to the lesser id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X
from ..sources.shared import stored
from .scoring import SLICE_ROWS, best, slices

K1, B = 1.2, 0.75
#: A route ranks so many times k candidates before it filters or is fused.
DEPTH = 4
#: Queries that meet all documents at once; more go in further blocks.
QUERY_BLOCK = 2000
#: Rows of query terms that are broadcast at most; beyond it they are joined by a shuffle.
BROADCAST_TERMS = 500_000
#: Substrings that one pass over the texts looks for; more take further passes.
PATTERNS = 200_000


def matches(institution: str | None = None, rule: str | None = None, status: str | None = None, effective: str | None = None) -> Column:
    """Conjunction of optional equalities; blank values don't count."""
    wanted = {"institution": institution, "rule": rule, "status": status, "effective": effective}
    return reduce(lambda a, b: a & b, [F.col(c) == v for c, v in wanted.items() if v and v.strip()], F.lit(True))


def ranked(hits: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best hits of each query: score down, id up. rank starts at 0."""
    order = Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), F.col("id").asc())
    return hits.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).filter(F.col("rank") < k)


def bm25(docs: DataFrame, query_tokens: DataFrame, boosts: dict[str, float]) -> DataFrame:
    """(query_id, id, score) of all documents that share a token with a query (query_id, term; distinct).

    Any token suffices; lengths are exact. Each field is cut into tokens once, and only the queries' terms leave the scan.
    One exchange, by document, serves term counts, document frequencies and the scores of each query.
    """
    small = query_tokens.count() <= BROADCAST_TERMS
    sized = F.broadcast if small else (lambda df: df)
    fields = list(boosts)
    cut = docs.select("id", *[X.tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"t{i}") for i, f in enumerate(fields)])
    numbered = lambda i: F.transform(f"t{i}", lambda t: F.struct(F.lit(i).alias("f"), F.size(f"t{i}").alias("dl"), t.alias("term")))
    each = F.concat(*map(numbered, range(len(fields))))
    found = cut.select("id", F.explode(each).alias("x")).select("id", "x.*").join(sized(query_tokens.select("term").distinct()), "term")
    posts = found.repartition("id").groupBy("id", "f", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = posts.groupBy("f", "term").agg(F.count("*").alias("df"))
    lengths = [F.avg(F.size(f"t{i}")).alias(f"a{i}") for i in range(len(fields))]
    stats = cut.agg(F.count("*").alias("n"), *lengths)  # one row
    scored = posts.join(sized(df), ["f", "term"]).crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    pick = lambda values: F.get(F.array(*values), F.col("f"))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / pick([F.col(f"a{i}") for i in range(len(fields))]))
    scored = scored.select("id", "term", (pick([F.lit(float(x)) for x in boosts.values()]) * idf * F.col("tf") * (K1 + 1) / norm).alias("s"))
    return scored.join(sized(query_tokens), "term").groupBy("query_id", "id").agg(F.sum("s").alias("score"))


def bm25_best(docs: DataFrame, query_tokens: DataFrame, boosts: dict[str, float], n: int) -> DataFrame:
    """(query_id, id, score, rank): the n best by bm25(), ranked where the documents are read.

    A first pass counts documents and lengths of each field and the documents of each term; a second scores. Neither ships
    postings or pairs: what leaves the workers are counts, and the best of each query and class of queries.
    """
    fields = list(boosts)
    cut = docs.select("id", *[X.tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"t{i}") for i, f in enumerate(fields)])

    def counted(part: pa.RecordBatch, i: int, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lengths in tokens, then (document, term, count) of field i."""
        column = part.column(f"t{i}")
        lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten()
        code = pc.fill_null(pc.index_in(flat, value_set=known.cast(flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        pair, tf = np.unique((row * len(known) + code)[code >= 0], return_counts=True)
        return lengths, *np.divmod(pair, len(known)), tf

    def reader(terms: list[str]):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = pa.array(terms, pa.string())
            df, total, rows = np.zeros((len(fields), len(terms)), np.int64), np.zeros(len(fields), np.int64), 0
            for part in slices(batches, SLICE_ROWS):
                rows += part.num_rows
                for i in range(len(fields)):
                    lengths, _, code, _ = counted(part, i, known)
                    total[i] += lengths.sum()
                    df[i] += np.bincount(code, minlength=len(terms))
            f, code = np.nonzero(df)
            f, code, m = [*f.tolist(), *range(len(fields)), -1], [*code.tolist(), *[-1] * len(fields), -1], [*df[f, code].tolist(), *total.tolist(), rows]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(code, pa.int64()), pa.array(m, pa.int64())], ["f", "code", "m"])

        weight, mean, n_docs = np.zeros((len(fields), len(terms))), np.ones(len(fields)), 0
        sums = cut.drop("id").mapInArrow(count, "f long, code long, m long").groupBy("f", "code").agg(F.sum("m").alias("m")).collect()  # at most one row a field and asked term
        n_docs = next((r["m"] for r in sums if r["f"] < 0), 0)
        for r in sums:
            if r["f"] >= 0 and r["code"] < 0:
                mean[r["f"]] = r["m"] / n_docs if r["m"] else 1.0
            elif r["f"] >= 0:
                weight[r["f"], r["code"]] = boosts[fields[r["f"]]] * np.log(1 + (n_docs - r["m"] + 0.5) / (r["m"] + 0.5)) * (K1 + 1)

        def open_reader():
            known = pa.array(terms, pa.string())

            def read(part: pa.RecordBatch):
                out = []
                for i in range(len(fields)):
                    lengths, row, code, tf = counted(part, i, known)
                    out.append((row, code, weight[i, code] * tf / (tf + K1 * (1 - B + B * lengths[row] / mean[i]))))
                return tuple(map(np.concatenate, zip(*out, strict=True)))

            return read

        return open_reader

    return best(cut, query_tokens, n, reader)


def _automaton(known: list[str]):
    import ahocorasick

    tree = ahocorasick.Automaton()
    for i, p in enumerate(known):
        tree.add_word(p, i)
    tree.make_automaton()
    return tree


def _held(part: pa.RecordBatch, tree, weights: list[tuple[tuple[str, ...], float]]) -> tuple[list[int], list[int], list[float]]:
    """(document in the slice, pattern, weight) for each weight one of whose columns holds the pattern."""
    texts = {c: part.column(c).to_pylist() for c in dict.fromkeys(c for columns, _ in weights for c in columns)}
    docs, at, score = [], [], []
    for row in range(part.num_rows):
        hits = {c: {i for _, i in tree.iter(t[row])} if t[row] else set() for c, t in texts.items()}
        for columns, w in weights:
            some = hits[columns[0]].union(*(hits[c] for c in columns[1:]))
            docs += [row] * len(some)
            at += some
            score += [w] * len(some)
    return docs, at, score


def occurrences(docs: DataFrame, weights: list[tuple[tuple[str, ...], float]], patterns: DataFrame) -> DataFrame:
    """(id, pattern, weight): the strings of patterns (one column) that occur in a document, by one pass over each text.

    A weight counts if one of its columns holds the pattern. The patterns are a stated set of queries: they go to the workers
    as one automaton, PATTERNS of them at a time, so no pair of a document and a pattern is formed that shares nothing.
    """
    names = list(dict.fromkeys(c for columns, _ in weights for c in columns))
    some = patterns.select(F.col(patterns.columns[0]).alias("p")).filter("p != ''").distinct()
    blocks = max(1, -(-some.count() // PATTERNS))

    def search(known: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = _automaton(known)
            for b in batches:
                for start in range(0, b.num_rows, 500):
                    part = b.slice(start, 500)
                    total: dict[tuple[int, int], float] = {}
                    for row, i, w in zip(*_held(part, tree, weights), strict=True):
                        total[row, i] = total.get((row, i), 0.0) + w
                    rows, at = pa.array([r for r, _ in total], pa.int64()), pa.array([i for _, i in total], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column("id").take(rows), pa.array(known, pa.string()).take(at), pa.array(list(total.values()), pa.float64())], ["id", "pattern", "weight"])

        return run

    rows, parts = docs.select("id", *names), []
    for k in range(blocks):
        known = sorted(r["p"] for r in some.filter(F.pmod(F.xxhash64("p"), F.lit(blocks)) == k).collect())  # a block of the query set
        if known:
            parts.append(rows.mapInArrow(search(known), "id string, pattern string, weight double"))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], "id string, pattern string, weight double")


def with_terms(queries: DataFrame) -> DataFrame:
    return queries.withColumn("terms", X.query_terms("q"))


def query_tokens(queries: DataFrame, terms: Column | None = None) -> DataFrame:
    """Distinct tokens of each query's terms (of the raw question if it has none)."""
    t = terms if terms is not None else F.col("terms")
    raw = F.when(F.size(t) > 0, F.array_join(t, " ")).otherwise(F.col("q") if terms is None else F.lit(""))
    return queries.select("query_id", F.explode(F.array_distinct(X.tokens(raw))).alias("term"))


def bm25_route(docs: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """Title and body by BM25. The filter comes after the cut: documents that fail it have taken a place."""
    hits = bm25_best(docs, query_tokens(with_terms(queries)), {"title": 2.0, "body": 1.0}, DEPTH * k)
    return _after(hits, docs, where, k)


def rule_route(docs: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """Rule names by BM25, for queries with a term that looks like one; filtered after the cut."""
    q = with_terms(queries)
    hits = bm25_best(docs, query_tokens(q, X.rule_terms(F.col("terms"))), {"rule": 3.0}, DEPTH * k)
    return _after(hits, docs, where, k)


def _after(hits: DataFrame, docs: DataFrame, where: Column | None, k: int) -> DataFrame:
    if where is None:
        return hits
    return ranked(hits.drop("rank").join(docs.filter(where).select("id"), "id"), DEPTH * k)


def lexical_route(docs: DataFrame, queries: DataFrame, k: int, where: Column | None = None, annex: bool = False) -> DataFrame:
    """Substring scores: per term 3 for the rule, 2 title, 1.5 label, 1 body; of annexes also their compact forms. The filter comes first."""
    some = docs if where is None else docs.filter(where)
    more = lambda c: (c, f"compact_{c}") if annex else (c,)
    weights = [(("rule",), 3.0), (more("title"), 2.0), (("label",), 1.5), (more("body"), 1.0)]
    names = list(dict.fromkeys(c for columns, _ in weights for c in columns))

    def reader(known: list[str]):
        def open_reader():
            tree = _automaton(known)

            def read(part: pa.RecordBatch):
                row, at, w = _held(part, tree, weights)
                return np.array(row, np.int64), np.array(at, np.int64), np.array(w, np.float64)

            return read

        return open_reader

    terms = with_terms(queries).select("query_id", F.explode("terms").alias("term"))
    return best(some.select("id", *names), terms, DEPTH * k, reader)


def annex_route(annexes: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """Annexes with the label that a query names: 100, and 10 more if the text before it names their rule."""
    some = annexes if where is None else annexes.filter(where)
    q = queries.select("query_id", X.direct_annex("q").alias("ref")).filter("ref is not null").select("query_id", F.regexp_replace("ref.prefix", r"(?U)\s+", "").alias("prefix"), F.col("ref.label").alias("label"))
    named = F.col("prefix").contains(F.regexp_replace("rule", r"(?U)\s+", "")) | F.col("prefix").contains(X.slugify("rule"))
    return ranked(some.join(q, "label").select("query_id", "id", F.when(named, 110.0).otherwise(100.0).alias("score")), DEPTH * k)


def cosine(a: Column, b: Column) -> Column:
    """Null for vectors of different length, without elements or of zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm)


def vector_route(vectors: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """Exact cosine of queries (query_id, query_vector) and vectors (id, embedding); the filter comes first.

    Each block of queries is a matrix that goes to the workers; a batch of vectors takes one product, and only what can be
    among a query's best leaves it. Vectors of another length than the query's, or of zero norm, have no score.
    """
    some = (vectors if where is None else vectors.filter(where)).select("id", "embedding")
    kind = dict(queries.dtypes)["query_id"]
    key = to_arrow_type(queries.schema["query_id"].dataType)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def unit(rows: list[list[float]]) -> np.ndarray:
        m = np.array(rows, np.float64).reshape(len(rows), -1)
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)

    def search(asked: dict[int, tuple[list, list[list[float]]]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrices = {size: (ids, unit(rows)) for size, (ids, rows) in asked.items()}
            for b in batches:
                rows = b.column("embedding").to_pylist()
                ids, out = b.column("id").to_pylist(), ([], [], [])
                for size, (names, q) in matrices.items():
                    fits = [i for i, r in enumerate(rows) if r is not None and len(r) == size and None not in r]
                    if not fits:
                        continue
                    scores = np.round(unit([rows[i] for i in fits]) @ q.T, 12)
                    for j, name in enumerate(names):
                        s = scores[:, j]
                        real = np.flatnonzero(~np.isnan(s))
                        if len(real) > DEPTH * k:  # all that tie with the last of the best stay, up to what rounding may move
                            real = real[s[real] >= np.partition(s[real], -DEPTH * k)[-DEPTH * k] - 1e-8]
                        out[0].extend([name] * len(real))
                        out[1].extend(ids[fits[i]] for i in real.tolist())
                        out[2].extend(s[real].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], key), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], ["query_id", "id", "score"])

        return run

    parts = []
    for i in range(blocks):
        asked: dict[int, tuple[list, list]] = {}
        for r in queries.select("query_id", "query_vector").filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect():  # a block of the query set
            if r["query_vector"] and None not in r["query_vector"]:
                names, rows = asked.setdefault(len(r["query_vector"]), ([], []))
                names.append(r["query_id"])
                rows.append(r["query_vector"])
        parts.append(ranked(some.mapInArrow(search(asked), f"query_id {kind}, id string, score double"), DEPTH * k))
    return reduce(DataFrame.unionByName, parts)


def fuse(routes: list[tuple[DataFrame, float]], k: int, rrf_k: int = 60, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Reciprocal-rank fusion of routes (…, id, rank) with their weights; a route without weight is left out.

    Contributions are added in the order of the routes, whatever order rows arrive in.
    """
    rows = [r.select(*by, "id", F.lit(i).alias("route"), (F.lit(float(w)) / (rrf_k + F.col("rank") + 1)).alias("part")) for i, (r, w) in enumerate(routes) if w > 0]
    parts = F.array_sort(F.collect_list(F.struct("route", "part")))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x["part"])
    return ranked(reduce(DataFrame.unionByName, rows).groupBy(*by, "id").agg(total.alias("score")), k, by)


def pins(docs: DataFrame, annexes: DataFrame, queries: DataFrame, where: Column | None = None, rule: str | None = None) -> DataFrame:
    """(query_id, id): the document that a question names. An article reference that leads nowhere leaves no pin at all."""
    keep = (lambda d: d if where is None else d.filter(where))
    q = queries.select("query_id", "q", X.article_ref("q").alias("a"), X.direct_article("q", F.lit(rule)).alias("r"))
    article = q.filter("r is not null").select("query_id", F.concat(F.col("r.rule"), F.lit("#"), F.col("r.article")).alias("id")).join(keep(docs).select("id"), "id")
    x = q.filter("a is null").select("query_id", X.direct_annex("q").alias("x")).filter("x is not null").select("query_id", F.regexp_replace("x.prefix", r"(?U)\s+", "").alias("prefix"), F.col("x.label").alias("label"))
    some = keep(annexes).select("id", "rule", "label")
    if rule:
        named = F.col("id") == F.concat(X.slugify(F.lit(rule)), F.lit("#"), F.col("label"))
    else:
        named = F.col("prefix").contains(F.regexp_replace("rule", r"(?U)\s+", "")) | F.col("prefix").contains(X.slugify("rule"))
    annex = some.join(x, "label").filter(named).groupBy("query_id").agg(F.min("id").alias("id"))
    return article.select("query_id", "id").unionByName(annex)


def merge_pinned(pinned: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The pin first, then k - 1 other hits in their order."""
    first = pinned.select("query_id", "id", F.lit(None).cast("double").alias("score"), F.lit(-1).cast("long").alias("rank"), F.lit(True).alias("pinned"))
    rest = hits.select("query_id", "id", "score", "rank", F.lit(False).alias("pinned")).join(pinned.select("query_id", "id"), ["query_id", "id"], "left_anti")
    order = Window.partitionBy("query_id").orderBy("rank", "id")
    return first.unionByName(rest).withColumn("rank", (F.row_number().over(order) - 1).cast("long")).filter(F.col("rank") < k)


def search(docs: DataFrame, annexes: DataFrame, queries: DataFrame, k: int = 5, where: Column | None = None, rule: str | None = None, vectors: tuple[DataFrame, DataFrame] | None = None, rrf_k: int = 60, vector_weight: float = 1.0) -> dict[str, DataFrame]:
    """Hybrid search: {'hits', 'pin', 'retrieval'}. Blank questions and k = 0 find nothing.

    vectors: (id, embedding) and (query_id, query_vector); without them that route is left out. Questions and what each route
    finds are stored before they are fused: one plan of all routes takes more of the driver's memory than any of them.
    """
    queries = stored(queries.filter(X.blank_to_null("q").isNotNull() & F.lit(k > 0)), "questions")
    both = docs.unionByName(annexes, allowMissingColumns=True)
    lexical = lexical_route(docs, queries, k, where).unionByName(lexical_route(annexes, queries, k, where, annex=True)) if "compact_body" in annexes.columns else lexical_route(both, queries, k, where)
    lexical = ranked(lexical.drop("rank"), DEPTH * k)
    routes = [(annex_route(annexes, queries, k, where), 1.0), (bm25_route(both, queries, k, where), 1.0)]
    if vectors is not None:
        # The filter comes first here too: a vector whose document fails it takes no place.
        kept = vectors[0] if where is None else vectors[0].join(both.filter(where).select("id"), "id", "left_semi")
        routes.append((vector_route(kept, vectors[1], k), vector_weight))
    routes += [(rule_route(both, queries, k, where), 1.0), (lexical, 1.0)]
    retrieval = fuse([(stored(r.select("query_id", "id", "rank"), "route"), w) for r, w in routes if w > 0], k, rrf_k)
    pin = stored(pins(docs, annexes, queries, where, rule), "pins")
    return {"hits": merge_pinned(pin, retrieval, k), "pin": pin, "retrieval": retrieval}


def merge_packs(hits: DataFrame, k: int) -> DataFrame:
    """Fuses each institution's hits (query_id, institution, id, rank) once more; ids take the institution as prefix."""
    named = hits.withColumn("id", F.concat("institution", F.lit("/"), "id"))
    return fuse([(named, 1.0)], k)


def route_packs(packs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, institution): packs (institution, aliases) that a question names by an alias; all packs if it names none."""
    names = packs.select("institution", F.explode(F.transform("aliases", X.alias_key)).alias("alias")).filter(F.length("alias") >= 2)
    q = queries.select("query_id", X.alias_key("q").alias("key"))
    named = q.join(F.broadcast(names), F.col("key").contains(F.col("alias"))).select("query_id", "institution").distinct()
    rest = q.join(named.select("query_id").distinct(), "query_id", "left_anti").select("query_id").crossJoin(F.broadcast(packs.select("institution")))
    return named.unionByName(rest)


def snippets(hits: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds a snippet to final hits only."""
    from ..functions.python import snippet

    q = with_terms(queries).select("query_id", "terms")
    return hits.join(docs.select("id", "body"), "id").join(q, "query_id").withColumn("snippet", snippet("body", "terms")).drop("body", "terms")
