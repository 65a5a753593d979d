"""The reference graph: nodes, edges, neighbours, closure and impact."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import shared_folder

REVERSE_KINDS = ("Cites", "ApplyMutatis", "Delegates", "LegalBasis")
FORWARD_KINDS = ("Delegates", "ApplyMutatis")


def document_edges(docs: DataFrame) -> DataFrame:
    """Edges (src, dst, kind, place) from references and legal bases of documents, in order."""
    refs = docs.select(F.col("id").alias("src"), F.posexplode("refs")).select("src", F.col("col.target").alias("dst"), X.edge_kind(F.col("col.kind")).alias("kind"), (F.col("pos") + 1000).alias("place"))
    basis = docs.select(F.col("id").alias("src"), F.posexplode("legal_basis")).select("src", F.concat("col.law", F.lit("#"), "col.article").alias("dst"), F.lit("LegalBasis").alias("kind"), F.col("pos").alias("place"))
    return basis.unionByName(refs)


def containment_edges(docs: DataFrame) -> DataFrame:
    """Institution → rule → document."""
    rule = F.concat(F.lit("rule:"), "institution", F.lit("/"), "rule")
    a = docs.select(F.concat(F.lit("institution:"), "institution").alias("src"), rule.alias("dst")).distinct()
    b = docs.select(rule.alias("src"), F.col("id").alias("dst"))
    return a.unionByName(b).select("src", "dst", F.lit("AppliesTo").alias("kind"), F.lit(-1).alias("place"))


def external_nodes(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Targets without a document: a law's article by its name, else an article. Of several sources the last one counts."""
    law = F.regexp_extract("dst", "^([^#]*)#", 1).rlike("(법|시행령|조례)$")
    missing = edges.filter("kind != 'AppliesTo'").join(docs.select(F.col("id").alias("dst")), "dst", "left_anti")
    last = F.max_by(F.col("kind") != "LegalBasis", F.struct("src", "place"))
    return missing.groupBy("dst").agg(last.alias("unresolved_ref")).select(F.col("dst").alias("id"), F.when(law, "LawArticle").otherwise("Article").alias("kind"), "unresolved_ref")


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, kind): the first inserted."""
    w = Window.partitionBy("src", "dst", "kind").orderBy("place")
    return edges.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def reverse_neighbors(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, neighbor): distinct sources of what points at id."""
    some = edges.filter(F.col("kind").isin(*REVERSE_KINDS))
    return ids.select("id").join(some, F.col("id") == F.col("dst")).select("id", F.col("src").alias("neighbor")).distinct()


def forward_closure(edges: DataFrame, ids: DataFrame, kinds: tuple[str, ...] = FORWARD_KINDS) -> DataFrame:
    """(id, reached): all that can be reached from each id, without the id itself. Cycles are safe.

    Level by level: the frontier joins the edges and loses what was reached before. Each level is stored in the shared
    checkpoint folder, so plans stay short and a lost executor costs no level.
    """
    spark = edges.sparkSession
    root = shared_folder(spark, "closure")
    step = edges.filter(F.col("kind").isin(*kinds)).select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct()
    start = ids.select("id", F.col("id").alias("reached")).distinct()
    start.write.parquet(f"{root}/level=0")
    level = 0
    while True:
        seen = spark.read.schema("id string, reached string, level int").parquet(root)
        new = seen.filter(F.col("level") == level).join(step, F.col("reached") == F.col("at")).select("id", F.col("to").alias("reached")).distinct()
        level += 1
        new.join(seen.select("id", "reached"), ["id", "reached"], "left_anti").write.parquet(f"{root}/level={level}")
        if not spark.read.schema("id string, reached string").parquet(f"{root}/level={level}").limit(1).count():
            return spark.read.schema("id string, reached string, level int").parquet(root).filter("id != reached").select("id", "reached")


def impact(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """One row an id: what cites it, what it delegates to, and the union of both."""
    rev = reverse_neighbors(edges, ids).groupBy("id").agg(F.array_sort(F.collect_set("neighbor")).alias("reverse_citations"))
    fwd = forward_closure(edges, ids).groupBy("id").agg(F.array_sort(F.collect_set("reached")).alias("delegation_chain"))
    none = F.array().cast("array<string>")
    out = ids.select("id").distinct().join(rev, "id", "left").join(fwd, "id", "left")
    out = out.select("id", F.coalesce("reverse_citations", none).alias("reverse_citations"), F.coalesce("delegation_chain", none).alias("delegation_chain"))
    return out.withColumn("affected", F.array_sort(F.array_union("reverse_citations", "delegation_chain")))


def graph_quality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts: nodes, edges by kind, broken edges (an end without node) and orphans (nodes without edge)."""
    ids = nodes.select("id").distinct()
    broken = edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").unionByName(edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")).distinct()
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    kind = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}")
    e = edges.agg(F.count("*").alias("n_edges"), kind("Cites"), kind("ApplyMutatis"), kind("Delegates"), kind("ExceptWhen"), kind("LegalBasis"))
    n = ids.agg(F.count("*").alias("n_nodes"))
    b = broken.agg(F.count("*").alias("n_broken"))
    o = ids.join(ends, "id", "left_anti").agg(F.count("*").alias("n_orphans"))
    return n.crossJoin(e).crossJoin(b).crossJoin(o)  # one row each
