"""Sharding: global byte-size prefix sums from per-range totals, cut at equal targets into contiguous shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, order_prefix, table

SHARDS = 40
#: Bytes that each document adds besides its text.
OVERHEAD = 16


def assign_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row a document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Documents are in ascending order of doc_id, then of size and checksum; a document's shard is that of the equal share of
    all bytes in which its middle byte lies. So each shard is a contiguous stretch whose bytes differ from the target by one
    document at most. slot counts a shard's documents from 0. law is 'bytes'; grown_shard is null, since more shards move
    every cut.

    A null text has no bytes and the checksum of the empty text. Null doc_ids come first. Equal rows take neighbouring
    slots; equal texts of different documents lie wherever their doc_ids put them. Other columns are ignored. No rows give no rows. Texts are read once, for size and checksum, and never shuffled.
    """
    ws = Workspace(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit(1).cast("long").alias("one"))
    sized = ws.save(sized)
    total = sized.agg(F.sum("size").alias("n")).head()["n"] or 1
    placed = order_prefix(ws, sized, ["doc_id", "size", "text_crc32"], ["size", "one"])
    # The middle byte settles the shard; whole numbers as decimals, since corpora overflow 64 bits here.
    middle = F.expr(f"CAST({shards} AS DECIMAL(10,0)) * CAST(2 * before_size + size AS DECIMAL(24,0)) div CAST({2 * total} AS DECIMAL(24,0))")
    placed = ws.save(placed.select("doc_id", "size", "text_crc32", "before_one", F.least(F.lit(shards - 1), middle.cast("int")).alias("shard")))
    first = placed.groupBy("shard").agg(F.min("before_one").alias("first"))  # a row for each shard
    out = placed.join(F.broadcast(first), "shard")
    ws.drop(sized)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before_one") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))
