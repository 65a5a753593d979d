"""The corpus pipeline: five stages from raw documents to encoded training text.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents; other columns of docs are ignored, whatever their names.

Null, empty and very long texts are documents like others: a text without words is kept by all stages unless the classifier
rejects it. Rows that share a doc_id are judged each by its own text by the classifier and by decontamination, and are one
document for near_dedup, which keeps or drops them together. Rows without doc_id are never near-duplicates, and come last
for substring_dedup. Repeated rows stay repeated. An empty table gives an empty one at every stage; without labels
the classifier rejects nothing, without a benchmark nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.common import Workspace, scratch, table
from quillmesh.llm.decontam import drop_contaminated
from quillmesh.llm.near_dup import near_duplicates
from quillmesh.llm.pieces import digest, encode
from quillmesh.llm.quality import score_quality
from quillmesh.llm.substring import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects."""
    scored = score_quality(docs, table(spark, sf_dir, "labels"), keep=("text", "lang", "source", "n_chars"))
    return scored.filter("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group of near-duplicates (five words, similarity 0.8)."""
    gone = near_duplicates(docs).filter("not kept").select("doc_id")
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that occur earlier, and documents of which nothing is left. Untouched texts stay as they are."""
    cut = remove_repeats(docs, carry=("text", "lang", "source"))
    changed = F.col("n_removed") > 0
    out = cut.filter((F.col("n_words") > F.col("n_removed")) | ~changed)
    out = out.withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every document; one row each."""
    import public_tokenizers

    return digest(encode(docs, public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("sentencepiece", sentencepiece)]
#: A trained classifier and lattice search are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        with scratch():  # a stage's own tables go as soon as its result is written
            before, docs = docs, ws.save(stage(spark, docs, sf_dir))
        if i:
            ws.drop(before)
    return docs
