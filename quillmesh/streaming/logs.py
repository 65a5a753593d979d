"""Question logs and events as streams: a file source, watermarked windows, and per-batch upserts of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.packs import QLOG, exists


def question_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of qlog-*.jsonl files as they arrive."""
    rows = spark.readStream.schema(QLOG).option("pathGlobFilter", "qlog-*.jsonl").json(folder)
    miss = F.coalesce("miss", F.lit(False)) | F.coalesce("search_miss", F.lit(False))
    return rows.select("ts", "question", "mode", miss.alias("miss"), X.normalize_question("question").alias("key")).filter("key != ''")


def counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("key").agg(F.count("*").alias("n"), F.count_if("miss").alias("misses"))


def windowed(events: DataFrame, at: str, by: str, width: str, late: str) -> DataFrame:
    """Counts by time window; rows later than `late` are dropped by the watermark."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, at: str, by: str, gap: str, late: str) -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n"))


def run_once(stream: DataFrame, folder: str) -> DataFrame:
    """Processes what is there, then stops; the result as a table below `folder`, which executors write, not the driver.

    Each batch replaces the table by all keys so far. Nothing to process leaves an empty table.
    """
    out = f"{folder}/result"

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(out) if exists(spark, out) else spark.createDataFrame([], stream.schema)
