"""The folder that driver and executors share, for what has to outlive a stage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir. Without that setting a local session (as in tests) gets a temporary folder; on
    a cluster it is an error, since executors would write to their own disks."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillmesh-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what follows has a short plan, and the driver gives the memory of the plan before
    back. For narrow rows: they go to an eighth of the files that a shuffle has."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // 8)
    df.repartition(files).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)
