"""What the training-data operators share: table reading, durable intermediate tables, word hashes, prefix sums."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space; bytes.split() cuts at the same six characters.
WORD_GAP = r"[\x20\x09-\x0D]+"
NO_ID = 2**63 - 1

_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of the slices that Python functions work on.
SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to `rows` rows and about SLICE_BYTES bytes at most (a longer row alone): texts can be long.

    So what a Python function holds is bounded whatever the session's own batch settings are; they stay as they are.
    At the end of a task the worker gives back what its allocators have kept, as it lives on beside the executor's JVM.
    """
    try:
        for b in batches:
            step = max(1, min(rows, b.num_rows * SLICE_BYTES // max(1, b.nbytes)))
            for i in range(0, b.num_rows, step):
                yield b.slice(i, step)
            b = None
    finally:
        give_back()


def give_back() -> None:
    """Free memory goes back to the system: Arrow's pool, then the C library's heap where it can be trimmed."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_scratch: ContextVar[list[Workspace] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch() -> Iterator[None]:
    """All intermediate tables that operators make inside are removed at its end; results have to be written by then."""
    mine: list[Workspace] = []
    before = _scratch.set(mine)
    try:
        yield
    finally:
        _scratch.reset(before)
        for ws in mine:
            ws.close()


class Workspace:
    """Intermediate tables in the folder that spark.checkpoint.dir names.

    They are Parquet files on shared storage, so a lost executor costs a re-read and never a recomputation. drop() removes
    a table that nothing reads any more, close() the whole folder; inside scratch() the caller needn't hold it. Without the
    setting a local session (as in tests) gets a temporary folder; on a cluster that is an error, as executors don't share it.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not where:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            where = "file://" + tempfile.mkdtemp(prefix="quillmesh-")
            spark.conf.set("spark.checkpoint.dir", where)
        self.root = f"{where.rstrip('/')}/quillmesh-{uuid.uuid4().hex}"
        self._n = 0
        if (mine := _scratch.get()) is not None:
            mine.append(self)

    def path(self) -> str:
        self._n += 1
        return f"{self.root}/t{self._n}"

    def save(self, df: DataFrame, narrow: bool = False) -> DataFrame:
        """narrow: rows of a few numbers, in an eighth of the files; to make a file costs more than such rows do."""
        path = self.path()
        if narrow:
            df = df.coalesce(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions", "200")) // 8))
        # Nobody waits for the marker of a finished job: the table is read by this driver only.
        df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.__dict__["_stored_at"] = path
        return out

    def view(self, stored: DataFrame, df: DataFrame) -> DataFrame:
        """df, which reads nothing but the stored table, is from now on what drop() takes to remove it."""
        df.__dict__["_stored_at"] = stored.__dict__.pop("_stored_at")
        return df

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            if path := df.__dict__.pop("_stored_at", None):
                self._delete(path)
        self.release()

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def release(self) -> None:
        """Shuffle files of finished plans go only when the driver collects its garbage; long jobs need that sooner."""
        gc.collect()
        self.spark._jvm.System.gc()


#: What operators remember in a Python worker across tasks: a function that forgets it, by operator.
_remembered: dict[str, Callable[[], None]] = {}


def enter(operator: str, forget: Callable[[], None] | None = None) -> None:
    """Called where an operator's work in a Python worker begins: the worker forgets what other operators have left."""
    for name in [n for n in _remembered if n != operator]:
        _remembered.pop(name)()
    if forget is not None:
        _remembered[operator] = forget


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each run of k consecutive words; none if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = out * _STEP + hashes[i : i + n]
    return mix(out)


def numbered(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of a column of lists of strings: the distinct ones that are not empty, each one's number among them in the order of
    the lists, and where each list begins (one more: the end)."""
    flat = lists.flatten()
    real = np.asarray(pc.binary_length(flat)) > 0
    kept = np.concatenate([[0], np.cumsum(real)])
    found = flat.filter(pa.array(real)).dictionary_encode()
    at = np.asarray(lists.offsets)
    return found.dictionary, found.indices.to_numpy(), kept[at - at[0]]


def numbered_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """numbered() of the words of a string column (null: none), cut at ASCII white space."""
    return numbered(pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null("")))


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128-bit codes of all words of a column as rows of two 64-bit numbers, and where each text's words begin."""
    distinct, codes, at = numbered_words(texts)
    digests = b"".join(map(xxhash.xxh3_128_digest, distinct.cast(pa.large_binary()).to_pylist()))
    return np.frombuffer(digests, "<u8").reshape(-1, 2)[codes], at


def raw(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).to_pylist()


def row_key(df: DataFrame, text: str = "text") -> DataFrame:
    """_id: doc_id with a place for null, after all others; _th: tells rows apart that share a doc_id."""
    return df.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("_th", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


def rows_of(batch: pa.RecordBatch | pa.Table, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def order_prefix(ws: Workspace, df: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """Adds before_<s> for each s in sums: its total over all rows that come earlier by the columns of order.

    Nulls come first; rows that are equal in all columns of order take any order among themselves, but a fixed one. No
    window spans the table: rows are dealt into sorted ranges by those columns and a running number, so that even rows of
    one key fill many ranges; each range is summed, the few range totals (one row a range) are summed in turn and joined
    back, and a window runs within each range only. df is read twice, so pass a narrow, stored table.
    """
    n = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = df.withColumn("_m", F.monotonically_increasing_id()).repartitionByRange(n, *order, "_m")
    dealt = ws.save(dealt.withColumn("_r", F.spark_partition_id()))
    totals = dealt.groupBy("_r").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_r", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums])
    inside = Window.partitionBy("_r").orderBy(*order, "_m").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(totals), "_r")  # one row a range: n at most
    for s in sums:
        out = out.withColumn(f"before_{s}", F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0)))
    return out.drop("_r", "_m", *[f"_o_{s}" for s in sums])
