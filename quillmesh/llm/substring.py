"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is `window` consecutive words. Its minimiser is the least hash among its m-word runs; consecutive windows that
share that run form one super-k-mer, which travels as one packed string (128-bit word codes) to the bucket of its minimiser.
Equal windows have equal minimisers, so each bucket can be judged alone: sorting its windows shows which occur earlier.

Most windows occur once, so the strings of a bucket travel only where that can matter:
1. census: super-k-mers as (minimiser, string hash, place); minimisers that occur once are done;
2. equal strings: all but the first occurrence are repeated whole (an aggregation that combines before the shuffle, so a
   passage in a third of the documents is a few rows);
3. buckets with several different strings: one packed string for each distinct string travels, sorted by bucket, and its
   windows are sorted. A bucket of more than `SPLIT` strings is dealt out by window instead, and its windows are counted as
   in step 2, so no group grows without bound.

Whole strings and single windows, in buckets of every size, count as equal if two independent 64-bit hashes agree, each over
its own half of the word codes: at 10^12 windows two different ones are mistaken for each other with chance 10^-14.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, enter, give_back, mix, raw, row_key, run_hashes, slices, table, text_words

MINIMISER = 6
SPLIT = 4096
#: Packed bytes that a task sorts at a time.
CHUNK = 8 << 20
#: Rows that a worker hands over at a time, about.
ROWS = 20_000

_PLACE = "_id long, _th long, start int, n int"


def super_kmers(h: np.ndarray, window: int, m: int) -> tuple[np.ndarray, ...]:
    """(minimiser, the string's two hashes, start, number of windows) of each super-k-mer in a document of word codes h."""
    count = len(h) - window + 1
    if count <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    # Leftmost least run of each window, by doubling. Equal windows have it at the same offset, so two of them never share
    # one super-k-mer, not even in periodic text.
    low = run_hashes(h[:, 0], m)
    at = np.arange(len(low))
    span, size = window - m + 1, 1
    while size < span:
        step = min(size, span - size)
        right = low[step:] < low[:-step]
        low, at = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])
        size += step
    starts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    n = np.diff(np.append(starts, count))
    # A string's hash from prefix sums of word code times an odd power, brought back to power 0 by the inverse.
    up, down = _powers(len(h) + 1)
    ends = starts + n + window - 1
    texts = []
    for half in range(2):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h[:, half]) * up[: len(h)], dtype=np.uint64)])
        texts.append(mix((sums[ends] - sums[starts]) * down[starts] + (n + window).astype(np.uint64)).view(np.int64))
    return low[starts].view(np.int64), *texts, starts, n


_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_tables[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, np.uint64(base), np.uint64)
            x[0] = 1
            _tables[i] = np.cumprod(x, dtype=np.uint64)
    return _tables


_STRING = "low long, string long, string2 long, "


def _words(column: pa.Array) -> Iterator[np.ndarray]:
    """Word codes of each text of a column."""
    codes, at = text_words(column)
    return (codes[i:j] for i, j in zip(at[:-1], at[1:], strict=True))


def _census(window: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substring")
        for b in slices(batches):
            found = [super_kmers(h, window, m) for h in _words(b.column("text"))]
            sizes = [len(f[0]) for f in found]
            if not sum(sizes):
                continue
            rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            low, one, two, start, n = (np.concatenate([f[i] for f in found]) for i in range(5))
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(one), pa.array(two), b.column("_id").take(rows), b.column("_th").take(rows), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["low", "string", "string2", "_id", "_th", "start", "n"])

    return run


def _wanted(batches: Iterator[pa.RecordBatch]):
    """(word codes, _id, _th, wanted) of each document."""
    for b in slices(batches):
        yield list(zip(_words(b.column("text")), b.column("_id").to_pylist(), b.column("_th").to_pylist(), b.column("wanted").to_pylist(), strict=True))


def _pack(window: int):
    """The packed string of each wanted super-k-mer."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def batch(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["bucket", "_id", "_th", "start", "n", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _wanted(batches):
            out: list[list] = [[] for _ in kinds]
            for h, i, th, wanted in rows:
                for w in wanted:
                    s, n = w["start"], w["n"]
                    for col, v in zip(out, (w["low"], i, th, s, n, h[s : s + n + window - 1].tobytes()), strict=True):
                        col.append(v)
                if len(out[0]) >= ROWS:
                    yield batch(out)
                    out = [[] for _ in kinds]
            yield batch(out)

    return run


def _singles(window: int):
    """Each window of the wanted super-k-mers as a super-k-mer of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _wanted(batches):
            out: list[list] = [[] for _ in range(6)]
            for h, i, th, wanted in rows:
                one, two = (run_hashes(h[:, half], window).view(np.int64).tolist() for half in range(2))
                for w in wanted:
                    s, n = w["start"], w["n"]
                    for col, v in zip(out, ([w["low"]] * n, one[s : s + n], two[s : s + n], [i] * n, [th] * n, range(s, s + n)), strict=True):
                        col.extend(v)
            out.append([1] * len(out[0]))
            kinds = (*[pa.int64()] * 5, pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["low", "string", "string2", "_id", "_th", "start", "n"])

    return run


def repeated_windows(window: int, bucket: np.ndarray, doc: np.ndarray, th: np.ndarray, start: np.ndarray, n: np.ndarray, packed: list[bytes]) -> list[np.ndarray]:
    """Places (doc, th, start) of the windows that occur earlier, by sorting all windows of complete buckets."""
    codes = np.frombuffer(b"".join(packed), np.uint64).reshape(-1, 2)
    offset = np.concatenate([[0], np.cumsum([len(p) // 16 for p in packed])[:-1]]).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at, b, d, t, s = offset[row] + step, bucket[row], doc[row], th[row], start[row] + step
    w, v = (run_hashes(codes[:, half], window)[at] for half in range(2))
    order = np.lexsort((s, d, v, w, b))
    b, d, t, s, w, v = (x[order] for x in (b, d, t, s, w, v))
    same = np.zeros(len(at), bool)
    same[1:] = (b[1:] == b[:-1]) & (w[1:] == w[:-1]) & (v[1:] == v[:-1])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))
    late = (d[head] != d) | (s[head] != s)
    return [d[late], t[late], s[late]]


def _judge(window: int):
    """Streams rows sorted by bucket; sorts the windows of as many complete buckets as fill a chunk."""

    def ready(t: pa.Table) -> pa.RecordBatch:
        col = lambda c: t.column(c).to_numpy()
        d, th, s = repeated_windows(window, col("bucket"), col("_id"), col("_th"), col("start").astype(np.int64), col("n").astype(np.int64), t.column("packed").to_pylist())
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(th), pa.array(s.astype(np.int32)), pa.array(np.ones(len(d), np.int32))], ["_id", "_th", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.nbytes
            if size >= CHUNK:
                t = pa.Table.from_batches(held)
                keys = t.column("bucket").to_numpy()
                cut = int(np.flatnonzero(keys != keys[-1]).max(initial=-1)) + 1
                if cut:
                    yield ready(t.slice(0, cut))
                    t = t.slice(cut)
                held, size = t.combine_chunks().to_batches(), t.nbytes
        if held:
            yield ready(pa.Table.from_batches(held))
        held.clear()
        give_back()

    return run


def repeated_ranges(docs: DataFrame, ws: Workspace, window: int = 20) -> DataFrame:
    """(_id, _th, ranges): for each document with repeated windows, the (start, n) of runs of them."""
    repeated, wanted = _whole(docs, ws, window)
    parts = [repeated, _sorted(docs, ws, wanted, window), _dealt(docs, ws, wanted, window)]
    every = repeated.filter("later").drop("later").union(parts[1]).union(parts[2])
    out = ws.save(every.groupBy("_id", "_th").agg(F.collect_list(F.struct("start", "n")).alias("ranges")))
    ws.drop(*parts, wanted)
    return out


def _later(rows: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Each place with its string's verdict: later (the string occurs earlier too) or not; and each string's first place."""
    key = ["low", "string", "string2"]
    strings = ws.save(rows.groupBy(*key).agg(F.min(F.struct("_id", "start", "_th", "n")).alias("first")))
    first = strings.select(*key, F.col("first._id").alias("f_id"), F.col("first.start").alias("f_start"))
    later = (F.col("_id") != F.col("f_id")) | (F.col("start") != F.col("f_start"))
    return ws.save(rows.join(first, key).select("_id", "_th", "start", "n", later.alias("later"))), strings


def _whole(docs: DataFrame, ws: Workspace, window: int) -> tuple[DataFrame, DataFrame]:
    """Super-k-mers, with whether their string occurs earlier; and by document those whose windows need a closer look."""
    every = ws.save(docs.select("_id", "_th", "text").mapInArrow(_census(window, MINIMISER), _STRING + _PLACE))
    often = ws.save(every.groupBy("low").agg(F.count("*").alias("c")).filter("c > 1").select("low"), narrow=True)
    some = ws.save(every.join(often, "low"))
    ws.drop(every, often)
    repeated, strings = _later(some, ws)
    ws.drop(some)
    many = ws.save(strings.groupBy("low").agg(F.count("*").alias("d")).filter("d > 1").select("low", (F.col("d") > SPLIT).alias("large")), narrow=True)
    wanted = strings.join(many, "low").select("first._id", "first._th", F.struct("first.start", "first.n", "low", "large").alias("w"))
    wanted = ws.save(wanted.groupBy("_id", "_th").agg(F.collect_list("w").alias("wanted")))
    ws.drop(strings, many)
    return repeated, wanted


def _texts(docs: DataFrame, wanted: DataFrame, large: bool) -> DataFrame:
    of = wanted.select("_id", "_th", F.filter("wanted", lambda w: w["large"] == F.lit(large)).alias("wanted")).filter("size(wanted) > 0")
    return docs.select("_id", "_th", "text").join(of.hint("shuffle_hash"), ["_id", "_th"])


def _sorted(docs: DataFrame, ws: Workspace, wanted: DataFrame, window: int) -> DataFrame:
    """Buckets of SPLIT strings at most: their packed strings meet and their windows are sorted."""
    packed = _texts(docs, wanted, False).mapInArrow(_pack(window), "bucket long, _id long, _th long, start int, n int, packed binary")
    return ws.save(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_judge(window), _PLACE))


def _dealt(docs: DataFrame, ws: Workspace, wanted: DataFrame, window: int) -> DataFrame:
    """Larger buckets are dealt out by window, and each window counted like a string."""
    if not wanted.filter(F.exists("wanted", lambda w: w["large"])).limit(1).count():
        return wanted.sparkSession.createDataFrame([], _PLACE)
    rows = ws.save(_texts(docs, wanted, True).mapInArrow(_singles(window), _STRING + _PLACE))
    placed, strings = _later(rows, ws)
    out = ws.save(placed.filter("later").drop("later"))
    ws.drop(rows, strings, placed)
    return out


def _strip(window: int, passed: tuple[str, ...]):
    """Removes covered words. kept: the words that stay joined by one space; same: nothing was removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            total, gone, kept, digest = [], [], [], []
            for text, ranges in zip(raw(b.column("text")), b.column("ranges").to_pylist(), strict=True):
                words = (text or b"").split()
                total.append(len(words))
                if ranges:
                    edge = np.zeros(len(words) + 1, np.int32)
                    for r in ranges:
                        edge[r["start"]] += 1
                        edge[r["start"] + r["n"] + window - 1] -= 1
                    drop = np.cumsum(edge[:-1]) > 0
                    words = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
                digest.append(hashlib.sha256(kept[-1]).hexdigest())
            own = [pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digest)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in passed), *own], [*passed, "n_words", "n_removed", "kept", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, window: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, the columns named in carry, n_words, n_removed, kept (text), kept_sha256.

    Words are runs of characters other than ASCII white space, unchanged. A word goes if a window of `window` words covers
    it whose words also start earlier: in a smaller doc_id, or earlier in the same document. Windows are judged on the
    input. A null, empty or short text has no window and keeps its words. Null doc_ids come after all others, as one
    document. Rows that share a doc_id are one place in that order, so none of them is earlier than another. Columns not
    named are ignored. No rows give no rows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark)
    keyed = row_key(docs)
    ranges = repeated_ranges(keyed, ws, window)
    rows = keyed.select("doc_id", "_id", "_th", *{"text": 0, **dict.fromkeys(carry)}).join(ranges.hint("shuffle_hash"), ["_id", "_th"], "left").drop("_id", "_th")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *carry)) + ", n_words long, n_removed long, kept string, kept_sha256 string"
    return rows.mapInArrow(_strip(window, ("doc_id", *carry)), schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
late AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM late),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
