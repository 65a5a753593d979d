"""Benchmark decontamination by spaced-seed hashing.

A seed looks at some of the words under a fixed mask and ignores the others. Hashes of the documents' masked words are
joined with those of the benchmark; each hit gives an alignment of a document with an item, and the words around it are
compared. A document is contaminated if a stretch of WORDS aligned words differs in SUBSTITUTIONS places at most (shorter
items: see allowed()). The masks find every such stretch: whichever of its words differ, one mask fits without them.

The benchmark may be large: its seeds are a table, not a value on the driver. What travels ahead is a Bloom filter of fixed
size (2 tables of 2^BITS bits) made of them. Documents are read once; only seeds that pass the filter leave the scan, each
with the few words around it, so a hit is judged where the join brings it and no text is moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, Workspace, enter, mix, row_key, slices, table

MASKS = ("111011011", "11010010111", "11001110011", "111111001")
WORDS, SUBSTITUTIONS = 13, 2
BITS = 24
_WORD = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def allowed(n: int) -> int:
    """Differences within a stretch of n words: SUBSTITUTIONS in WORDS words, in proportion for items of fewer (rounded down)."""
    return SUBSTITUTIONS * n // WORDS


def masks_for(n: int) -> tuple[str, ...]:
    """Masks for items of n words. With one difference in a short item, two of its thirds are as they were."""
    if n >= WORDS:
        return MASKS
    if not allowed(n):
        return ("1" * n,)
    third = [i * 3 // n for i in range(n)]
    return tuple("".join("0" if t == out else "1" for t in third).strip("0") for out in range(3))


def words_of(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased words (letters, digits, underscores)."""
    w = _WORD.findall((text or "").lower())
    return np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))


def seeds(h: np.ndarray, mask: str, n: int) -> np.ndarray:
    """The masked hash at each place where the mask fits, for stretches of n words."""
    m = len(h) - len(mask) + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.full(m, np.uint64(int(mask, 2) * 64 + n), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = out * _STEP + h[i : i + m]
    return mix(out)


def around(h: np.ndarray, p: int, mask: str, n: int) -> tuple[int, bytes]:
    """The words of all stretches of n words that hold the mask at p: how many stand before p, and their hashes."""
    first = max(0, p + len(mask) - n)
    return p - first, h[first : p + n].tobytes()


_SEED = [("hash", pa.int64()), ("span", pa.int32()), ("n", pa.int32()), ("place", pa.int32()), ("before", pa.int32()), ("near", pa.binary())]
_SEED_DDL = "hash long, span int, n int, place int, before int, near binary"


def _columns(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True) if rows else [[]] * len(_SEED), _SEED, strict=True)]


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        keys, rows = [], []
        for key, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
            h = words_of(text)
            n = min(WORDS, len(h))
            for mask in masks_for(n) if n else ():
                for p, s in enumerate(seeds(h, mask, n).view(np.int64).tolist()):
                    rows.append((s, len(mask), n, p, *around(h, p, mask, n)))
            keys += [key] * (len(rows) - len(keys))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *_columns(rows)], ["item", *(c for c, _ in _SEED)])


class Filter:
    """A Bloom filter of 64-bit hashes: two tables, read by the lowest BITS bits and the next."""

    def __init__(self, hashes: DataFrame, bits: int) -> None:
        self.bits, self.tables = bits, []
        for i in range(2):
            place = F.shiftrightunsigned("hash", i * bits).bitwiseAND(F.lit((1 << bits) - 1)) + 1
            rows = hashes.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
            out = np.zeros((1 << bits) // 8, np.uint8)
            for r in rows.collect():  # at most 2^bits / 32768 rows of 4 kB, however large the benchmark is
                part = np.frombuffer(r["m"], np.uint8)[: len(out)]
                out[(r["k"] - 1) * 4096 : (r["k"] - 1) * 4096 + len(part)] = part
            self.tables.append(out)

    def reader(self):
        """A function: the places of an array of hashes that pass."""
        first, second = (np.unpackbits(t, bitorder="little").astype(bool) for t in self.tables)
        low = np.uint64((1 << self.bits) - 1)

        def passing(h: np.ndarray) -> np.ndarray:
            at = np.flatnonzero(first[h & low])
            return at[second[(h[at] >> np.uint64(self.bits)) & low]]

        return passing


def _scan(sieve: Filter, sizes: list[int]):
    """One row a document (without hash), and one for each of its seeds that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("decontam")
        passing = sieve.reader()
        for b in slices(batches):
            at, rows, n_words = [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                h = words_of(text)
                at.append(i)
                rows.append((None,) * len(_SEED))
                n_words.append(len(h))
                for n in sizes:
                    for mask in masks_for(n):
                        s = seeds(h, mask, n)
                        for p in passing(s).tolist():
                            at.append(i)
                            rows.append((int(s[p : p + 1].view(np.int64)[0]), len(mask), n, p, *around(h, p, mask, n)))
                            n_words.append(None)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("doc_id", "_id", "_th")), pa.array(n_words, pa.int64()), *_columns(rows)], ["doc_id", "_id", "_th", "n_words", *(c for c, _ in _SEED)])

    return run


def stretches(doc: bytes, before: int, item: bytes, first: int, n: int) -> list[int]:
    """Where stretches of n aligned words within the bounds begin, counted from the place of the seed."""
    a, z = np.frombuffer(doc, np.uint64), np.frombuffer(item, np.uint64)
    lead = min(before, first)
    a, z = a[before - lead :], z[first - lead :]
    size = min(len(a), len(z))
    if size < n:
        return []
    differ = np.concatenate([[0], np.cumsum(a[:size] != z[:size])])
    return (np.flatnonzero(differ[n:] - differ[:-n] <= allowed(n)) - lead).tolist()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of joined seeds the stretches: their begin in the item, by alignment."""
    for b in slices(batches):
        at, starts = [], []
        columns = (b.column(c).to_pylist() for c in ("near", "before", "i_near", "i_before", "n", "i_place"))
        for i, (near, before, i_near, i_before, n, place) in enumerate(zip(*columns, strict=True)):
            for s in stretches(near, before, i_near, i_before, n):
                at.append(i)
                starts.append(place + s)
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("_id", "_th", "item", "shift", "n")), pa.array(starts, pa.int32())], ["_id", "_th", "item", "shift", "n", "start"])


def _found(ws: Workspace, docs: DataFrame, benchmark: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """One row a document (doc_id, _id, _th, n_words), and one for each contaminated text (_id, _th, ids, overlap_words)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct().withColumn("item", F.xxhash64("item_id", "text"))
    seeded = ws.save(items.select("item", "text").mapInArrow(_item_seeds, "item long, " + _SEED_DDL))
    sieve = Filter(seeded, bits)
    sizes = sorted(r["n"] for r in seeded.select("n").distinct().collect())  # WORDS values at most
    kind = dict(docs.dtypes)["doc_id"]
    keyed = row_key(docs.select("doc_id", "text")).select("doc_id", "_id", "_th", "text")
    scanned = ws.save(keyed.mapInArrow(_scan(sieve, sizes), f"doc_id {kind}, _id long, _th long, n_words long, " + _SEED_DDL))
    hits = scanned.filter("hash is not null").select("_id", "_th", "hash", "span", "n", "place", "before", "near")
    sides = seeded.select("item", "hash", "span", "n", F.col("place").alias("i_place"), F.col("before").alias("i_before"), F.col("near").alias("i_near"))
    met = hits.join(sides, ["hash", "span", "n"]).withColumn("shift", F.col("place") - F.col("i_place"))
    met = met.select("_id", "_th", "item", "shift", "n", "near", "before", "i_near", "i_before", "i_place").mapInArrow(_verify, "_id long, _th long, item long, shift int, n int, start int")
    # Words covered by stretches of n words that begin at sorted places: n for the last, up to the next begin for the others.
    lines = met.groupBy("_id", "_th", "item", "shift", "n").agg(F.array_sort(F.collect_set("start")).alias("s"))
    steps = F.zip_with(F.slice("s", 2, F.size("s")), F.slice("s", 1, F.greatest(F.lit(1), F.size("s") - 1)), lambda b, a: F.least(F.col("n"), F.coalesce(b - a, F.lit(0))))
    lines = lines.select("_id", "_th", "item", (F.col("n") + F.aggregate(steps, F.lit(0), lambda x, y: x + y)).cast("long").alias("words"))
    by_text = lines.join(items.select("item", "item_id"), "item").groupBy("_id", "_th")
    return scanned.filter("hash is null"), ws.save(by_text.agg(F.array_sort(F.collect_set(F.coalesce("item_id", F.lit(NO_ID)))).alias("ids"), F.max("words").alias("overlap_words")))


def find_contamination(docs: DataFrame, benchmark: DataFrame, bits: int = BITS) -> DataFrame:
    """One row a document: doc_id, n_words, contaminated, kept, n_items, item_ids, overlap_words.

    Words are runs of letters, digits and underscores, lower-cased. item_ids: the items of which the document holds WORDS
    aligned words with SUBSTITUTIONS differences at most. An item of fewer words has to be there whole, with one difference
    from 7 words on and none below. overlap_words: the most words of one item that such stretches of one alignment cover.

    Null, empty and short texts are clean; items without words match nothing; items with different ids but equal texts are
    both reported, repeated rows of the benchmark once. Rows that share a doc_id are judged each by its own text. Other
    columns are ignored. An empty benchmark leaves all clean; no documents give no rows. Memory: a worker holds the filter
    and one slice of texts; hot seeds are joined as exchanges of stored tables, which can be split.
    """
    rows, found = _found(Workspace(docs.sparkSession), docs, benchmark, bits)
    out = rows.select("doc_id", "_id", "_th", "n_words").join(found, ["_id", "_th"], "left")
    ids = F.coalesce(F.transform("ids", lambda i: F.when(i != NO_ID, i)), F.array().cast("array<long>"))
    hit = F.col("ids").isNotNull()
    return out.select("doc_id", "n_words", hit.alias("contaminated"), (~hit).alias("kept"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.coalesce("overlap_words", F.lit(0)).cast("long").alias("overlap_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, bits: int = BITS) -> DataFrame:
    """docs, in all its columns, without the rows that find_contamination() reports."""
    _, found = _found(Workspace(docs.sparkSession), docs, benchmark, bits)
    return row_key(docs).join(found.select("_id", "_th"), ["_id", "_th"], "left_anti").select(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
