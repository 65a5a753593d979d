"""Near-duplicate detection by circulant MinHash, banding and exact verification.

Each document's set of word shingles is hashed to 64 bits. Two permutations give the whole signature: sigma places the
shingles on a circle of 2^32 slots, and coordinate k is the least pi(sigma(x) + k) over the set, pi applied after a circular
shift by k. Coordinates are cut into bands; documents that agree in a band are candidates; full sets confirm each link.

How it stays linear where a group of copies holds much of the input:
- documents with equal sets are one class from the start (an aggregation that combines before the shuffle);
- each class is first compared with one other only, the least class of all its band buckets, and what links is merged;
- then with the least class of each of its buckets (a star), where that lies in another component;
- only buckets that still hold several components are compared across components, in blocks, never all with all.
So every candidate pair is either verified or already connected, and no link between candidates is lost.

Sets hold 64-bit hashes of shingles, and links are confirmed on them: two texts link wrongly only if shingles collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, enter, mix, raw, run_hashes, slices, table, word_hashes

#: Signature coordinates at most, and the chance to miss a pair that lies exactly at the threshold.
COORDINATES, MISS = 192, 1e-6
#: Rows of the blocks in which buckets that hold several components are compared.
BLOCK = 512
#: Coordinates of the longer signature that their members get for it; estimates by it are twice as sharp.
LONG = 1024


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one shingle, no words none."""
    words = (text or b"").lower().split()  # bytes.lower() maps A-Z only
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    return np.unique(run_hashes(h, min(k, len(h))))


def bands_for(threshold: float) -> tuple[int, int]:
    """(rows, bands): the most rows a band for which a pair at the threshold is missed with chance MISS at most."""
    for rows in range(12, 0, -1):
        bands = COORDINATES // rows
        if (1 - threshold**rows) ** bands <= MISS:
            return rows, bands
    return 1, COORDINATES


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """n circulant MinHash coordinates (uint32)."""
    sigma = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(1, n + 1, dtype=np.uint32)[:, None]
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(sigma), 1024):
        x = sigma[None, i : i + 1024] + shift
        t = x >> np.uint32(16)
        x ^= t
        x *= np.uint32(0x85EBCA6B)
        np.right_shift(x, np.uint32(13), out=t)
        x ^= t
        x *= np.uint32(0xC2B2AE35)
        np.right_shift(x, np.uint32(16), out=t)
        x ^= t
        np.minimum(out, x.min(axis=1), out=out)
    return out


def _profile(k: int, rows: int, bands: int):
    """Per document: set size, set digest, band hashes, and the low byte of each coordinate for quick estimates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("near_dup")
        for b in slices(batches):
            sizes, keys, sigs = [], [], []
            for text in raw(b.column("text")):
                s = shingle_set(text, k)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append(signature(s, rows * bands))
            if not sizes:
                continue
            sig = np.array(sigs, np.uint32)
            part = sig.reshape(len(sig), bands, rows).astype(np.uint64)
            h = np.broadcast_to(np.arange(bands, dtype=np.uint64), part.shape[:2])
            for i in range(rows):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + part[:, :, i])
            flat = pa.array(h.astype(np.int64).ravel())
            offsets = pa.array(np.arange(len(sig) + 1, dtype=np.int32) * bands)
            low = sig.astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(offsets, flat), pa.array([r.tobytes() for r in low], pa.binary())],
                ["doc_id", "n_shingles", "key", "bands", "low"],
            )

    return run


def _agreeing(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    return (a == b).mean(axis=1) >= least


def _estimate(least: float):
    """Drops pairs whose signatures agree far too seldom: 6.5 standard deviations below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if not b.num_rows:
                continue
            a, z = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in ("low_a", "low_b"))
            yield b.select(["a", "b"]).filter(pa.array(_agreeing(a, z, least)))

    return run


def _confirm(percent: int):
    """Keeps pairs with 100 * intersection >= percent * union, on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ok = []
            for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum())
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([shingle_set(t, k).tobytes() for t in raw(b.column("text"))], pa.binary())], ["id", "set"])

    return run


def _long(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sigs = [signature(shingle_set(t, k), LONG).astype(np.uint8).tobytes() for t in raw(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sigs, pa.binary())], ["id", "low"])

    return run


def _cross(least: float):
    """Pairs across components within a block, or between two blocks, of one bucket; by signature estimate.

    A pair that shares an earlier band too is left to that band's bucket.
    """

    def run(key, t):
        _, inner, x, y = (k.as_py() for k in key)
        ids, comp = t.column("id").to_numpy(), t.column("comp").to_numpy()
        side, band = t.column("side").to_numpy(), t.column("band")[0].as_py()
        low = np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint8).reshape(len(ids), -1)
        earlier = np.asarray(t.column("bands").combine_chunks().flatten()).reshape(len(ids), -1)[:, :band]
        a, b = [], []
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        within = not inner and x == y
        for n, i in enumerate(left.tolist()):
            js = left[n + 1 :] if within else right
            js = js[(comp[js] != comp[i]) & (ids[js] != ids[i])]
            js = js[~(earlier[js] == earlier[i]).any(axis=1)] if len(js) else js
            js = js[_agreeing(low[js], low[i][None, :], least)] if len(js) else js
            a += [ids[i]] * len(js)
            b += ids[js].tolist()
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """id and component_id (least reachable id) of every id in edges (a, b), by label passing with pointer jumping."""
    both = ws.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), narrow=True)
    labels = ws.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("c")), narrow=True)
    while True:
        # The label of an id's label, then the least label among the neighbours.
        jumped = labels.alias("l").join(labels.select(F.col("id").alias("r"), F.col("c").alias("rc")), F.col("l.c") == F.col("r"), "left")
        jumped = jumped.select("id", "c", F.least("c", "rc").alias("j"))
        near = both.join(jumped.select(F.col("id").alias("b"), "j"), "b").groupBy("a").agg(F.min("j").alias("m"))
        new = ws.save(jumped.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("j", "m").alias("c"), (F.least("j", "m") < F.col("c")).alias("moved")), narrow=True)
        ws.drop(labels)
        labels = new
        if not labels.filter("moved").limit(1).count():
            ws.drop(both)
            return ws.view(labels, labels.select("id", F.col("c").alias("component_id")))


class NearDuplicates:
    """One run over a table of documents. See near_duplicates()."""

    def __init__(self, docs: DataFrame, k: int, percent: int) -> None:
        self.spark = docs.sparkSession
        self.ws = Workspace(self.spark)
        self.docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.k, self.percent, t = k, percent, percent / 100
        self.rows, self.bands = bands_for(t)
        self.least = t - 6.5 * (t * (1 - t) / (self.rows * self.bands)) ** 0.5

    def classes(self) -> DataFrame:
        """Each document with the least doc_id of those with an equal set."""
        prof = self.ws.save(self.docs.mapInArrow(_profile(self.k, self.rows, self.bands), "doc_id long, n_shingles long, key binary, bands array<long>, low binary"))
        # Stored before the join, so that both of its sides are exchanges and a hot key's rows can be split.
        groups = self.ws.save(prof.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n"), narrow=True)
        named = prof.join(groups, "key", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
        keep = F.col("doc_id") == F.col("rep")
        out = self.ws.save(named.select("doc_id", "n_shingles", "rep", F.when(keep, F.col("bands")).alias("bands"), F.when(keep, F.col("low")).alias("low")))
        self.ws.drop(prof, groups)
        return out

    def buckets(self, reps: DataFrame) -> DataFrame:
        """Band buckets with two classes or more: bucket, id, centre (the least id)."""
        each = reps.select("id", F.posexplode("bands").alias("band", "bucket"))
        shared = each.groupBy("bucket").agg(F.min("id").alias("centre"), F.max("id").alias("last")).filter("centre < last").select("bucket", "centre")
        shared = self.ws.save(shared, narrow=True)
        # A bucket is one row of the hashed side, so that side is even, and the rows of the other needn't be sorted.
        out = self.ws.save(each.join(shared.hint("shuffle_hash"), "bucket"), narrow=True)
        self.ws.drop(shared)
        return out

    def verified(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """Those of the distinct pairs (a, b) that are links: first by estimate, then on the full sets."""
        side = lambda s: reps.select(F.col("id").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("low").alias(f"low_{s}"))
        near = pairs.join(side("a"), "a").join(side("b"), "b")
        fits = f"100 * least(n_a, n_b) >= {self.percent} * greatest(n_a, n_b)"
        near = self.ws.save(near.filter(fits).select("a", "b", "low_a", "low_b").mapInArrow(_estimate(self.least), "a long, b long"), narrow=True)
        out = self.confirmed(near)
        self.ws.drop(near)
        return out

    def confirmed(self, near: DataFrame) -> DataFrame:
        ids = near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct()
        sets = self.ws.save(self.docs.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_sets(self.k), "id long, set binary"))
        one = lambda s: sets.select(F.col("id").alias(s), F.col("set").alias(f"set_{s}"))
        links = near.join(one("a"), "a").join(one("b"), "b").select("a", "b", "set_a", "set_b")
        out = self.ws.save(links.mapInArrow(_confirm(self.percent), "a long, b long"), narrow=True)
        self.ws.drop(sets)
        return out

    def apart(self, buckets: DataFrame, comp: DataFrame, reps: DataFrame) -> DataFrame:
        """Pairs of a class and the centre of one of its buckets that are in different components so far."""
        stars = buckets.filter("id != centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
        side = lambda s: comp.select(F.col("id").alias(s), F.col("component_id").alias(f"c_{s}"))
        named = stars.join(side("a"), "a", "left").join(side("b"), "b", "left")
        return self.ws.save(named.filter("coalesce(c_a, a) != coalesce(c_b, b)").select("a", "b"), narrow=True)

    def across(self, buckets: DataFrame, comp: DataFrame, reps: DataFrame) -> DataFrame:
        """Pairs of a bucket that lie in different components so far; buckets of all sizes alike, by the longer signature."""
        named = self.ws.save(buckets.join(comp, "id", "left").withColumn("comp", F.coalesce("component_id", "id")).drop("component_id"), narrow=True)
        split = named.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), F.min(F.struct("id", "comp")).alias("least"))
        # Of two classes only, the star has tried the one pair. The component of the least id is as a rule the large one;
        # its members meet only the others.
        split = self.ws.save(split.filter("lo < hi and n > 2").select("bucket", F.col("least.comp").alias("main")), narrow=True)
        left = self.ws.save(named.join(split, "bucket").select("bucket", "band", "id", "comp", (F.col("comp") == F.col("main")).alias("inner")), narrow=True)
        self.ws.drop(named, split)
        ids = left.select(F.col("id").alias("doc_id")).distinct()
        long = self.ws.save(self.docs.join(ids.hint("shuffle_hash"), "doc_id", "left_semi").mapInArrow(_long(self.k), "id long, low binary"))
        out = self.ws.save(self._blocks(left, long.join(reps.select("id", "bands"), "id")).distinct())
        self.ws.drop(left, long)
        return out

    def _blocks(self, left: DataFrame, reps: DataFrame) -> DataFrame:
        size = left.groupBy("bucket").agg(F.ceil(F.count_if("inner") / BLOCK).alias("n_in"), F.ceil(F.count_if(~F.col("inner")) / BLOCK).alias("n_out"))
        rows = left.join(size, "bucket").join(reps, "id")
        own = F.pmod(F.xxhash64("id"), F.greatest(F.when(F.col("inner"), F.col("n_in")).otherwise(F.col("n_out")), F.lit(1)))
        rows = rows.withColumn("own", own)
        out_range = F.sequence(F.lit(0).cast("long"), F.col("n_out") - 1)
        # An inner block meets each outer block (side 0 and 1); outer blocks meet each other and themselves.
        met = F.when(F.col("inner"), F.transform(out_range, lambda o: F.struct(F.lit(True).alias("i"), F.col("own").alias("x"), o.alias("y"), F.lit(0).alias("side")))).otherwise(
            F.concat(
                F.when(F.col("n_in") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_in") - 1, F.lit(0).cast("long"))), lambda i: F.struct(F.lit(True).alias("i"), i.alias("x"), F.col("own").alias("y"), F.lit(1).alias("side")))).otherwise(F.array()),
                F.transform(out_range, lambda o: F.struct(F.lit(False).alias("i"), F.least("own", o).alias("x"), F.greatest("own", o).alias("y"), F.when(F.col("own") > o, 1).otherwise(0).alias("side"))),
            )
        )
        rows = rows.filter("n_out > 0").select("bucket", "band", "id", "comp", "low", "bands", F.explode(met).alias("m")).select("bucket", "band", "id", "comp", "low", "bands", "m.*")
        t = self.percent / 100
        return rows.groupBy("bucket", "i", "x", "y").applyInArrow(_cross(t - 6.5 * (t * (1 - t) / LONG) ** 0.5), "a long, b long")

    def run(self) -> DataFrame:
        ws = self.ws
        docs = self.classes()
        reps = docs.filter("n_shingles > 0 and bands is not null").select(F.col("rep").alias("id"), "n_shingles", "bands", "low")
        buckets = self.buckets(reps)
        star = ws.save(buckets.filter("id != centre").groupBy("id").agg(F.min("centre").alias("a")).select("a", F.col("id").alias("b")), narrow=True)
        links = self.verified(star, reps)
        ws.drop(star)
        comp = components(ws, links)
        # What is compared across components comes by a sharper estimate already.
        for pairs, check in ((self.apart, lambda p: self.verified(p, reps)), (self.across, self.confirmed)):
            more = pairs(buckets, comp, reps)
            if more.limit(1).count():
                links = links.union(check(more))
                old, comp = comp, components(ws, links)
                ws.drop(old)
            ws.drop(more)
        ws.drop(buckets)
        out = docs.select("doc_id", "n_shingles", "rep").join(comp, F.col("rep") == F.col("id"), "left")
        alone = F.when(F.col("n_shingles") == 0, F.col("doc_id"))
        return out.select("doc_id", "n_shingles", F.coalesce(alone, "component_id", "rep").alias("component_id"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Words are runs of characters other than ASCII white space, with A-Z lower-cased; a set holds the distinct k-word
    shingles; documents link if 100 * intersection >= percent * union; component_id is the least doc_id reachable.

    A null or wordless text has an empty set and links with nothing. A text of fewer than k words is one shingle. Rows that
    share a doc_id are one document: a link of one is a link of both. A row without doc_id links with nothing
    (component_id null, kept). Other columns are ignored. No rows give no rows.
    """
    found = NearDuplicates(docs, k, percent).run()
    nameless = docs.filter("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), "text")
    sized = nameless.mapInArrow(_profile(k, 1, 1), "doc_id long, n_shingles long, key binary, bands array<long>, low binary")
    found = found.union(sized.select("doc_id", "n_shingles", F.lit(None).cast("long")))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 2) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.x = q.x AND p.doc_id <> q.doc_id GROUP BY ALL) JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
