"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors: one for each of its words, its words' character 3- to 5-grams, and its word
bigrams, all hashed into BUCKETS rows; a bigram of one word twice also backs off to "the same word again", since its own
hash is new for every word. A softmax layer reads the mean. Vectors and layer are trained together by stochastic
gradient descent in numpy on a bounded sample of labelled rows.

For scoring, layer and vectors fold into one number a bucket, so a document's logit is a mean over its features. Features
come by numpy from the distinct words of an Arrow batch; nothing is remembered from one batch to the next.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, enter, give_back, mix, numbered_words, row_key, slices, table

BUCKETS, WIDTH = 1 << 18, 16
#: Labelled rows to learn from, at most: those whose hashed doc_id and text are least.
SAMPLE = 4000
EPOCHS, RATE = 8, 0.6
GRAMS = (3, 4, 5)
#: The bucket that bigrams of one word twice share; no other feature has it.
SAME = BUCKETS - 1
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct word <w>: a hash; and the buckets of the word and its character n-grams, with the word each is of."""
    n = len(words)
    chars = np.frombuffer("".join([f"<{w}>" for w in words.to_pylist()]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    size = np.fromiter(map(len, words.to_pylist()), np.int64, n) + 2
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(n), size)
    place = (np.arange(len(chars)) - start[owner]).astype(np.uint64)
    whole = mix(np.add.reduceat(mix(chars + (place << np.uint64(32))), start))
    owners, hashes = [np.arange(n)], [whole]
    for k in GRAMS:
        m = len(chars) - k + 1
        if m > 0:
            h = np.full(m, np.uint64(k), np.uint64)
            for i in range(k):
                h = h * _STEP + chars[i : i + m]
            inside = owner[:m] == owner[k - 1 :]
            owners.append(owner[:m][inside])
            hashes.append(mix(h[inside]))
    return whole, (np.concatenate(hashes) % np.uint64(SAME)).astype(np.int64), np.concatenate(owners)


def bigrams(codes: np.ndarray, whole: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all pairs of neighbouring words (by number, with their hashes), and the text each pair is in."""
    inside = text[:-1] == text[1:]
    h = whole[codes]
    pair = (mix(h[:-1] * _STEP + h[1:] + np.uint64(1))[inside] % np.uint64(SAME)).astype(np.int64)
    again = inside & (codes[:-1] == codes[1:])
    return np.concatenate([pair, np.full(again.sum(), SAME)]), np.concatenate([text[:-1][inside], text[:-1][again]])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets of a text with their counts."""
    enter("quality")
    for b in slices(batches):
        ids, n = [], []
        for i in range(b.num_rows):
            words, codes, _ = numbered_words(b.column("text").slice(i, 1))
            whole, buckets, owner = word_features(words)
            often = np.bincount(codes, minlength=len(words))
            pairs, _ = bigrams(codes, whole, np.zeros(len(codes), np.int8))
            u, of = np.unique(np.concatenate([buckets, pairs]), return_inverse=True)
            ids.append(u.astype(np.int32))
            n.append(np.bincount(of, np.concatenate([often[owner], np.ones(len(pairs))]), len(u)).astype(np.float32))
        yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(ids, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], ["label", "ids", "n"])


def labelled(docs: DataFrame, labels: DataFrame, column: str, mod: int, out: int, rows: int) -> DataFrame:
    """_l, text, label of rows that may be learned from: crc32(doc_id as text) mod `mod` is not `out`; `rows` at most.

    Equal rows count once. `rows` labels are drawn first; documents that share a doc_id are more rows than that, so the
    rows are drawn again, by doc_id and text, from what the labels meet.
    """
    ok = F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod != out
    some = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ok).select(F.col("doc_id").cast("long").alias("_l"), F.col(column).cast("int").alias("label"))
    some = some.distinct().orderBy(F.xxhash64("_l"), "_l", "label").limit(rows)
    keys = ["_l", "_th", "label"]
    met = row_key(docs.select("doc_id", "text")).join(F.broadcast(some), F.col("_id") == F.col("_l"))  # `rows` rows at most
    met = Workspace(docs.sparkSession).save(met.select(*keys, "text"))
    drawn = met.select(*keys).distinct().orderBy(F.xxhash64("_l", "_th"), *keys).limit(rows)
    return met.join(F.broadcast(drawn), keys).dropDuplicates(keys).select("_l", "text", "label")  # again `rows` at most


def train(ids: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """One weight a bucket, and the bias, of the logit of label 1."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(labels), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(labels)):
            rate = RATE * (1 - done / steps)
            done += 1
            u, s = ids[i], counts[i] / max(1.0, counts[i].sum())
            mean = s @ vectors[u] if len(u) else np.zeros(WIDTH, np.float32)
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ layer
            layer -= rate * np.outer(p, mean)
            bias -= rate * p * 0.1
            if len(u):
                # A step on the mean reaches each vector by its share; vectors are rare, so their step is larger.
                vectors[u] -= (rate * 8) * np.outer(np.sqrt(s), back)
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def logits(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """The bias and the mean weight of each text's features."""
    words, codes, at = numbered_words(texts)
    whole, buckets, owner = word_features(words)
    text = np.repeat(np.arange(len(texts)), np.diff(at))
    sums, sizes = np.bincount(owner, weights[buckets], len(words)), np.bincount(owner, minlength=len(words))
    pairs, of = bigrams(codes, whole, text)
    total = np.bincount(text, sums[codes], len(texts)) + np.bincount(of, weights[pairs], len(texts))
    n = np.bincount(text, sizes[codes], len(texts)) + np.bincount(of, minlength=len(texts))
    return bias + total / np.maximum(1, n)


def _score(weights: np.ndarray, bias: float, passed: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        for b in slices(batches):
            z = logits(b.column("text"), weights, bias)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in passed), pa.array(1 / (1 + np.exp(-z)))], [*passed, "score"])

    return run


def held_out(mod: int, out: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == out, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: doc_id, the columns in keep, held_out, score, predicted (1 if score >= 0.7).

    Learned from `rows` labelled rows at most, none of them held out. Null and empty texts are scored by the bias alone.
    A null doc_id is not held out. Without any label 0 to learn from, nothing speaks against a document: score 1. Rows that
    share a doc_id are scored each by its own text. Columns not named are ignored. No rows give no rows.
    """
    got = labelled(docs, labels, "quality", 4, 2, rows).repartition(16, "_l").select("label", "text").mapInArrow(_counts, "label int, ids array<int>, n array<float>").toArrow()
    y = np.array(got.column("label").to_pylist(), np.int64)
    passed = ("doc_id", "held_out", *keep)
    rows_ = docs.withColumn("held_out", held_out(4, 2)).select(*passed, *({"text"} - set(passed)))
    if not len(y) or y.min() > 0:
        out = rows_.withColumn("score", F.lit(1.0)).select(*passed, "score")
    else:
        y = (y > 0).astype(np.int64)
        order = np.lexsort((y, [zlib.crc32(np.asarray(v.values).tobytes()) for v in got.column("ids")]))  # rows come in any order
        ids = [np.asarray(got.column("ids")[int(i)].values) for i in order]
        n = [np.asarray(got.column("n")[int(i)].values) for i in order]
        weights, bias = train(ids, n, y[order])
        del got, ids, n
        give_back()  # the driver goes on to other work
        kinds = dict(rows_.dtypes)
        out = rows_.mapInArrow(_score(weights, bias, passed), ", ".join(f"`{c}` {kinds[c]}" for c in passed) + ", score double")
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
