"""Toxicity by weak supervision.

1. Voters. Lexicons of words and of character n-grams are drawn from disjoint folds of the labelled sample (terms that mark
   toxic rows almost only); each votes by how many of a text's words it hits, and says nothing on the fold it was drawn
   from. Pattern voters look at shouting, exclamation marks, symbols and repetition. The annotator, whose labels the rows
   carry, is one more voter who errs now and then. A voter says toxic (1), clean (-1) or nothing (0).
2. Label model. Votes are modelled as drawn around a mean for each class with one shared covariance: the means are the
   voters' accuracies and the covariance their correlations, so lexicons that repeat each other count once. Both are
   estimated by expectation maximisation, beginning with what the annotator says; the annotator's accuracy is estimated
   like any other's, no label is taken as the truth. Rows of one fold are modelled together: the same voters are silent.
3. Classifier. A linear model over hashed words and character n-grams is trained on the posterior labels by a proximal
   online method, which leaves all but telling terms at zero.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import enter, raw, slices, table
from .quality import held_out, labelled

BUCKETS = 1 << 20
#: Labelled rows that voters are drawn from, at most; the label model and the classifier see the same texts.
SAMPLE = 6000
FOLDS = 3
REMEMBERED = 500_000
_WORD = re.compile(r"\w+")
_PATTERNS = 5


def tokens(text: bytes | None) -> list[str]:
    return _WORD.findall((text or b"").decode().lower())


def grams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w, *{w[i : i + n] for n in (4, 5, 6) for i in range(len(w) - n + 1)} - {w}]


def buckets(word: str) -> list[int]:
    return [xxhash.xxh32_intdigest(g) % BUCKETS for g in grams(word)]


def patterns(text: bytes | None, words: list[str]) -> list[int]:
    """Votes that need no lexicon."""
    t = (text or b"").decode()
    n = max(1, len(words))
    upper = sum(map(str.isupper, t)) / max(1, sum(map(str.isalpha, t)))
    bangs, marks = t.count("!") / n, sum(map(t.count, "#*$%&")) / n
    return [1 if upper > 0.6 else 0, 1 if bangs > 0.5 else 0, 1 if marks > 0.3 else 0, 1 if len(set(words)) < 0.2 * n else -1, -1 if bangs == 0 and marks == 0 else 0]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of a text's distinct words, with the number of words that have each; and the pattern votes."""
    for b in slices(batches):
        ids, n, votes = [], [], []
        for text in raw(b.column("text")):
            words = tokens(text)
            flat = [x for w in set(words) for x in buckets(w)]
            u, c = np.unique(np.array(flat, np.int32), return_counts=True)
            ids.append(u)
            n.append(c.astype(np.float32))
            votes.append(patterns(text, words))
        yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(ids, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32())), pa.array(votes, pa.list_(pa.int32()))], ["label", "ids", "n", "votes"])


def lexicon(ids: list[np.ndarray], y: np.ndarray, support: int, precision: float) -> np.ndarray:
    """Buckets found in `support` toxic rows at least, nearly all of whose rows are toxic."""
    pos, neg = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for u, label in zip(ids, y, strict=True):
        (pos if label else neg)[u] += 1
    odds = (pos + 0.1) / (pos + neg * max(1.0, y.sum() / max(1, (1 - y).sum())) + 0.2)
    return (pos >= support) & (odds >= precision)


def votes_of(ids: list[np.ndarray], n: list[np.ndarray], lexicons: list[np.ndarray]) -> np.ndarray:
    """Each lexicon gives three voters: any hit, several hits, and clean if none."""
    out = np.zeros((len(ids), 3 * len(lexicons)))
    for i, (u, c) in enumerate(zip(ids, n, strict=True)):
        for j, lex in enumerate(lexicons):
            hits = c[lex[u]].sum() if len(u) else 0
            out[i, 3 * j : 3 * j + 3] = (1 if hits else 0, 1 if hits >= 4 else 0, 0 if hits else -1)
    return out


class LabelModel:
    """Two classes; votes have a mean for each class and a shared covariance. Fitted by expectation maximisation."""

    def fit(self, votes: np.ndarray, rounds: int = 25) -> LabelModel:
        """votes: rows by voters, the annotator last. Voters that say one thing only are left out."""
        self.used = np.flatnonzero(votes.std(axis=0) > 0)
        v = votes[:, self.used]
        q = np.where(votes[:, -1] > 0, 0.95, 0.05)
        for _ in range(rounds):
            p = float(np.clip(q.mean(), 1e-3, 0.9))
            self.mean = np.stack([((1 - q) @ v) / max(1e-9, (1 - q).sum()), (q @ v) / max(1e-9, q.sum())])
            d0, d1 = v - self.mean[0], v - self.mean[1]
            self.covariance = (d0.T * (1 - q)) @ d0 / len(v) + (d1.T * q) @ d1 / len(v) + 0.05 * np.eye(v.shape[1])
            self.weights = np.linalg.solve(self.covariance, self.mean[1] - self.mean[0])
            self.bias = np.log(p / (1 - p)) - 0.5 * (self.mean.sum(axis=0) @ self.weights)
            q = self.posterior(votes)
        sd = np.sqrt(np.diag(self.covariance))
        self.correlation = self.covariance / np.outer(sd, sd)
        self.accuracy = (q @ (v > 0) + (1 - q) @ (v < 0)) / np.maximum(1, (v != 0).sum(axis=0))
        return self

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(votes[:, self.used] @ self.weights + self.bias, -30, 30)))


def train(ids: list[np.ndarray], n: list[np.ndarray], target: np.ndarray, epochs: int = 10, rate: float = 0.3, l1: float = 8.0, seed: int = 5) -> tuple[np.ndarray, float]:
    """Proximal follow-the-regularised-leader on soft targets: (weights, bias), most weights exactly 0."""
    z, s, bias = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0
    rng = np.random.default_rng(seed)

    def weights(zu: np.ndarray, su: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zu) <= l1, 0.0, -(zu - np.sign(zu) * l1) / ((1 + np.sqrt(su)) / rate + 0.01))

    for e in range(epochs):
        for i in rng.permutation(len(target)):
            u, x = ids[i], np.minimum(n[i], 3)
            w = weights(z[u], s[u])
            p = 1 / (1 + np.exp(-np.clip(bias + w @ x, -30, 30)))
            g = (p - target[i]) * x
            z[u] += g - (np.sqrt(s[u] + g * g) - np.sqrt(s[u])) / rate * w
            s[u] += g * g
            bias -= 0.05 / (1 + e) * (p - target[i])
    return weights(z, s).astype(np.float32), bias


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights = {int(i): float(weights[i]) for i in np.flatnonzero(weights)}
        self.bias = bias
        self.known: dict[str, tuple] = {}

    def word(self, w: str) -> tuple:
        """The telling buckets of a word."""
        if w not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[w] = tuple(b for b in buckets(w) if b in self.weights)
        return self.known[w]

    def logit(self, text: bytes | None) -> float:
        found: dict[int, int] = {}
        for w in set(tokens(text)):
            for b in self.word(w):
                found[b] = found.get(b, 0) + 1
        return self.bias + sum(self.weights[b] * min(3, c) for b, c in sorted(found.items()))


def _score(weights: np.ndarray, bias: float):
    some = np.flatnonzero(weights)
    sparse = (some.astype(np.int32), weights[some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("toxicity")
        full = np.zeros(BUCKETS, np.float32)
        full[sparse[0]] = sparse[1]
        scorer = Scorer(full, bias)
        for b in slices(batches):
            z = np.array([scorer.logit(t) for t in raw(b.column("text"))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], ["doc_id", "held_out", "score"])

    return run


def learn(ids: list[np.ndarray], n: list[np.ndarray], patterns_: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, bias, targets): voters from folds of the labels, a label model over their votes, the classifier on its posterior."""
    fold = np.arange(len(y)) % FOLDS
    target = np.zeros(len(y))
    lexicons = [[lexicon([ids[i] for i in np.flatnonzero(fold == f)], y[fold == f], *need) for need in ((3, 0.9), (6, 0.97))] for f in range(FOLDS)]
    for f in range(FOLDS):
        part = np.flatnonzero(fold == f)
        if len(part):
            others = [x for g in range(FOLDS) if g != f for x in lexicons[g]]
            votes = np.hstack([votes_of([ids[i] for i in part], [n[i] for i in part], others), patterns_[part], 2.0 * y[part, None] - 1])
            target[part] = LabelModel().fit(votes).posterior(votes)
    return *train(ids, n, target), target


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Learned from `rows` labelled rows at most, none of them held out. Null and empty texts are scored by the bias alone. A
    null doc_id is not held out. Without any toxic label to learn from every score is 0. Rows that share a doc_id are scored
    each by its own text. Other columns are ignored. No rows give no rows.
    """
    got = labelled(docs, labels, "toxic", 5, 0, rows).repartition(16, "_l").select("label", "text").mapInArrow(_features, "label int, ids array<int>, n array<float>, votes array<int>").toArrow()
    y = (np.array(got.column("label").to_pylist(), np.int64) > 0).astype(np.int64)
    base = docs.select("doc_id", held_out(5, 0).alias("held_out"), "text")
    if not y.sum():
        out = base.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    else:
        order = np.lexsort((y, [zlib.crc32(np.asarray(v.values).tobytes()) for v in got.column("ids")]))  # rows come in any order
        ids = [np.asarray(got.column("ids")[int(i)].values) for i in order]
        n = [np.asarray(got.column("n")[int(i)].values) for i in order]
        votes = np.array([got.column("votes")[int(i)].as_py() for i in order], float).reshape(-1, _PATTERNS)
        weights, bias, _ = learn(ids, n, votes, y[order])
        out = base.mapInArrow(_score(weights, bias), f"doc_id {dict(base.dtypes)['doc_id']}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
