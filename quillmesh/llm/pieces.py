"""SentencePiece encoding and decoding with exact N-best segmentation.

A text is a lattice: an edge for each vocabulary piece that occurs, with the piece's score, and for a character that no piece
covers an edge to its bytes. A forward Viterbi pass gives the best score from the start to every position. A backward A-star
search from the end uses those scores as its heuristic; as they are exact, complete segmentations leave the queue in order
of score, the first being the Viterbi path.

No piece of the vocabulary has a space mark after another character, and none holds a line end, so the lattice falls apart at
those places: a text's N best are put together from those of its parts. The parts (words, mostly) recur, so each distinct
one is segmented once for each Python worker; how far its second best lies behind comes with the forward pass.

The lattice maximises the sum of the scores in the model file. For a unigram model these are log probabilities, and the
result is the library's own N-best encoding (tests compare). For a BPE model, such as piece_bpe_32k.model, they are the
negative ranks of its merges: the library applies merges one by one and gives other ids for the same text. Who trains with
a BPE model's own ids must take the library's; decoding is the same for both.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import enter, mix, numbered, slices, table

SPACE = "▁"
REMEMBERED = 500_000
#: Longer parts are segmented one by one.
COLUMNS = 40
SLOTS = 1 << 18
MARKS = ".,!?;:*#$%&"
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_NEVER = float("inf")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A SentencePiece model's vocabulary as a lattice."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_: dict[int, int] = {}
        self.table: list[bytes] = [b""] * n
        self.pieces: dict[str, tuple[int, float]] = {}
        for i in range(n):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_[int(p[3:5], 16)] = i
                self.table[i] = bytes([int(p[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[p] = (i, model.get_score(i))
                self.table[i] = p.replace(SPACE, " ").encode()
        self.longest = max(map(len, self.pieces))
        #: A character without a piece costs more than any ordinary piece, as in SentencePiece.
        self.fallback = min(s for _, s in self.pieces.values() if s > -1e8) - 10
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.pieces):
            raise ValueError("a piece spans a space or a line end; texts can't be cut there")
        if any(a.isalpha() and b in MARKS for p in self.pieces for a, b in zip(p, p[1:])):  # noqa: B905
            raise ValueError("a piece spans a letter and a mark; parts can't be cut there")
        self.scores = {p: s for p, (_, s) in self.pieces.items()}
        self.code = {p: i.to_bytes(4, "little") for p, (i, _) in self.pieces.items()}
        self.found: dict[tuple[str, int], list] = {}
        self.pieces_of = pa.array(self.table, pa.large_binary())
        self._tables = self._hash_tables()
        self.known: dict[str, tuple[bytes, float, float]] = {}
        self.literal = (self._codes(SPACE), self.fallback, _NEVER)

    def _codes(self, char: str) -> bytes:
        return np.array([self.bytes_[b] for b in char.encode()], "<i4").tobytes()

    def edges(self, part: str) -> list[list[tuple[int, str, float]]]:
        """For each position the edges that end there: (start, piece, score); the longest piece first."""
        get, longest = self.pieces.get, self.longest
        out: list[list] = [[]]
        for end in range(1, len(part) + 1):
            here = []
            for start in range(max(0, end - longest), end):
                if hit := get(part[start:end]):
                    here.append((start, part[start:end], hit[1]))
            if not here or here[-1][0] != end - 1:
                here.append((end - 1, part[end - 1], self.fallback))
            out.append(here)
        return out

    @staticmethod
    def forward(edges: list[list[tuple[int, str, float]]]) -> tuple[list[float], list[tuple]]:
        """Best score from the start to each position, and the edge it came by; the longest piece wins a tie."""
        best, back = [0.0], [()]
        for here in edges[1:]:
            top, by = -_NEVER, ()
            for e in here:
                if (s := best[e[0]] + e[2]) > top:
                    top, by = s, e
            best.append(top)
            back.append(by)
        return best, back

    def n_best(self, part: str, n: int) -> list[tuple[float, list[str]]]:
        """The n best segmentations of a part, best first: backward A-star over the forward scores."""
        edges = self.edges(part)
        best, _ = self.forward(edges)
        order, out = count(), []
        queue = [(-best[-1], next(order), len(part), 0.0, None)]
        while queue and len(out) < n:
            _, _, at, done, path = heapq.heappop(queue)
            if not at:
                cut = []
                while path:
                    cut.append(path[0])
                    path = path[1]
                out.append((done, cut))
                continue
            for start, piece, score in edges[at]:
                heapq.heappush(queue, (-(best[start] + score + done), next(order), start, done + score, (piece, path)))
        return out

    def alternatives(self, part: str, n: int) -> list[tuple[float, bytes]]:
        """How far the n best segmentations of a part lie behind the first, and their ids."""
        key = (part, n)
        if key not in self.found:
            if len(self.found) >= REMEMBERED // 8:
                self.found.clear()
            ways = self.n_best(part, n)
            self.found[key] = [(ways[0][0] - score, b"".join([self.code.get(p) or self._codes(p) for p in cut])) for score, cut in ways]
        return self.found[key]

    def segment(self, part: str) -> tuple[bytes, float, float]:
        """Ids of the best segmentation (little-endian 32 bits), its score, and how far the second best lies behind.

        The forward pass keeps the two best scores of each position. Marks behind a letter are a part of their own: no piece
        spans the two.
        """
        known = self.known
        if part in known:
            return known[part]
        body = part.rstrip(MARKS)
        if len(body) < len(part) and body[-1:].isalpha():
            (codes, score, behind), (tail, more, other) = self.segment(body), self.segment(part[len(body) :])
            known[part] = found = (codes + tail, score + more, min(behind, other))
            return found
        get, longest = self.scores.get, self.longest
        best, second, back = [0.0], [-_NEVER], [0]
        for end in range(1, len(part) + 1):
            top = next_ = -_NEVER
            by = score = None
            for start in range(end - longest if end > longest else 0, end):
                score = get(part[start:end])
                if score is not None:
                    s = best[start] + score
                    if s > top:
                        next_, top, by = top, s, start
                    elif s > next_:
                        next_ = s
                    s = second[start] + score
                    if s > next_:
                        next_ = s
            if score is None:  # no piece for this one character
                s = best[end - 1] + self.fallback
                if s > top:
                    next_, top, by = top, s, end - 1
                elif s > next_:
                    next_ = s
                next_ = max(next_, second[end - 1] + self.fallback)
            best.append(top)
            second.append(next_)
            back.append(by)
        cut, at = [], len(part)
        while at:
            cut.append(part[back[at] : at])
            at = back[at]
        codes = b"".join([self.pieces[p][0].to_bytes(4, "little") if p in self.pieces else self._codes(p) for p in reversed(cut)])
        known[part] = found = (codes, best[-1], best[-1] - second[-1])
        return found

    def _hash_tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(keys, scores) of hash tables: each holds what collided in the one before."""
        keys = np.array([self._key(p) for p in self.scores], np.uint64)
        scores, out = np.array(list(self.scores.values())), []
        while len(keys):
            slot = (keys >> np.uint64(8 * len(out))) & np.uint64(SLOTS - 1)
            _, first = np.unique(slot, return_index=True)
            k, s = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -_NEVER)
            k[slot[first]], s[slot[first]] = keys[first], scores[first]
            out.append((k, s))
            rest = np.setdiff1d(np.arange(len(keys)), first)
            keys, scores = keys[rest], scores[rest]
        return out

    @staticmethod
    def _key(piece: str) -> int:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in piece:
                h = h * _STEP + np.uint64(ord(c))
            return mix(np.array([h + np.uint64(len(piece))]))[0]

    def _score_of(self, keys: np.ndarray) -> np.ndarray:
        """Scores of the pieces with these keys; minus infinity for what is no piece."""
        out = np.full(len(keys), -_NEVER)
        for i, (known, scores) in enumerate(self._tables):
            slot = (keys >> np.uint64(8 * i)) & np.uint64(SLOTS - 1)
            hit = known[slot] == keys
            out = np.where(hit, scores[slot], out)
        return out

    def _lattices(self, parts: list[str]) -> None:
        """segment() for many parts of about one length at a time: the same forward pass, over columns of positions."""
        size = len(parts[-1])
        chars = np.array(parts, f"U{size}").view(np.uint32).reshape(len(parts), size).astype(np.uint64)
        sums = [np.zeros(len(parts), np.uint64)]
        for i in range(size):
            sums.append(sums[-1] * _STEP + chars[:, i])
        power = [np.uint64(pow(int(_STEP), n, 2**64)) for n in range(size + 1)]
        best, second, back = [np.zeros(len(parts))], [np.full(len(parts), -_NEVER)], [np.zeros(len(parts), np.int8)]
        for end in range(1, size + 1):
            top, next_, by = np.full(len(parts), -_NEVER), np.full(len(parts), -_NEVER), np.zeros(len(parts), np.int8)
            for n in range(min(end, self.longest), 0, -1):
                score = self._score_of(mix(sums[end] - sums[end - n] * power[n] + np.uint64(n)))
                if n == 1:
                    score = np.where(score == -_NEVER, self.fallback, score)
                s = best[end - n] + score
                wins = s > top
                next_ = np.maximum(np.maximum(next_, np.where(wins, top, s)), second[end - n] + score)
                by[wins] = n
                top = np.where(wins, s, top)
            best.append(top)
            second.append(next_)
            back.append(by)
        rows = np.arange(len(parts))
        ends = np.fromiter(map(len, parts), np.int64, len(parts))
        final, other = np.array(best)[ends, rows], np.array(second)[ends, rows]
        steps, code = np.array(back).T.tolist(), self.code
        for part, by, at, score, behind in zip(parts, steps, ends.tolist(), final.tolist(), (final - other).tolist(), strict=True):
            cut = []
            while at:
                piece = part[at - by[at] : at]
                cut.append(code.get(piece) or self._codes(piece))
                at -= by[at]
            cut.reverse()
            self.known[part] = (b"".join(cut), score, behind)

    def segment_all(self, parts: list[str]) -> None:
        """Makes all parts known."""
        bodies = {p: p.rstrip(MARKS) for p in parts}
        base = set()
        for p, body in bodies.items():
            base.update((body, p[len(body) :]) if len(body) < len(p) and body[-1:].isalpha() else (p,))
        base = sorted((p for p in base if len(p) <= COLUMNS and p not in self.known), key=len)
        for i in range(0, len(base), 2048):
            self._lattices(base[i : i + 2048])
        for p in parts:
            self.segment(p)

    def parts(self, text: str) -> list[str | None]:
        """Cuts a text where no piece reaches across. None stands for a space mark in the text itself, which goes as bytes."""
        out: list[str | None] = []
        if not text:
            return out
        for i, stretch in enumerate(text.split(SPACE)):
            if i:
                out.append(None)
            for j, line in enumerate(stretch.split("\n")):
                if j:
                    out.append("\n")
                first = not i and not j  # the mark that SentencePiece puts before a text
                if "  " in line or first and line[:1] == " ":
                    out += _RUNS.findall(SPACE * first + line.replace(" ", SPACE))
                else:
                    words = line.split(" ")
                    if first or words[0]:
                        out.append(SPACE + words[0] if first else words[0])
                    out += [SPACE + w for w in words[1:]]
        return out

    def encode(self, texts: list[str], n: int) -> list[list[tuple[float, bytes]]]:
        """For each text its n best segmentations, best first: score and ids (little-endian 32 bits)."""
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        plain = [not (t[:1] == " " or "  " in t or SPACE in t or "\0" in t) for t in texts]
        cut = self._cut_all([t for t, p in zip(texts, plain, strict=True) if p])
        out = iter(self._put_together(*cut, n))
        odd = iter(self._put_together(*self._numbered([self.parts(t) for t, p in zip(texts, plain, strict=True) if not p]), n))
        return [next(out if p else odd) for p in plain]

    @staticmethod
    def _cut_all(texts: list[str]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """parts() of texts without doubled, leading or literal space marks and without NUL, by Arrow: numbered()."""
        marked = pc.replace_substring(pa.array([SPACE + t if t else "" for t in texts], pa.large_string()), " ", "\0" + SPACE)
        distinct, codes, at = numbered(pc.split_pattern(pc.replace_substring(marked, "\n", "\0\n\0"), "\0"))
        return distinct.to_pylist(), codes, at

    @staticmethod
    def _numbered(parts: list[list[str | None]]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        number: dict[str | None, int] = {}
        codes = [number.setdefault(p, len(number)) for text in parts for p in text]
        return list(number), np.array(codes, np.int64), np.cumsum([0, *map(len, parts)])

    def _put_together(self, distinct: list[str | None], codes: np.ndarray, at: np.ndarray, n: int) -> list[list[tuple[float, bytes]]]:
        """N best of texts from those of their parts, numbered among the distinct ones."""
        self.segment_all([p for p in distinct if p is not None and p not in self.known])
        found = [self.literal if p is None else self.known[p] for p in distinct]
        flat = pa.array([f[0] for f in found], pa.large_binary()).take(pa.array(codes))
        place = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
        data = flat.buffers()[2] or pa.py_buffer(b"")
        size = np.diff(at)
        text = np.repeat(np.arange(len(size)), size)
        scores = np.bincount(text, np.array([f[1] for f in found])[codes], len(size)) if len(codes) else np.zeros(len(size))
        # The n best differ from the best in the n - 1 parts at most whose second best is nearest.
        behind, near = np.array([f[2] for f in found])[codes], [[] for _ in size]
        some = np.flatnonzero(size)
        for _ in range(n - 1 if len(some) else 0):
            least = np.minimum.reduceat(behind, at[some])
            hits = np.flatnonzero((behind == np.repeat(least, size[some])) & (behind < _NEVER))
            of, first = np.unique(text[hits], return_index=True)
            for i, k in zip(of.tolist(), hits[first].tolist(), strict=True):
                near[i].append(k)
            behind[hits[first]] = _NEVER
        out = []
        for i, score in enumerate(scores.tolist()):
            a, z = int(place[at[i]]), int(place[at[i + 1]])
            best = data[a:z].to_pybytes()
            ways: list[tuple[float, dict[int, bytes]]] = [(0.0, {})]
            for k in near[i]:
                other = self.alternatives(distinct[codes[k]], n)
                ways = sorted(((gap + g, {**there, k: ids} if j else there) for gap, there in ways for j, (g, ids) in enumerate(other)), key=lambda w: w[0])[:n]
            every = []
            for gap, there in ways:
                ids, done = [], 0
                for k in sorted(there):
                    ids += [best[done : int(place[k]) - a], there[k]]
                    done = int(place[k + 1]) - a
                every.append((score - gap, b"".join([*ids, best[done:]]) if there else best))
            out.append(every)
        return out

    def decode(self, ids: pa.Array) -> list[bytes]:
        """UTF-8 texts of a column of id lists."""
        flat = self.pieces_of.take(ids.flatten())
        place = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
        data = flat.buffers()[2] or pa.py_buffer(b"")
        at = np.asarray(ids.offsets)
        texts = [data[i:j].to_pybytes() for i, j in zip(place[at[:-1] - at[0]].tolist(), place[at[1:] - at[0]].tolist(), strict=True)]
        return [t[1:] if t[:1] == b" " else t for t in texts]


_models: dict[str, Pieces] = {}


def forget() -> None:
    _models.clear()


def model_at(path: str) -> Pieces:
    """One for each Python worker, across tasks."""
    if path not in _models:
        _models.clear()
        _models[path] = Pieces(path)
    return _models[path]


def _lists(ids: list[bytes]) -> pa.Array:
    sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
    values = pa.Array.from_buffers(pa.int32(), int(sizes.sum()), [None, pa.py_buffer(b"".join(ids))])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _encode(path: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("pieces", forget)
        model = model_at(path)
        for b in slices(batches, 2000):
            texts = [t or "" for t in b.column("text").to_pylist()]
            got = model.encode(texts, n)
            ids, many = _lists([ways[0][1] for ways in got]), np.cumsum([0, *(len(ways) - 1 for ways in got)]).astype(np.int32)
            whole = [d == t.encode() for d, t in zip(model.decode(ids), texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), ids, pa.array([[s for s, _ in ways] for ways in got], pa.list_(pa.float64())),
                    pa.ListArray.from_arrays(pa.array(many), _lists([x for ways in got for _, x in ways[1:]])),
                    pa.array([[zlib.crc32(x) for _, x in ways] for ways in got], pa.list_(pa.int64())), pa.array(whole),
                ],
                ["doc_id", "ids", "scores", "others", "crc32s", "round_trip"],
            )

    return run


def encode(docs: DataFrame, path: str, n: int = 3) -> DataFrame:
    """One row a document: doc_id, ids (best segmentation), scores (of the n best, best first), others (ids of the second to
    the n-th best), crc32s (unsigned crc32 of each one's ids as little-endian 32-bit integers), round_trip.

    round_trip: decoding the ids gives the text back. Null and empty texts have no ids, the one score 0 and no others. Fewer
    than n scores: the text has no more segmentations. Equal scores count each; their order is fixed by the parts' own.
    Rows that share a doc_id are encoded each. Other columns are ignored. No rows give no rows.
    """
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_encode(path, n), f"doc_id {kind}, ids array<int>, scores array<double>, others array<array<int>>, crc32s array<long>, round_trip boolean")


def decode(encoded: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """doc_id and text of rows with id lists. A null or empty list is the empty text; an id beyond the vocabulary fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("pieces", forget)
        model = model_at(path)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.decode(b.column("ids")), pa.binary()).cast(pa.string())], ["doc_id", "text"])

    ids = F.coalesce(column, F.array().cast("array<int>")).alias("ids")
    return encoded.select("doc_id", ids).mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and the same of the other segmentations, three scores, round_trip."""
    one = [F.get("scores", F.lit(i)).alias(f"score_{i + 1}") for i in range(3)]
    more = [F.get("crc32s", F.lit(i)).alias("ids_crc32" if not i else f"ids_crc32_{i + 1}") for i in range(3)]
    sizes = F.transform("others", lambda x: F.size(x).cast("long")).alias("n_pieces_others")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), *more, sizes, *one, "round_trip")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))
