"""Token-ID output: Parquet list columns, delta encoded, with controlled row groups, pages and page indexes.

A store is a folder of Parquet files in ascending doc_id order. Each row holds doc_id, n_tokens and ids (a list column).
Ids are written with version 2 pages (delta binary packing, since a dictionary of token ids doesn't pay) in row groups and
pages of set sizes; Parquet's column and offset indexes let a reader fetch the ids of a few documents, or only the
metadata columns, without reading the rest.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, enter, numbered_words, order_prefix, slices, table

#: Distinct words whose ids a Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 1_000_000
END_ID = 1


#: A normaliser and a pre-tokenizer under which no pre-token spans white space and a word is encoded alone.
NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
MARKS = ".,!?;:*#$%&"


def by_word(spec: dict) -> bool:
    """Whether a tokenizer file (its JSON) provably gives a text the ids of its words, one word after the other.

    That is so if the text is split by SPLIT, no alternative of which matches white space, after NORMALISER, which maps
    white space to a space and other characters without regard to what lies beyond a space; and if no added token holds
    white space or reaches for its neighbours.
    """
    split = {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    parts = pre.get("pretokenizers") or [{}, {}]
    plain = all(not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) and not any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens") or [])
    bytes_ = len(parts) == 2 and parts[1].get("type") == "ByteLevel" and not parts[1].get("add_prefix_space") and not parts[1].get("use_regex", True)
    normal = (spec.get("normalizer") or {}).get("normalizers") == NORMALISER
    return plain and normal and pre.get("type") == "Sequence" and parts[0] == split and bytes_ and model.get("type") == "BPE" and not model.get("dropout") and not spec.get("truncation")


class WordEncoder:
    """The library's ids of whole texts. Where by_word() holds, each distinct word is encoded once and remembered.

    Words are cut at ASCII white space. One of Latin letters, with marks behind it perhaps, is one pre-token or two: the
    library normalises it and its BPE model merges it. Any other word takes the library's whole way. With any other
    tokenizer file each text goes through the library as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = by_word(json.load(f))
        self.model = self.whole.model
        self.code = [i.to_bytes(4, "little") for i in range(self.whole.get_vocab_size())]
        self.known: dict[bytes, bytes] = {}
        self.marks: dict[str, bytes] = {}
        # The byte alphabet of byte-level BPE: printable bytes stand for themselves, others for letters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (b for b in range(256) if b not in plain)
        self.alphabet = dict(zip(plain, plain, strict=True)) | {b: 256 + i for i, b in enumerate(rest)}

    def slow(self, text: str) -> bytes:
        return b"".join([self.code[i] for i in self.whole.encode(text, add_special_tokens=False).ids])

    def lowered(self, texts: list[str]) -> dict[str, str]:
        """Normal forms, made in one call: NUL is neither white space nor changed nor composed, so it keeps texts apart."""
        odd = [t for t in texts if not t.isascii() and "\0" not in t]
        return dict(zip(odd, self.whole.normalizer.normalize_str("\0".join(odd)).split("\0"), strict=True)) if odd else {}

    def add(self, new: list[bytes]) -> None:
        code, tokenize, known = self.code, self.model.tokenize, self.known
        texts = list(map(bytes.decode, new))
        low_of = self.lowered(texts)
        for word, text in zip(new, texts, strict=True):
            low = text.lower() if text.isascii() else low_of.get(text, "")
            body = low.rstrip(MARKS)
            if not body.isalpha() or not (body.isascii() or max(body) < "\u0250"):
                known[word] = self.slow(text)
                continue
            raw_body, size = body.encode(), len(body)
            ids = known.get(raw_body)
            if ids is None:
                if not body.isascii():
                    body = raw_body.decode("latin-1").translate(self.alphabet)
                ids = known[raw_body] = b"".join([code[t.id] for t in tokenize(body)])
            if marks := low[size:]:
                if marks not in self.marks:
                    self.marks[marks] = self.slow(marks)
                ids += self.marks[marks]
            known[word] = ids

    def encode(self, texts: pa.Array, end: bytes = b"") -> tuple[pa.Buffer, np.ndarray]:
        """Little-endian 32-bit ids of all texts (null: empty), each with `end` behind it; and where each begins, in ids."""
        if not self.by_word:
            got = [self.slow(t or "") + end for t in texts.to_pylist()]
            return pa.py_buffer(b"".join(got)), np.cumsum([0, *(len(x) // 4 for x in got)])
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.marks.clear()
        # Arrow cuts and numbers the words; Python sees each distinct one of the batch once.
        words, codes, at = numbered_words(texts)
        distinct = words.cast(pa.large_binary()).to_pylist()
        ids = list(map(self.known.get, distinct))
        if new := [w for w, i in zip(distinct, ids, strict=True) if i is None]:
            self.add(new)
            ids = list(map(self.known.__getitem__, distinct))
        flat = pa.array([*ids, end], pa.large_binary()).take(pa.array(np.insert(codes, at[1:], len(ids))))
        starts = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] // 4
        return flat.buffers()[2] or pa.py_buffer(b""), starts[at + np.arange(len(at))]

    def ids(self, texts: list[str | None]) -> list[list[int]]:
        data, at = self.encode(pa.array(texts, pa.string()))
        flat = np.frombuffer(data, "<u4")
        return [flat[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)]


_encoders: dict[str, WordEncoder] = {}


def forget() -> None:
    _encoders.clear()


def encoder(path: str) -> WordEncoder:
    """One for each Python worker, across tasks."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, row_group_bytes: int = 16 << 20, page_bytes: int = 128 << 10) -> None:
    """Encodes every whole text (null: empty), appends end_id, and writes the store in ascending doc_id order."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("token_store", forget)
        enc = encoder(tokenizer)
        for b in slices(batches, 10_000):
            data, at = enc.encode(b.column("text"), end)
            ids = pa.Array.from_buffers(pa.int32(), int(at[-1]), [None, data])
            sizes = pa.array(np.diff(at).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), ids)], ["doc_id", "n_tokens", "ids"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    (
        dealt.mapInArrow(encode, "doc_id long, n_tokens int, ids array<int>").write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")
        .option("parquet.block.size", str(row_group_bytes)).option("parquet.page.size", str(page_bytes)).parquet(path)
    )


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and n_tokens; the pages of ids stay unread."""
    return spark.read.parquet(path).select("doc_id", "n_tokens")


def read_docs(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The ids of documents first to last; row groups and pages outside that range stay unread."""
    return spark.read.parquet(path).filter(F.col("doc_id").between(first, last))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens and the crc32 of the ids, all from the files."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("ids")
            flat, off = np.asarray(col.flatten()).astype("<i4", copy=False), np.asarray(col.offsets)
            data, off = memoryview(flat).cast("B"), (off - off[0]) * 4
            sums = [zlib.crc32(data[i:j]) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            n = np.diff(off) // 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "n_tokens", "ids_crc32"])

    return spark.read.parquet(path).select("doc_id", "ids").mapInArrow(crc, "doc_id long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """One row a document, read back from a store of docs: doc_id, start, n_tokens, ids_crc32.

    A null text is an empty one (only the end id). Null doc_ids are written and read first. Rows that share a doc_id stay
    separate rows; which of them is first is settled by their length and sum. No rows give no rows; columns besides doc_id
    and text are ignored. Memory: one Arrow batch (bounded in rows and bytes) or one text, and REMEMBERED words.
    """
    ws = Workspace(docs.sparkSession)
    path = ws.path()
    write_store(docs, path, tokenizer, end_id)
    ws.release()
    narrow = ws.save(digest(docs.sparkSession, path))
    out = order_prefix(ws, narrow, ["doc_id", "n_tokens", "ids_crc32"], ["n_tokens"])
    return out.select("doc_id", F.col("before_n_tokens").alias("start"), "n_tokens", "ids_crc32")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
