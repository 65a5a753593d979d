"""The training-data operators against plain versions, round trips and held-out labels, and their edge cases."""

import hashlib
import json
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import chat, decontam, near_dup, pieces, quality, queries, rules, sharding, substring, token_store, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_FILE, PIECE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, score double, kept boolean, n_words long"
SYLLABLES = ["an", "er", "tion", "th", "ou", "é", "ß", "re", "on", "st"]


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


def corpus(seed=1):
    """Near and exact copies, shared passages, periodic and very long texts, odd characters, empty and null ones."""
    rng = random.Random(seed)
    base = [words(rng, rng.randint(30, 160)) for _ in range(12)]
    passage = words(rng, 55)
    out = [" ".join(b) for b in base]
    for i in range(90):
        w = list(base[i % 5])
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8, 13])):
            w[rng.randrange(len(w))] = f"q{rng.randrange(99)}"
        if i % 4 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passage[rng.randrange(4) :]
        out.append((" ".join(w[:-3]) + "\n" + " ".join(w[-3:])).upper() if i % 17 == 0 else " ".join(w))
    out += ["", None, " \n\t", "a", "a b", "A  B", "x " * 400, "ab cd " * 60, " ".join(words(rng, 4000)), "don't I'M here ▁ a▁b  two  spaces \x1c … 你好　世界 é <|endoftext|> *** THE!! the, end."]
    return list(enumerate(out))


ROWS = corpus()


def frame(spark, rows=ROWS, parts=5):
    """Extra columns have names that operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 0.5, True, 7) for i, t in rows], SCHEMA).repartition(parts)


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


# Near duplicates


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 512), (5, 80, 4)])
def test_near_dup_matches_brute_force(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    got = by_id(near_dup.near_duplicates(frame(spark), k, percent), "n_shingles", "component_id")
    assert got == brute.near_dup(ROWS, k, percent)


def test_near_dup_edges(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A b C d"), (None, "a b c d"), (3, None), (4, "")]
    got = near_dup.near_duplicates(frame(spark, rows), 3, 85).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True)]
    assert near_dup.near_duplicates(frame(spark, []), 3, 85).count() == 0


def test_bands_miss_hardly_anything():
    for t in (0.8, 0.85, 0.9):
        rows, bands = near_dup.bands_for(t)
        assert (1 - t**rows) ** bands <= near_dup.MISS


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    same = (near_dup.signature(a, 1024) == near_dup.signature(b, 1024)).mean()
    assert abs(same - 800 / 1200) < 0.07


def test_components_of_a_chain(spark):
    ws = near_dup.Workspace(spark)
    edges = spark.createDataFrame([(i, i + 1) for i in range(20, 60)] + [(7, 9), (9, 8)], "a long, b long")
    got = {r.id: r.component_id for r in near_dup.components(ws, edges).collect()}
    assert got == {**dict.fromkeys(range(20, 61), 20), 7: 7, 8: 7, 9: 7}


# Repeated passages


@pytest.mark.parametrize(("split", "chunk"), [(4096, 8 << 20), (3, 2000)])
def test_substring_matches_brute_force(spark, monkeypatch, split, chunk):
    monkeypatch.setattr(substring, "SPLIT", split)
    monkeypatch.setattr(substring, "CHUNK", chunk)
    got = by_id(substring.remove_repeats(frame(spark)), "n_words", "n_removed", "kept_sha256")
    assert got == brute.substring_dedup(ROWS)


def test_substring_edges(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None)]
    got = sorted((r.doc_id or 99, r.n_words, r.n_removed) for r in substring.remove_repeats(frame(spark, rows)).collect())
    assert got == [(1, 25, 0), (1, 25, 0), (2, 25, 25), (3, 0, 0), (99, 25, 25)]
    assert substring.remove_repeats(frame(spark, [])).count() == 0


def test_windows_with_one_hash_are_told_apart(monkeypatch):
    real, calls = substring.run_hashes, []

    def half(h, k):  # every other call: the first of the two hashes says nothing
        calls.append(k)
        return np.zeros(max(0, len(h) - k + 1), np.uint64) if len(calls) % 2 else real(h, k)

    monkeypatch.setattr(substring, "run_hashes", half)
    code = lambda a: np.repeat(np.arange(a, a + 3, dtype=np.uint64), 2).tobytes()
    n = np.array([1, 1, 1])
    d, _, s = substring.repeated_windows(3, np.zeros(3, np.int64), np.array([5, 6, 7]), n, n * 0, n, [code(0), code(1), code(0)])
    assert (d.tolist(), s.tolist()) == ([7], [0])


# Token store


def test_token_store(spark, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_FILE)
    start, want = 0, {}
    for i, t in ROWS:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert by_id(token_store.token_table(frame(spark), WORD_FILE), "start", "n_tokens", "ids_crc32") == want
    path = f"file://{tmp_path}/store"
    token_store.write_store(frame(spark), path, WORD_FILE)
    some = token_store.read_docs(spark, path, 3, 5)
    assert sorted((r.doc_id, len(r.ids)) for r in some.collect()) == [(i, want[i][1]) for i in (3, 4, 5)]
    plan = token_store.read_meta(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1]
    assert token_store.token_table(frame(spark, []), WORD_FILE).count() == 0


ODD = ["Straße ÉCOLE İstanbul ΣΑΣ ς's don't x.y a1b2 <|endoftext|> foo<|endoftext|>bar 你好  x　y é Å \x1c q !!! *** a,,b ½ ﬁ İ!", "é" * 50 + "!", "\x00 \x7f \u200b", "'s 're it's, We'll! 'd", "Ⅷ ª ʰ ǅ ẞ.", "élève mot\u00a0suite château", "garçon \u00a0 forêt", "naïve über straße", "\u2028 \u3000x\u3000 y", "prix\u00a0: 3\u00a0500 €", "\u0301 e\u0301 \u0301x", "mot\0nul é\0"]


def test_word_encoder_is_the_library():
    enc = token_store.WordEncoder(WORD_FILE)
    assert enc.by_word
    every = [*ODD, *(t or "" for _, t in ROWS)]
    assert enc.ids(every) == [e.ids for e in enc.whole.encode_batch(every, add_special_tokens=False)]


def test_mixed_batches_keep_documents_apart():
    enc, rng = token_store.WordEncoder(WORD_FILE), random.Random(11)
    some = [w for t in ODD for w in t.split(" ")]
    for k in range(2500):
        if k % 3:
            enc.known.clear()
        batch = [" ".join(rng.choices(some, k=rng.randint(0, 9))) for _ in range(4)]
        assert enc.ids(batch) == [e.ids for e in enc.whole.encode_batch(batch, add_special_tokens=False)]


def test_other_tokenizer_files_take_whole_texts():
    enc = token_store.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not enc.by_word
    assert enc.ids([*ODD, None]) == [enc.whole.encode(t, add_special_tokens=False).ids for t in [*ODD, ""]]


def test_prefix_sums_of_one_key_fill_many_ranges(spark):
    from quillmesh.llm.common import Workspace, order_prefix

    ws = Workspace(spark)
    rows = ws.save(spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.lit(5)).alias("k"), (F.col("id") % 7).alias("v")))
    out = order_prefix(ws, rows, ["k", "v"], ["v"]).collect()
    dealt = spark.read.parquet(f"{ws.root}/t2").groupBy("_r").count().collect()
    assert len(dealt) >= 8 and max(r["count"] for r in dealt) < 1000
    total = 0
    for r in sorted(out, key=lambda r: (r.k is not None, r.k or 0, r.v, r.before_v)):
        assert r.before_v == total
        total += r.v


def test_intermediate_tables_go_with_their_scope(spark):
    import os

    from quillmesh.llm import common

    with common.scratch():
        ws = common.Workspace(spark)
        assert ws.save(spark.range(3)).count() == 3
        at = ws.root.removeprefix("file://")
        assert os.path.isdir(at)
    assert not os.path.exists(at)

    class Cluster:
        conf = sparkContext = None

    far = Cluster()
    far.conf = type("C", (), {"get": lambda self, *a: None})()
    far.sparkContext = type("S", (), {"master": "yarn", "getConf": lambda self: far.conf})()
    with pytest.raises(ValueError, match="checkpoint"):
        common.Workspace(far)


# SentencePiece


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(PIECE_FILE)


def test_n_best_is_exact(model):
    def every(part):
        if not part:
            return [0.0]
        out = []
        for n in range(1, min(len(part), model.longest) + 1):
            hit = model.pieces.get(part[:n])
            if hit or n == 1:
                out += [(hit[1] if hit else model.fallback) + s for s in every(part[n:])]
        return out

    for part in ("▁there", "▁thanks", "été", "▁▁a", "你x"):
        want = sorted(every(part), reverse=True)
        got = [s for s, _ in model.n_best(part, 6)]
        assert got == want[:6]
        _, best, behind = model.segment(part)
        assert best == want[0] and (best - behind == want[1] if len(want) > 1 else behind == float("inf"))
        assert all("".join(p) == part for _, p in model.n_best(part, 6))


def test_columns_give_what_single_parts_give(model):
    rng = random.Random(5)
    parts = list({("▁" if i % 3 else "") + "".join(rng.choices("aeinrstéßÉ你\t▁,.!x", k=rng.randint(1, 30))) for i in range(3000)})
    model.known.clear()
    one = {p: model.segment(p) for p in parts}
    model.known.clear()
    model.segment_all(parts)
    assert {p: model.known[p] for p in parts} == one


def test_n_best_of_a_text_is_that_of_its_whole_lattice(model):
    for t in ("the thing", "a  b the", "é\nthe\n\nend ", "one ▁ two"):
        (ways,) = model.encode([t], 5)
        scores = [w for w, _ in ways]
        if "▁" not in t:
            whole = [s for s, _ in model.n_best("▁" + t.replace(" ", "▁"), 5)]
            assert scores == pytest.approx(whole)
            assert all(b"".join(model.code.get(p) or model._codes(p) for p in cut) in [x for _, x in ways] for _, cut in model.n_best("▁" + t.replace(" ", "▁"), 2))
        assert scores == sorted(scores, reverse=True)


def test_sentencepiece_round_trip(spark):
    encoded = pieces.encode(frame(spark), PIECE_FILE)
    out = pieces.digest(encoded).collect()
    assert len(out) == len(ROWS) and all(r.round_trip for r in out)
    assert {r.doc_id: r.n_pieces for r in out}[len(ROWS) - 10] == 0  # the empty text
    assert by_id(pieces.decode(encoded, PIECE_FILE), "text") == {i: (t or "",) for i, t in ROWS}
    second = encoded.filter("size(others) > 0").withColumn("ids", F.element_at("others", -1))
    assert all(t == (dict(ROWS)[i] or "",) for i, t in by_id(pieces.decode(second, PIECE_FILE), "text").items())
    for r in encoded.collect():
        lists = [r.ids, *r.others]
        assert r.crc32s == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in lists] and len(lists) == len(r.scores) == len({tuple(x) for x in lists})
    assert pieces.encode(frame(spark, []), PIECE_FILE).count() == 0 == pieces.decode(pieces.encode(frame(spark, []), PIECE_FILE), PIECE_FILE).count()


def test_both_ways_of_cutting_agree(model):
    for t in ("", "\nabc", " a", "a\n b  c", "a \n b ", "x ▁ y", "\0", "a\n\0", "trailing ", "\n\n", "é 你好\n", "  ", *(t for _, t in ROWS[:40] if t)):
        assert model._put_together(*model._numbered([model.parts(t)]), 3) == model.encode([t], 3)


def test_ties_count_each(model):
    """Of segmentations with one score each is returned, in the same order every time."""
    model.found.clear()
    first = model.encode(["the  the", "a" * 30], 4)
    model.found.clear()
    assert first == model.encode(["the  the", "a" * 30], 4) and all(len({x for _, x in ways}) == len(ways) for ways in first)


def test_lattice_is_the_library_on_a_unigram_model(tmp_path):
    """A unigram model written by hand (nothing is trained): the library's N best are ours."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.unk_id, m.trainer_spec.bos_id, m.trainer_spec.eos_id = 1, True, 0, 1, 2
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = "identity", True, False, True
    for p, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=p, score=0.0, type=kind)
    for i in range(256):
        m.pieces.add(piece=f"<0x{i:02X}>", score=0.0, type=6)
    rng = random.Random(3)
    for p in sorted({x for n in (1, 2, 3) for _ in range(40) for x in ["".join(rng.choices("abcde", k=n))]} | {"▁", "▁a", "▁ab", "▁c", "a", "b", "c", "d", "e"}):
        m.pieces.add(piece=p, score=-rng.uniform(1, 9), type=1)
    path = f"{tmp_path}/u.model"
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Pieces(path)
    for _ in range(200):
        t = " ".join("".join(rng.choices("abcde", k=rng.randint(1, 7))) for _ in range(rng.randint(1, 3)))
        (ways,) = own.encode([t], 3)
        assert [np.frombuffer(x, "<i4").tolist() for _, x in ways][:1] == [library.encode(t)]
        theirs = [sum(map(library.get_score, x)) for x in library.nbest_encode_as_ids(t, 3)]  # ties come in any order there
        assert [s for s, _ in ways] == pytest.approx(theirs, abs=1e-4)
        assert [sum(map(library.get_score, np.frombuffer(x, "<i4").tolist())) for _, x in ways] == pytest.approx(theirs, abs=1e-4)


# Classifiers


def test_classifiers_on_held_out_rows(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(700):
        w = words(rng, rng.randint(20, 90))
        bad, toxic = i % 4 == 0, i % 5 == 1
        if bad:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = "zorbu" + rng.choice(SYLLABLES)
        docs.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(9001, ""), (9002, None), (None, "x")]
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for got, mod, out, truth in ((quality.score_quality(frame(spark, docs), lab), 4, 2, {i: q for i, q, _ in labels}), (toxicity.score_toxicity(frame(spark, docs), lab), 5, 0, {i: t for i, _, t in labels})):
        rows = got.collect()
        assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
        held = [r for r in rows if r.held_out]
        assert {r.doc_id for r in held} == {i for i, _ in docs if i is not None and zlib.crc32(str(i).encode()) % mod == out}
        right = [r.predicted == truth[r.doc_id] for r in held if r.doc_id in truth]
        assert sum(right) / len(right) > 0.97
    none = lab.filter(F.lit(False))
    assert {r.predicted for r in quality.score_quality(frame(spark), none).collect()} == {1}
    assert {r.score for r in toxicity.score_toxicity(frame(spark), none).collect()} == {0.0}
    assert quality.score_quality(frame(spark, []), lab).count() == 0


def test_label_model_finds_correlated_voters():
    rng = np.random.default_rng(0)
    y = (rng.random(2000) < 0.3).astype(int)
    flip = lambda p: np.where(rng.random(2000) < p, 1 - y, y) * 2 - 1
    a = flip(0.1)
    votes = np.stack([a, a, flip(0.1), flip(0.4), 2 * y - 1], axis=1).astype(float)
    m = toxicity.LabelModel().fit(votes)
    assert m.correlation[0, 1] > 0.8 > 0.3 > abs(m.correlation[0, 2])
    assert m.accuracy[2] > m.accuracy[3]


def test_label_model_is_plain_expectation_maximisation():
    spoken = [(1, 1), (1, 1), (-1, -1), (0, -1), (-1, 1), (1, 1), (-1, -1)]
    votes = [(a, 0, b) for a, b in spoken]  # the second voter never speaks
    q = [0.95 if b > 0 else 0.05 for _, b in spoken]
    for _ in range(3):
        p = sum(q) / len(q)
        mean = [[sum(w * v[j] for w, v in zip(ws, spoken)) / sum(ws) for j in range(2)] for ws in ([1 - x for x in q], q)]
        cov = [[0.05 * (i == j) + sum(w * (v[i] - mean[c][i]) * (v[j] - mean[c][j]) for x, v in zip(q, spoken) for c, w in ((0, 1 - x), (1, x))) / len(votes) for j in range(2)] for i in range(2)]
        det = cov[0][0] * cov[1][1] - cov[0][1] * cov[1][0]
        d = [mean[1][j] - mean[0][j] for j in range(2)]
        w = [(cov[1][1] * d[0] - cov[0][1] * d[1]) / det, (cov[0][0] * d[1] - cov[1][0] * d[0]) / det]
        bias = np.log(p / (1 - p)) - 0.5 * sum((mean[0][j] + mean[1][j]) * w[j] for j in range(2))
        q = [1 / (1 + np.exp(-(v[0] * w[0] + v[1] * w[1] + bias))) for v in spoken]
    got = toxicity.LabelModel().fit(np.array(votes, float), rounds=3)
    assert got.posterior(np.array(votes, float)) == pytest.approx(q)


def test_features_are_those_of_plain_counting():
    import pyarrow as pa

    text = "ab abc ab ab é x"
    whole, buckets, owner = quality.word_features(pa.array(["ab", "abc", "é", "x"]))
    assert np.bincount(owner).tolist() == [1 + sum(max(0, n + 2 - k + 1) for k in quality.GRAMS) for n in (2, 3, 1, 1)]
    weights = np.random.default_rng(1).normal(size=quality.BUCKETS)
    codes = np.array([0, 1, 0, 0, 2, 3])
    pairs, _ = quality.bigrams(codes, whole, np.zeros(6, int))
    assert len(pairs) == 6 and (pairs == quality.SAME).sum() == 1
    every = [b for c in codes for b in buckets[owner == c]] + pairs.tolist()
    assert quality.logits(pa.array([text, None, "", text]), weights, 0.5) == pytest.approx([0.5 + weights[every].mean(), 0.5, 0.5, 0.5 + weights[every].mean()])


def test_labelled_rows_are_bounded_though_doc_ids_repeat(spark):
    rows = [(i % 4, f"text {i % 50}") for i in range(2000)]
    labels = spark.createDataFrame([(i, 1) for i in range(4)] * 3, "doc_id long, quality int")
    got = quality.labelled(frame(spark, rows), labels, "quality", 4, 9, 3).collect()
    assert len(got) == 3 == len({(r["_l"], r.text) for r in got})


def test_classifiers_take_long_texts_and_repeated_ids(spark):
    long = "word " * 200_000
    docs = [(1, "good text here"), (1, "good text here"), (1, "other"), (2, long), (3, None), (None, long)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for got in (quality.score_quality(frame(spark, docs), labels), toxicity.score_toxicity(frame(spark, docs), labels)):
        assert got.count() == len(docs)


# Decontamination


def test_masks_find_every_two_substitutions():
    from itertools import combinations

    for errors in combinations(range(decontam.WORDS), decontam.SUBSTITUTIONS):
        assert any(not any(m[e - s] == "1" for e in errors if 0 <= e - s < len(m)) for m in decontam.MASKS for s in range(decontam.WORDS - len(m) + 1))


def test_masks_of_short_items_find_every_substitution():
    for n in range(1, decontam.WORDS):
        assert decontam.allowed(n) == (1 if n >= 7 else 0)
        for wrong in range(n if decontam.allowed(n) else 0):
            assert any(not any(m[wrong - s] == "1" for _ in (0,) if 0 <= wrong - s < len(m)) for m in decontam.masks_for(n) for s in range(n - len(m) + 1))


@pytest.mark.parametrize("bits", [24, 6])
def test_decontamination_matches_brute_force(spark, bits):
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate((30, 15, 13, 9, 60, 12, 7, 3))] + [(98, None), (99, "")]
    docs = []
    for i in range(120):
        w = words(rng, 40)
        own = items[i % 8][1].split()
        a = rng.randrange(max(1, len(own) - 20))
        part = own[a : a + rng.choice([9, 12, 13, 20, 60])]
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            part[rng.randrange(len(part))] = "ZZ"
        docs.append((i, " ".join(w[:20] + [p.upper() for p in part] + w[20:]) if i % 3 else " ".join(w)))
    docs += [(900, None), (901, ""), (902, items[3][1]), (903, " ".join(words(rng, 30_000)) + " " + items[1][1]), (904, items[5][1] + " Слово слово " + items[6][1])]

    def match(text, item):
        d, b = ([w.lower() for w in decontam._WORD.findall(x or "")] for x in (text, item))
        n = min(len(b), decontam.WORDS)
        allowed = 2 if n == 13 else 1 if n >= 7 else 0
        return n and any(sum(x != y for x, y in zip(d[p : p + n], b[q : q + n])) <= allowed for p in range(len(d) - n + 1) for q in range(len(b) - n + 1))

    want = {i: [k for k, t in items if match(text, t)] for i, text in docs}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.item_ids, r.kept, r.contaminated) for r in decontam.find_contamination(frame(spark, docs), bench, bits).collect()}
    assert got == {i: (ids, not ids, bool(ids)) for i, ids in want.items()} and any(want.values())
    clean = sorted((i for i, ids in want.items() if not ids))
    assert sorted(r.doc_id for r in decontam.drop_contaminated(frame(spark, docs), bench, bits).collect()) == clean
    assert decontam.find_contamination(frame(spark), bench.filter(F.lit(False))).filter("contaminated").count() == 0
    assert decontam.find_contamination(frame(spark, []), bench).count() == 0


def test_decontamination_edges(spark):
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (1, item), (2, item), (None, item)], "item_id long, text string")
    got = decontam.find_contamination(frame(spark, [(1, item), (1, item), (1, "clean"), (None, item + " x")]), bench).collect()
    assert sorted((r.doc_id or 0, r.contaminated, r.overlap_words, r.n_items) for r in got) == [(0, True, 20, 3), (1, False, 0, 0), (1, True, 20, 3), (1, True, 20, 3)]
    assert {tuple(r.item_ids) for r in got} == {(), (1, 2, None)}


# Rules, shards, chat


def test_rules_match_plain_counts(spark):
    got = {r.doc_id: r for r in rules.apply_rules(frame(spark)).collect()}
    for i, t in ROWS:
        w, lines = brute.words(t), [x for x in (t or "").split("\n") if brute.words(x)]
        at = {}
        for j in range(len(w) - 2):
            at.setdefault(tuple(w[j : j + 3]), []).append(j)
        repeated = {j + k for js in at.values() if len(js) > 1 for j in js for k in range(3)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)), i
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert rules.apply_rules(frame(spark, [])).count() == 0


def test_shards(spark):
    rows = [*ROWS, (5, "again"), (5, "again"), (None, "first")]
    out = sharding.assign_shards(frame(spark, rows), 7).collect()
    assert len(out) == len(rows) and {r.law for r in out} == {"bytes"} and {r.grown_shard for r in out} == {None}
    order = sorted(out, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.shard, r.slot))
    assert [r.shard for r in order] == sorted(r.shard for r in out)
    for s in range(7):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    total, largest = sum(r.size for r in out), max(r.size for r in out)
    assert all(abs(sum(r.size for r in out if r.shard == s) - total / 7) <= largest for s in range(7))
    texts = dict(ROWS)
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in out if r.doc_id not in (None, 5))
    assert sharding.assign_shards(frame(spark, []), 7).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", 'say "hi"\n?'), (1, 1, "assistant", "hi"), (1, 2, "user", None), (1, 4, "user", ""), (1, 5, "tool", "x"), (2, 3, "assistant", "late"), (None, 0, "user", "a"), (1, 0, "user", 'say "hi"\n?'), (3, 0, None, None)]
    out = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == len(rows)
    one = {(r.conv_id, r.turn, r.kind): r for r in out}
    assert one[1, 0, "call"].linked and one[1, 1, "result"].linked and not one[2, 3, "result"].linked
    assert [one[1, t, "call"].depth for t in (0, 2, 4)] == [0, 1, 2] and one[1, 1, "result"].place == 1
    assert one[1, 2, "call"].errors == "missing:text,missing:words" and one[1, 4, "call"].errors == "range:text,range:words"
    parsed = [json.loads(r.json) for r in out]
    assert all(json.dumps(p, sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json for p, r in zip(parsed, out, strict=True))
    wide = spark.createDataFrame([(1, 0, "user", "x " * 90_000, "own", "y", 1), (1, 1, "assistant", "z", None, None, None)], "conv_id long, turn long, role string, text string, id string, json string, depth long")
    assert sorted((r.turn, r.kind, r.errors, r.depth) for r in chat.format_conversations(wide).collect()) == [(0, "call", "range:text,range:words", 0), (1, "result", "", 0)]
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_depths_and_cycles(spark):
    links = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "gone")] + [(f"n{i}", f"n{i - 1}") for i in range(1, 20)], "id string, parent string")
    got = {r.id: r.depth for r in chat.depths(chat.Workspace(spark), links).collect()}
    assert (got["a"], got["b"], got["c"], got["z"], got["x"], got["n1"], got["n19"]) == (0, 1, 2, 0, None, 0, 18)


def test_validation(spark):
    schemas = spark.createDataFrame([("f", "n", "integer", True, 1, 9), ("f", "s", "string", False, 2, 3), ("f", "b", "boolean", False, None, None)], chat.SCHEMA_TYPE)
    calls = spark.createDataFrame([("f", {"n": "5", "s": "ab", "b": "true"}), ("f", {"n": "50"}), ("f", {"n": "x", "q": "1"}), ("f", {"s": "abcd"}), ("g", {"a": "1"}), ("f", None)], "name string, args map<string,string>")
    got = sorted((r.errors, r.args_json) for r in chat.validate(calls, schemas).collect())
    assert got == sorted([("", '{"b":true,"n":5,"s":"ab"}'), ("range:n", '{"n":50}'), ("type:n,unknown:q", '{"n":"x","q":"1"}'), ("missing:n,range:s", '{"s":"abcd"}'), ("unknown_tool", '{"a":"1"}'), ("missing:n", "{}")])


# The pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None
    rng = random.Random(8)
    clean = [" ".join(words(rng, 80)) for _ in range(40)]
    items = [(i, " ".join(words(rng, 20))) for i in range(3)]
    shared, own = " ".join(words(rng, 60)), " ".join(words(rng, 50))
    docs = [(i, t) for i, t in enumerate(clean)] + [(100, clean[0]), (101, clean[1] + " more"), (102, clean[2] + " " + items[1][1]), (103, " ".join(words(rng, 50)) + " " + shared), (104, shared + " " + own)]
    docs += [(200 + i, " ".join(w.upper() + "!!" for w in words(rng, 40))) for i in range(30)]
    f = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    f.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, at, str(tmp_path))
        if i < 4:
            assert out.columns == list(cp.COLUMNS)
        out.write.parquet(f"{tmp_path}/stage{i}")
        at = spark.read.parquet(f"{tmp_path}/stage{i}")
        kept.append({r.doc_id for r in at.select("doc_id").collect()})
    assert kept[0] == {i for i, _ in docs if i < 200}
    assert kept[1] == kept[0] - {100, 101}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/stage2").collect()}
    assert shared in texts[103] and texts[104] == own
    assert kept[3] == kept[2] - {102}
    assert {r.doc_id for r in cp.run(spark, str(tmp_path)).collect()} == kept[4] == kept[3]


def test_every_stage_takes_odd_rows(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(9)
    text = " ".join(words(rng, 70))
    rows = [(1, text), (1, text), (2, text), (2, None), (3, ""), (4, None), (None, text), (None, None), (5, " ".join(words(rng, 30_000)))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, ids string, _id long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), False, 0.1, "x", 7) for i, t in rows], schema)
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = {"quality": 9, "near_dedup": 7, "substring_dedup": None, "decontaminate": 9, "sentencepiece": 9}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path)).collect()
        assert want[name] in (None, len(out)), (name, len(out))
        assert stage(spark, docs.filter(F.lit(False)), str(tmp_path)).count() == 0, name
    cut = cp.substring_dedup(spark, docs, str(tmp_path)).collect()
    # The copies of doc 1 are one place and stay; what repeats them goes; texts without words stay as they are.
    assert sorted((r.doc_id or 0, r.text is None) for r in cut) == [(0, True), (1, False), (1, False), (2, True), (3, False), (4, True), (5, False)]


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
