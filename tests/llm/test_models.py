"""Toxicity, language, near-duplicates, language model, media: brute force and held-out rows on small tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.llm import hmm_lm, langid_segments, lsi_decontam, simhash_ball, telephony, toxicity_kn
from brindle.llm.common import fold, read_table
from brindle.llm.queries import op9_telephony
from brindle.llm.tokens import vocabulary_path

SF = "/root/testdata/sf0.01"
PIECES = "piece_bpe_32k.model"
ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "no key"), (5, "same text"), (5, "same text"), (6, "12 34 ..."), (7, "long " * 30000)]


def odd_rows(spark):
    return spark.createDataFrame([(k, t, "en", "key clash") for k, t in ODD], "doc_id long, text string, lang string, key string")


# -- toxicity -----------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    models = toxicity_kn.fit(docs, labels, learn=fold("k", 5) != 0)
    rows = toxicity_kn.score(docs, models).where(fold("doc_id", 5) == 0).join(labels, "doc_id").collect()
    right = sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows)
    assert right / len(rows) > 0.95
    odd = toxicity_kn.score(odd_rows(spark), models).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] < 0.5 for r in odd)
    assert toxicity_kn.score(docs.limit(0), models).count() == 0


def test_toxicity_without_labels(spark):
    docs = odd_rows(spark)
    models = toxicity_kn.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"), learn=F.lit(True))
    assert toxicity_kn.score(docs, models).where("score < 0.5").count() == len(ODD)
    assert toxicity_kn.keep_below(docs, models).count() == len(ODD)


def test_kneser_ney_sums_to_one():
    models = toxicity_kn.fit_models(Counter({"aba": 3, "abc": 1}), Counter({"aba": 1, "bad": 4}))
    for top in models.top:
        context = "^^^ab"
        prefix, _ = toxicity_kn.codes(["ab"])
        g = 0
        for c in prefix[-6:-1].tolist():
            g = g << 8 | c
        total = 0.0
        for c in range(256):
            one = np.array([(g << 8) | c], dtype=np.uint64)
            p = np.full(1, 1.0 / 256)
            for order, t in enumerate(models.lower, 1):
                p = models._step(one & np.uint64((1 << 8 * order) - 1), *t, p)
            total += models._step(one, *top, p)[0]
        assert total == pytest.approx(1.0), context


def test_scripts_with_many_characters():
    # toxic and ordinary words of rare characters, far more than 250 of them
    ordinary = Counter({chr(0x4E00 + k) + chr(0x4E01 + k): 3 for k in range(0, 2000, 2)})
    toxic = Counter({chr(0x6E00 + k) + chr(0x6E01 + k): 3 for k in range(0, 2000, 2)})
    models = toxicity_kn.fit_models(ordinary, toxic)
    ratios = models.log_ratio([chr(0x4E00 + 1990) + chr(0x4E01 + 1990), chr(0x6E00 + 1990) + chr(0x6E01 + 1990)])[:, 0]
    assert ratios[0] < -1 and ratios[1] > 1


def test_a_hot_key_is_learned_from_in_bounds(spark):
    docs = spark.range(3000).select((F.col("id") % 10).alias("doc_id"), F.concat(F.lit("some words and "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)], "doc_id long, toxic int")
    models = toxicity_kn.fit(docs, labels, learn=F.lit(True), sample_bytes=2000)
    assert toxicity_kn.score(docs, models).count() == 3000


# -- language -----------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = {"▁": 1, "a": 2, "b": 3, "ab": 4, "▁a": 5, "▁ab": 6, "aba": 7}
    p = np.array([1e-3, 0.1, 0.2, 0.15, 0.2, 0.1, 0.05, 0.2])

    def brute(s):
        if not s:
            return 1.0
        total = sum(p[k] * brute(s[len(x) :]) for x, k in pieces.items() if s.startswith(x))
        return total if s[0] in pieces else total + p[0] ** len(s[0].encode()) * brute(s[1:])

    words = ["abab", "a", "é", "aba", "bé"]
    edges = langid_segments.lattice(words, langid_segments.prefixes(pieces))
    lengths, log_p = np.array([len(w) + 1 for w in words]), np.log(np.stack([p, p[::-1]], axis=1))
    got = langid_segments.log_probability(edges, lengths, log_p)
    assert got[:, 0] == pytest.approx([math.log(brute("▁" + w)) for w in words])
    p = p[::-1]
    assert got[:, 1] == pytest.approx([math.log(brute("▁" + w)) for w in words])
    uses = langid_segments.expect(edges, lengths, np.ones(len(words)), log_p[:, :1])
    assert uses.sum() > len(words)


def test_long_words_are_scored_whole(tmp_path):
    pieces = {"▁": 1, "a": 2, "b": 3, "ab": 4, "▁a": 5}
    p = np.array([1e-9, 0.1, 0.2, 0.15, 0.2, 0.1])
    word = "ab" * 5000 + "é" * 300  # its probability is far below the smallest float
    want = [0.0]  # the same sum, position by position
    text = "▁" + word
    for k in range(1, len(text) + 1):
        ways = [want[k - len(x)] + math.log(p[i]) for x, i in pieces.items() if text[max(0, k - len(x)) : k] == x]
        if text[k - 1] not in pieces:
            ways.append(want[k - 1] + 2 * math.log(p[0]))
        most = max(ways)
        want.append(most + math.log(sum(math.exp(w - most) for w in ways)))
    got = langid_segments.log_probability(langid_segments.lattice([word], langid_segments.prefixes(pieces)), np.array([len(text)]), np.log(p)[:, None])
    assert got[0, 0] == pytest.approx(want[-1])


def test_unspaced_and_unseen_scripts():
    from brindle.llm.langid_segments import _judge
    from brindle.llm.common import Memo

    counts = {"ja": Counter({"これは長い文章です" * 8: 3, "日本語の言葉を並べて書く" * 6: 2}), "en": Counter({"these": 3, "are": 4, "words": 5})}
    model = langid_segments.fit_counts(counts, vocabulary_path(PIECES))
    names, _ = _judge(model, Memo(model.scorer()), ["日本語の文章を長い言葉で書く" * 9, "these words are words", "ⴰ" * 400])
    assert names[:2] == ["ja", "en"]
    values = model.scorer()(["ⴰ" * 400])[0, :2]
    assert np.isfinite(values).all() and values[0] != values[1]


def test_language_held_out(spark):
    docs = read_table(spark, SF, "documents")
    model = langid_segments.fit(docs, vocabulary_path(PIECES), learn=fold("k", 4) != 2)
    rows = langid_segments.predict(docs, model).where(fold("doc_id", 4) == 2).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95
    odd = langid_segments.predict(odd_rows(spark), model).collect()
    assert Counter(r["lang_pred"] == "und" for r in odd) == {True: 4, False: 4}
    assert langid_segments.keep_known(odd_rows(spark), model).count() == 4
    assert langid_segments.predict(docs.limit(0), model).count() == 0
    nothing = langid_segments.fit(odd_rows(spark).withColumn("lang", F.lit(None).cast("string")), vocabulary_path(PIECES), learn=F.lit(True))
    assert {r["lang_pred"] for r in langid_segments.predict(odd_rows(spark), nothing).collect()} == {"und"}


# -- near-duplicates ----------------------------------------------------------------------------------------


def plain_fingerprint(text, size=3):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["A", "b", " ", "\t", "É", "\x1c", "\xa0", "cd", "\r\n"]), max_size=30).map("".join))
def test_fingerprint(text):
    assert int(simhash_ball.fingerprints([text])[0]) == plain_fingerprint(text)


def brute_components(fps, radius):
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a in range(len(fps)):
            for b in range(len(fps)):
                if (fps[a] ^ fps[b]).bit_count() <= radius and root[b] < root[a]:
                    root[a], changed = root[b], True
    return root


def test_ball_join_is_brute_force(spark):
    rng = np.random.default_rng(4)
    fps = [0]
    for _ in range(150):
        f = fps[rng.integers(len(fps))] if rng.random() < 0.7 else int(rng.integers(1 << 62))
        for b in rng.integers(0, 64, rng.integers(0, 4)).tolist():
            f ^= 1 << b
        fps.append(f)
    fps = sorted(set(fps), key=lambda f: f - (1 << 64) if f >> 63 else f)
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r["fp"]: r["root"] for r in simhash_ball.components(simhash_ball.links(frame)).collect()}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = brute_components(fps, 2)
    assert [roots.get(s, s) for s in signed] == [signed[r] for r in want]
    with pytest.raises(ValueError):
        simhash_ball.links(frame, radius=3)


def test_near_duplicates_of_odd_rows(spark):
    got = simhash_ball.near_duplicates(odd_rows(spark)).collect()
    assert Counter(r["component_id"] for r in got if r["fp"] == 0) == {1: 3}
    kept = simhash_ball.keep_first(odd_rows(spark))
    assert kept.columns == ["doc_id", "text", "lang", "key"]
    assert kept.count() == len({plain_fingerprint(t) for _, t in ODD})
    assert simhash_ball.near_duplicates(odd_rows(spark).limit(0)).count() == 0


def test_first_rows_of_components(spark, tmp_path):
    """keep_first on tables that are no files, on files, with names that clash, and beyond the broadcast."""
    from pyspark.sql import Row

    near = " ".join(f"word{k}" for k in range(400))
    rows = [Row(doc_id=k, text=t, fp=1, row=2, file="x", _metadata="m") for k, t in [(9, near), (3, near), (3, near), (None, near), (5, near + " more"), (7, "other text here"), (8, ""), (2, None), (None, "alone")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, row int, file string, _metadata string")
    fps = [plain_fingerprint(r.text) for r in rows]
    root = brute_components([*fps], 2)
    want = sorted((min((rows[k].doc_id is None, rows[k].doc_id or 0, k) for k in range(len(rows)) if root[k] == x)[:2] for x in set(root)))
    docs.drop("_metadata").repartition(3).write.parquet(str(tmp_path / "docs"))
    files = spark.read.parquet(str(tmp_path / "docs"))
    for table, most in ((docs.drop("_metadata"), 200_000), (files, 200_000), (files, 0), (files.where("true"), 0)):
        got = simhash_ball.keep_first(table, broadcast_rows=most)
        assert got.columns == table.columns
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == want


def test_hot_keys_are_joined_apart(spark):
    from brindle.operators.similarity import join_by

    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(7, "hot"), (11, "cold"), (14, "cold")], "k long, w string")
    for how in ("inner", "left"):
        plain = sorted(map(str, left.join(right, "k", how).collect()))
        assert sorted(map(str, join_by(left, right, "k", how).collect())) == plain


# -- language model -----------------------------------------------------------------------------------------


def test_forward_recursion_is_the_sum_over_paths():
    rng = np.random.default_rng(1)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    m = hmm_lm.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    from itertools import product

    texts = [np.array([0, 4, 2, 1]), np.array([3]), np.array([1, 1])]
    for t, got in zip(texts, hmm_lm.log10_likelihood(m, texts), strict=True):
        total = 0.0
        for path in product(range(3), repeat=len(t)):
            p = m.start[path[0]] * m.emit[t[0], path[0]]
            for k in range(1, len(t)):
                p *= m.move[path[k - 1], path[k]] * m.emit[t[k], path[k]]
            total += p
        assert got == pytest.approx(math.log10(total))
    got = hmm_lm.Counts(m)
    hmm_lm.expected_counts(m, texts, got)
    want = hmm_lm.Counts(m)  # over all paths
    for t in texts:
        ways = []
        for path in product(range(3), repeat=len(t)):
            p = m.start[path[0]] * m.emit[t[0], path[0]]
            for k in range(1, len(t)):
                p *= m.move[path[k - 1], path[k]] * m.emit[t[k], path[k]]
            ways.append((path, p))
        whole = sum(p for _, p in ways)
        for path, p in ways:
            want.start[path[0]] += p / whole
            for k, x in enumerate(path):
                want.emit[t[k], x] += p / whole
                if k:
                    want.move[path[k - 1], x] += p / whole
    for name in ("start", "move", "emit"):
        assert getattr(got, name) == pytest.approx(getattr(want, name), rel=1e-4)


def test_long_texts_are_trained_on_whole():
    rng = np.random.default_rng(2)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    m = hmm_lm.Model(norm(rng.random(3), 0), norm(rng.random((3, 3)), 1), norm(rng.random((5, 3)), 0))
    texts = [rng.integers(0, 5, n) for n in (5000, 700, 699, 3, 1)]
    whole, spans = hmm_lm.Counts(m), hmm_lm.Counts(m)
    hmm_lm.expected_counts(m, texts, whole)
    hmm_lm.expected_counts(m, texts, spans, span=300)
    assert whole.start.sum() == pytest.approx(5, rel=1e-3) and whole.move.sum() == pytest.approx(sum(map(len, texts)) - 5, rel=1e-3)
    for name in ("start", "move", "emit"):
        assert getattr(spans, name) == pytest.approx(getattr(whole, name), rel=1e-3)


def test_word_classes():
    words = [b"a", b"ab", b"xab", "é".encode(), b" ", b"\xff\xfe"]
    assert hmm_lm.word_classes(words, 7).tolist() == [hmm_lm.word_class(w, 7) for w in words]
    assert hmm_lm.word_classes([], 7).tolist() == []


def test_language_model(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").unionByName(odd_rows(spark).select("doc_id", "text"))
    small = hmm_lm.Settings(known_words=200, own_growth=1.0, classes=20, first_rows=100, flush=1000)
    rows = hmm_lm.score(docs, fold("k", 5) != 1, settings=small).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert len(rows) == len(texts)

    def tokens(t):
        return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), " "]

    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1
    c = Counter(w for k, t in texts if not held(k) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((k is not None, k or 0, held(k), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 4)) for k, t in texts)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, not r["learn"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows)
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    assert [g[-1] for g in got] == pytest.approx([w[-1] for w in want], abs=1e-3)
    out = [r for r in rows if not r["learn"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_language_model_without_training_rows(spark):
    rows = hmm_lm.score(odd_rows(spark), F.lit(False)).collect()
    assert len(rows) == len(ODD) and all(r["score"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 for r in rows)
    assert hmm_lm.score(odd_rows(spark).limit(0), F.lit(True)).count() == 0


# -- media --------------------------------------------------------------------------------------------------


def test_tables_of_the_codecs():
    u, a = telephony.mulaw_table(), telephony.alaw_table()
    assert u[0] == -32124 and u[0x80] == 32124 and u[0xFF] == 0 and u[0x7F] == 0
    assert a[0xD5] == 8 and a[0x55] == -8 and a[0xAA] == 32256 and a[0x2A] == -32256
    assert len(set(a.tolist())) == 256


def plain_adpcm(block):
    value = int.from_bytes(block[:2], "little", signed=True)
    index, out = min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = telephony.STEPS[index]
            diff = step >> 3
            diff += step if nibble & 4 else 0
            diff += step >> 1 if nibble & 2 else 0
            diff += step >> 2 if nibble & 1 else 0
            value = max(-32768, min(32767, value + (-diff if nibble & 8 else diff)))
            index = max(0, min(88, index + telephony.CHANGES[nibble & 7]))
            out.append(value)
    return out


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=36, max_size=36))
def test_adpcm(block):
    got = telephony.decode_adpcm(np.frombuffer(block + block, np.uint8).reshape(2, -1))
    assert got[0].tolist() == got[1].tolist() == plain_adpcm(block)


def test_resampling_keeps_a_constant():
    assert telephony.resample(np.full(100, 1000, np.int16), 2, 1)[20:-20].tolist() == pytest.approx([1000] * 160, abs=2)
    assert len(telephony.resample(np.zeros(0, np.int16), 2, 1)) == 0
    assert len(telephony.resample(np.arange(100, dtype=np.int16), 3, 2)) == 150


def test_containers_round_trip(spark):
    for codec in ("mulaw", "alaw", "adpcm"):
        assert telephony.open_container(telephony.container(b"x" * 384, codec))[0::3] == (codec, b"x" * 384)
    rows = telephony.digest(telephony.store_texts(odd_rows(spark))).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = dict(ODD).get(r["key"]) or ""
        assert r["n_bytes"] == len(text.encode()) and r["payload_bytes"] % 192 == 0 and r["payload_bytes"] >= 192
    same = [r for r in rows if r["key"] == 5]
    assert same[0] == same[1]
    media = telephony.store_texts(odd_rows(spark)).withColumnRenamed("key", "doc_id")
    for r in media.collect():  # the stored PCM is what a plain table look-up and the filter give
        text = (dict(ODD).get(r["doc_id"]) or "").encode()
        plain = text + b" " * (max(192, -(-len(text) // 192) * 192) - len(text))
        assert r["pcm"] == telephony.resample(np.array([telephony.mulaw_table()[c] for c in plain]), 2, 1).astype("<i2").tobytes()
    assert telephony.decode_media(media).where("length(pcm) > 0").count() == len(ODD)


def test_media_that_cannot_be_decoded(spark):
    good = telephony.container(b"x" * 192, "mulaw")
    bad = [None, b"", b"RIFF", b"not a file", good[:22], good[:20] + b"\x63" + good[21:], telephony.container(b"x" * 192, "adpcm", block=4), telephony.container(b"x", "alaw", rate=0)]
    rows = spark.createDataFrame([(0, good), *enumerate(bad, 1)], "doc_id long, media binary")
    got = {r["doc_id"]: r["pcm"] for r in telephony.decode_media(rows).collect()}
    assert len(got[0]) == 4 * 192 and all(got[k] is None for k in range(1, len(bad) + 1))
    empty = spark.createDataFrame([(1, telephony.container(b"", "alaw")), (2, telephony.container(b"x" * 100, "adpcm"))], "doc_id long, media binary")
    assert [r["pcm"] for r in telephony.decode_media(empty).collect()] == [b"", b""]


def test_media_query_by_plain_rules(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in op9_telephony(spark, sf).collect()}
    rows = read_table(spark, sf, "documents").collect()
    assert len(got) == len(rows)
    for r in rows:
        raw = (r["text"] or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        media = telephony.container(payload, "mulaw")
        own = got[r["doc_id"]]
        assert (own["n_bytes"], own["payload_bytes"], own["payload_sha256"], own["tail_crc32"], own["media_bytes"], own["media_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())


def test_media_query_resamples_to_16_khz(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r["feature"] for r in op9_telephony(spark, sf).collect()}
    for r in read_table(spark, sf, "documents").limit(40).collect():
        raw = (r["text"] or "").encode()
        codes = np.frombuffer(raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw)), np.uint8)
        pcm = telephony.resample(telephony.mulaw_table()[codes], 2, 1)
        assert len(pcm) == 2 * len(codes)
        assert f"crc32={zlib.crc32(pcm.astype('<i2').tobytes()):08x};" in got[r["doc_id"]]


def test_sound_is_stored_whole_and_small(spark):
    draw = np.random.default_rng(3)
    codes = draw.integers(0, 256, 960).astype(np.uint8)
    own = telephony.at_rate(telephony.mulaw_table()[codes], 8000, 16000)
    others = [b"", b"\1\2", draw.integers(-32768, 32768, 501).astype("<i2").tobytes(), draw.integers(-32768, 32768, 64).astype("<i2").tobytes(), np.full(9, -32768, "<i2").tobytes()]
    for pcm in (own, own[:-2], own[2:], *others):
        assert telephony.unpack_pcm(telephony.pack_pcm(pcm)) == pcm
    docs = spark.createDataFrame([(k, f"text {k} " * 300) for k in range(5)], "doc_id long, text string")
    for r in telephony.store_texts(docs).collect():
        pcm = telephony.to_pcm(bytes(r["media"]), 16000)
        assert telephony.unpack_pcm(bytes(r["pcm"])) == pcm
        assert len(r["pcm"]) <= len(pcm) // 4 + 5


# -- decontamination ----------------------------------------------------------------------------------------


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=20), st.lists(st.integers(0, 5), max_size=20))
def test_common_length(a, b):
    assert lsi_decontam.common_length(lsi_decontam.Item(1, np.array(a), np.zeros(0, dtype=np.int64)), b) == common(a, b)


def test_planted_passages_are_found(spark):
    docs, bench = read_table(spark, SF, "documents"), read_table(spark, SF, "benchmark")
    items = {r["item_id"]: lsi_decontam.normal_words(r["text"]) for r in bench.collect()}
    words = items[5]
    changed = [w if k % 6 else "changedword" for k, w in enumerate(words)]
    extra = [(900001, " ".join(["filler"] * 30 + words + ["filler"] * 30)), (900002, " ".join(changed)), (900003, None), (900004, ""), (None, " ".join(words))]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    want = set()
    for r in both.collect():
        own = " " + " ".join(lsi_decontam.normal_words(r["text"] or "")) + " "
        want |= {(r["doc_id"], i) for i, w in items.items() if " " + " ".join(w) + " " in own}
    leaks = lsi_decontam.find_leaks(both, bench)
    got = {(r["doc_id"], r["item_id"]) for r in leaks.collect()}
    assert want <= got
    assert got - want <= {(900002, 5)} and (900002, 5) in got
    clean = lsi_decontam.keep_clean(both, leaks)
    assert clean.count() == both.count() - len({k for k, _ in got})
    assert lsi_decontam.find_leaks(both.limit(0), bench).count() == 0
    assert lsi_decontam.find_leaks(odd_rows(spark), bench.limit(0)).count() == 0


def test_a_much_copied_passage_is_found(spark):
    words = [f"word{k}" for k in range(48)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    copy = " ".join(["filler"] * 6 + words + ["filler"] * 6)
    rows = [(k, copy if k % 3 == 0 else " ".join(f"other{k}x{j}" for j in range(120))) for k in range(90)]
    got = lsi_decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {r["doc_id"] for r in got.collect()} == set(range(0, 90, 3))


def test_a_passage_of_common_words_is_found(spark):
    # every word of the item stands in a third of all blocks, next to words that weigh far more
    words = [f"common{k}" for k in range(24)]
    bench = spark.createDataFrame([(1, " ".join(words)), (1, " ".join(words)), (2, "rare0x1 rare1x1 rare2x1 rare3x1")], "item_id long, text string")
    rows = []
    for k in range(300):
        own = [w for j in range(8) for w in (words[(7 * k + 5 * j) % 24], f"rare{k}x{j}", words[(11 * k + 13 * j) % 24])]
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, " ".join([f"rare{j}x1" for j in range(40)] + words + [f"rare{j}x2" for j in range(40)])) for k in range(2)]
    got = lsi_decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).where("item_id = 1").collect()
    assert sorted(r["doc_id"] for r in got) == [1000, 1001]


def test_one_space_for_all_items(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    bench = read_table(spark, SF, "benchmark").select("item_id", "text")
    more = bench.unionByName(spark.createDataFrame([(10_000 + k, f"unrelated{k} words{k} only{k} here{k} and{k} there{k}") for k in range(700)], "item_id long, text string"))
    few = {(r["doc_id"], r["item_id"]) for r in lsi_decontam.find_leaks(docs, bench).collect()}
    many = {(r["doc_id"], r["item_id"]) for r in lsi_decontam.find_leaks(docs, more).collect()}
    assert few and few == many


def test_paraphrases_of_items_that_end_in_common_words():
    text = "Which river crosses the old harbour town? Marlow says the Tamsin. It is so."
    v = lsi_decontam.Vocabulary([text])
    weights = np.ones(v.size)
    weights[[0, *v.numbers(["it", "is", "so", "the"])]] = 0
    item = lsi_decontam.make_queries([(1, text)], v, lsi_decontam.Space(weights, lsi_decontam.Settings()), np.eye(v.size)).items[0]
    other = lambda words: v.numbers(words.split())
    assert lsi_decontam.verify(other("which stream crosses an old town marlow says the tamsin yes"), item, 0, lsi_decontam.Settings())[0]
    assert not lsi_decontam.verify(other("which river crosses the old harbour town it is so"), item, 0, lsi_decontam.Settings())[0]
