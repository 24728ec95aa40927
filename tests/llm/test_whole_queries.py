"""The queries and the pipeline over whole tables, against brute force with plain rules."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import langid_segments, license_minhash, lsi_decontam, queries, toxicity_kn
from brindle.llm.common import read_table
from brindle.llm.tokens import vocabulary_path

SF = "/root/testdata/sf0.001"


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def library(name):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path(name))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_token_shards(spark):
    encode, at, want = library("byte_bpe_50k.json"), 0, []
    for r in read_table(spark, SF, "documents").orderBy("doc_id").collect():
        ids = [*encode(r["text"]), 0]
        want.append((r["doc_id"], at, len(ids), crc(ids)))
        at += len(ids)
    got = queries.op2_token_shards(spark, SF).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def plain_pieces(rows):
    encode, out = library("word_bpe_49k.json"), []
    for key, text in rows:
        ids = [*encode(text), 1]
        out += [(key, n, 4096 * n, len(ids[4096 * n : 4096 * n + 4096]), crc(ids[4096 * n : 4096 * n + 4096])) for n in range(-(-len(ids) // 4096))]
    return sorted(out)


def check_packing(rows, got):
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == plain_pieces(rows)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    least = -(-sum(r["length"] for r in got) // 4096)
    assert least <= len(by) <= least + 1 + least // 50


def test_packing(spark):
    rows = [(r["doc_id"], r["text"]) for r in read_table(spark, SF, "documents").collect()]
    check_packing(rows, queries.op10_best_two_fit(spark, SF).collect())


def brute_leaks(rows, bench):
    """(key, item) for every text that holds an item: the comparison at every word of every text."""
    s, v = lsi_decontam.Settings(), lsi_decontam.Vocabulary([t for _, t in bench])
    texts = {k: v.numbers(lsi_decontam.normal_words(t or "")) for k, t in rows}
    blocks = [x[a : a + s.block] for x in texts.values() for a in range(0, len(x), s.block)]
    frequency = np.zeros(v.size)
    for b in blocks:
        frequency[np.unique(b[b > 0])] += 1
    frequency[0] = len(blocks)
    weights = lsi_decontam.term_weights(frequency, [v.numbers(lsi_decontam.normal_words(t)) for _, t in bench], s)
    found = {}
    for item, text in bench:
        numbers = v.numbers(lsi_decontam.normal_words(text))
        numbers = numbers[numbers > 0]
        if not len(numbers):
            continue
        one = lsi_decontam.Item(item, numbers, lsi_decontam.answer_terms(text, v, weights))
        for key, own in texts.items():
            if np.isin(own, numbers).sum() < s.paraphrase * len(numbers):
                continue
            shares = [share for begin in range(len(own)) for holds, share in [lsi_decontam.verify(own, one, begin, s)] if holds]
            if shares:
                found[key, item] = max(shares)
    return found


def test_decontamination(spark):
    rows = [(r["doc_id"], r["text"]) for r in read_table(spark, SF, "documents").collect()]
    bench = [(r["item_id"], r["text"]) for r in read_table(spark, SF, "benchmark").collect()]
    words = bench[0][1].split()
    changed = [(90_001, " ".join(w for k, w in enumerate(words) if k % 7)), (90_002, " ".join(["stop"] * 50 + [w if k % 5 else "else" for k, w in enumerate(bench[1][1].split())]))]
    changed += [(90_010 + n, " ".join(["stop"] * n + [w for k, w in enumerate(t.split()) if k % (5 + n)])) for n, (_, t) in enumerate(bench[2:8])]
    docs = spark.createDataFrame(rows + changed + [(90_003, "same text twice")] * 2, "doc_id long, text string")
    table = read_table(spark, SF, "benchmark")
    got = {(r["doc_id"], r["item_id"]): r["lcs_share"] for r in lsi_decontam.find_leaks(docs, table).collect()}
    want = brute_leaks(rows + changed, bench)
    assert got.keys() <= want.keys() and len(want) > 5
    assert {k for k, share in want.items() if share >= 0.8} <= got.keys()
    assert len(got) >= 0.95 * len(want)
    assert {(r["doc_id"], r["item_id"]) for r in queries.op3_lsi_decontam(spark, SF).collect()} <= want.keys()


def test_decontamination_with_names_that_clash(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta", "x")] * 2, "item_id long, text string, terms string")
    rows = [(k, t, "a", "b", "c") for k, t in [(1, "alpha beta gamma delta epsilon zeta eta theta"), (1, "other words"), (None, "so alpha beta gamma delta epsilon zeta eta theta"), (3, None)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __k string, __d string, digest string")
    leaks = lsi_decontam.find_leaks(docs, bench)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["lcs_share"]) for r in leaks.collect()) == [(False, 1, 1.0), (True, 0, 1.0)]
    for most in (500_000, 0):
        kept = lsi_decontam.keep_clean(docs, leaks, broadcast_rows=most)
        assert kept.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, "other words"), (3, None)]


def test_licenses_of_equal_templates(spark):
    notices = [("B", "one two three four five six seven"), ("A", "one two three four five six seven"), ("A", "three four five six seven eight nine")]
    docs = spark.createDataFrame([(1, "x one two three four five six seven y"), (1, "x one two three four five six seven y"), (2, "three four five six seven eight nine")], "doc_id long, text string")
    got = sorted(tuple(r) for r in license_minhash.scan(docs, notices).collect())
    assert got == [(1, "A", 1.0, 3), (1, "B", 1.0, 3), (2, "A", 1.0, 3)]


def test_kneser_ney_by_its_formula():
    """Log-ratios of words from counters of byte strings, order by order."""
    ordinary, toxic = Counter({"abra": 3, "cad": 2, "é": 1}), Counter({"abba": 2, "cad": 1, "dab": 4})
    models = toxicity_kn.fit_models(ordinary, toxic)
    order, mark = toxicity_kn.ORDER, toxicity_kn.BOUNDARY

    def grams(word):
        raw = bytes([mark]) * (order - 1) + word.encode() + bytes([mark])
        return [raw[k : k + order] for k in range(len(raw) - order + 1)]

    top = [Counter(), Counter()]
    for c, words in zip(top, (ordinary, toxic), strict=True):
        for w, n in words.items():
            for g in grams(w):
                c[g] += n
    kinds, lower = set(top[0]) | set(top[1]), {}
    for n in range(order - 1, 0, -1):
        lower[n] = Counter(g[1:] for g in kinds)
        kinds = set(lower[n])

    def step(counts, gram, below):
        same = {g: c for g, c in counts.items() if g[:-1] == gram[:-1]}
        if not same:
            return below
        total = sum(same.values())
        return max(same.get(gram, 0) - toxicity_kn.DISCOUNT, 0) / total + toxicity_kn.DISCOUNT * len(same) / total * below

    def probability(gram, c):
        p = 1 / 256
        for n in range(1, order):
            p = step(lower[n], gram[-n:], p)
        return step(top[c], gram, p)

    for w in ["abra", "abba", "cad", "zé", "dabra"]:
        want = sum(math.log(probability(g, 1)) - math.log(probability(g, 0)) for g in grams(w))
        assert models.log_ratio([w])[0].tolist() == pytest.approx([want, len(w.encode()) + 1])


def fingerprint(text):
    import re

    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark):
    rows = [(r["doc_id"], fingerprint(r["text"])) for r in read_table(spark, SF, "documents").collect()]
    root = {k: k for k, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, x in rows:
            for b, y in rows:
                if (x ^ y).bit_count() <= 2 and root[b] < root[a]:
                    root[a], changed = root[b], True
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash_ball(spark, SF).collect()}
    assert got == {k: (f"{f:016x}", root[k]) for k, f in rows}


def test_pipeline_by_brute_force(spark):
    """run() keeps what plain rules keep; the models' scores come from their own, separately tested, operators."""
    docs = read_table(spark, SF, "documents").orderBy("doc_id")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    models = toxicity_kn.fit(docs, read_table(spark, SF, "labels"), learn=F.lit(True))
    kept = {r["doc_id"] for r in toxicity_kn.score(docs, models).collect() if r["score"] < 0.5}
    left = docs.where(F.col("doc_id").isin(sorted(kept)))
    model = langid_segments.fit(left, vocabulary_path("piece_bpe_32k.model"), learn=F.lit(True))
    kept = {r["doc_id"] for r in langid_segments.predict(left, model).collect() if r["lang_pred"] != "und"}
    prints = sorted((k, fingerprint(texts[k])) for k in kept)
    first = []
    groups = []
    for k, f in prints:
        near = [g for g in groups if any((f ^ x).bit_count() <= 2 for x in g)]
        for g in near[1:]:
            near[0] |= g
            groups.remove(g)
        if near:
            near[0].add(f)
        else:
            groups.append({f})
    for g in groups:
        first.append(min(k for k, f in prints if f in g))
    bench = [(r["item_id"], r["text"]) for r in read_table(spark, SF, "benchmark").collect()]
    rows = [(k, texts[k]) for k in sorted(first)]
    bad = {k for (k, _), share in brute_leaks(rows, bench).items()}
    got = corpus_pipeline.run(spark, SF).collect()
    check_packing([(k, t) for k, t in rows if k not in bad], got)
