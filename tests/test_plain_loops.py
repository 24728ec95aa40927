"""Queries that SQL can't express, against plain loops over the same rows."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.operators import corpus
from brindle.plans import catalog
from brindle.plans.queries import table
from brindle.sources import generators

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(*values):
    """Spark's xxhash64: the hash of each value seeds the next. Integers have 4 or 8 bytes: ("i", n) or ("l", n)."""
    from xxhash import xxh64_intdigest

    h = 42
    for kind, v in values:
        raw = v.encode() if kind == "s" else int(v).to_bytes({"i": 4, "l": 8}[kind], "little", signed=True)
        h = xxh64_intdigest(raw, h)
    return signed(h)


def test_noise(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").select("doc_id", "text").limit(40).collect()}
    got = {r["doc_id"]: r["noisy"] for r in catalog.QUERIES["noise_variants"](spark, SF).collect()}
    kind = dict(table(spark, SF, "documents").dtypes)["doc_id"]
    key = lambda k: ("l" if kind == "bigint" else "i", k)
    for k, text in docs.items():
        if text is None:
            assert got[k] is None
            continue
        out = text
        for turn in range(4):
            old, new = corpus.CONFUSED[spark_hash(key(k), ("i", 42), ("i", turn)) % len(corpus.CONFUSED)]
            if spark_hash(key(k), ("i", 42), ("s", "turns")) % 4 >= turn:
                out = out.replace(old, new)
        noisy = ""
        for j, c in enumerate(out):
            dice = spark_hash(key(k), ("i", j), ("i", 42)) % 1000
            noisy += "" if dice < 1 else c.translate(str.maketrans("O0I1S5B8", "0O1l5S8B")) if dice < 5 else c
        assert got[k] == noisy


def test_limits(spark):
    rows = sorted((r["user_id"], r["ts"], r["event_id"]) for r in table(spark, SF, "events").collect())
    got = {r["event_id"]: (r["allowed"], r["retry_after"]) for r in catalog.QUERIES["rate_limited_events"](spark, SF).collect()}
    moments = defaultdict(set)
    for user, ts, _ in rows:
        moments[user].add(ts)
    assert sum(map(len, moments.values())) == len(rows)  # no ties, so the order is one
    kept = defaultdict(list)
    for user, ts, event in rows:
        t = ts.timestamp()
        kept[user] = [x for x in kept[user] if t - x < 3600]
        ok = len(kept[user]) < 3
        want = (True, 0) if ok else (False, max(1, int(3600 - (t - kept[user][0]))))
        if ok:
            kept[user].append(t)
        assert got[event][0] == want[0] and abs(got[event][1] - want[1]) <= 1
    assert len(got) == len(rows)


def test_lines_of_boxes(spark):
    pages = defaultdict(list)
    for r in table(spark, SF, "lineitem").collect():
        x, y, text = r["l_linenumber"] * 100.0, float(int(r["l_quantity"]) // 10 * 30) + float(r["l_discount"]) * 10, f"P{r['l_partkey']}"
        pages[r["l_orderkey"]].append((y + 10.0, x, x + 8.0 * len(text), text))
    got = {r["doc"]: r["text"] for r in catalog.QUERIES["layout_lines"](spark, SF).collect()}
    assert got.keys() == pages.keys()
    for doc, boxes in pages.items():
        lines, anchor = [], None
        for box in sorted(boxes):
            if anchor is None or abs(box[0] - anchor) > 15:
                lines.append([])
                anchor = box[0]
            lines[-1].append(box[1:])
        texts = []
        for line in lines:
            line.sort()
            text = line[0][2]
            for (a0, a1, t), (b0, _, u) in zip(line, line[1:]):
                text += " " * max(1, int((b0 - a1) / max((a1 - a0) / max(len(t), 1), 1.0) * 0.15)) + u
            texts.append(text)
        assert got[doc] == "\n".join(texts)


def test_evidence(spark):
    def words(t):
        return set(re.findall(r"\w+", t.lower().replace("ß", "ss")))

    def fold(w):
        return re.sub(r"[\W_]", "", w).translate(str.maketrans("0158", "oisb"))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    turns = defaultdict(dict)
    for r in table(spark, SF, "conversations").collect():
        turns[r["conv_id"]][r["turn"]] = r["text"]
    got = {r["conv_id"]: (r["evidence_score"], r["evidence_status"]) for r in catalog.QUERIES["evidence_scores"](spark, SF).collect()}
    want = {}
    for conv, said in turns.items():
        own, there = words(said[0]), words("\n".join(t for k, t in sorted(said.items()) if k))
        folded = {fold(t) for t in there}

        def close(w):
            f = fold(w)
            return any(abs(len(t) - len(f)) <= 0.2 * max(len(t), len(w)) + 1 and 1 - distance(f, t) / max(len(f), len(t), 1) >= 0.8 for t in folded)

        score = sum(w in there or close(w) for w in own) / len(own) if own else 0.0
        want[conv] = (pytest.approx(score), "supported" if score >= 0.8 else "uncertain" if score >= 0.5 else "unsupported")
    assert got == {k: v for k, v in want.items() if len(turns[k]) > 1}


def test_best_sequences(spark):
    from difflib import SequenceMatcher

    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").limit(12).collect()]
    docs = [(k, t[n : n + 300]) for n in (0, 150) for k, t in ((r["doc_id"], r["text"] or "") for r in table(spark, SF, "documents").limit(60).collect())] + [(1000 + i, t[5:]) for i, t in items[:4]] + [(900, items[0][1][5:])]
    from brindle.operators import similarity

    got = {r["item_id"]: (r["doc_id"], pytest.approx(r["ratio"])) for r in similarity.best_sequence(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), least=0.2, block_chars=2000).collect()}
    want = {}
    for i, t in items:
        ratio, key = max((SequenceMatcher(None, t, d).ratio(), -k) for k, d in docs)
        if ratio > 0.2:
            want[i] = (-key, ratio)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(want[k][1] == v[1] for k, v in got.items())


def test_ratio_with_one_index_of_the_second_text():
    import random
    from difflib import SequenceMatcher

    from brindle.operators.similarity import _Seeded

    draw = random.Random(1)
    word = lambda n: "".join(draw.choice("aaabcdeé ") for _ in range(n))
    for n in (0, 1, 40, 199, 200, 201, 900):
        second = word(n)
        seeded = _Seeded(second)
        for first in ("", "a", second, second[5:], word(60), word(20) + second[:150] + word(20)):
            want = SequenceMatcher(None, first, second).ratio()
            assert seeded.ratio(first, 0.0) == seeded.ratio(first, want) == want
            assert seeded.ratio(first, min(want + 0.2, 1.1)) in (want, -1.0)
        assert seeded.ratio("z" * (n + 1), 0.1) == -1.0


def test_best_sequence_of_equal_texts_in_many_parts(spark):
    from brindle.operators import similarity

    item = "The quick brown fox jumps over the lazy dog, again and again."
    docs = spark.createDataFrame([(k, item if k % 3 == 0 else item[k % 20 :] + str(k)) for k in range(40, 100)] + [(None, item), (1, None), (2, "")], "doc_id long, text string").repartition(7)
    asked = spark.createDataFrame([(1, item), (2, "zzzz" * 9), (3, item[:30])], "item_id long, text string")
    got = {r["item_id"]: (r["doc_id"], r["ratio"]) for r in similarity.best_sequence(asked, docs, least=0.3).collect()}
    assert got[1] == (42, 1.0) and 2 not in got


def test_synthetic_rows(spark):
    def digit(body):
        values, v = {}, 10
        for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
            v += v % 11 == 0
            values[c] = v
            v += 1
        return sum((values[c] if c.isalpha() else int(c)) * 2**k for k, c in enumerate(body)) % 11 % 10

    for rows, shares in ((generators.multi_container(spark, 600), generators.MULTI), (generators.turkish(spark, 600), generators.TURKISH)):
        got = rows.collect()
        assert rows.repartition(7).exceptAll(rows).isEmpty()
        for r in got:
            assert len(r["references"]) == r["n_containers"]
            assert all(re.fullmatch("[A-Z]{3}U[0-9]{7}", c) and digit(c[:10]) == int(c[10]) and c in r["text"] for c in r["references"])
        for share, low, high in shares:
            assert abs(sum(low <= r["n_containers"] <= high for r in got) / 6 - share) < 7
    assert catalog.QUERIES["synthetic_instructions"](spark, SF).count() == 2000


def test_deep_json(spark):
    from brindle.operators import evaluate

    deep = "7"
    for k in range(20):
        deep = f'{{"a": {deep}}}' if k % 2 else f"[{deep}, {{}}]"
    rows = spark.createDataFrame([(1, deep), (2, '"] } [ {"'), (3, None), (4, "broken ["), (5, '{"x": "a \\\\" ] b"}')], "case int, j string")
    got = {(r["case"], r["path"], r["value"]) for r in evaluate.flatten_json(rows, "j").collect()}
    assert sum(c == 1 for c, *_ in got) == 1
    path = next(p for c, p, _ in got if c == 1)
    assert path.count("a") == 10 and path.count("[0]") == 10
    assert (2, "", "] } [ {") in got and not any(c in (3, 4) for c, *_ in got)


def test_short_items_are_contained(spark):
    from brindle.operators import similarity

    docs = spark.createDataFrame([(1, "The one, two three"), (1, "other"), (2, None), (None, "x two y"), (4, "twofold")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "Two"), (11, "one two"), (12, ""), (13, None), (14, "one two three four five six")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in similarity.containing(docs, items).collect()}
    assert got == {(1, 10), (None, 10), (1, 11)}
    assert similarity.containing(docs, items.limit(0)).count() == 0


def test_whole_texts_are_redacted(spark):
    from brindle.functions import text as tx

    text = "x" * 6000 + " api_key=abc123, token: 'tt' Authorization: Bearer aa.bb?\nsecret\t=\"s s\" ?token=q&x=1 end"
    got = spark.createDataFrame([(text,)], "t string").select(tx.redact_secrets(F.col("t")).alias("a"), F.length(tx.redact_secrets(F.col("t"), 4000)).alias("n")).first()
    assert got["a"][6000:] == " api_key=[REDACTED], token: '[REDACTED]' Authorization: Bearer [REDACTED] secret\t=\"[REDACTED] s\" ?token=[REDACTED]&x=1 end"
    assert got["n"] == 4000


def test_replay_widens_its_bound(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, F.lit("hot")).when(F.col("id") < 4990, F.lit("mid")).otherwise(F.lit(None).cast("string")).alias("source"))
    got = corpus.replay_sample(rows, new_rows=700).groupBy("source").count().collect()
    import hashlib

    order = lambda k: hashlib.sha256(f"{k}|42".encode()).hexdigest()
    counts = {r["source"]: r["count"] for r in got}
    assert sum(counts.values()) == 300 and counts[None] == 10
    families = {"hot": sorted(range(4000), key=order), "mid": sorted(range(4000, 4990), key=order)}
    rest = sorted((order(k), f) for f, ks in families.items() for k in ks[100:])
    top = [f for _, f in rest[: 300 - 210]]
    assert counts["hot"] == 100 + top.count("hot") and counts["mid"] == 100 + top.count("mid")


def test_replay_of_null_keys_and_repeated_rows(spark):
    rows = spark.createDataFrame([(None, "a", 1), (1, "a", 1), (1, "a", 2), (2, None, 1), (3, None, 1)], "doc_id long, source string, x int")
    got = corpus.replay_sample(rows, new_rows=12)
    assert got.columns == rows.columns and got.count() == 5 and got.exceptAll(rows).isEmpty()
    assert corpus.replay_sample(rows, new_rows=2).count() == 1
    assert corpus.replay_sample(rows.limit(0), new_rows=10).count() == 0


def test_xml_against_a_schema(spark, tmp_path):
    from brindle.operators import validate

    (tmp_path / "p.xsd").write_text('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="p"><xs:complexType><xs:sequence><xs:element name="n" type="xs:integer"/></xs:sequence></xs:complexType></xs:element></xs:schema>')
    (tmp_path / "a.xml").write_text("<r><p><n>1</n></p><p><n>x</n></p><p><m>2</m></p></r>")
    good, bad = validate.read_valid_xml(spark, str(tmp_path / "a.xml"), "p", "n string", str(tmp_path / "p.xsd"))
    assert [r["n"] for r in good.collect()] == ["1"] and bad.cache().count() == 2
