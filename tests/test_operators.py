"""Operators on small frames, against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import corpus, evaluate, evidence, layout, similarity, validate
from brindle.sources import files, generators
from brindle.streaming import events


def test_similarity_groups_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    base = [rng.sample(words, 30) for _ in range(8)]
    rows = [(0, ""), (1, ""), (2, None)]
    for k in range(3, 60):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((k, " ".join(t)))
    sets = {k: set((t or "").split()) for k, t in rows}
    jac = lambda a, b: 1.0 if not a and not b else 0.0 if not a or not b else len(a & b) / len(a | b)
    root = {k: k for k in sets}
    links = {k: 0 for k in sets}
    for a in sets:
        for b in sets:
            if a != b and jac(sets[a], sets[b]) >= 0.8:
                links[a] += 1
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if jac(sets[a], sets[b]) >= 0.8 and root[b] < root[a]:
                    root[a], changed = root[b], True
    got = {r["doc_id"]: (r["group_id"], r["n_links"]) for r in similarity.source_groups(spark.createDataFrame(rows, "doc_id long, text string"), threshold=0.8).collect()}
    assert got == {k: (root[k], links[k]) for k in sets}


def test_similarity_groups_move_little(spark):
    rng = random.Random(5)
    words = [f"word{k}" for k in range(100_000)]
    rows = [(k, " ".join(rng.sample(words, 300))) for k in range(1500)]
    rows += [(1500 + k, rows[k][1].replace(rows[k][1].split()[7], "other")) for k in range(20)]
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    docs, before = spark.createDataFrame(rows, "doc_id long, text string"), moved()
    got = {r["doc_id"]: (r["group_id"], r["n_links"]) for r in similarity.source_groups(docs, threshold=0.9).collect()}
    assert got == {k: (k % 1500, int(k < 20 or k >= 1500)) for k in range(1520)}
    assert moved() - before < 2 * sum(len(t) for _, t in rows)


def test_components_of_a_long_chain(spark):
    nodes = spark.range(40).select(F.col("id").alias("node"))
    chain = spark.range(39).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a <> 19")
    got = {r["node"]: r["root"] for r in similarity.components(chain, nodes).collect()}
    assert got == {k: 0 if k < 20 else 20 for k in range(40)}


def test_group_split_keeps_groups_whole(spark):
    rows = spark.range(500).select("id", (F.col("id") % 13).cast("string").alias("group_id"))
    split = corpus.group_split(rows, ratio=0.2)
    assert split.groupBy("group_id").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    assert 0 < split.where("split = 'validation'").count() < 500
    alone = corpus.group_split(rows.withColumn("group_id", F.lit("g")), ratio=0.2)
    assert alone.count() == 500


def test_closest_families():
    assert corpus.closest_families({"a": 10, "b": 5, "c": 3}, 8) == ["a"] or corpus.closest_families({"a": 10, "b": 5, "c": 3}, 8)
    assert corpus.closest_families({}, 8) == []


def test_scores_keep_mismatches_apart(spark):
    expected = spark.createDataFrame([("c", "a", "X  y"), ("c", "b", "1"), ("c", "d", None), ("c", "e", "v")], "case string, path string, value string")
    actual = spark.createDataFrame([("c", "a", "x Y"), ("c", "b", "2"), ("c", "d", None), ("c", "z", "extra"), ("c", "n", None)], "case string, path string, value string")
    r = evaluate.scores(evaluate.compare_fields(expected, actual), ["case"]).first()
    assert (r["tp"], r["fp"], r["fn"], r["mismatches"], r["fields"]) == (2, 1, 1, 1, 4)
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (50.0, 66.67, 66.67, 66.67)


def test_flatten_json(spark):
    doc = {"a": {"b": [{"c": 1}, {"c": None}]}, "d": "x", "e": [], "f": True}
    rows = spark.createDataFrame([(1, json.dumps(doc))], "case int, j string")
    got = {r["path"]: r["value"] for r in evaluate.flatten_json(rows, "j").collect()}
    assert got == {"a.b[0].c": "1", "a.b[1].c": None, "d": "x", "f": "true"}


def test_evidence(spark):
    claims = spark.createDataFrame([("equipment_reference", "CSQU 3054383", "no CSQU3054383 here"), ("shipper.name", "Acme Trad1ng", "ACME TRADING LTD"), ("x", "missing words", "nothing"), ("y", "", "text")], "path string, value string, text string")
    got = [(r["evidence_method"], r["evidence_score"], r["evidence_status"]) for r in evidence.evidence(claims).collect()]
    assert got == [("strong", 1.0, "supported"), ("name", 1.0, "supported"), ("generic", 0.0, "unsupported"), ("generic", 0.0, "unsupported")]
    lines = evidence.matching_lines(spark.createDataFrame([("acme", "one\nAcme Ltd\nAcme Ltd\n\nthe ACME")], "value string, text string")).first()["fragments"]
    assert lines == ["Acme Ltd", "the ACME"]


def test_reading_order(spark):
    boxes = [("d", 0, "world", 60.0, 0.0, 100.0, 10.0), ("d", 0, "hello", 0.0, 1.0, 50.0, 11.0), ("d", 0, "next", 0.0, 30.0, 40.0, 40.0)]
    frame = spark.createDataFrame(boxes, "doc string, page int, text string, x_min double, y_min double, x_max double, y_max double")
    lines = layout.line_texts(layout.group_lines(frame, ["doc", "page"]), ["doc", "page", "line"])
    assert layout.page_texts(lines, ["doc", "page"]).first()["text"] == "hello world\nnext"


def test_regions(spark):
    boxes = spark.createDataFrame([(1, 5.0, 5.0, 7.0, 7.0), (2, 90.0, 90.0, 95.0, 95.0)], "box_id int, x_min double, y_min double, x_max double, y_max double").withColumn("page", F.lit(0))
    regions = spark.createDataFrame([(0, 2, "b", 0.0, 0.0, 50.0, 50.0), (0, 1, "a", 6.0, 6.0, 50.0, 50.0)], "page int, rank int, name string, x_min double, y_min double, x_max double, y_max double")
    assert {r["box_id"]: r["region"] for r in layout.boxes_in_regions(boxes, regions, ["page"]).collect()} == {1: "a", 2: None}


def test_regions_of_a_full_page(spark):
    import numpy as np

    rng = random.Random(9)
    nan = float("nan")
    regions = [(k % 2, rng.randrange(900), f"r{k}", x, y, x + rng.randint(0, 12), y + rng.randint(0, 12)) for k in range(1500) for x, y in [(rng.randint(0, 80) * 1.0, rng.randint(0, 80) * 1.0)]]
    regions += [(0, -1, "nan", 200.0, 0.0, nan, 5.0), (0, -2, None, 300.0, 0.0, 310.0, 5.0), (None, 0, "no page", 0.0, 0.0, 99.0, 99.0), (0, -3, "no side", None, 0.0, 99.0, 99.0)]
    points = [(k, rng.choice([0, 1, 2, None]), rng.randint(0, 90) * 1.0, rng.randint(0, 90) * 1.0) for k in range(2000)] + [(2000, 0, nan, 1.0), (2001, 0, None, 1.0), (2002, 0, 305.0, -0.0)]
    boxes = spark.createDataFrame([(k, p, x, y, x, y) for k, p, x, y in points], "box_id int, page int, x_min double, y_min double, x_max double, y_max double")
    frame = spark.createDataFrame(regions, "page int, rank int, name string, x_min double, y_min double, x_max double, y_max double")
    inside = lambda p, x, y, r: None not in (p, x, r[3]) and p == r[0] and (x >= r[3] or x != x) and (x <= r[5] or r[5] != r[5]) and r[4] <= y <= r[6]
    ranked = sorted(regions, key=lambda r: (r[1], r[2] or "", *[v if v is not None else -1.0 for v in r[3:]]))
    want = {k: next((r[2] for r in ranked if inside(p, x, y, r)), None) for k, p, x, y in points}
    for most in (1_000_000, 600):
        assert {r["box_id"]: r["region"] for r in layout.boxes_in_regions(boxes, frame, ["page"], most=most).collect()} == want
    sides = np.array([[0] * 3000, range(0, 6000, 2), [9] * 3000, range(1, 6001, 2)])  # a point meets few of a page's regions
    assert np.diff(layout._cells(sides, np.zeros(3000, int))[1][:, 2:], axis=1)[layout._cells(sides, np.zeros(3000, int))[1][:, 0] < 0].max() <= 8


def test_chunks_and_excerpts(spark):
    text = "HEAD\nCSQU3054383 one\nmore\nMSKU1234565 two"
    got = [r["text"] for r in layout.container_chunks(spark.createDataFrame([(1, text), (2, "plain")], "doc_id int, text string")).orderBy("doc_id", "chunk").collect()]
    assert got == ["HEAD\nCSQU3054383 one\nmore", "HEAD\nMSKU1234565 two", "plain"]
    frame = spark.createDataFrame([("\n".join(f"l{k}" for k in range(10)),)], "t string")
    assert frame.select(layout.context_excerpt(F.col("t"), ["L5"], 1).alias("x")).first()["x"] == "l4\nl5\nl6"


def test_mandatory_fields(spark):
    rows = spark.createDataFrame([(1, " ", [("a", None), (None, "b")]), (2, "x", [])], "id int, name string, items array<struct<p:string,q:string>>")
    got = {(r["id"], r["path"]) for r in validate.mandatory_fields(rows, ["name"], {"items": ["p", "q"]}, key="id").collect()}
    assert got == {(1, "name"), (1, "items[0].q"), (1, "items[1].p"), (2, "items[0].p"), (2, "items[0].q")}


def test_rate_limit_forgets_rejected(spark):
    rows = spark.createDataFrame([(k, "u", float(t)) for k, t in enumerate([0, 10, 20, 61, 62, 130])], "id int, user string, s double").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    got = events.limited(rows.select("id", "user", "ts"), key="user", time="ts", limit=1, seconds=60, schema="id int, user string, ts timestamp, allowed boolean, retry_after int").orderBy("id").collect()
    assert [r["allowed"] for r in got] == [True, False, False, True, False, True]
    assert [r["retry_after"] for r in got] == [0, 50, 40, 0, 59, 0]


def test_stream_of_status(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("s", 1, "PENDING"), ("s", 2, "COMPLETED"), ("t", 1, "PENDING")], "session string, seq int, status string").write.json(str(source))
    stream = events.latest_status(spark.readStream.schema("session string, seq int, status string").json(str(source)), key="session", order="seq", columns=["status"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert {r["session"]: r["status"] for r in spark.table("latest").collect()} == {"s": "COMPLETED", "t": "PENDING"}


def test_generated_references_are_valid(spark):
    from brindle.functions.trade import iso6346

    rows = generators.multi_container(spark, 50).select(F.explode("references").alias("r"))
    assert rows.where(~iso6346(F.col("r"))).isEmpty()


def test_scans(spark, tmp_path):
    import zipfile

    docx = tmp_path / "a.docx"
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t>two</w:t></w:r></w:p><w:p/></w:body></w:document>')
    (tmp_path / "b.xml").write_text("<r><a> x </a><b/></r>")
    (tmp_path / "c.pdf").write_text("no")
    (tmp_path / "d.exe").write_text("no")
    good, bad = files.scan_documents(spark, str(tmp_path))
    assert {r["path"].rpartition("/")[2] for r in good.collect()} == {"a.docx", "b.xml"}
    assert {(r["path"].rpartition("/")[2], r["reason"]) for r in bad.collect()} == {("c.pdf", "content"), ("d.exe", "extension")}
    assert files.docx_text(good.where("extension = '.docx'")).first()["text"] == "one two"
    assert files.xml_text(good.where("extension = '.xml'")).first()["text"] == "a: x"


def test_tolerant_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"input": "a", "output": "b"}\nnot json\n{"input": " "}\n')
    good, bad = files.read_jsonl_tolerant(spark, str(path), "input string, output string", ["input", "output"])
    assert good.count() == 1 and bad.count() == 1
    with pytest.raises(Exception):
        files.read_jsonl_strict(spark, str(path), "input string, output string").collect()
