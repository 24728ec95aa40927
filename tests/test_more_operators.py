"""Corpus, validation and stream operators that the queries don't reach."""

import pytest
from pyspark.sql import functions as F

from brindle.operators import corpus, similarity, validate
from brindle.sources import files
from brindle.streaming import events


def test_tagged_union_and_differences(spark):
    a, b = spark.range(3).withColumn("x", F.lit("a")), spark.range(2, 5)
    both = corpus.tagged_union({"one": a, "two": b})
    assert both.count() == 6 and both.where("_source = 'two' AND x IS NULL").count() == 3
    assert {r["id"] for r in corpus.missing_values(a, b, "id").collect()} == {0, 1}
    assert {r["id"] for r in corpus.shared_values(a, b, "id").collect()} == {2}


def test_fail_closed(spark):
    rows = spark.range(5).withColumnRenamed("id", "doc_id")
    assert similarity.fail_if_any(rows, rows.where("doc_id > 9")).count() == 5
    with pytest.raises(ValueError, match="3"):
        similarity.fail_if_any(rows, rows.where("doc_id = 3"))


def test_noise_is_repeatable_and_bounded(spark):
    rows = spark.createDataFrame([(k, "SOB 105 text " * 20) for k in range(20)], "id int, t string")
    noisy = rows.select("id", "t", corpus.character_noise(F.col("t"), F.col("id"), "heavy").alias("a"), corpus.character_noise(F.col("t"), F.col("id"), "heavy").alias("b"), corpus.substitution_noise(F.col("t"), F.col("id")).alias("s"))
    for r in noisy.collect():
        assert r["a"] == r["b"] and 0.9 * len(r["t"]) <= len(r["a"]) <= len(r["t"])
    assert noisy.where("s <> t").count() > 0


def test_references_are_swapped_as_words(spark):
    row = spark.createDataFrame([("BK1 BK12 (BK1)", "BK1", "X$1")], "t string, o string, n string")
    assert row.select(corpus.swap_reference(F.col("t"), F.col("o"), F.lit("NEW")).alias("x")).first()["x"] == "NEW BK12 (NEW)"
    assert row.select(corpus.swap_reference(F.col("t"), F.lit(None).cast("string"), F.col("n")).alias("x")).first()["x"] == "BK1 BK12 (BK1)"


def test_running_sum_by_range(spark):
    df = spark.range(200).select((199 - F.col("id")).alias("k"), F.lit(2).alias("v"))
    got = {r["k"]: r["s"] for r in corpus.running_sum_by_range(df, "k", "v", "s").collect()}
    assert got == {k: 2 * (k + 1) for k in range(200)}


def test_collection_has_a_budget(spark):
    rows = spark.createDataFrame([(k, f"q{k % 2}", f"u{k // 2 % 5}") for k in range(30)], "n int, q string, u string")
    got = corpus.collect_candidates(rows, query="q", url="u", order="n", most=4).collect()
    assert len(got) <= 4 and len({r["u"] for r in got}) == len(got)


def test_batches_are_admitted_whole(spark):
    rows = spark.createDataFrame([("a.PDF", 5), ("b.exe", 5), ("c.xml", 0), ("d.png", 1 << 30)], "name string, size long")
    assert [r["reason"] for r in validate.admit_batch(rows).collect()] == [None, "extension", "empty", "size"]
    with pytest.raises(ValueError):
        validate.admit_batch(rows.limit(0))


@pytest.mark.parametrize("mode, risk, key, wanted", [("off", 99, True, False), ("always", 0, True, True), ("risk", 30, True, True), ("risk", 29, True, False), ("always", 99, False, False), (None, 99, True, False)])
def test_review(spark, mode, risk, key, wanted):
    row = spark.range(1).select(validate.needs_review(F.lit(mode), F.lit(risk), F.lit(key)).alias("x"))
    assert row.first()["x"] is wanted


def test_total_mismatch(spark):
    parts = F.array(F.lit(10.0), F.lit(20.0))
    rows = spark.range(1).select(validate.findings(validate.total_finding(parts, F.lit(30.5), "a"), validate.total_finding(parts, F.lit(40.0), "b")).alias("f"))
    assert [f["path"] for f in rows.first()["f"]] == ["b"]


def test_required_fields_fail(spark):
    rows = spark.createDataFrame([("a",), (" ",)], "x string")
    with pytest.raises(Exception, match="lacks x"):
        files.require_fields(rows, ["x"]).collect()


def test_manifest_and_known_hashes(spark, tmp_path):
    rows = spark.createDataFrame([("train",), ("train",), ("validation",)], "split string")
    one = files.manifest(rows, "split").first()
    assert one["counts"] == {"train": 2, "validation": 1} and one["rows"] == 3
    (tmp_path / "m.jsonl").write_text('{"sha256": "a", "status": "accepted"}\n{"sha256": "b", "status": "rejected"}\nbroken\n{"sha256": "a", "status": "pending_review"}\n')
    assert [r["sha256"] for r in files.known_hashes(spark, str(tmp_path / "m.jsonl")).collect()] == ["a"]


def test_tail_and_resume(spark):
    log = spark.range(10)
    assert [r["id"] for r in events.tail(log, 3).collect()] == [7, 8, 9]
    assert events.resumed(log, 6).count() == 3


def test_limited_stream(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.createDataFrame([("u", t) for t in (1000, 1010, 1061, 1070)], "user string, s int").select("user", F.timestamp_seconds("s").alias("ts"))
    rows.coalesce(1).write.parquet(str(source))
    stream = events.limited_stream(spark.readStream.schema(rows.schema).parquet(str(source)), key="user", time="ts", limit=1, seconds=60)
    q = stream.writeStream.outputMode("append").format("memory").queryName("limits").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert [r["allowed"] for r in spark.table("limits").orderBy("ts").collect()] == [True, False, True, False]


def test_windowed_stream(spark, tmp_path):
    source = tmp_path / "in"
    rows = spark.createDataFrame([("a", 0), ("a", 10), ("b", 4000)], "kind string, s int").select("kind", F.timestamp_seconds("s").alias("ts"))
    rows.coalesce(1).write.parquet(str(source))
    stream = events.windowed_counts(events.deduplicated(spark.readStream.schema(rows.schema).parquet(str(source)), id="ts", time="ts"), time="ts", by=["kind"], delay=None)
    q = stream.writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.table("windows").columns == ["window_start", "kind", "n"]
