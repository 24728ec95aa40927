"""Records as JSON, their hashes, packages and archives."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(value) -> str:
    """Keys in order, no spaces, characters as they are."""
    import json

    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def pruned(value):
    """Objects and lists without nulls, empty texts, empty lists and objects, and (in objects) false; at any depth."""
    empty = lambda x: x is None or x == "" or x == [] or x == {}
    if isinstance(value, dict):
        each = {k: pruned(v) for k, v in value.items()}
        return {k: v for k, v in each.items() if not empty(v) and v is not False}
    if isinstance(value, list):
        return [v for v in map(pruned, value) if not empty(v)]
    return value


def _json_batches(task: str):
    """Arrow batches of JSON texts through one of the rules above: SQL has no order of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            at = batch.schema.get_field_index("__json")
            out = []
            for text in batch.column(at).to_pylist():
                try:
                    value = json.loads(text) if text is not None else None
                except ValueError:
                    value = None
                if task == "object":
                    value = value if isinstance(value, dict) else {}
                elif task == "prune":
                    value = pruned(value)
                out.append(None if value is None and text != "null" else canonical(value))
            yield pa.RecordBatch.from_arrays([*[c for k, c in enumerate(batch.columns) if k != at], pa.array(out, type=pa.string())], names=[*[n for n in batch.schema.names if n != "__json"], "__json"])

    return run


def _mapped(rows: DataFrame, json: str, out: str, task: str) -> DataFrame:
    given = rows.withColumn("__json", F.col(json).cast("string"))
    return given.mapInArrow(_json_batches(task), given.schema).withColumnRenamed("__json", out)


def canonical_json(rows: DataFrame, json: str, *, out: str = "canonical") -> DataFrame:
    """P56 beside each row; null where the text is no JSON."""
    return _mapped(rows, json, out, "canonical")


def json_hash(rows: DataFrame, json: str, *, out: str = "sha256") -> DataFrame:
    """SHA-256 of the canonical text beside each row."""
    return canonical_json(rows, json, out="__c").withColumn(out, F.sha2("__c", 256)).drop("__c")


def object_of(rows: DataFrame, json: str, *, out: str = "object") -> DataFrame:
    """P55 beside each row: the object in canonical form; `{}` where the text is none."""
    return _mapped(rows, json, out, "object")


def prune_empty(rows: DataFrame, json: str, *, out: str = "pruned") -> DataFrame:
    """N04 beside each row."""
    return _mapped(rows, json, out, "prune")


# -- files and packages -------------------------------------------------------------------------------------


def listing_hash(files: DataFrame, by: list[str], *, path: str = "path", size: str = "size") -> DataFrame:
    """Of each artifact (a handful of files) their number and the SHA-256 of its canonical listing of paths and sizes."""
    entry = F.struct(F.col(path).alias("path"), F.col(size).cast("long").alias("size"))
    grouped = files.groupBy(*by).agg(F.count(F.lit(1)).alias("file_count"), F.array_sort(F.collect_list(entry)).alias("__l"))
    return grouped.withColumn("manifest_sha256", F.sha2(F.to_json("__l"), 256)).drop("__l")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """name, size and sha256 of the files of a folder. A file is read whole; packages' files are below 2 GB."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def contract_findings(hashes: DataFrame, contract: dict[str, str]) -> DataFrame:
    """name, expected and actual of every file of the contract that is missing or differs; empty means it holds."""
    spark = hashes.sparkSession
    wanted = spark.createDataFrame(sorted(contract.items()) or [("", "")], "name string, expected string").where("name <> ''")
    return wanted.join(hashes.select("name", F.col("sha256").alias("actual")), "name", "left").where(~F.col("expected").eqNullSafe(F.col("actual")))


def package_findings(train: DataFrame, validation: DataFrame, *, key: Column, hard: DataFrame | None = None, counts: dict[str, int] | None = None, replay: float | None = None, replay_range: tuple[float, float] = (0.6, 0.7)) -> DataFrame:
    """Rows of `finding` and `n`: keys in both parts, wrong numbers of records, hard rows that validation lacks,
    a share of replayed rows out of range. Empty means the package holds."""
    spark = train.sparkSession
    both = train.select(key.alias("k")).intersect(validation.select(key.alias("k"))).agg(F.count(F.lit(1)).alias("n")).select(F.lit("overlap").alias("finding"), "n")
    out = both
    for name, rows in (("train", train), ("validation", validation)):
        if counts and name in counts:
            out = out.union(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"{name}_count").alias("finding"), F.abs(F.col("n") - counts[name]).alias("n")))
    if hard is not None:
        out = out.union(hard.select(key.alias("k")).distinct().join(validation.select(key.alias("k")).distinct(), "k", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("hard_not_in_validation").alias("finding"), "n"))
    if replay is not None and not replay_range[0] <= replay <= replay_range[1]:
        out = out.union(spark.createDataFrame([("replay_share", 1)], "finding string, n long"))
    return out.where("n > 0")


def notebook_findings(notebooks: DataFrame, forbidden: list[str], *, text: str = "text", key: str = "path") -> DataFrame:
    """key, cell and finding of code cells of notebooks (JSON texts): a forbidden piece of text, a line that is a
    comment. Whether a cell compiles is left to a Python host."""
    cells = notebooks.select(F.col(key), F.posexplode(F.from_json(F.col(text), "cells array<struct<cell_type:string,source:variant>>")["cells"]).alias("cell", "c")).where("c.cell_type = 'code'")
    source = F.coalesce(F.array_join(F.expr("try_variant_get(c.source, '$', 'array<string>')"), ""), F.expr("try_variant_get(c.source, '$', 'string')"))
    cells = cells.select(key, "cell", source.alias("s"))
    found = F.array_compact(F.array(*[F.when(F.contains("s", F.lit(f)), F.lit(f"forbidden: {f}")) for f in forbidden], F.when(F.col("s").rlike(r"(?m)^\s*#"), F.lit("comment line"))))
    return cells.select(key, "cell", F.explode(found).alias("finding"))


def write_artifacts(rows: DataFrame, path: str, *, session: str = "session_id") -> None:
    """One folder of JSON lines for each session."""
    rows.withColumn("__session", F.col(session)).repartition("__session").write.partitionBy("__session").mode("append").json(path)


def _zip(group: pa.Table) -> pa.Table:
    import io
    import zipfile

    sink = io.BytesIO()
    rows = sorted(zip(group.column("name").to_pylist(), group.column("content").to_pylist(), strict=True))
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as out:
        for name, content in rows:
            entry = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))  # the same rows give the same bytes
            entry.compress_type = zipfile.ZIP_DEFLATED
            out.writestr(entry, content or b"")
    return pa.table({"archive": [group.column("archive")[0].as_py()], "content": pa.array([sink.getvalue()], pa.binary())})


def archives(files: DataFrame, by: str, *, name: str = "name", content: str = "content") -> DataFrame:
    """Archive and content (a ZIP file) for each batch or session. An archive's files are held at once; a batch
    has 50 at most."""
    rows = files.select(F.col(by).cast("string").alias("archive"), F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content"))
    return rows.groupBy("archive").applyInArrow(_zip, "archive string, content binary")


def write_package(parts: dict[str, DataFrame], path: str) -> DataFrame:
    """Each part as JSON lines below the path; returns name and rows of each, its manifest."""
    spark = next(iter(parts.values())).sparkSession
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")
    counted = [(name, spark.read.schema(rows.schema).json(f"{path}/{name}").count()) for name, rows in parts.items()]
    return spark.createDataFrame(counted, "name string, rows long")


def stored_path(status: Column, name: Column, root: str) -> Column:
    """Where a discovered file goes: the folder of its status, for accepted and pending ones."""
    return F.when(status.isin("accepted", "pending_review"), F.concat(F.lit(root.rstrip("/") + "/"), status, F.lit("/"), name))


# -- checks and counts --------------------------------------------------------------------------------------


def no_truncation(rows: DataFrame, length: Column, limit: int) -> DataFrame:
    """The rows, or an error if one is longer than the limit."""
    over = rows.where(length > limit).count()
    if over:
        raise ValueError(f"{over} rows are longer than {limit}")
    return rows


def health(predictions: DataFrame, *, split: str = "split", order: str = "position", text: str = "completion", first: int = 5) -> DataFrame:
    """Of the first rows of each split, whether the answer is a JSON object and whether it repeats itself."""
    from pyspark.sql import Window

    from brindle.functions.text import repetition_guard

    ranked = predictions.withColumn("__n", F.row_number().over(Window.partitionBy(split).orderBy(order))).where(F.col("__n") <= first).drop("__n")
    kind = F.schema_of_variant(F.try_parse_json(F.col(text)))
    marked = ranked.withColumns({"json_valid": F.coalesce(kind.startswith("OBJECT"), F.lit(False)), "repeats": repetition_guard(F.lower(F.col(text)), window=24, stride=8, count=4, least=0)})
    return marked.withColumn("healthy", F.col("json_valid") & ~F.col("repeats"))


def discovery_summary(records: DataFrame, *, status: str = "status", downloaded: str = "sha256") -> DataFrame:
    """One row: candidates searched, downloaded, and by status."""
    n = lambda s: F.count_if(F.col(status) == s)
    return records.agg(F.count(F.lit(1)).alias("searched"), F.count(F.col(downloaded)).alias("downloaded"), n("accepted").alias("accepted"), n("pending_review").alias("pending_review"), n("rejected").alias("rejected"), n("duplicate").alias("duplicates"), n("error").alias("errors"))


def feature_counts(rows: DataFrame, features: Column) -> DataFrame:
    """How many rows have each feature of an array."""
    return rows.select(F.explode(F.array_distinct(features)).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
