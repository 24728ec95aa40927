"""Scans and sinks (S01-S17, S21, K01-K04, K09): files as DataFrames and back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Accepted extensions, and how files of a kind begin.
EXTENSIONS = [".pdf", ".docx", ".xml", ".png", ".jpg", ".jpeg"]
MAGIC = {"pdf": b"%PDF-", "png": b"\x89PNG\r\n\x1a\n", "jpeg": b"\xff\xd8\xff", "docx": b"PK\x03\x04"}
LEAST_TEXT = 50
DOCX_PART = 16 << 20


def extension(path: Column) -> Column:
    """The lower-cased suffix; empty without one."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def scan_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Binary files whose extension is allowed and whose first bytes fit it; and the rest with a reason."""
    marked = judge_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL").select("path", "length", "extension", "reason")


def judge_files(files: DataFrame) -> DataFrame:
    """S01, S02 beside each file (path, content): extension, kind by the first bytes, and the reason to refuse it."""
    judged = files.withColumn("extension", extension(F.col("path"))).withColumn("kind", sniff(F.col("content")))
    expected = F.translate(F.col("extension"), ".", "")
    fits = (F.col("extension") == ".xml") | (F.col("kind") == F.when(expected.isin("jpg", "jpeg"), F.lit("jpeg")).otherwise(expected))
    return judged.withColumn("reason", F.when(~F.col("extension").isin(EXTENSIONS), F.lit("extension")).when(F.coalesce(~fits, F.lit(True)), F.lit("content")))


def sniff(content: Column) -> Column:
    """The kind by the first bytes; null if unknown."""
    out = F.lit(None).cast("string")
    for kind, head in MAGIC.items():
        out = F.when(F.substring(content, 1, len(head)) == F.lit(head), F.lit(kind)).otherwise(out)
    return out


def _docx(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xml.etree.ElementTree as ET

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def one(content: bytes | None) -> tuple[str | None, str | None]:
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                if "[Content_Types].xml" not in z.namelist():
                    return None, "no content types"
                if z.getinfo("word/document.xml").file_size > DOCX_PART:
                    return None, "too large"
                raw = z.read("word/document.xml")
            if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
                return None, "declarations are not allowed"
            paragraphs = (" ".join(t.text for t in p.iter(f"{w}t") if t.text) for p in ET.fromstring(raw).iter(f"{w}p"))
            return "\n".join(p for p in paragraphs if p.strip()), None
        except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
            return None, type(e).__name__

    for batch in batches:
        got = [one(c) for c in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([g[0] for g in got], type=pa.string()), pa.array([g[1] for g in got], type=pa.string())], names=["path", "text", "error"])


def docx_text(files: DataFrame) -> DataFrame:
    """Path, text and error; paragraphs of the main part, blank ones dropped."""
    return files.select("path", "content").mapInArrow(_docx, "path string, text string, error string")


def _make_docx(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xml.sax.saxutils import escape

    def one(paragraphs: list[str]) -> bytes:
        body = "".join(f"<w:p><w:r><w:t>{escape(p)}</w:t></w:r></w:p>" for p in paragraphs)
        sink = io.BytesIO()
        with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", "<Types/>")
            z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
        return sink.getvalue()

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([one(p) for p in batch.column("paragraphs").to_pylist()], type=pa.binary())], names=["path", "content"])


def make_docx(rows: DataFrame) -> DataFrame:
    """path and content of small documents from path and paragraphs (an array of text)."""
    return rows.select("path", "paragraphs").mapInArrow(_make_docx, "path string, content binary")


def zip_entries(rows: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, name and content of each file in ZIP archives; one that is broken has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                        out += [(k, n, z.read(n)) for n in z.namelist()]
                except zipfile.BadZipFile:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], type=t) for j, t in enumerate((pa.string(), pa.string(), pa.binary()))], names=["k", "name", "content"])

    return rows.select(F.col(key).cast("string"), content).mapInArrow(run, "k string, name string, content binary").withColumnRenamed("k", key)


def _xml(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xml.etree.ElementTree as ET

    def one(content: bytes | None) -> tuple[str | None, str | None]:
        if b"<!DOCTYPE" in (content or b"") or b"<!ENTITY" in (content or b""):
            return None, "declarations are not allowed"
        try:
            lines = (f"{e.tag.rpartition('}')[2]}: {e.text.strip()}" for e in ET.fromstring(content or b"").iter() if isinstance(e.tag, str) and e.text and e.text.strip())
            return "\n".join(lines), None
        except ET.ParseError as e:
            return None, type(e).__name__

    for batch in batches:
        got = [one(c) for c in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([g[0] for g in got], type=pa.string()), pa.array([g[1] for g in got], type=pa.string())], names=["path", "text", "error"])


def xml_text(files: DataFrame) -> DataFrame:
    """Path, text (`name: text` lines in document order) and error."""
    return files.select("path", "content").mapInArrow(_xml, "path string, text string, error string")


def read_jsonl_strict(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Any malformed line fails the read."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of one file or a folder that parse and have the required fields, with their file; and the malformed lines."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("_file"), "value")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    rows = lines.select("_file", F.from_json("value", f"{schema}, _corrupt_record string", options).alias("r")).select("_file", "r.*")
    good = rows.where("_corrupt_record IS NULL").drop("_corrupt_record")
    for name in required or []:
        good = good.where(F.col(name).isNotNull() & (F.trim(F.col(name).cast("string")) != ""))
    return good, rows.where("_corrupt_record IS NOT NULL").select("_file", "_corrupt_record")


def require_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The rows, failing at run time on the first that lacks a field."""
    for name in fields:
        bad = F.col(name).isNull() | (F.trim(F.col(name).cast("string")) == "")
        rows = rows.withColumn(name, F.when(bad, F.raise_error(F.lit(f"a row lacks {name}"))).otherwise(F.col(name)))
    return rows


def source_records(rows: DataFrame, *, prompt: str = "input", answer: str = "output") -> DataFrame:
    """Rows with at least 50 characters of input and an output."""
    return rows.where((F.length(F.trim(F.col(prompt))) >= LEAST_TEXT) & F.col(answer).isNotNull() & (F.col(answer) != ""))


def session_records(spark: SparkSession, root: str) -> DataFrame:
    """session_id, input and output of session folders that hold both files."""
    text = spark.read.text(f"{root}/*/ocr_layout_text.txt", wholetext=True).select(session_id(F.col("_metadata.file_path")).alias("session_id"), F.col("value").alias("input"))
    label = spark.read.text(f"{root}/*/approved_instruction.json", wholetext=True).select(session_id(F.col("_metadata.file_path")).alias("session_id"), F.col("value").alias("output"))
    return text.join(label, "session_id").where(F.col("session_id").rlike(r"^[0-9]{8}_[0-9]{6}_[0-9]{6}$") & (F.length("input") >= LEAST_TEXT))


def session_id(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """case_name (by default the file's stem) and ocr_text of multi-line JSON files."""
    rows = spark.read.schema("case_name string, ocr_text string, expected string").option("multiLine", "true").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    return rows.select(F.coalesce("case_name", stem).alias("case_name"), "ocr_text", "expected")


def pinned(files: DataFrame, sha256: str) -> DataFrame:
    """Binary files, failing at run time on one whose content has another hash."""
    wrong = F.sha2("content", 256) != F.lit(sha256)
    return files.withColumn("content", F.when(wrong, F.raise_error(F.lit("a file's content is not the pinned one"))).otherwise(F.col("content")))


def known_hashes(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of manifest rows that were accepted or wait for review; malformed lines are skipped."""
    rows = spark.read.schema("sha256 string, status string").option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("status").isin("accepted", "pending_review") & F.col("sha256").isNotNull()).select("sha256").distinct()


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a row."""
    rows.write.mode(mode).json(path)


def manifest(rows: DataFrame, by: str) -> DataFrame:
    """One row: counts by `by` as a map, and the number of rows."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "n")))).alias("counts"), F.sum("n").alias("rows"))


def to_xml(rows: DataFrame, struct: str, row_tag: str) -> Column:
    """A struct as XML; null fields are left out."""
    return F.to_xml(F.col(struct), {"rowTag": row_tag, "ignoreNullFields": "true"})


def undelivered(rows: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Rows without an earlier success in the delivery log."""
    done = log.where(F.col("status") == "success").select(key).distinct()
    return rows.join(done, key, "left_anti")
