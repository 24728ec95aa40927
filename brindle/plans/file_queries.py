"""Queries over scans, sinks, records and queues, and the same results in DuckDB SQL. Files are written from the tables
to the shared folder first."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import corpus, evaluate, queues, records, similarity
from brindle.plans.queries import query, table
from brindle.sources import files
from brindle.sources.shared import shared_path, stored, write_file


def choose(by, *values):
    """The value at `by` modulo their number."""
    return F.get(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (by % len(values)).cast("int"))


def pick(by: str, *values: str) -> str:
    """The same in SQL; the values are SQL."""
    return f"([{', '.join(values)}])[{by} % {len(values)} + 1]"


# -- scans --------------------------------------------------------------------------------------------------


@query(
    f"""WITH f AS (SELECT s_suppkey AS id, s_suppkey % 6 AS e, s_suppkey % 5 AS h FROM supplier) SELECT id, {pick('e', "'.pdf'", "'.docx'", "'.png'", "'.jpeg'", "'.xml'", "'.exe'")} AS extension,
    {pick('h', "'pdf'", "'docx'", "'png'", "'jpeg'", "NULL")} AS kind, CASE WHEN e = 5 THEN 'extension' WHEN e = 4 OR e = h THEN NULL ELSE 'content' END AS reason FROM f"""
)
def file_checks(spark, sf_dir):
    """Extensions and first bytes."""
    path = F.concat(F.lit("in/"), F.col("s_suppkey").cast("string"), choose(F.col("s_suppkey"), ".PDF", ".docx", ".png", ".JPEG", ".xml", ".exe"))
    content = choose(F.col("s_suppkey"), *[F.lit(bytearray(b)) for b in (b"%PDF-1.7", b"PK\x03\x04x", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"plain")])
    return files.judge_files(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), path.alias("path"), content.alias("content"))).select("id", "extension", "kind", "reason")


@query("SELECT CAST(c_custkey AS VARCHAR) AS path, c_name || chr(10) || c_mktsegment || ' end' AS text, NULL::VARCHAR AS error FROM customer WHERE c_custkey % 4 <> 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), NULL, 'BadZipFile' FROM customer WHERE c_custkey % 4 = 0")
def docx_texts(spark, sf_dir):
    """Paragraphs of written documents; what is no document has an error."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.array(F.col("c_name"), F.lit(" "), F.concat("c_mktsegment", F.lit(" end"))).alias("paragraphs"))
    made = files.make_docx(rows)
    return files.docx_text(made.withColumn("content", F.when(F.col("path").cast("long") % 4 == 0, F.lit(bytearray(b"no archive"))).otherwise(F.col("content"))))


@query("SELECT CAST(c_custkey AS VARCHAR) AS path, 'name: ' || c_name || chr(10) || 'segment: ' || c_mktsegment AS text FROM customer")
def xml_texts(spark, sf_dir):
    """Local names and texts of elements, namespaces aside."""
    body = F.concat(F.lit('<p:a xmlns:p="urn:x"><p:name> '), F.col("c_name"), F.lit("</p:name><b><segment>"), F.col("c_mktsegment"), F.lit("</segment><none/></b></p:a>"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.encode(body, "UTF-8").alias("content"))
    return files.xml_text(rows).select("path", "text")


@query("SELECT 'good' AS kind, doc_id, length(text) AS n FROM documents WHERE doc_id % 10 <> 0 AND trim(text) <> '' UNION ALL SELECT 'bad', NULL, count(*) FROM documents WHERE doc_id % 10 = 0")
def jsonl_tolerant(spark, sf_dir):
    """Rows that parse and have a text; every tenth line is cut off."""
    path = shared_path(spark, "lines")
    docs = table(spark, sf_dir, "documents")
    whole = F.to_json(F.struct("doc_id", "text"))
    docs.select(F.when(F.col("doc_id") % 10 == 0, F.lit('{"doc_id": 1, "text": "cut')).otherwise(whole).alias("value")).write.text(path)
    good, bad = files.read_jsonl_tolerant(spark, path, "doc_id long, text string", ["text"])
    return good.select(F.lit("good").alias("kind"), "doc_id", F.length("text").cast("long").alias("n")).union(bad.agg(F.lit("bad"), F.lit(None).cast("long"), F.count(F.lit(1))))


@query("SELECT lang, count(*) AS n, count(text) AS texts, sum(n_chars) AS chars FROM documents GROUP BY lang")
def jsonl_strict(spark, sf_dir):
    """All rows written and read again."""
    path = shared_path(spark, "lines")
    files.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars"), path)
    rows = files.read_jsonl_strict(spark, path, "doc_id long, text string, lang string, n_chars long")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("texts"), F.sum("n_chars").alias("chars"))


@query("SELECT event_type, 2 * count(*) AS n FROM events GROUP BY event_type")
def audit_appends(spark, sf_dir):
    """Rows appended twice to one log."""
    path = shared_path(spark, "log")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type")
    for _ in range(2):
        files.write_jsonl(rows, path, mode="append")
    return files.read_jsonl_strict(spark, path, "event_id long, event_type string").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, n_chars FROM documents WHERE length(trim(text)) >= 50 AND doc_id % 3 <> 0")
def source_records(spark, sf_dir):
    """Long enough inputs with an output."""
    rows = table(spark, sf_dir, "documents").withColumn("output", F.when(F.col("doc_id") % 3 != 0, F.lit("{}")).otherwise(F.lit("")))
    return files.source_records(rows, prompt="text").select("doc_id", "n_chars")


@query("SELECT '20240101_000000_' || lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS session_id, n_name AS name FROM nation WHERE n_nationkey % 5 <> 0")
def session_folders(spark, sf_dir):
    """Sessions with both files; every fifth lacks its label."""
    root = shared_path(spark, "sessions")
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():  # 25 rows
        folder = f"{root}/20240101_000000_{r['n_nationkey']:06d}"
        write_file(spark, f"{folder}/ocr_layout_text.txt", (r["n_name"] + "\n" + "x" * 60).encode())
        if r["n_nationkey"] % 5:
            write_file(spark, f"{folder}/approved_instruction.json", b"{}")
    rows = files.session_records(spark, root)
    return rows.select("session_id", F.substring_index("input", "\n", 1).alias("name"))


@query("SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'case-' || n_nationkey ELSE 'f' || n_nationkey END AS case_name, n_name AS ocr_text FROM nation")
def fixture_files(spark, sf_dir):
    """Fixtures by name, or by their file's."""
    import json

    root = shared_path(spark, "fixtures")
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():  # 25 rows
        name = {"case_name": f"case-{r['n_nationkey']}"} if r["n_nationkey"] % 2 == 0 else {}
        write_file(spark, f"{root}/f{r['n_nationkey']}.json", json.dumps({**name, "ocr_text": r["n_name"], "expected": {}}, indent=1).encode())
    return files.read_fixtures(spark, root).select("case_name", "ocr_text")


@query("SELECT n_nationkey AS id, length(n_name) AS size FROM nation")
def pinned_files(spark, sf_dir):
    """Each content against its own hash."""
    import hashlib

    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.encode("n_name", "UTF-8").alias("content"))
    out = None
    for r in nation.collect():  # 25 rows
        one = files.pinned(nation.where(F.col("id") == r["id"]), hashlib.sha256(r["content"]).hexdigest())
        out = one if out is None else out.union(one)
    return out.select("id", F.length("content").cast("long").alias("size"))


@query("SELECT coalesce(lang, 'none') AS lang, count(*) AS n, (SELECT count(*) FROM documents) AS rows FROM documents GROUP BY 1")
def manifest_counts(spark, sf_dir):
    """The manifest's counts."""
    one = files.manifest(table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang")), "lang")
    return one.select(F.explode("counts").alias("lang", "n"), "rows")


@query("SELECT sha256(n_name) AS sha256 FROM nation WHERE n_nationkey % 3 <> 2")
def manifest_hashes(spark, sf_dir):
    """Hashes that were accepted or wait for review."""
    path = shared_path(spark, "manifest")
    rows = table(spark, sf_dir, "nation").select(F.sha2("n_name", 256).alias("sha256"), choose(F.col("n_nationkey"), "accepted", "pending_review", "rejected").alias("status"))
    files.write_jsonl(rows.union(rows), path)
    return files.known_hashes(spark, path)


# -- JSON records -------------------------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT event_id, event_type, value FROM (SELECT event_id, event_type, event_id % 4 AS value FROM events)) SELECT event_id, path, v AS value FROM e, LATERAL (SELECT unnest(['a.b[0].c', 'a.b[1][0]', 'kind', 'none']) AS path, unnest([CAST(value AS VARCHAR), 'true', event_type, NULL]) AS v)"""
)
def json_leaves(spark, sf_dir):
    """Leaves at any depth."""
    body = F.concat(F.lit('{"a": {"b": [{"c": '), (F.col("event_id") % 4).cast("string"), F.lit('}, [true, {}], []]}, "kind": "'), F.col("event_type"), F.lit('", "none": null, "empty": []}'))
    return evaluate.flatten_json(table(spark, sf_dir, "events").select("event_id", body.alias("j")), "j", key="event_id")


@query("SELECT event_id, path, v AS value FROM events, LATERAL (SELECT unnest(['x[0].n', 'x[1]', 's']) AS path, unnest([CAST(event_id % 2 AS VARCHAR), 'true', CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END]) AS v) WHERE v <> ''")
def json_scalars(spark, sf_dir):
    """Without null, false and empty leaves; zero stays."""
    body = F.concat(F.lit('{"x": [{"n": '), (F.col("event_id") % 2).cast("string"), F.lit('}, true, false, null], "s": "'), F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.col("event_type")), F.lit('"}'))
    return evaluate.flatten_json(table(spark, sf_dir, "events").select("event_id", body.alias("j")), "j", key="event_id", scalars=True)


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, CASE WHEN event_id % 2 = 0 THEN event_type END AS second, NULL::VARCHAR AS beyond FROM events")
def json_paths(spark, sf_dir):
    """Values at paths."""
    body = F.concat(F.lit('{"a": [{"b": 1}, '), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"b": "'), F.col("event_type"), F.lit('"}'))).otherwise(F.lit("7")), F.lit("]}"))
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", evaluate.json_value(F.col("props"), "page").alias("page"), evaluate.json_value(body, "a[1].b").alias("second"), evaluate.json_value(body, "a[5].b").alias("beyond"))


@query("""SELECT n_nationkey AS id, '{"a":{"k":' || n_nationkey || '},"b":[1,"é"],"z":"' || n_name || '"}' AS canonical, sha256('{"a":{"k":' || n_nationkey || '},"b":[1,"é"],"z":"' || n_name || '"}') AS sha256 FROM nation""")
def canonical_records(spark, sf_dir):
    """Keys in order, compact, and the hash."""
    body = F.concat(F.lit('{"z": "'), F.col("n_name"), F.lit('", "b": [1, "\\u00e9"],  "a": {"k": '), F.col("n_nationkey").cast("string"), F.lit("}}"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), body.alias("j"))
    return records.json_hash(records.canonical_json(rows, "j"), "j").select("id", "canonical", "sha256")


@query("""SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN '{"a":' || n_nationkey || '}' ELSE '{}' END AS object FROM nation""")
def record_objects(spark, sf_dir):
    """Objects; lists and broken texts give an empty one."""
    k = F.col("n_nationkey")
    body = F.when(k % 3 == 0, F.concat(F.lit('{"a" : '), k.cast("string"), F.lit("}"))).when(k % 3 == 1, F.lit("[1]")).otherwise(F.lit("{broken"))
    return records.object_of(table(spark, sf_dir, "nation").select(k.alias("id"), body.alias("j")), "j").select("id", "object")


@query("""SELECT n_nationkey AS id, '{"k":{"l":[0,{"m":"' || n_name || '"}]},"n":0}' AS pruned FROM nation""")
def pruned_records(spark, sf_dir):
    """Nothing empty stays, at any depth."""
    body = F.concat(F.lit('{"a": null, "b": "", "c": [], "d": {"e": {"f": [null, "", {}]}}, "g": false, "k": {"l": [0, {"m": "'), F.col("n_name"), F.lit('", "x": null}], "y": ""}, "n": 0}'))
    return records.prune_empty(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), body.alias("j")), "j").select("id", "pruned")


# -- packages, checks, counts -------------------------------------------------------------------------------


@query("""SELECT n_regionkey AS region, count(*) AS file_count, sha256('[' || string_agg('{"path":"' || n_name || '.bin","size":' || length(n_name) || '}', ',' ORDER BY n_name) || ']') AS manifest_sha256 FROM nation GROUP BY 1""")
def listing_hashes(spark, sf_dir):
    """An artifact's files as one hash."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.concat("n_name", F.lit(".bin")).alias("path"), F.length("n_name").alias("size"))
    return records.listing_hash(rows, ["region"])


@query("SELECT n_name || '.txt' AS name, sha256(n_name) AS actual FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT 'missing.txt', NULL")
def contract_findings(spark, sf_dir):
    """written files against a contract in which some hashes are wrong and one file is missing."""
    import hashlib

    root = shared_path(spark, "package")
    contract = {"missing.txt": "0"}
    for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():  # 25 rows
        write_file(spark, f"{root}/{r['n_name']}.txt", r["n_name"].encode())
        contract[f"{r['n_name']}.txt"] = "wrong" if r["n_nationkey"] % 4 == 1 else hashlib.sha256(r["n_name"].encode()).hexdigest()
    return records.contract_findings(records.file_hashes(spark, root), contract).select("name", "actual")


@query("SELECT 'overlap' AS finding, count(*) AS n FROM (SELECT text FROM documents WHERE doc_id % 5 = 0 INTERSECT SELECT text FROM documents WHERE doc_id % 5 <> 0) HAVING count(*) > 0 UNION ALL SELECT 'train_count', 7 UNION ALL SELECT 'replay_share', 1")
def package_findings(spark, sf_dir):
    """Overlap of the parts, a count that is off by seven, a share out of range."""
    docs = table(spark, sf_dir, "documents")
    train, validation = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")
    return records.package_findings(train, validation, key=F.col("text"), hard=validation.where("doc_id % 10 = 0"), counts={"train": train.count() - 7, "validation": validation.count()}, replay=0.8)


@query("SELECT n_nationkey AS path, 1 AS cell, 'forbidden: eval(' AS finding FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 2, 'comment line' FROM nation")
def notebook_findings(spark, sf_dir):
    """forbidden pieces and comment lines in code cells."""
    code = F.when(F.col("n_nationkey") % 2 == 0, F.lit("x = eval('1')")).otherwise(F.lit("x = 1"))
    text = F.concat(F.lit('{"cells": [{"cell_type": "markdown", "source": "# eval("}, {"cell_type": "code", "source": ["'), code, F.lit('\\n", "y = 2"]}, {"cell_type": "code", "source": "a = 1\\n  # why"}]}'))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("path"), text.alias("text"))
    return records.notebook_findings(rows, ["eval(", "exec("])


@query("SELECT user_id AS session_id, count(*) AS n FROM events GROUP BY user_id")
def session_artifacts(spark, sf_dir):
    """A folder for each session, read back."""
    path = shared_path(spark, "artifacts")
    records.write_artifacts(table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", "event_type"), path)
    back = spark.read.schema("session_id long, event_id long, event_type string").json(path)
    return back.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS archive, n_name AS name, length(n_name) AS size FROM nation")
def archived_files(spark, sf_dir):
    """ZIP files, and what is in them."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("batch"), F.col("n_name").alias("name"), F.encode("n_name", "UTF-8").alias("content"))
    return files.zip_entries(records.archives(rows, "batch"), "archive").select("archive", "name", F.length("content").cast("long").alias("size"))


@query("SELECT 'train' AS name, count(*) AS rows FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT 'validation', count(*) FROM documents WHERE doc_id % 10 = 0")
def written_package(spark, sf_dir):
    """The parts of a package and their rows as read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return records.write_package({"train": docs.where("doc_id % 10 <> 0"), "validation": docs.where("doc_id % 10 = 0")}, shared_path(spark, "package"))


@query(f"SELECT page_id, CASE WHEN page_id % 3 < 2 THEN '/out/' || {pick('page_id', chr(39) + 'accepted' + chr(39), chr(39) + 'pending_review' + chr(39), chr(39) + 'rejected' + chr(39))} || '/p' || page_id || '.html' END AS path FROM pages")
def stored_paths(spark, sf_dir):
    """Where accepted and pending files go."""
    k = F.col("page_id")
    return table(spark, sf_dir, "pages").select("page_id", records.stored_path(choose(k, "accepted", "pending_review", "rejected"), F.concat(F.lit("p"), k.cast("string"), F.lit(".html")), "/out/").alias("path"))


@query("SELECT doc_id, n_chars FROM documents")
def truncation_gate(spark, sf_dir):
    """All rows, as none is over the limit."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return records.no_truncation(rows, F.col("n_chars"), 1 << 30)


@query("SELECT conv_id % 2 AS split, conv_id, conv_id % 3 = 0 AS json_valid, conv_id % 3 = 2 AS repeats FROM (SELECT DISTINCT conv_id FROM conversations) QUALIFY row_number() OVER (PARTITION BY conv_id % 2 ORDER BY conv_id) <= 5")
def health_rows(spark, sf_dir):
    """The first rows of each split."""
    k = F.col("conv_id")
    text = F.when(k % 3 == 0, F.lit('{"a": 1}')).when(k % 3 == 1, F.lit("[1]")).otherwise(F.repeat(F.lit("a b c d e f g h "), F.lit(12)))
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", (k % 2).alias("split"), k.alias("position"), text.alias("completion"))
    return records.health(rows).select("split", "conv_id", "json_valid", "repeats")


@query("SELECT count(*) AS searched, count(*) FILTER (page_id % 5 <> 4) AS downloaded, count(*) FILTER (page_id % 5 = 0) AS accepted, count(*) FILTER (page_id % 5 = 1) AS pending_review, count(*) FILTER (page_id % 5 = 2) AS rejected, count(*) FILTER (page_id % 5 = 3) AS duplicates, count(*) FILTER (page_id % 5 = 4) AS errors FROM pages")
def discovery_summary(spark, sf_dir):
    """The counts of a discovery run."""
    k = F.col("page_id")
    rows = table(spark, sf_dir, "pages").select(choose(k, "accepted", "pending_review", "rejected", "duplicate", "error").alias("status"), F.when(k % 5 != 4, F.sha2(F.coalesce("html", F.lit("")), 256)).alias("sha256"))
    return records.discovery_summary(rows)


@query("SELECT f AS feature, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter([CASE WHEN n_chars > 500 THEN 'long' END, lang, source], lambda x: x IS NOT NULL))) AS f FROM documents) GROUP BY f")
def feature_counts(spark, sf_dir):
    """Rows of each feature."""
    return records.feature_counts(table(spark, sf_dir, "documents"), F.array_compact(F.array(F.when(F.col("n_chars") > 500, F.lit("long")), F.col("lang"), F.col("source"))))


# -- queues -------------------------------------------------------------------------------------------------


@query("SELECT s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 10 > 7")
def expired_entries(spark, sf_dir):
    """Old entries with a name of ours."""
    now = F.lit("2024-06-30 00:00:00").cast("timestamp")
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("not ours "), F.col("s_name"))).otherwise(F.translate("s_name", "#", "_"))
    rows = table(spark, sf_dir, "supplier").select(name.alias("name"), F.col("s_name").alias("s"), (now - F.make_dt_interval((F.col("s_suppkey") % 10).cast("int"))).alias("modified"))
    return queues.expired(rows, now, 7).select(F.col("s").alias("name"))


@query("SELECT row_number() OVER (ORDER BY s_suppkey <> 7, s_suppkey % 3, lower(s_name), s_suppkey) AS place, 'm/' || s_suppkey AS path, s_suppkey = 7 AS active, s_suppkey % 2 = 0 AS selectable FROM supplier")
def model_catalogue(spark, sf_dir):
    """The active model first, then by source and name; a path that was seen twice counts once."""
    one = table(spark, sf_dir, "supplier").select(F.concat(F.lit("m/"), F.col("s_suppkey").cast("string")).alias("path"), choose(F.col("s_suppkey"), "A", "b", "C").alias("source"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("OpenVINO")).otherwise(F.lit("other")).alias("format"), F.lit(2).alias("position"))
    seen = one.withColumn("position", F.lit(1)).withColumn("source", F.lit("early"))
    ranked = stored(queues.catalogue(one.union(seen), "m/7").withColumn("place", F.monotonically_increasing_id()), "catalogue")
    from pyspark.sql import Window

    return ranked.withColumn("place", F.row_number().over(Window.orderBy("place")).cast("long")).select("place", "path", "active", "selectable")


@query(
    """WITH q AS (SELECT s_suppkey AS session_id, s_suppkey % 5 = 0 AS consumed, s_suppkey % 7 = 0 AS active, s_suppkey * 1.0 AS created_at, CASE WHEN s_suppkey % 4 = 0 THEN s_suppkey * 2.0 END AS completed_at FROM supplier),
    gone AS (SELECT session_id FROM q WHERE NOT consumed AND NOT active AND 320 - completed_at >= 300), rest AS (SELECT * FROM q WHERE session_id NOT IN (SELECT session_id FROM gone))
    SELECT session_id FROM gone UNION ALL SELECT session_id FROM (SELECT session_id, row_number() OVER (ORDER BY coalesce(completed_at, created_at), session_id) AS r FROM rest WHERE NOT consumed AND NOT active) WHERE r <= (SELECT count(*) FROM rest) - 6 + 1"""
)
def pruned_queues(spark, sf_dir):
    """Expired queues, then the oldest beyond the capacity."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("session_id"), (F.col("s_suppkey") % 5 == 0).alias("consumed"), (F.col("s_suppkey") % 7 == 0).alias("active"), F.col("s_suppkey").cast("double").alias("created_at"), F.when(F.col("s_suppkey") % 4 == 0, F.col("s_suppkey") * 2.0).alias("completed_at"))
    return queues.pruned_queues(rows, 320.0, most=6)


@query("SELECT s_suppkey AS batch_id FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier WHERE s_suppkey % 2 = 0) WHERE r <= (SELECT count(*) FROM supplier) - 6 + 1")
def evicted_batches(spark, sf_dir):
    """Finished batches that give way."""
    gone, _ = queues.evicted(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("batch_id"), (F.col("s_suppkey") % 2 == 0).alias("terminal")), most=6)
    return gone


@query("SELECT user_id AS subscriber, event_id AS id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def delivered_entries(spark, sf_dir):
    """What a bounded queue still holds."""
    return queues.delivered(table(spark, sf_dir, "events").select(F.col("user_id").alias("subscriber"), F.col("event_id").alias("id")), most=3)


@query(f"SELECT p_partkey, {pick('p_partkey', chr(39) + 'qwen' + chr(39), chr(39) + 'florence' + chr(39), chr(39) + 'unknown' + chr(39))} AS target FROM part")
def adapter_targets(spark, sf_dir):
    """Adapters by the name of their base."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", queues.adapter_target(choose(k, "org/Qwen2-7B", "FLORENCE-large", "other")).alias("target"))


# -- unions and joins ---------------------------------------------------------------------------------------


@query("SELECT _source, count(*) AS n, count(extra) AS extras FROM (SELECT 'a' AS _source, NULL AS extra FROM documents WHERE lang = 'en' UNION ALL SELECT 'b', doc_id FROM documents WHERE n_chars > 200) GROUP BY _source")
def tagged_sources(spark, sf_dir):
    """All rows of both with their source's name."""
    docs = table(spark, sf_dir, "documents")
    both = corpus.tagged_union({"a": docs.where("lang = 'en'").select("doc_id"), "b": docs.where("n_chars > 200").select("doc_id", F.col("doc_id").alias("extra"))})
    return both.groupBy("_source").agg(F.count(F.lit(1)).alias("n"), F.count("extra").alias("extras"))


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def missing_keys(spark, sf_dir):
    """Customers without an urgent order."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    return corpus.missing_values(orders, orders.where("o_orderpriority = '1-URGENT'"), "k")


@query("SELECT conv_id, array_to_string(list_filter(['a', 'b', 'c', role], lambda x, i: list_position(['a', 'b', 'c', role], x) = i), ',') AS paths FROM conversations")
def path_union(spark, sf_dir):
    """The paths of both lists, in order, once each."""
    return table(spark, sf_dir, "conversations").select("conv_id", F.array_join(corpus.path_union(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"), F.col("role"), F.lit("a"))), ",").alias("paths"))


@query("SELECT doc_id FROM documents WHERE doc_id IS NOT NULL")
def fail_closed(spark, sf_dir):
    """All rows, as none is among the forbidden."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return similarity.fail_if_any(docs, docs.select((F.col("doc_id") + 10_000_000).alias("doc_id")))


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 4 = 0 AND text IS NOT NULL) GROUP BY text")
def new_documents(spark, sf_dir):
    """The first row of each text that the history lacks."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("hash"))
    return similarity.new_only(docs, docs.where("doc_id % 4 = 0"), "hash", order="doc_id").select("doc_id")


@query("SELECT o_orderstatus AS status, round(count(*) FILTER (o_totalprice > 100000) * 100.0::DOUBLE / count(*), 1) AS pass_rate FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def pass_rates(spark, sf_dir):
    """A14."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return evaluate.pass_rate(orders.withColumn("passed", F.col("o_totalprice") > 100000), "passed").select(F.lit("O").alias("status"), "pass_rate")


@query("SELECT event_id, event_type FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 100 AND event_id > (SELECT max(event_id) - 50 FROM events)")
def log_tail(spark, sf_dir):
    """The tail of a log after the last entry that a reader has."""
    from brindle.streaming import events as streams

    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    last = events.agg(F.max("event_id")).first()[0]
    return streams.resumed(streams.tail(events, 100, id="event_id"), last - 50, id="event_id")


@query(
    """WITH p AS (SELECT page_id, string_split(url, '#')[1] AS url, CAST(page_id % 3 AS VARCHAR) AS q FROM pages WHERE url IS NOT NULL), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY page_id) AS r FROM f) SELECT page_id, q FROM r WHERE r <= 7 ORDER BY page_id LIMIT 20"""
)
def budgeted_candidates(spark, sf_dir):
    """Each query's share of the budget."""
    from brindle.functions import text as tx

    pages = table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", tx.strip_fragment(F.col("url")).alias("url"), (F.col("page_id") % 3).cast("string").alias("q"))
    return corpus.collect_candidates(pages, query="q", url="url", order="page_id", most=20).select("page_id", "q")


@query("SELECT conv_id, len(list(turn)) - 1 AS n_prompt, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id")
def prompt_parts(spark, sf_dir):
    """All messages but the last, and the last."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    prompt, completion = corpus.prompt_and_completion(F.col("m"))
    return turns.select("conv_id", F.size(prompt).cast("long").alias("n_prompt"), F.get(completion, F.lit(0))["role"].alias("role"))


@query("SELECT doc_id, 'You are careful.' AS system, lang AS prompt, source AS answer FROM documents")
def chat_rows(spark, sf_dir):
    """The three messages of a row."""
    rows = corpus.chat_messages(table(spark, sf_dir, "documents").withColumn("instructions", F.lit("You are careful.")), instruction="instructions", prompt="lang", answer="source")
    at = lambda k: F.get("messages", F.lit(k))["content"]
    return rows.select("doc_id", at(0).alias("system"), at(1).alias("prompt"), at(2).alias("answer"))


@query("SELECT p_partkey, 'ref ' || 'NEW' || p_partkey || ', not ' || 'X' || p_partkey || '1' AS text FROM part")
def swapped_references(spark, sf_dir):
    """P50: a reference is replaced as a word."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("ref X"), k, F.lit(", not X"), k, F.lit("1"))
    return table(spark, sf_dir, "part").select("p_partkey", corpus.swap_reference(text, F.concat(F.lit("X"), k), F.concat(F.lit("NEW"), k)).alias("text"))


@query("SELECT CAST(list_position(['f2', 'f3', 'f1'], f) - 1 AS INT) AS place, f AS family FROM (SELECT unnest(['f2', 'f3']) AS f)")
def closest_families(spark, sf_dir):
    """Families of 5, 40 and 12 rows towards 50 rows: the closest first, then what comes closer."""
    sizes = {"f1": 5, "f2": 40, "f3": 12}
    picked = corpus.closest_families(sizes, 50)
    return spark.createDataFrame(list(enumerate(picked)), "place int, family string")
