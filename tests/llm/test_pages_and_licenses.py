"""Main text of pages, license notices, the queries' contract and the pipeline."""

import random
import re

import duckdb
import pytest

import corpus_pipeline
from brindle.llm import html_tagpath, license_minhash, queries
from brindle.llm.common import read_table

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="no-menu"><header><p>Site, name.</p></header><nav><ul><li><a>Home</a><li><a>More</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, and more cookies, to please you.</p></div>
<div id="content"><h1>A  title</h1><p>First &amp; <b>bold</b> text, with a comma.<br>Second line, here.<p>Unclosed, but fine. Yes.</p><div class="ad">Buy, now. Cheap.</div><p>Short.</p><script>var x="</p>";</script>
<form><label>Mail</label><input></form><ul><li>One, two.<li>Three, four.</ul></div><aside><p>Side, bar, text, long enough to look like an article, really.</p></aside>
<div class="comments"><p>I, too, have a comment, and it is long. Very long, indeed, as comments go.</p></div><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_tagpath.main_text(PAGE) == "A title First & bold text, with a comma. Second line, here. Unclosed, but fine. Yes. Short. One, two. Three, four."


@pytest.mark.parametrize("page, text", [("", ""), ("no tags, only text.", "no tags, only text."), ("<p>cut <b>off, here", "cut off, here"), ("<body><p>a < b, and c > d.</p></body>", "a < b, and c > d."), ("<nav>menu</nav>", ""), ("<p>a, b.</p><a href='x", "a, b. <a href='x"), ("<p>x&#233;&nbsp;y, z.</p>", "xé y, z."), ("<!-- <p>no</p> -->", ""), ("<p title='a>b'>yes, it is.</p>", "yes, it is.")])
def test_odd_pages(page, text):
    assert html_tagpath.main_text(page) == text


LONG = "A long sentence, with commas, and more of them, to carry weight. " * 12


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><article><h1>Title</h1><div class=body><p>{LONG}</p><p>{LONG}</p></div></article></body>", f"Title {LONG}{LONG}"),
        (f"<body><article><section><p>{LONG * 3}</p><p>{LONG}</p></section><section><p>Short end, here.</p></section></article></body>", f"{LONG * 4}Short end, here."),
        (f"<body><article><p>Intro.</p><ul>{f'<li>{LONG}</li>' * 4}</ul></article></body>", f"Intro. {LONG * 4}"),
        (f"<body><div class=post><h1>Title</h1><div class=body><p>{LONG}</p><p>{LONG}</p></div></div><div class=legal>All rights, reserved.</div></body>", f"Title {LONG}{LONG}"),
        (f"<body><div class=post><p>Intro.</p><ul>{f'<li>{LONG}</li>' * 4}</ul></div><div class=legal>All rights, reserved.</div></body>", f"Intro. {LONG * 4}"),
    ],
)
def test_the_whole_article(page, text):
    assert html_tagpath.main_text(page) == text.strip()


BODY = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>Short end.</p>"
BODY_TEXT = f"Title {LONG}{LONG}Short end."


@pytest.mark.parametrize("wrapper", ['style="overflow:hidden"', 'data-hidden="false"', 'class="content no-sidebar"', 'class="promo-free"', 'id="post-comments-enabled"', "class=has-sidebar", "class='layout-with-navbar'", 'class="two-columns right-sidebar"', 'class="modal-content"', 'class="comments"'])
def test_wrappers_of_the_article(wrapper):
    assert html_tagpath.main_text(f"<body><nav><a>Home</a></nav><div {wrapper}>{BODY}</div></body>") == BODY_TEXT
    assert html_tagpath.main_text(f"<body><form id=aspnetForm><div {wrapper}>{BODY}<div class='comments-area'><p>I, too, have something, long, to say.</p></div></div></form></body>") == BODY_TEXT


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><article><header><h1>Title</h1><p>By me, today.</p></header><p>{LONG}</p></article></body>", f"Title {LONG}"),
        (f"<body><div class=entry><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p><p>{LONG}</p></div></body>", f"Title {LONG}{LONG}"),
        (f"<body><div>{BODY}<p style='display: none'>Unseen, text.</p><p hidden>Unseen, too.</p></div></body>", BODY_TEXT),
        (f"<body><div>{BODY}<div><a href=/1>More stories</a> <a href=/2>Contact</a></div></div></body>", BODY_TEXT),
        (f"<body><div>{BODY}</div><section id=comments>{f'<p>A comment, that is longer than all: {LONG}</p>' * 4}</section></body>", BODY_TEXT),
        (f"<body><div>{BODY}</div><div class='comment-list'>{f'<p>A comment, that is as long: {LONG}</p>' * 2}</div></body>", BODY_TEXT),
        (f"<body><div class=ad>{LONG * 5}</div><p>Short, but real.</p></body>", "Short, but real."),
        (f"<body><div><p>Short, but real.</p></div><div class='comment-list'><p>{LONG * 9}</p></div></body>", "Short, but real."),
        (f"<body><div class='right-sidebar'><p>{LONG * 9}</p></div><div>More.</div></body>", f"{LONG * 9}"),
        (f"<body><div>{BODY}<p>See <a href=/x>this, please</a>, and <a href=/y>that</a>.</p></div></body>", BODY_TEXT + " See this, please, and that."),
        (f"<body><div>{BODY}<div class='cookie-consent'><p>We, too, use cookies.</p></div></div></body>", BODY_TEXT),
        (f"<body><p>{LONG}</p><p>An <span class=share>Share it, now.</span> end.</p></body>", f"{LONG}An end."),
        (f"<body><article><p>{LONG}</p><ul><li><a href=/a>A source</a></li></ul></article></body>", f"{LONG}A source"),
        (f'<body><p title="x > y">{LONG}</p><p>open "quote" and it\'s <b class=x">so</b>.</p></body>', f'{LONG}open "quote" and it\'s so.'),
    ],
)
def test_what_belongs_to_the_article(page, text):
    assert html_tagpath.main_text(page) == text.strip()


@pytest.mark.parametrize("page", ["<a " * 200_000, "<div>x" * 50_000, "<b>" * 50_000 + "<div>y</div>" * 50_000, "<ul>" + "<div>" * 30_000 + "<li>a</li>" * 30_000, "</p>" * 200_000, '<a x="' * 100_000 + ">", "<p class='a b" * 50_000, "<div class=ad>z" * 30_000, "x" * 3_000_000, "<script>" * 100_000, "<!--" * 100_000, "&amp" * 300_000])
def test_very_long_pages_take_time_in_proportion(page):
    import time

    def took(p):
        began = time.process_time()
        html_tagpath.main_text(p)
        return time.process_time() - began

    assert took(page) < 20 and took(page) < 8 * took(page[: len(page) // 4]) + 1


def test_all_pages_have_their_article(spark):
    import html as entities

    rows = read_table(spark, SF, "pages").collect()
    got = {r["page_id"]: r["text"] for r in html_tagpath.extract(read_table(spark, SF, "pages")).collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|<footer)", r["html"], re.DOTALL)[1]
        plain = re.sub(r"<[^>]*>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", article))
        assert got[r["page_id"]] == " ".join(entities.unescape(plain).split())


def test_null_and_repeated_pages(spark):
    pages = spark.createDataFrame([(1, None, None, 1), (2, "u", "<p>a, b.</p>", 2), (2, "u", "<p>a, b.</p>", 2)], "page_id long, url string, html string, n_chars int")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_tagpath.extract(pages).collect()) == [(1, "", 0), (2, "a, b.", 5), (2, "a, b.", 5)]
    assert html_tagpath.extract(pages.limit(0)).count() == 0


# -- licenses -----------------------------------------------------------------------------------------------


def by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(con.sql(license_minhash.oracle_sql()).fetchall(), key=str)


def test_licenses_match_brute_force(spark):
    rng = random.Random(7)
    words = ["lorem", "ipsum", "licensed", "under", "the", "license", "mit", "software", "permission"]
    rows = [(1, None), (2, ""), (3, "MIT license"), (None, "x " * 9 + "Released under the MIT License. y z"), (5, "Released under the MIT License. " * 3)]
    for k in range(10, 120):
        _, notice = rng.choice(license_minhash.NOTICES)
        own = notice.split()
        for _ in range(rng.choice([0, 0, 1, 4])):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((k, " ".join(rng.choices(words, k=rng.randint(0, 70)) + own + rng.choices(words, k=rng.randint(0, 70)))))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = sorted((tuple(r) for r in license_minhash.scan(docs).collect()), key=str)
    assert got == by_sql(rows)
    assert (None, "MIT", 1.0, 1) in got
    assert license_minhash.scan(docs.limit(0)).count() == 0


def test_edited_notices_are_found_by_their_whole_containment(spark):
    def shingles(text):
        words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    rows, want = [], set()
    for license, notice in license_minhash.NOTICES:
        words = notice.split()
        for k in range(len(words)):
            rows.append((len(rows), " ".join([*["lorem"] * 9, *words[:k], "changed", *words[k + 1 :], *["ipsum"] * 9])))
            best = {}
            for name, other in license_minhash.NOTICES:
                whole = shingles(other)
                share = len(whole & shingles(rows[-1][1])) / len(whole) if whole else 0
                if share >= 0.8:
                    best[name] = max(best.get(name, (0, 0)), (share, len(whole)))
            want |= {(rows[-1][0], name, *x) for name, x in best.items()}
    got = {tuple(r) for r in license_minhash.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 150 and got == want


def test_licenses_use_no_python(spark):
    plan = license_minhash.scan(read_table(spark, SF, "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def test_license_query_is_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op4_license_minhash"]).fetchall()
    assert sorted(map(tuple, queries.op4_license_minhash(spark, SF).collect())) == sorted(want)


# -- contract and pipeline ----------------------------------------------------------------------------------

COLUMNS = {
    "op1_html_tagpath": ("pages", ["page_id", "url", "text", "n_chars"]),
    "op2_token_shards": ("documents", ["doc_id", "start", "n_tokens", "ids_crc32"]),
    "op5_toxicity_kn": ("documents", ["doc_id", "held_out", "score", "predicted"]),
    "op6_langid_segments": ("documents", ["doc_id", "held_out", "lang_pred", "score"]),
    "op7_simhash_ball": ("documents", ["doc_id", "fingerprint", "component_id"]),
    "op8_hmm_lm": ("documents", ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]),
    "op9_telephony": ("documents", ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]),
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, name):
    table, columns = COLUMNS[name]
    df = queries.QUERIES[name](spark, SF)
    assert df.columns[: len(columns)] == columns
    assert df.count() == read_table(spark, SF, table).count()


def test_pipeline_keeps_what_each_stage_keeps(spark):
    docs = read_table(spark, LARGER, "documents")
    columns, before = docs.columns, docs.count()
    extra = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "123 456", "en", "s", 7)], docs.schema)
    current = docs.unionByName(extra)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, current, LARGER).cache()
        assert after.columns == columns
        assert after.exceptAll(current).isEmpty()
        kept[name] = {r["doc_id"] for r in after.select("doc_id").collect()}
        current = after
    toxic = {r["doc_id"] for r in read_table(spark, LARGER, "labels").where("toxic = 1").collect()}
    assert len(kept["toxicity"] & toxic) <= 0.35 * len(toxic)
    assert before + 2 - len(kept["toxicity"]) <= 0.2 * before
    assert kept["toxicity"] - kept["language"] == {10_001, 10_002}
    packed = corpus_pipeline.STAGES[-1][1](spark, current, LARGER)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept["decontamination"]
    whole = corpus_pipeline.run(spark, LARGER)
    assert {r["doc_id"] for r in whole.select("doc_id").distinct().collect()} == kept["decontamination"] - {10_001, 10_002}


def test_entry_without_the_folder(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "brindle", tmp_path / "brindle", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
