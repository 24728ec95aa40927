"""Queries over the driver's tables, one or more for each family of operators, and the same results in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as tx
from brindle.functions import nested, trade
from brindle.operators import corpus, evaluate, evidence, layout, similarity, validate
from brindle.plans import documents
from brindle.plans.schemas import INSTRUCTION
from brindle.plans.shipping import ship_package
from brindle.sources import generators
from brindle.sources.shared import read_texts
from brindle.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    path = f"{sf_dir}/{name}.parquet"
    return read_texts(spark, path) if name in ("documents", "pages") else spark.read.parquet(path)


# SQL of the text rules, as DuckDB writes them
NORM = r"trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
COLLAPSE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
TOKENS = "list_distinct(list_filter(string_split(" + NORM + ", ' '), lambda w: w <> ''))"
COUNT = r"len(list_filter(regexp_split_to_array(coalesce({0}, ''), '\s+'), lambda w: w <> ''))"
norm, collapse, tokens, count = NORM.format, COLLAPSE.format, TOKENS.format, COUNT.format


# -- text and fingerprints ----------------------------------------------------------------------------------


@query(f"SELECT doc_id, sha256({norm('text')}) AS fingerprint, sha256({collapse(chr(39).join(['replace(lower(text), ', 'ß', ', ', 'ss', ')']))}) AS loose FROM documents")
def doc_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.fingerprint(F.col("text")).alias("fingerprint"), tx.loose_fingerprint(F.col("text")).alias("loose"))


@query(f"SELECT sha256({norm('text')}) AS fingerprint, min(doc_id) AS first_id, count(*) AS n_docs FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark, sf_dir):
    return similarity.exact_groups(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY sha256({norm('text')}) ORDER BY doc_id) = 1")
def dedupe_keep_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return similarity.keep_first(docs, [tx.fingerprint(F.col("text"))]).select("doc_id", "n_chars")


@query(
    f"""SELECT doc_id, {norm('text')} AS p01, len({tokens('text')}) AS n_distinct, translate(regexp_replace(replace(lower(source), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '0158', 'oisb') AS folded,
    {COLLAPSE.format("text")} AS collapsed FROM documents"""
)
def text_normal_forms(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text(t).alias("p01"), F.size(tx.token_set(t)).cast("long").alias("n_distinct"), tx.fold_confusables(F.col("source")).alias("folded"), tx.collapse(t).alias("collapsed"))


_SECRETS = r"regexp_replace(regexp_replace(translate(text, chr(13) || chr(10), '  '), '(?i)(\bbearer\s+)[^\s,;]+', '\1[REDACTED]', 'g'), '(?i)((?:api[_-]?key|token|secret)[' || chr(34) || ''']?\s*[:=]\s*[' || chr(34) || ''']?)[^\s' || chr(34) || ''',;&}]+', '\1[REDACTED]', 'g')"


@query(f"SELECT doc_id, {_SECRETS} AS redacted FROM documents")
def redact_secrets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.redact_secrets(F.col("text")).alias("redacted"))


@query("SELECT c_custkey, CASE WHEN length(c_name) > 3 THEN left(c_name, 2) || '***' || right(c_name, 1) ELSE '***' END AS masked FROM customer")
def mask_personal(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", tx.mask_value(F.col("c_name")).alias("masked"))


_HTML = r"trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_HTML} AS text FROM pages")
def html_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.clean_html(F.col("html")).alias("text"))


@query("SELECT string_split(url, '#')[1] AS url, min(page_id) AS first_id, count(*) AS n FROM pages WHERE url IS NOT NULL GROUP BY 1")
def url_dedupe(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", tx.strip_fragment(F.col("url")).alias("url"))
    return pages.groupBy("url").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT page_id, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')[-1], '(.)\\.[^.]*$', '\\1'), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), 70), ''), 'document')
    || '_' || left(sha256(coalesce(html, '')), 12) || '.html' AS name FROM pages WHERE url IS NOT NULL"""
)
def safe_filenames(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where("url IS NOT NULL")
    return pages.select("page_id", tx.safe_filename(F.col("url"), F.sha2(F.coalesce("html", F.lit("")), 256), F.lit("html")).alias("name"))


@query("SELECT doc_id, regexp_matches(text, '[ÇĞİÖŞÜçğıöşü]') OR contains(upper(text), 'ALICI') OR contains(upper(text), 'KONŞİMENTO') OR contains(upper(text), 'GÖNDERİCİ') OR contains(upper(text), 'YÜKLEME LİMANI') OR contains(upper(text), 'BOŞALTMA LİMANI') AS turkish FROM documents")
def turkish_detector(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.is_turkish(F.col("text")).alias("turkish"))


_REP = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"


@query(
    f"""WITH t AS (SELECT doc_id, {_REP} AS w FROM documents), k AS (SELECT doc_id, len(w) AS n, array_to_string(w[s + 1 : s + 64], ' ') AS x FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 64, 0) + 1, 8)) AS s FROM t)),
    r AS (SELECT doc_id, x FROM k WHERE n >= 256 GROUP BY 1, 2 HAVING count(*) >= 15) SELECT doc_id, doc_id IN (SELECT doc_id FROM r) AS repeats FROM documents"""
)
def repetition_guard(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.repetition_guard(F.col("text")).alias("repeats"))


# -- similarity ---------------------------------------------------------------------------------------------

_NEAR = f"""t AS (SELECT doc_id, {tokens('text')} AS t FROM documents), s AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM t),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.w = b.w AND a.doc_id <> b.doc_id AND a.n * 0.9 <= b.n AND b.n * 0.9 <= a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.9
  UNION ALL SELECT a.doc_id, b.doc_id FROM t a JOIN t b ON a.doc_id <> b.doc_id AND len(a.t) = 0 AND len(b.t) = 0)"""


@query(
    f"""WITH RECURSIVE {_NEAR}, r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node),
    g AS (SELECT node, min(root) AS group_id FROM r GROUP BY node), l AS (SELECT a, count(*) AS n FROM p GROUP BY a)
    SELECT g.node AS doc_id, group_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links FROM g LEFT JOIN l ON l.a = g.node"""
)
def source_groups(spark, sf_dir):
    return similarity.source_groups(table(spark, sf_dir, "documents"), threshold=0.9)


_BEST = f"""d AS (SELECT doc_id, {tokens('text')} AS t FROM documents), b AS (SELECT item_id, {tokens('text')} AS u FROM benchmark),
dw AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM d), bw AS (SELECT item_id, len(u) AS m, unnest(u) AS w FROM b),
j AS (SELECT doc_id, item_id, count(*) / (n + m - count(*)) AS s FROM dw JOIN bw USING (w) GROUP BY doc_id, item_id, n, m)"""


@query(f"WITH {_BEST} SELECT doc_id, item_id, round(s, 4) AS similarity FROM j QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, item_id) = 1")
def forbidden_best_match(spark, sf_dir):
    return similarity.best_match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_HOLDS = f"SELECT d.doc_id, b.item_id FROM (SELECT doc_id, ' ' || {norm('text')} || ' ' AS t FROM documents) d JOIN (SELECT item_id, {norm('text')} AS u FROM benchmark) b ON b.u <> '' AND contains(d.t, ' ' || b.u || ' ')"


@query(_HOLDS)
def forbidden_containment(spark, sf_dir):
    return similarity.containing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(f"SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_HOLDS}))")
def decontaminated(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return similarity.without(docs, similarity.containing(docs, table(spark, sf_dir, "benchmark"))).select("doc_id", "source")


@query("SELECT lower(n_name) AS name, s_suppkey, levenshtein(s_name, n_name) AS distance, 1 - levenshtein(replace(lower(s_name), '#', ''), replace(lower(n_name), '_', '')) / greatest(length(replace(lower(s_name), '#', '')), length(replace(lower(n_name), '_', ''))) AS similarity FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def edit_distances(spark, sf_dir):
    both = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    a, b = F.replace(F.lower("s_name"), F.lit("#"), F.lit("")), F.replace(F.lower("n_name"), F.lit("_"), F.lit(""))
    return both.select(F.lower("n_name").alias("name"), "s_suppkey", F.levenshtein("s_name", "n_name").cast("long").alias("distance"), tx.edit_similarity(a, b).alias("similarity"))


# -- corpus -------------------------------------------------------------------------------------------------

_SPLIT = """g AS (SELECT source AS group_id, count(*) AS n, sha256(source || '|42') AS o FROM documents GROUP BY source), s AS (SELECT *, sum(n) OVER (ORDER BY o) AS upto, max(o) OVER () AS last FROM g),
t AS (SELECT greatest(1, CAST(floor(count(*) * 0.1 + 0.5) AS BIGINT)) AS target FROM documents), m AS (SELECT group_id, CASE WHEN upto - n < target AND o <> last THEN 'validation' ELSE 'train' END AS split FROM s, t)"""


@query(f"WITH {_SPLIT} SELECT doc_id, group_id, split FROM documents JOIN m ON source = group_id")
def group_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("group_id"))
    return corpus.group_split(docs).select("doc_id", "group_id", "split")


@query(f"WITH {_SPLIT} SELECT group_id FROM m WHERE split = 'train' INTERSECT SELECT group_id FROM m WHERE split = 'validation'")
def split_isolation(spark, sf_dir):
    split = corpus.group_split(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("group_id")))
    return corpus.shared_values(split.where("split = 'train'"), split.where("split = 'validation'"), "group_id")


@query("SELECT source, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM documents GROUP BY source")
def mix_by_source(spark, sf_dir):
    return corpus.mix(table(spark, sf_dir, "documents"), "source")


@query(
    """WITH o AS (SELECT doc_id, source, sha256(doc_id || '|42') AS o FROM documents), k AS (SELECT CAST(floor(200 * 0.3 / (1 - 0.3) + 0.5) AS INT) AS wanted, count(DISTINCT source) AS f FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY o, doc_id) AS r FROM o) SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (ORDER BY CASE WHEN r > wanted // f THEN 1 ELSE 0 END, CASE WHEN r > wanted // f THEN o END, source, r) AS place, wanted FROM r, k) WHERE place <= wanted"""
)
def replay_sample(spark, sf_dir):
    return corpus.replay_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), new_rows=200)


@query(
    """WITH f AS (SELECT lang AS family, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang), a AS (
    SELECT [family] AS families, n AS total FROM f UNION ALL SELECT [x.family, y.family], x.n + y.n FROM f x JOIN f y ON x.family < y.family
    UNION ALL SELECT [x.family, y.family, z.family], x.n + y.n + z.n FROM f x JOIN f y ON x.family < y.family JOIN f z ON y.family < z.family)
    SELECT array_to_string(families, ',') AS families, CAST(total AS BIGINT) AS total FROM a ORDER BY abs(total - (SELECT count(*) // 3 FROM documents)), -len(families), families LIMIT 1"""
)
def family_combination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    families = docs.where("lang IS NOT NULL").groupBy(F.col("lang").alias("family")).agg(F.count(F.lit(1)).alias("n"))
    best = corpus.closest_combination(families, docs.count() // 3)
    return best.select(F.array_join("families", ",").alias("families"), "total")


@query("SELECT 'quality' AS field, count(*) FILTER (quality IS NOT NULL) AS n FROM labels UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NOT NULL) FROM labels")
def field_presence(spark, sf_dir):
    return corpus.field_presence(table(spark, sf_dir, "labels"), ["quality", "toxic"])


@query(f"SELECT count(*) AS rows, min(n) AS least, max(n) AS most, avg(n) AS mean, (list(n ORDER BY n))[count(*) // 2 + 1] AS median FROM (SELECT {count('text')} AS n FROM documents)")
def token_stats(spark, sf_dir):
    out = corpus.token_statistics(table(spark, sf_dir, "documents"))
    return out.select("rows", *[F.col(c).cast("long").alias(c) for c in ("least", "most")], "mean", F.col("median").cast("long").alias("median"))


@query(f"SELECT CAST({count('text')} // 256 * 256 AS BIGINT) AS bin, count(*) AS n FROM documents GROUP BY 1")
def token_histogram(spark, sf_dir):
    return corpus.token_histogram(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id, {count('text')} AS n_tokens FROM documents ORDER BY 2 DESC, 1 LIMIT 10")
def longest_docs(spark, sf_dir):
    out = corpus.longest(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))


@query(f"SELECT count(*) AS rows, count(*) FILTER (n > 2048) AS over, count(*) FILTER (n <= 2048 AND n >= 1740.8) AS near FROM (SELECT {count('text')} AS n FROM documents)")
def length_gate(spark, sf_dir):
    return corpus.length_gate(table(spark, sf_dir, "documents"))


@query("WITH s AS (SELECT list(n_chars ORDER BY n_chars) AS v FROM documents) SELECT p, v[CAST(floor(p * (len(v) - 1)) AS BIGINT) + 1] AS n_chars FROM s, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) q(p)")
def length_quantiles(spark, sf_dir):
    return corpus.quantiles(table(spark, sf_dir, "documents"), "n_chars", [0.5, 0.9, 0.99])


@query("SELECT conv_id, '<|im_start|>' || string_agg(role || chr(10) || text || '<|im_end|>' || chr(10), '<|im_start|>' ORDER BY turn) AS chat, count(*) AS n FROM conversations GROUP BY conv_id")
def chat_messages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"), F.count(F.lit(1)).alias("n"))
    return turns.select("conv_id", corpus.chat_template(F.col("m")).alias("chat"), "n")


@query("SELECT doc_id, CAST((length(text) > 5000)::INT * 10 + (regexp_matches(text, '[0-9]{3}'))::INT * 8 + (lang <> 'en')::INT * 5 AS INT) AS score, sha256(text) AS hash FROM documents ORDER BY score DESC, hash, doc_id LIMIT 50")
def hard_examples(spark, sf_dir):
    t = F.col("text")
    _, score = corpus.difficulty({"long": (F.length(t) > 5000, 10), "numbers": (t.rlike("[0-9]{3}"), 8), "foreign": (F.col("lang") != "en", 5)})
    return corpus.hard_examples(table(spark, sf_dir, "documents"), score.cast("int"), 50)


@query()
def noise_variants(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    noisy = docs.withColumn("noisy", corpus.character_noise(corpus.substitution_noise(F.col("text"), F.col("doc_id")), F.col("doc_id"), "light"))
    return noisy.select("doc_id", "noisy")


# -- quality, evidence, evaluation --------------------------------------------------------------------------


@query(
    r"""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents), f AS (SELECT doc_id, t, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(t, '[^a-zA-Z\x{00C0}-\x{02FF}]', '', 'g')) AS latin,
    (contains(t, 'bill of lading') OR contains(t, 'shipping instruction') OR contains(t, 'sea waybill'))::INT AS g1, (contains(t, 'shipper') OR contains(t, 'exporter'))::INT AS g2, (contains(t, 'consignee') OR contains(t, 'notify'))::INT AS g3,
    (contains(t, 'port of loading') OR contains(t, 'port of discharge') OR contains(t, 'vessel'))::INT AS g4, (contains(t, 'container') OR contains(t, 'gross weight') OR contains(t, 'packages'))::INT AS g5,
    len(list_filter(['the', 'and', 'shipper', 'consignee', 'port', 'weight', 'container', 'vessel'], lambda w: contains(' ' || t || ' ', ' ' || w || ' '))) AS hits FROM t),
    e AS (SELECT *, g1 + g2 + g3 + g4 + g5 AS g, least(1.0::DOUBLE, 0.6::DOUBLE * CASE WHEN letters = 0 THEN 0::DOUBLE ELSE latin / letters END + 0.4::DOUBLE * least(1.0::DOUBLE, hits / 8)) AS english FROM f)
    SELECT doc_id, CAST(g AS INT) AS groups, round(english, 9) AS english, round(least(100.0::DOUBLE, 20 + least(20.0::DOUBLE, length(t) / 25) + g / 5 * 40 + english * 10), 6) AS score, g1 = 1 AND g >= 3 AS relevant FROM e"""
)
def quality_gate(spark, sf_dir):
    out = validate.quality_gate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("groups").cast("int").alias("groups"), F.round("english", 9).alias("english"), F.round("quality_score", 6).alias("score"), "relevant")


_FOLD = r"translate(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', '', 'g'), '0158', 'oisb')"


@query()
def evidence_scores(spark, sf_dir):
    """How far each conversation's other turns support its first. DuckDB's edit distance counts bytes, so a
    plain loop tests this."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("turn = 0").select("conv_id", F.col("text").alias("value"))
    told = turns.where("turn > 0").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return evidence.fuzzy_evidence(asked.join(told, "conv_id")).select("conv_id", "evidence_score", "evidence_status")


_PAIRS = "p AS (SELECT d.doc_id, d.lang AS category, k AS path, CASE k WHEN 'toxic' THEN CAST(toxic AS VARCHAR) ELSE CAST(quality AS VARCHAR) END AS e, CASE k WHEN 'toxic' THEN CASE WHEN d.n_chars % 7 = 0 THEN NULL WHEN d.n_chars % 5 = 0 THEN '1' ELSE '0' END ELSE CASE WHEN d.n_chars > 500 THEN '1' ELSE '0' END END AS a FROM documents d JOIN labels USING (doc_id), (VALUES ('toxic'), ('quality')) v(k))"


@query(
    f"""WITH {_PAIRS}, s AS (SELECT category, CASE WHEN e IS NOT DISTINCT FROM a THEN 'correct' WHEN a IS NULL THEN 'missing' ELSE 'mismatch' END AS state FROM p),
    n AS (SELECT category, count(*) FILTER (state = 'correct') AS tp, 0::BIGINT AS fp, count(*) FILTER (state = 'missing') AS fn, count(*) FILTER (state = 'mismatch') AS mismatches, count(*) AS fields FROM s GROUP BY category),
    r AS (SELECT *, round(tp * 100.0::DOUBLE / fields, 2) AS accuracy, CASE WHEN tp + fp = 0 THEN 100.0::DOUBLE ELSE round(tp * 100.0::DOUBLE / (tp + fp), 2) END AS precision, CASE WHEN tp + fn = 0 THEN 100.0::DOUBLE ELSE round(tp * 100.0::DOUBLE / (tp + fn), 2) END AS recall FROM n)
    SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE round(2 * precision * recall / (precision + recall), 2) END AS f1 FROM r"""
)
def eval_by_category(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    case = both.withColumn("case", F.struct("doc_id", "lang"))
    toxic = F.when(F.col("n_chars") % 7 == 0, F.lit(None)).when(F.col("n_chars") % 5 == 0, F.lit("1")).otherwise(F.lit("0"))
    long = F.when(F.col("n_chars") > 500, F.lit("1")).otherwise(F.lit("0"))
    field = lambda p, v: F.struct(F.lit(p).alias("path"), v.cast("string").alias("value"))
    expected = case.select("case", F.inline(F.array(field("toxic", F.col("toxic")), field("quality", F.col("quality")))))
    actual = case.select("case", F.inline(F.array(field("toxic", toxic), field("quality", long))))
    compared = evaluate.compare_fields(expected, actual).withColumn("category", F.col("case.lang"))
    return evaluate.scores(compared, ["category"])


# -- events -------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events")
def sliding_count(spark, sf_dir):
    return streams.sliding_count(table(spark, sf_dir, "events"), key="user_id", time="ts", seconds=3600).select("event_id", "user_id", "in_window")


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n_events FROM events GROUP BY user_id")
def latest_status(spark, sf_dir):
    return streams.latest_status(table(spark, sf_dir, "events"), key="user_id", order="ts", columns=["event_id"])


@query(
    """WITH i AS (SELECT user_id AS batch_id, event_id AS position, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'COMPLETED' WHEN 'click' THEN 'PROCESSING' ELSE 'QUEUED' END AS s FROM events)
    SELECT batch_id, count(*) AS items, count(*) FILTER (s IN ('COMPLETED', 'ERROR')) AS done, count(*) FILTER (s = 'ERROR') AS errors, coalesce(min(position) FILTER (s = 'PROCESSING'), min(position) FILTER (s = 'QUEUED')) AS current, round(count(*) FILTER (s IN ('COMPLETED', 'ERROR')) * 100.0::DOUBLE / count(*), 1) AS percent FROM i GROUP BY batch_id"""
)
def batch_progress(spark, sf_dir):
    kind = F.col("event_type")
    items = table(spark, sf_dir, "events").select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("position"), F.when(kind == "error", F.lit("ERROR")).when(kind == "purchase", F.lit("COMPLETED")).when(kind == "click", F.lit("PROCESSING")).otherwise(F.lit("QUEUED")).alias("status"))
    return streams.batch_progress(items)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf_dir):
    return streams.windowed_counts(table(spark, sf_dir, "events"), time="ts", by=["event_type"])


@query()
def rate_limited_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return streams.limited(events, key="user_id", time="ts", limit=3, seconds=3600, schema="event_id long, user_id long, ts timestamp_ntz, allowed boolean, retry_after int" if dict(events.dtypes)["ts"] == "timestamp_ntz" else "event_id long, user_id long, ts timestamp, allowed boolean, retry_after int")


# -- shipping rules on the relational tables ----------------------------------------------------------------

_NUM = "CASE WHEN p_partkey % 4 = 0 THEN printf('%.2f', p_retailprice) WHEN p_partkey % 4 = 1 THEN replace(printf('%.2f', p_retailprice), '.', ',') WHEN p_partkey % 4 = 2 THEN '1.' || replace(printf('%.2f', 100 + p_retailprice % 900), '.', ',') ELSE '1,' || printf('%.2f', 100 + p_retailprice % 900) END"


@query(
    f"""SELECT p_partkey, raw, TRY_CAST(CASE WHEN contains(raw, ',') AND contains(raw, '.') THEN CASE WHEN length(raw) - instr(reverse(raw), '.') > length(raw) - instr(reverse(raw), ',') THEN replace(raw, ',', '') ELSE replace(replace(raw, '.', ''), ',', '.') END
    WHEN contains(raw, ',') THEN CASE WHEN instr(reverse(raw), ',') - 1 IN (1, 2) AND raw NOT LIKE ',%' THEN replace(raw, ',', '.') ELSE replace(raw, ',', '') END ELSE raw END AS DOUBLE) AS value FROM (SELECT p_partkey, {_NUM} AS raw FROM part)"""
)
def number_parse(spark, sf_dir):
    price, k = F.col("p_retailprice"), F.col("p_partkey") % 4
    two = lambda c: F.format_string("%.2f", c)
    small = two(100 + price % 900)
    raw = F.when(k == 0, two(price)).when(k == 1, F.replace(two(price), F.lit("."), F.lit(","))).when(k == 2, F.concat(F.lit("1."), F.replace(small, F.lit("."), F.lit(",")))).otherwise(F.concat(F.lit("1,"), small))
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    return rows.select("p_partkey", "raw", trade.parse_number(F.col("raw")).alias("value"))


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T08:30:00' END AS moment FROM orders"""
)
def date_normalise(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "yyyy/MM/dd"))
    moment = F.concat(F.date_format(d, "dd-MM-yyyy"), F.when(F.col("o_orderkey") % 3 == 2, F.lit(" 25:00")).otherwise(F.lit(" 8:30")))
    return orders.select("o_orderkey", trade.normalize_date(day).alias("day"), trade.normalize_date(moment).alias("moment"))


_REF = "'MSKU' || lpad(CAST((s_suppkey * 7919) % 10000000 AS VARCHAR), 7, '0')"
_ISO = " + ".join(f"(CASE substr(r, {k + 1}, 1) " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in (("M", 24), ("S", 30), ("K", 21), ("U", 32))) + f" ELSE TRY_CAST(substr(r, {k + 1}, 1) AS INT) END) * {2 ** k}" for k in range(10))


@query(f"SELECT s_suppkey, r AS reference, ({_ISO}) % 11 % 10 = CAST(substr(r, 11, 1) AS INT) AS valid FROM (SELECT s_suppkey, {_REF} AS r FROM supplier)")
def iso6346(spark, sf_dir):
    ref = F.concat(F.lit("MSKU"), F.lpad((F.col("s_suppkey") * 7919 % 10_000_000).cast("string"), 7, "0"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", ref.alias("reference"), trade.iso6346(ref).alias("valid"))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'CT' WHEN 1 THEN 'PL' WHEN 2 THEN 'IBC' WHEN 3 THEN 'DR' ELSE p_type END AS package, CASE p_partkey % 3 WHEN 0 THEN '45G1' WHEN 1 THEN '22R1' ELSE NULL END AS equipment,
    CASE p_partkey % 2 WHEN 0 THEN 'CZ' ELSE 'OWNER' END AS role, CASE p_partkey % 2 WHEN 0 THEN 'HAMBURG' ELSE 'IZMIR' END AS port FROM part"""
)
def code_maps(spark, sf_dir):
    k = F.col("p_partkey")
    package = F.when(k % 5 == 0, F.lit("cartons")).when(k % 5 == 1, F.lit(" Plt")).when(k % 5 == 2, F.lit("TOTE")).when(k % 5 == 3, F.lit("drum")).otherwise(F.col("p_type"))
    equipment = F.when(k % 3 == 0, F.lit("40' high cube")).when(k % 3 == 1, F.lit("20 Reefer")).otherwise(F.lit("99 BOX"))
    role = F.when(k % 2 == 0, F.lit("exporter")).otherwise(F.lit("OWNER"))
    port = F.when(k % 2 == 0, F.lit("DEHAM HAMBURG PORT")).otherwise(F.lit("IZMIR"))
    return table(spark, sf_dir, "part").select("p_partkey", trade.packaging_code(package).alias("package"), trade.equipment_code(equipment).alias("equipment"), trade.role_code(role).alias("role"), trade.port_name(port).alias("port"))


@query(
    """WITH l AS (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n, count(*) FILTER (l_discount = 0) AS free FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, o_totalprice, q, n, free FROM orders JOIN l ON o_orderkey = l_orderkey),
    p AS (SELECT o_orderkey, CAST((CASE WHEN q <= 0 THEN 20 ELSE 0 END) + (CASE WHEN q > 150 THEN 20 ELSE 0 END) + free * 5 + 15 AS BIGINT) AS points FROM o) SELECT o_orderkey, least(100, points) AS risk, 100 - least(100, points) AS confidence FROM p"""
)
def nested_audit(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count_if(F.col("l_discount") == 0).alias("free"))
    both = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    found = validate.findings(validate.positive_finding(F.col("q"), "quantity", "quantity"), validate.finding(F.col("q") > 150, "weight", "weight"))
    score, sure = validate.risk(found, F.col("free"), F.lit(True), F.lit(""))
    return both.select("o_orderkey", score.alias("risk"), sure.alias("confidence"))


@query("SELECT o_orderkey, 'items[' || (row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, nullif(l_discount, 0) NULLS FIRST) - 1) || '].discount' AS path, l_discount FROM orders JOIN lineitem ON o_orderkey = l_orderkey QUALIFY l_discount = 0".replace(", l_discount FROM", " FROM"))
def mandatory_fields(spark, sf_dir):
    item = F.struct("l_linenumber", "l_partkey", F.nullif(F.col("l_discount"), F.lit(0.0)).alias("discount"))
    nested = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    kept = table(spark, sf_dir, "orders").select("o_orderkey").join(nested, "o_orderkey")
    return validate.mandatory_fields(kept, [], {"items": ["discount"]}, key="o_orderkey")


_BOX = "b AS (SELECT l_orderkey AS doc, l_linenumber, l_partkey, l_shipdate, l_quantity * 20 AS y_min, CAST(l_linenumber * 100 AS DOUBLE) AS x_min FROM lineitem)"


@query(f"WITH {_BOX} SELECT doc, l_linenumber, l_partkey, CASE WHEN y_min < 1000 * 0.35 THEN 'upper' WHEN y_min < 1000 * 0.65 THEN 'middle' ELSE 'lower' END AS region FROM b")
def region_split(spark, sf_dir):
    y = F.col("l_quantity") * 20
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_linenumber", "l_partkey", layout.region(y, F.lit(1000)).alias("region"))


@query()
def layout_lines(spark, sf_dir):
    """The lines of boxes made from line items; an ordered fold, tested against a plain loop."""
    items = table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_linenumber") * 100).cast("double"), F.floor(F.col("l_quantity") / 10) * 30 + F.col("l_discount") * 10
    text = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    boxes = items.select(F.col("l_orderkey").alias("doc"), F.lit(0).alias("page"), text.alias("text"), x.alias("x_min"), y.alias("y_min"), (x + 8.0 * F.length(text)).alias("x_max"), (y + 20.0).alias("y_max"))
    lines = layout.line_texts(layout.group_lines(boxes, ["doc", "page"]), ["doc", "page", "line"])
    return layout.page_texts(lines, ["doc", "page"])


@query(
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 25 ELSE 5 END AS risk, 'DRAFT' AS grade, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS n_findings, 1 AS n_missing, 'BK' || o_orderkey AS booking, strftime(o_orderdate, '%Y-%m-%d') AS issued, c_name AS shipper, CASE WHEN o_orderkey % 3 <> 0 THEN 'ACME LTD' END AS consignee,
    'IZMIR' AS loading, '45G1' AS kind, 2 AS n_containers, 18750.0::DOUBLE AS gross, 1 AS n_items, 12.5::DOUBLE AS volume, 'COL' AS freight FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def document_pipeline(spark, sf_dir):
    """Instructions written from orders, read back by the pattern extractor, normalised, validated and graded."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey").cast("string")
    text = F.concat_ws("\n", F.concat(F.lit("BOOKING NO: BK"), key), F.concat(F.lit("SHIPPER: "), F.col("c_name")), F.when(F.col("o_orderkey") % 3 != 0, F.lit("CONSIGNEE: ACME LTD.")), F.concat(F.lit("DATE: "), F.date_format("o_orderdate", "dd.MM.yyyy")), F.lit("PORT OF LOADING: TRIZM IZMIR"), F.concat(generators.reference(key, F.lit("1"), 7), F.lit(" 40HC GROSS: 18,750.00 KG")), F.lit("TEA 12.5 CBM"), F.lit("FREIGHT COLLECT"))
    done = documents.process(orders.select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))
    i = F.col("instruction")
    party = lambda role: F.get(F.filter(i["parties"], lambda p: p["party_role_code"] == role), F.lit(0))["party_name"]
    first, item = F.get(i["equipment_list"], F.lit(0)), F.get(i["cargo_items"], F.lit(0))
    return done.select(
        "doc_id", "risk", "grade", F.size("findings").alias("n_findings"), "n_missing", i["carrier_booking_reference"].alias("booking"), i["issue_date"].alias("issued"), party("CZ").alias("shipper"), party("CN").alias("consignee"), F.get(i["transport_plans"], F.lit(0))["port_of_loading"]["location_name"].alias("loading"),
        first["iso_equipment_code"].alias("kind"), F.size(i["equipment_list"]).alias("n_containers"), first["cargo_gross_weight"]["weight"].alias("gross"), F.size(i["cargo_items"]).alias("n_items"), item["volume"]["volume_value"].alias("volume"), i["freight_payment_term_code"].alias("freight"),
    )


@query()
def synthetic_instructions(spark, sf_dir):
    """A fixed number of generated rows of each kind."""
    return generators.multi_container(spark, 1000).select("id", "n_containers", "text").unionByName(generators.turkish(spark, 1000).select("id", "n_containers", "text"))


@query(
    """SELECT o_orderkey AS id, 'SI' || o_orderkey AS reference, 'BK' || o_custkey AS booking, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE c_name END AS shipper, 'ACME' AS consignee, CASE WHEN o_orderkey % 2 = 0 THEN c_mktsegment END AS notify,
    'IZMIR' AS loading, NULL::VARCHAR AS discharge, (SELECT string_agg('C' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber % 2 = 1) AS containers FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber % 2 = 1)"""
)
def erp_flatten(spark, sf_dir):
    """Nested instructions flattened to the rows of an ERP system; null and blank containers go."""
    reference = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("C"), F.col("l_partkey").cast("string"))).otherwise(F.when(F.col("l_linenumber") % 4 == 0, F.lit(" ")))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", reference.alias("r")))).alias("x"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(lines.where(F.exists("x", lambda x: x["l_linenumber"] % 2 == 1)), F.col("o_orderkey") == F.col("l_orderkey"))
    party = lambda role, name: F.struct(role.alias("party_role_code"), name.alias("party_name"))
    shipper = F.when(F.col("o_orderkey") % 5 == 0, F.lit("FW")).when(F.col("o_orderkey") % 5 == 1, F.lit("SHI")).otherwise(F.lit("CZ"))
    parties = F.array(party(F.lit("CN"), F.lit("ACME")), party(shipper, F.col("c_name")), party(F.when(F.col("o_orderkey") % 2 == 0, F.lit("N1")), F.col("c_mktsegment")))
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    plans = F.array(F.struct(F.struct(F.lit("IZMIR").alias("location_name")).alias("port_of_loading")))
    body = F.struct(text("SI", "o_orderkey").alias("shipping_instruction_reference"), text("BK", "o_custkey").alias("carrier_booking_reference"), parties.alias("parties"), plans.alias("transport_plans"), F.transform("x", lambda x: F.struct(x["r"].alias("equipment_reference"))).alias("equipment_list"))
    rows = orders.select("o_orderkey", F.from_json(F.to_json(body), INSTRUCTION).alias("i"))
    return rows.select(F.col("o_orderkey").alias("id"), *nested.erp_row(F.col("i"))).withColumn("containers", F.array_join("containers", ","))


# -- more joins, decisions and layouts ----------------------------------------------------------------------


@query(
    f"""WITH v AS (SELECT conv_id, string_split({norm('text')}, ' ')[2] AS value FROM conversations WHERE turn = 0), t AS (SELECT conv_id, text FROM conversations WHERE turn = 1)
    SELECT v.conv_id, value, CASE WHEN {_FOLD.format('value').replace("translate(", "", 1).rsplit(", '0158'", 1)[0]} <> '' AND contains({_FOLD.format('text').replace("translate(", "", 1).rsplit(", '0158'", 1)[0]}, {_FOLD.format('value').replace("translate(", "", 1).rsplit(", '0158'", 1)[0]}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM v JOIN t USING (conv_id)"""
)
def evidence_strong(spark, sf_dir):
    """does the answer hold the question's second word as an identifier?"""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("turn = 0").select("conv_id", F.get(F.split(tx.normalize_text(F.col("text")), " "), F.lit(1)).alias("value"))
    both = asked.join(turns.where("turn = 1").select("conv_id", "text"), "conv_id")
    return both.select("conv_id", "value", evidence.strong_evidence(F.col("value"), F.col("text")).alias("score"))


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_orderkey % 10 AS page, l_linenumber * 100.0::DOUBLE AS cx, l_quantity * 20 AS cy FROM lineitem), r AS (SELECT s_suppkey AS rank, s_name AS name, s_suppkey % 10 AS page, (s_suppkey * 37 % 500)::DOUBLE AS a, (s_suppkey * 91 % 700)::DOUBLE AS b, (s_suppkey * 37 % 500 + 250)::DOUBLE AS c, (s_suppkey * 91 % 700 + 300)::DOUBLE AS d FROM supplier)
    SELECT l_orderkey, l_linenumber, l_partkey, (SELECT arg_min(name, rank) FROM r WHERE r.page = b.page AND cx BETWEEN r.a AND r.c AND cy BETWEEN r.b AND r.d) AS region FROM b"""
)
def region_join(spark, sf_dir):
    """Boxes to the first rectangle of their page that holds their centre."""
    x, y, s = (F.col("l_linenumber") * 100).cast("double"), F.col("l_quantity") * 20, F.col("s_suppkey")
    boxes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_orderkey") % 10).alias("page"), (x - 5).alias("x_min"), (x + 5).alias("x_max"), (y - 5).alias("y_min"), (y + 5).alias("y_max"))
    left, top = (s * 37 % 500).cast("double"), (s * 91 % 700).cast("double")
    regions = table(spark, sf_dir, "supplier").select((s % 10).alias("page"), s.alias("rank"), F.col("s_name").alias("name"), left.alias("x_min"), top.alias("y_min"), (left + 250).alias("x_max"), (top + 300).alias("y_max"))
    return layout.boxes_in_regions(boxes, regions, ["page"]).select("l_orderkey", "l_linenumber", "l_partkey", "region")


@query(
    """WITH b AS (SELECT l_orderkey AS doc, l_linenumber * 100.0::DOUBLE AS x_min, 'P' || l_partkey AS text FROM lineitem), c AS (SELECT *, x_min + 8.0::DOUBLE * length(text) AS x_max FROM b),
    g AS (SELECT *, row_number() OVER w AS place, x_min - lag(x_max) OVER w AS gap, lag(greatest(1.0::DOUBLE, (x_max - x_min) / greatest(length(text), 1))) OVER w AS width FROM c WINDOW w AS (PARTITION BY doc ORDER BY x_min, x_max, text)),
    p AS (SELECT *, CASE WHEN gap IS NULL THEN '' ELSE repeat(' ', greatest(1, CAST(floor(gap / width * 0.15) AS INT))) END || text AS piece FROM g) SELECT doc, string_agg(piece, '' ORDER BY place) AS text FROM p GROUP BY doc"""
)
def line_texts(spark, sf_dir):
    """Each order's boxes as one line, gaps as spaces."""
    text = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    x = (F.col("l_linenumber") * 100).cast("double")
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), text.alias("text"), x.alias("x_min"), (x + 8.0 * F.length(text)).alias("x_max"))
    return layout.line_texts(boxes, ["doc"])


@query(f"WITH m AS (SELECT sha256({norm('text')}) AS f, doc_id % 10 = 0 AS v FROM documents) SELECT count(*) AS shared FROM (SELECT f FROM m WHERE v INTERSECT SELECT f FROM m WHERE NOT v)")
def overlap_counts(spark, sf_dir):
    """Fingerprints that a validation and a training part share."""
    marked = table(spark, sf_dir, "documents").select(tx.fingerprint(F.col("text")).alias("f"), (F.col("doc_id") % 10 == 0).alias("v"))
    return corpus.shared_values(marked.where("v"), marked.where("NOT v"), "f").agg(F.count(F.lit(1)).alias("shared"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def undelivered_orders(spark, sf_dir):
    """Orders without a successful delivery in the log."""
    from brindle.sources.files import undelivered

    log = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linestatus") == "F", F.lit("success")).otherwise(F.lit("error")).alias("status"))
    return undelivered(table(spark, sf_dir, "orders"), log, "o_orderkey").select("o_orderkey", "o_custkey")


@query(
    """SELECT doc_id, CASE WHEN n_chars = 0 THEN 'error' WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'duplicate' WHEN lang <> 'en' OR english < 0.72 THEN 'rejected' WHEN score >= 60 THEN 'accepted' ELSE 'pending_review' END AS status
    FROM (SELECT doc_id, n_chars, lang, CASE WHEN n_chars % 3 = 0 THEN 0.5 ELSE 0.9 END AS english, n_chars % 100 AS score FROM documents)"""
)
def acceptance(spark, sf_dir):
    """the precedence of the decisions."""
    docs = table(spark, sf_dir, "documents")
    known = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("known"))
    n = F.col("n_chars")
    status = validate.acceptance(F.coalesce("known", F.lit(False)), n == 0, F.col("lang") == "en", F.when(n % 3 == 0, 0.5).otherwise(0.9), n % 100)
    return docs.join(known.distinct(), "doc_id", "left").select("doc_id", status.alias("status"))


@query("SELECT a.l_orderkey, CASE WHEN a.h IS NOT DISTINCT FROM b.h THEN '' ELSE 'quantity' END AS changed FROM (SELECT l_orderkey, sum(l_quantity) AS h FROM lineitem GROUP BY 1) a JOIN (SELECT l_orderkey, sum(l_quantity) + max(l_orderkey % 2) AS h FROM lineitem GROUP BY 1) b USING (l_orderkey)")
def repeat_runs(spark, sf_dir):
    """Which values of two runs differ, by case."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"))
    second = sums.withColumn("quantity", F.col("quantity") + F.col("l_orderkey") % 2)
    return evaluate.changed_between_runs(sums, second, ["quantity"], case="l_orderkey").select("l_orderkey", F.array_join("changed", ",").alias("changed"))


@query("SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: len(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda j: abs(j - i) <= 1 AND contains(lower(string_split(text, chr(10))[j]), 'license'))) > 0), chr(10)) AS excerpt FROM documents WHERE contains(lower(text), 'license')")
def context_excerpts(spark, sf_dir):
    """Lines about licenses with a line of context on both sides."""
    docs = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("license")))
    return docs.select("doc_id", layout.context_excerpt(F.col("text"), ["license"], 1).alias("excerpt"))


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment, true AS same FROM customer")
def xml_roundtrip(spark, sf_dir):
    """Structs to XML and back."""
    from brindle.sources.files import to_xml

    rows = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit(None).cast("string").alias("note")).alias("s"))
    back = rows.withColumn("x", to_xml(rows, "s", "Party")).withColumn("b", F.from_xml("x", "name string, segment string, note string", {"rowTag": "Party"}))
    return back.select("c_custkey", "b.name", "b.segment", (F.col("b").eqNullSafe(F.col("s"))).alias("same"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'TRAIN-' || p_partkey ELSE 'fp:' || sha256(upper(p_name || '|' || p_brand || '|' || p_type)) END AS family, sha256(p_name || '|' || p_brand) AS duplicate FROM part")
def family_keys(spark, sf_dir):
    """Family and duplicate keys."""
    part = table(spark, sf_dir, "part")
    ref = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" TRAIN-"), F.col("p_partkey").cast("string"), F.lit(" ")))
    return part.select(F.col("p_partkey").alias("id"), corpus.family_key(ref, F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("family"), corpus.duplicate_key(F.col("p_name"), F.col("p_brand")).alias("duplicate"))
