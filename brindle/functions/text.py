"""Text normalisation, fingerprints, similarity, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of settings whose value is a secret.
SECRET_NAMES = ["api key", "token", "secret"]


def _secret_patterns() -> list[str]:
    """Rules in order; group 1 stays, what follows it is hidden: what a bearer brings, and the value that a secret's name
    is set to, in quotes or not, up to white space, a quote, a comma, a semicolon, a closing brace or the next setting
    of an address."""
    name = "(?:" + "|".join(n.replace(" ", "[_-]?") for n in SECRET_NAMES) + ")"
    return [r"(?i)(\bbearer\s+)[^\s,;]+", rf"(?i)({name}[\"']?\s*[:=]\s*[\"']?)[^\s\"',;&}}]+"]


SECRET_PATTERNS = _secret_patterns()
#: Letters and words that tell Turkish.
TURKISH_LETTERS = "ÇĞİÖŞÜçğıöşü"
TURKISH_MARKERS = ["KONŞİMENTO", "GÖNDERİCİ", "ALICI", "YÜKLEME LİMANI", "BOŞALTMA LİMANI"]


def casefold(c: Column) -> Column:
    """Lower case with the sharp s spelled out; equals full case folding on Latin text."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def normalize_text(c: Column) -> Column:
    """Case-folded words of letters, digits and underscores, one space between them."""
    return F.trim(F.regexp_replace(casefold(c), r"[^\p{L}\p{N}_]+", " "))


def fingerprint(c: Column) -> Column:
    """SHA-256 of the normalised text."""
    return F.sha2(normalize_text(c), 256)


def loose_fingerprint(c: Column) -> Column:
    """SHA-256 of the case-folded text with white space collapsed; marks stay."""
    return F.sha2(collapse(casefold(c)), 256)


def collapse(c: Column) -> Column:
    """White space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def boilerplate_key(c: Column) -> Column:
    """A line as it is compared: collapsed and case-folded."""
    return casefold(collapse(c))


def normalize_identifier(c: Column) -> Column:
    """Letters and digits only, case-folded."""
    return F.regexp_replace(casefold(c), r"[^\p{L}\p{N}]+", "")


def fold_confusables(c: Column) -> Column:
    """P04 with the digits that readers of scans confuse with letters."""
    return F.translate(normalize_identifier(c), "0158", "oisb")


def token_set(c: Column) -> Column:
    """Distinct words of the normalised text; the empty text has none."""
    return F.array_distinct(F.filter(F.split(normalize_text(c), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length of two folded tokens; 1 if both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def clean_html(c: Column) -> Column:
    """P10: tags to spaces, the five named references and the numeric apostrophe decoded, white space collapsed."""
    out = F.regexp_replace(c, r"<[^>]+>", " ")
    for mark, text in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(mark), F.lit(text))
    return collapse(out)


def strip_fragment(url: Column) -> Column:
    """The address without its fragment."""
    return F.substring_index(url, "#", 1)


def safe_filename(url: Column, sha256: Column, kind: Column) -> Column:
    """The decoded stem of the path in safe characters, at most 70, with 12 digits of the hash and the type."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    name = F.element_at(F.split(F.url_decode(path), "/"), -1)
    stem = F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), r"[^A-Za-z0-9._-]+", "_")
    stem = F.left(F.regexp_replace(stem, r"^[._-]+|[._-]+$", ""), F.lit(70))
    return F.concat(F.when(stem == "", F.lit("document")).otherwise(stem), F.lit("_"), F.left(sha256, F.lit(12)), F.lit("."), kind)


def query_url(query: Column, base: str = "https://www.google.com/search?q=") -> Column:
    """A search address; spaces become plus signs."""
    return F.concat(F.lit(base), F.url_encode(query))


def redact_secrets(c: Column, longest: int | None = None) -> Column:
    """One line, secrets hidden; cut at `longest` characters if that is given (a log's lines are at most 4000)."""
    out = F.translate(c, "\r\n", "  ")
    for pattern in SECRET_PATTERNS:
        out = F.regexp_replace(out, pattern, "$1[REDACTED]")
    return out if longest is None else F.left(out, F.lit(longest))


def mask_value(c: Column) -> Column:
    """P15, one value: the first two and the last character, or stars alone for up to three; blank stays."""
    return F.when(c.isNull() | (F.trim(c) == ""), c).when(F.length(c) > 3, F.concat(F.left(c, F.lit(2)), F.lit("***"), F.right(c, F.lit(1)))).otherwise(F.lit("***"))


def is_turkish(c: Column) -> Column:
    """A Turkish letter, or a marker word in the upper-cased text."""
    out = c.rlike(f"[{TURKISH_LETTERS}]")
    for marker in TURKISH_MARKERS:
        out = out | F.upper(c).contains(marker)
    return F.coalesce(out, F.lit(False))


def comparison_value(c: Column) -> Column:
    """N03, text: case-folded and collapsed. Numbers are rounded to six digits by comparison_number."""
    return boilerplate_key(c)


def comparison_number(c: Column) -> Column:
    """N03, numbers."""
    return F.round(c.cast("double"), 6)


def labelled_value(text: Column, patterns: list[tuple[str, int]]) -> Column:
    """Of patterns in order, the first with a non-empty group; trimmed, final dots removed."""
    def one(pattern: str, group: int) -> Column:
        value = F.trim(F.regexp_replace(F.trim(F.regexp_extract(text, pattern, group)), r"\.+$", ""))
        return F.get(F.filter(F.array(value), lambda v: v != ""), F.lit(0))  # the array binds the value, so it is computed once

    return F.coalesce(*[one(p, g) for p, g in patterns])


def tokens_for_repetition(c: Column) -> Column:
    """Words and single marks, as the repetition guard counts them."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))


def repetition_guard(c: Column, *, window: int = 64, stride: int = 8, count: int = 15, least: int = 256) -> Column:
    """does one window of tokens, cut every `stride` tokens, occur `count` times or more? False under `least` tokens."""
    tokens = tokens_for_repetition(c)
    # one-element arrays bind the tokens, so they are computed once
    starts = lambda t: F.sequence(F.lit(0), F.greatest(F.size(t) - window, F.lit(0)), F.lit(stride))
    hashes = lambda t: F.array_sort(F.transform(starts(t), lambda k: F.xxhash64(F.slice(t, k + 1, window))))
    # in sorted order a value that occurs `count` times equals the one count - 1 places on
    repeated = lambda h: F.exists(F.transform(h, lambda x, k: x == F.get(h, k + count - 1)), lambda y: F.coalesce(y, F.lit(False)))
    judged = F.transform(F.array(tokens), lambda t: F.when(F.size(t) < least, F.lit(False)).otherwise(F.get(F.transform(F.array(hashes(t)), repeated), F.lit(0))))
    return F.coalesce(F.get(judged, F.lit(0)), F.lit(False))


def mask_fields(value: Column, paths: list[str]) -> Column:
    """P15, a struct: the named text fields masked; a path leads through structs by dots."""
    out = value
    for path in paths:
        at = value
        for name in path.split("."):
            at = at[name]
        out = out.withField(path, mask_value(at))
    return out


def compose(c: Column) -> Column:
    """Canonical composition (NFC), which Spark lacks: an Arrow batch at a time, and only where a character isn't ASCII."""
    import unicodedata

    def nfc(x):
        return x.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    nfc = F.pandas_udf(nfc, "string", F.PandasUDFType.SCALAR)
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(nfc(c))


def repair_utf8(c: Column) -> Column:
    """Composed text; where the whole text is UTF-8 that was read as Latin-1, it is read anew, if that is valid."""
    mixed = c.rlike(r"[\x{00C2}-\x{00F4}][\x{0080}-\x{00BF}]") & ~c.rlike(r"[^\x{0000}-\x{00FF}]")
    return compose(F.coalesce(F.when(mixed, F.try_validate_utf8(F.encode(c, "ISO-8859-1").cast("string"))), c))


def relevance_payload(title: Column, snippet: Column, url: Column, excerpt: Column, most: int = 4000) -> Column:
    """What a reviewer is shown, each part cut to its length."""
    source = F.struct(F.left(title, F.lit(300)).alias("title"), F.left(snippet, F.lit(600)).alias("snippet"), F.left(url, F.lit(1000)).alias("url"))
    return F.struct(F.lit("topic_and_english_filter_only_no_quality_scoring").alias("task"), source.alias("source"), F.left(excerpt, F.lit(most)).alias("limited_text_excerpt"))


def join_regions(upper: Column, middle: Column, lower: Column) -> Column:
    """P20: the three regions' texts with the fixed marks between them."""
    return F.concat(F.coalesce(upper, F.lit("")), F.lit("\n\n--- ORTA BOLGE ---\n\n"), F.coalesce(middle, F.lit("")), F.lit("\n\n--- ALT BOLGE ---\n\n"), F.coalesce(lower, F.lit("")))


def tracking_number(moment: Column) -> Column:
    """The day, and the first five digits of the time."""
    return F.concat(F.lit("ERP-"), F.date_format(moment, "yyyyMMdd"), F.lit("-"), F.left(F.date_format(moment, "HHmmssSSSSSS"), F.lit(5)))


#: Names of layout engines.
LAYOUTS = {
    "hybrid": "Florence-2 VLM",
    "hybrid_partial_fallback": "Florence-2 VLM + bazı sayfalarda Y-Oranı Fallback",
    "y_ratio_fallback": "Florence-2 başarısız → Y-Oranı Fallback",
    "y_ratio": "Y-Orani Ayrıştırması",
    "off": "Duz OCR",
}


def layout_label(c: Column) -> Column:
    """Known engines to their names; others stay."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LAYOUTS.items() for x in pair]), c), c)
