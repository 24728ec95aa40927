"""How well a document's text supports extracted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.nested import let
from brindle.functions.text import edit_similarity, fold_confusables, normalize_identifier, normalize_text

#: The last part of paths whose values must stand in the text as they are.
STRONG = ["equipment_reference", "seal_number", "carrier_booking_reference", "shipping_instruction_reference", "transport_document_reference", "un_number", "hs_code", "tax_id", "vessel_imo_number"]
SUPPORTED, UNCERTAIN, SIMILAR = 0.8, 0.5, 0.8


def strong_evidence(value: Column, text: Column) -> Column:
    """1 if the value's letters and digits stand in the text's, else 0."""
    v = normalize_identifier(value)
    return F.when((v != "") & F.contains(normalize_identifier(text), v), F.lit(1.0)).otherwise(F.lit(0.0))


def status(score: Column) -> Column:
    return F.when(score >= SUPPORTED, F.lit("supported")).when(score >= UNCERTAIN, F.lit("uncertain")).otherwise(F.lit("unsupported"))


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_text(c), " "), lambda w: w != ""))


def fuzzy_evidence(claims: DataFrame, *, value: str = "value", text: str = "text") -> DataFrame:
    """J11 beside each claim: evidence_score, the share of the value's words that the text has, exactly or with an edit
    similarity of 0.8 or more after folding confusable characters; evidence_status. A value without words scores 0."""
    def matched(own: Column, there: Column) -> Column:
        # each word is folded once, whatever it is compared with
        folded = lambda words: F.transform(words, lambda w: F.struct(w.alias("word"), fold_confusables(w).alias("folded")))
        rest, texts = folded(F.array_except(own, there)), F.array_distinct(F.transform(there, fold_confusables))

        def close(w: Column, t: Column) -> Column:
            near = F.abs(F.length(t) - F.length(w["folded"])) <= 0.2 * F.greatest(F.length(t), F.length(w["word"])) + 1
            return near & (edit_similarity(w["folded"], t) >= SIMILAR)

        found = let(texts, lambda there: F.size(F.filter(rest, lambda w: F.exists(there, lambda t: close(w, t)))))
        return (F.size(F.array_intersect(own, there)) + found) / F.size(own)

    own, there = _words(F.col(value)), _words(F.col(text))
    score = F.when(F.size(own) == 0, F.lit(0.0)).otherwise(matched(own, there))
    return claims.withColumn("evidence_score", score).withColumn("evidence_status", status(F.col("evidence_score")))


def evidence(claims: DataFrame, *, path: str = "path", value: str = "value", text: str = "text") -> DataFrame:
    """each claim by its path: identifiers must stand in the text, other values are matched by words."""
    last = F.regexp_extract(F.col(path), r"([A-Za-z_]+)(?:\[[0-9]+\])?$", 1)
    method = F.when(last.isin(STRONG), F.lit("strong")).when(last.endswith("name"), F.lit("name")).when(F.col(path).contains("address"), F.lit("address")).otherwise(F.lit("generic"))
    found = fuzzy_evidence(claims, value=value, text=text).withColumn("evidence_method", method)
    score = F.when(F.col("evidence_method") == "strong", strong_evidence(F.col(value), F.col(text))).otherwise(F.col("evidence_score"))
    return found.withColumn("evidence_score", score).withColumn("evidence_status", status(F.col("evidence_score")))


def matching_lines(claims: DataFrame, *, value: str = "value", text: str = "text", most: int = 5) -> DataFrame:
    """The first lines that share a word with the value or hold it as an identifier, in order, without repeats."""
    own, v = _words(F.col(value)), normalize_identifier(F.col(value))
    lines = F.array_distinct(F.filter(F.transform(F.split(F.col(text), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""))
    hits = F.filter(lines, lambda x: F.arrays_overlap(_words(x), own) | ((v != "") & F.contains(normalize_identifier(x), v)))
    return claims.withColumn("fragments", F.slice(hits, 1, most))
