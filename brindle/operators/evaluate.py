"""Field-level evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import comparison_value


def json_depth(json: Column) -> Column:
    """How deep lists and objects nest in a JSON text: the most brackets open at once, those in strings aside."""
    brackets = F.regexp_replace(F.regexp_replace(json, r'"(?:[^"\\\\]++|\\\\.)*+"', ""), r"[^\[\]{}]+", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, step, lambda acc: acc["most"])


def flatten_json(rows: DataFrame, json: str, *, key: str = "case", scalars: bool = False) -> DataFrame:
    """One row for each leaf of a JSON column: key, path like a.b[0].c, value as text (null for a JSON null).
    Empty lists and objects have no leaf; leaves may be as deep as they are. With `scalars` (N02) null, false and empty
    leaves go."""
    level = rows.select(F.col(key), F.lit("").alias("path"), F.try_parse_json(F.col(json)).alias("v")).where("v IS NOT NULL")
    depth = rows.agg(F.max(json_depth(F.col(json)))).first()[0] or 0
    out = None
    for k in range(depth + 1):
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        leaves = level.where(~nested)
        if scalars:
            leaves = leaves.where(~F.expr("is_variant_null(v)") & ~((kind == "BOOLEAN") & (F.expr("variant_get(v, '$', 'string')") == "false")) & (F.expr("variant_get(v, '$', 'string')") != ""))
        leaves = leaves.select(key, "path", F.expr("CASE WHEN is_variant_null(v) THEN NULL ELSE variant_get(v, '$', 'string') END").alias("value"))
        out = leaves if out is None else out.union(leaves)
        if k == depth:
            break
        step = level.where(nested)
        level = step.lateralJoin(step.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key").alias("name"), F.col("value").alias("child"))).select(
            key, F.when(F.col("name").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("path", F.when(F.col("path") == "", F.lit("")).otherwise(F.lit(".")), F.col("name"))).alias("path"), F.col("child").alias("v")
        )
    return out


def json_value(json: Column, path: str) -> Column:
    """The value at a path like a[0].b as text; null where there is none."""
    return F.try_variant_get(F.try_parse_json(json), "$." + path, "string")


def compare_fields(expected: DataFrame, actual: DataFrame, *, case: str = "case") -> DataFrame:
    """Every expected or actual field with its state. correct: equal after normalisation, two nulls too;
    missing: not there, or null where a value is expected; mismatch; extra: not expected and not null."""
    e = expected.select(case, "path", F.col("value").alias("expected"), F.lit(True).alias("has_e"))
    a = actual.select(case, "path", F.col("value").alias("actual"), F.lit(True).alias("has_a"))
    both = e.join(a, [case, "path"], "full_outer")
    state = (
        F.when(F.col("has_e") & F.col("has_a") & comparison_value(F.col("expected")).eqNullSafe(comparison_value(F.col("actual"))), F.lit("correct"))
        .when(F.col("has_e") & F.col("actual").isNull(), F.lit("missing"))
        .when(F.col("has_e"), F.lit("mismatch"))
        .when(F.col("actual").isNotNull(), F.lit("extra"))
        .otherwise(F.lit("none"))
    )
    return both.select(case, "path", "expected", "actual", state.alias("state"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(100.0)).otherwise(a * 100.0 / b)


def scores(compared: DataFrame, by: list[str]) -> DataFrame:
    """Counts, accuracy, precision, recall and F1 in percent. A mismatch is neither a false positive nor a
    false negative; a missing field is a false negative, an extra one a false positive. Ratios without a
    denominator are 100, F1 then comes from the rounded precision and recall, 0 if both are 0."""
    n = lambda s: F.count_if(F.col("state") == s)
    counts = compared.groupBy(*by).agg(n("correct").alias("tp"), n("extra").alias("fp"), n("missing").alias("fn"), n("mismatch").alias("mismatches"), F.count_if(F.col("state").isin("correct", "missing", "mismatch")).alias("fields"))
    rounded = counts.withColumns({"accuracy": F.round(_ratio(F.col("tp"), F.col("fields")), 2), "precision": F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fp")), 2), "recall": F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fn")), 2)})
    p, r = F.col("precision"), F.col("recall")
    return rounded.withColumn("f1", F.when(p + r == 0, F.lit(0.0)).otherwise(F.round(2 * p * r / (p + r), 2)))


def changed_between_runs(first: DataFrame, second: DataFrame, hashes: list[str], *, case: str = "case") -> DataFrame:
    """Cases of two runs and the hashes that differ."""
    a, b = first.alias("a"), second.alias("b")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{h}").eqNullSafe(F.col(f"b.{h}")), F.lit(h)) for h in hashes]))
    return a.join(b, case).select(case, changed.alias("changed"))


def pass_rate(rows: DataFrame, passed: str) -> DataFrame:
    """A14."""
    return rows.agg(F.round(F.count_if(F.col(passed)) * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("pass_rate"))


def evaluate_cases(cases: DataFrame, expected: str, actual: str, *, case: str = "case") -> DataFrame:
    """Each case's scores from two JSON columns. A case without a readable actual result misses every field.
    Expected lists, objects and nulls that are empty at the top are no fields (N05)."""
    wanted = flatten_json(cases, expected, key=case).where(~(F.col("value").isNull() & ~F.col("path").rlike(r"[.\[]")))
    found = flatten_json(cases, actual, key=case)
    compared = compare_fields(wanted, found, case=case)
    failed = cases.select(F.col(case), F.try_parse_json(F.col(actual)).isNull().alias("failed"))
    return failed.join(scores(compared, [case]), case, "left")


def report(scored: DataFrame, by: str, title: str) -> DataFrame:
    """One row with an HTML report of the scores: a table line a category; their number is what a report holds."""
    cells = [by, "fields", "tp", "fp", "fn", "mismatches", "accuracy", "precision", "recall", "f1"]
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), safe(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in cells], F.lit("</tr>"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).cast("string").alias("by"), line.alias("line")))), lambda x: x["line"]), "\n")
    head = f"<h1>{title}</h1><table><tr>" + "".join(f"<th>{c}</th>" for c in cells) + "</tr>\n"
    return scored.agg(F.concat(F.lit(head), lines, F.lit("</table>")).alias("html"))
