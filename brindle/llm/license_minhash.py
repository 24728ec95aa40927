"""Operator 4: license notices by MinHash bands over overlapping text windows, verified by exact containment.

DataFrame functions only. Texts become hashes of 5-word shingles. Templates are cut into pieces of up to 16
shingles; by its length a piece belongs to a class of windows, so wide and so far apart that any run of that
length lies wholly in one window. Windows and pieces meet if one of `BANDS` MinHash values is equal. A window that
holds four fifths of a piece has a Jaccard similarity of at least 0.3 with it, so it is missed with a
probability of at most (1 - 0.3) ** 32, about one in 90,000; a window that is the piece, never.

A band's value can be equal only where the piece's own smallest shingle of that band stands. So signatures are
computed for the windows around such shingles alone; this loses nothing and spares the other windows' minima.
The bands only name candidates: one met piece is enough. A candidate is verified by the exact share of the whole
template's distinct shingles that the document has, wherever an edit falls. If a document has four fifths of a
template's shingles, it has four fifths of at least one piece's.

Defined results: null or empty text, or fewer than five words, matches nothing; a template needs five words;
repeated notices in a document give one row for each document and license; rows with equal ids count as one
document, a null id as one too; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, PIECE, BANDS = 5, 16, 32
#: Windows by the number of shingles of a piece: (from, to, width, stride).
CLASSES = [(1, 1, 1, 1), (2, 4, 5, 2), (5, 8, 12, 4), (9, 16, 24, 8)]
#: Public short notices of common licenses.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def class_of(size: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, (low, high, _, _) in enumerate(CLASSES):
        out = F.when((size >= low) & (size <= high), F.lit(k)).otherwise(out)
    return out


def template_pieces(spark: SparkSession, notices: list[tuple[str, str]]) -> DataFrame:
    """template, license, n (of its distinct shingles), piece, class, shingles (distinct)."""
    rows = [(k, name, text) for k, (name, text) in enumerate(notices)]
    base = spark.createDataFrame(rows, "template int, license string, text string").withColumn("words", F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    base = base.withColumn("all", F.expr(f"filter(transform(words, (w, k) -> IF(k <= size(words) - {SHINGLE}, xxhash64({', '.join(f'get(words, k + {j})' for j in range(SHINGLE))}), NULL)), x -> x IS NOT NULL)")).where(F.size("all") > 0)
    many = F.ceil(F.size("all") / F.lit(PIECE)).cast("int")
    each = F.ceil(F.size("all") / many).cast("int")
    pieces = base.select("template", "license", "all", F.posexplode(F.sequence(F.lit(0), many - 1)).alias("piece", "at"), each.alias("each"))
    cut = pieces.withColumn("shingles", F.array_distinct(F.slice("all", F.col("at") * F.col("each") + 1, F.col("each")))).where(F.size("shingles") > 0)
    sums = base.select("template", F.size(F.array_distinct("all")).cast("long").alias("n"))
    return cut.join(sums, "template").select("template", "license", "n", "piece", class_of(F.size("shingles")).alias("class"), "shingles")


def minima(shingles: Column) -> Column:
    """The smallest of the shingles under each band's permutation, as hash of band and value."""


    def permuted(band: int):
        return lambda x: F.xxhash64(x, F.lit(band))

    return F.array(*[F.array_min(F.transform(shingles, permuted(b))) for b in range(BANDS)])


def scan(docs: DataFrame, notices: list[tuple[str, str]] | None = None, *, key: str = "doc_id", text: str = "text", containment: float = 0.8) -> DataFrame:
    """key, license, containment (of the best matching template), n_shingles (of that template) for each license found."""
    spark = docs.sparkSession
    pieces = template_pieces(spark, notices or NOTICES).withColumn("minima", minima(F.col("shingles")))
    listed = pieces.collect()  # as many rows as there are templates' pieces
    if not listed:
        return docs.select(F.col(key), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("n_shingles")).where(F.lit(False))
    # the shingles that are smallest in some band of some piece
    marks = {b: {r["minima"][b] for r in listed} for b in range(BANDS)}
    wanted = spark.createDataFrame([(x,) for x in sorted({x for r in listed for x in r["shingles"]})], "x long")
    for_bands = wanted.withColumn("keep", F.array(*[F.xxhash64("x", F.lit(b)).isin(list(marks[b])) for b in range(BANDS)]))
    anchors = [r["x"] for r in for_bands.where(F.exists("keep", lambda v: v)).collect()]
    literal = lambda a: f"{a}L" if a > -(1 << 63) else "CAST(-9223372036854775808 AS BIGINT)"
    is_anchor = f"x IN ({', '.join(map(literal, anchors))})"
    # Arrays of one element bind a value to a name, so that it is computed once: the words w, then their hashes h.
    words = r"array(filter(split(lower(__text), '[^\\p{L}\\p{N}]+'), v -> v <> ''))"
    hashes = f"transform(filter({words}, w -> size(w) >= {SHINGLE}), w -> transform(sequence(0, size(w) - {SHINGLE}), k -> xxhash64({', '.join(f'get(w, k + {j})' for j in range(SHINGLE))})))"
    with_anchors = f"filter(transform({hashes}, h -> named_struct('h', h, 'at', filter(transform(h, (x, k) -> IF({is_anchor}, k, NULL)), k -> k IS NOT NULL))), s -> size(s.at) > 0)"
    found = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).select("__key", F.explode(F.expr(with_anchors)).alias("s")).select("__key", "s.h", "s.at")
    window = []
    for c, (_, _, width, stride) in enumerate(CLASSES):
        # the windows of this class in which an anchor stands: starts are multiples of the stride
        window.append(f"transform(array_distinct(flatten(transform(at, k -> sequence(CAST(ceil(greatest(k - {width - 1}, 0) / {stride}) AS INT), CAST(floor(k / {stride}) AS INT))))), j -> named_struct('class', {c}, 'h', array_distinct(slice(h, j * {stride} + 1, {width}))))")
    windows = found.select("__key", F.explode(F.expr(f"concat({', '.join(window)})")).alias("x")).select("__key", "x.class", F.col("x.h").alias("h"))
    signed = windows.select("__key", "class", "h", F.posexplode(minima(F.col("h"))).alias("band", "least"))
    banded = spark.createDataFrame([(r["template"], r["class"], k, m) for r in listed for k, m in enumerate(r["minima"])], "template int, class int, band int, least long")
    met = signed.join(F.broadcast(banded.distinct()), ["class", "band", "least"])  # the templates are a list in this module, or the caller's
    named = met.select(F.col("__key").alias("__named"), F.col("template").alias("__template")).distinct()
    # all shingles of templates that the documents have, of rows with equal ids together
    templates = spark.createDataFrame(sorted({(x, r["template"], r["license"], r["n"]) for r in listed for x in r["shingles"]}), "x long, template int, license string, n long")
    is_wanted = f"x IN ({', '.join(literal(x) for x in sorted({x for r in listed for x in r['shingles']}))})"
    own = found.select("__key", F.explode(F.expr(f"array_distinct(filter(h, x -> {is_wanted}))")).alias("x")).distinct()
    hits = own.join(F.broadcast(templates), "x").groupBy("__key", "template", "license", "n").agg(F.count(F.lit(1)).alias("hits"))
    enough = hits.where(F.col("hits") / F.col("n") >= containment)
    whole = enough.join(named, F.col("__key").eqNullSafe(F.col("__named")) & (F.col("template") == F.col("__template")), "left_semi").withColumn("containment", F.col("hits") / F.col("n"))
    top = whole.groupBy("__key", "license").agg(F.max(F.struct("containment", "n")).alias("top"))
    return top.select(F.col("__key").alias(key), "license", F.col("top.containment").alias("containment"), F.col("top.n").alias("n_shingles"))


def oracle_sql(notices: list[tuple[str, str]] | None = None, containment: float = 0.8) -> str:
    """The same rows by an exact join of shingles, without windows and bands: DuckDB SQL over the view documents."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quoted(n)}, {quoted(t)})" for k, (n, t) in enumerate(notices or NOTICES))
    words = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    shingles = f"list_distinct(list_transform(range(len(w) - {SHINGLE - 1}), lambda k: array_to_string(w[k + 1 : k + {SHINGLE}], ' ')))"
    return f"""
WITH t0 AS (SELECT template, license, {words.format('body')} AS w FROM (VALUES {values}) v(template, license, body)),
t1 AS (SELECT template, license, {shingles} AS s FROM t0 WHERE len(w) >= {SHINGLE}),
t2 AS (SELECT template, license, len(s) AS n, unnest(s) AS sh FROM t1),
d0 AS (SELECT doc_id, {words.format('text')} AS w FROM documents WHERE text IS NOT NULL),
d1 AS (SELECT doc_id, unnest({shingles}) AS sh FROM d0 WHERE len(w) >= {SHINGLE}),
hits AS (SELECT doc_id, template, license, n, count(DISTINCT sh) AS hits FROM d1 JOIN t2 USING (sh) GROUP BY doc_id, template, license, n),
whole AS (SELECT doc_id, license, n, hits / CAST(n AS DOUBLE) AS containment FROM hits WHERE hits / CAST(n AS DOUBLE) >= {containment}),
top AS (SELECT doc_id, license, max(row(containment, CAST(n AS BIGINT))) AS x FROM whole GROUP BY doc_id, license)
SELECT doc_id, license, x[1] AS containment, x[2] AS n_shingles FROM top
"""
