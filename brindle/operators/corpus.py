"""Training-corpus preparation: splits, samples, mixes, statistics, augmentation, chat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(c: Column, seed: int) -> Column:
    """The fixed shuffle order of keys: SHA-256 of key and seed, which any engine can compute."""
    return F.sha2(F.concat(c.cast("string"), F.lit(f"|{seed}")), 256)


def running_sum_by_range(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """`value` summed over all rows that come before in `order`, the row included, without one task for all rows:
    range partitions, their totals (one row each) summed up front, then a sum inside each partition."""
    from brindle.operators.similarity import checkpointed

    dealt = checkpointed(df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()))
    totals = dealt.groupBy("__p").agg(F.sum(value).alias("__t")).collect()  # one row a partition
    before, base = {}, 0
    for r in sorted(totals, key=lambda r: r["__p"]):
        before[r["__p"]] = base
        base += r["__t"] or 0
    bases = df.sparkSession.createDataFrame([(int(p), int(b)) for p, b in before.items()] or [(0, 0)], "__p int, __base long")
    inside = F.sum(value).over(Window.partitionBy("__p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(bases), "__p").withColumn(out, inside + F.col("__base")).drop("__p", "__base")


def group_split(rows: DataFrame, *, group: str = "group_id", ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Whole groups go to validation in shuffled order until round(rows * ratio) rows are there; never all groups.
    Adds `split`."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("__o", order_key(F.col(group), seed))
    total, groups = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    target = max(1, int(total * ratio + 0.5)) if total else 0
    summed = running_sum_by_range(sizes, "__o", "n", "upto")
    last = sizes.agg(F.max("__o")).first()[0]
    chosen = (F.col("upto") - F.col("n") < target) & ((F.col("__o") != F.lit(last)) if groups > 1 else F.lit(True))
    marked = summed.select(group, F.when(chosen, F.lit("validation")).otherwise(F.lit("train")).alias("split"))
    return rows.join(marked, group)


def shared_values(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Values that both have."""
    return left.select(column).intersect(right.select(column))


def missing_values(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Values of the left that the right lacks; empty means subset."""
    return left.select(column).distinct().join(right.select(column).distinct(), column, "left_anti")


def tagged_union(frames: dict[str, DataFrame], tag: str = "_source") -> DataFrame:
    """All rows of all frames with the frame's name; U02 is a union without the tag."""
    out = None
    for name, df in frames.items():
        one = df.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def path_union(first: Column, second: Column) -> Column:
    """The paths of both arrays in order, once each."""
    return F.array_distinct(F.concat(first, second))


def mix(rows: DataFrame, by: str) -> DataFrame:
    """Rows of each source and its share in percent."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(by, "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def replay_sample(rows: DataFrame, *, new_rows: int, ratio: float = 0.3, family: str = "source", key: str = "doc_id", seed: int = 42) -> DataFrame:
    """new_rows * r / (1 - r) rows, evenly from each family in shuffled order, then a top-up from the rest.

    Of a family no more rows are needed than its even share and the whole sample, so only rows below a bound of the
    shuffled order that holds that many are ranked; the bound is widened until every family has enough.
    """
    from brindle.operators.similarity import checkpointed, join_by

    wanted = int(new_rows * ratio / (1 - ratio) + 0.5)
    order = F.coalesce(order_key(F.col(key), seed), F.lit("0" * 64))  # a null key comes first
    place = F.conv(F.left(order, F.lit(8)), 16, 10).cast("double") / 2.0**32
    ordered = checkpointed(rows.select(F.struct(family).alias("__f"), order.alias("__o"), place.alias("__u"), F.struct(key).alias("__key")))
    sizes = checkpointed(ordered.groupBy("__f").agg(F.count(F.lit(1)).alias("__n")))
    families = sizes.count()
    if not wanted or not families:
        return rows.limit(0)
    even = wanted // families
    width = 2
    while True:
        few = join_by(ordered, sizes, "__f").where(F.col("__u") < width * (even + wanted + 10) / F.col("__n"))
        held = few.groupBy("__f", "__n").agg(F.count(F.lit(1)).alias("__h"))
        enough = sizes.join(held.select("__f", "__h"), "__f", "left").where(F.coalesce("__h", F.lit(0)) < F.least(F.col("__n"), F.lit(even + wanted))).isEmpty()
        if enough:
            break
        width *= 4
    ranked = few.withColumn("__r", F.row_number().over(Window.partitionBy("__f").orderBy("__o", "__key")))
    late = F.col("__r") > even
    chosen = ranked.orderBy(late.cast("int"), F.when(late, F.col("__o")), "__f", "__r").limit(wanted)
    # a sample of the size that was asked for; a repeated key gives as many rows as were chosen of it
    numbered = rows.withColumn("__key", F.struct(key)).withColumn("__f", F.struct(family))
    picks = chosen.groupBy("__f", "__key").agg(F.count(F.lit(1)).alias("__c"))
    met = numbered.join(F.broadcast(picks) if wanted <= 200_000 else picks, ["__f", "__key"])
    w = Window.partitionBy("__f", "__key").orderBy(F.lit(1))
    return met.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= F.col("__c")).drop("__f", "__key", "__c", "__i")


def closest_families(sizes: dict, target: int) -> list:
    """Again and again the family that brings the sum closest to the target, while it gets closer; smallest name first on ties.
    sizes: rows of each family, as many entries as families."""
    left, total, out = dict(sizes), 0, []
    while left:
        name = min(left, key=lambda k: (abs(total + left[k] - target), str(k)))
        if out and abs(total + left[name] - target) >= abs(total - target):
            break
        total += left.pop(name)
        out.append(name)
    return out


def closest_combination(families: DataFrame, target: int, *, name: str = "family", size: str = "n") -> DataFrame:
    """Of all one to three families, those whose sum is closest to the target; ties prefer more families, then names."""
    a, b, c = (families.select(F.col(name).alias(f"f{k}"), F.col(size).alias(f"n{k}")) for k in (1, 2, 3))
    one = a.select(F.array("f1").alias("families"), F.col("n1").alias("total"))
    two_rows = a.join(b, F.col("f1") < F.col("f2"))
    two = two_rows.select(F.array("f1", "f2"), F.col("n1") + F.col("n2"))
    three = two_rows.join(c, F.col("f2") < F.col("f3")).select(F.array("f1", "f2", "f3"), F.col("n1") + F.col("n2") + F.col("n3"))
    every = one.union(two).union(three)
    return every.orderBy(F.abs(F.col("total") - target), -F.size("families"), "families").limit(1)


def token_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def token_statistics(rows: DataFrame, text: str = "text") -> DataFrame:
    """Number, least, most, mean and upper median (the value at n // 2 in order) of the token counts."""
    counted = rows.select(token_count(F.col(text)).alias("n"))
    by_value = counted.groupBy("n").agg(F.count(F.lit(1)).alias("times"))  # as many rows as there are different counts
    totals = by_value.agg(F.sum("times").alias("rows"), F.min("n").alias("least"), F.max("n").alias("most"), (F.sum(F.col("n") * F.col("times")) / F.sum("times")).alias("mean"))
    at = running_sum_by_range(by_value, "n", "times", "upto").crossJoin(F.broadcast(totals)).where(F.col("upto") > F.floor(F.col("rows") / 2))
    return at.groupBy("rows", "least", "most", "mean").agg(F.min("n").alias("median"))


def token_histogram(rows: DataFrame, text: str = "text", width: int = 256) -> DataFrame:
    """Documents by token count in bins of a fixed width."""
    return rows.select((F.floor(token_count(F.col(text)) / width) * width).cast("long").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def longest(rows: DataFrame, n: int = 10, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A top-n report."""
    return rows.select(key, token_count(F.col(text)).alias("n_tokens")).orderBy(F.desc("n_tokens"), key).limit(n)


def length_gate(rows: DataFrame, limit: int = 2048, text: str = "text") -> DataFrame:
    """rows over the limit, and near it (85 to 100 %)."""
    n = token_count(F.col(text))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(n > limit).alias("over"), F.count_if((n <= limit) & (n >= 0.85 * limit)).alias("near"))


def quantiles(rows: DataFrame, value: str, points: list[float]) -> DataFrame:
    """Values at index int(p * (n - 1)) in order, by counts of equal values."""
    by_value = rows.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("times"))
    upto = running_sum_by_range(by_value, "v", "times", "upto")
    total = by_value.agg(F.sum("times").alias("rows"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("p")
    asked = total.select("rows", wanted).withColumn("at", F.floor(F.col("p") * (F.col("rows") - 1)))
    return upto.join(F.broadcast(asked), F.col("upto") > F.col("at")).groupBy("p").agg(F.min("v").alias(value))


def chat_messages(rows: DataFrame, *, instruction: str, prompt: str, answer: str) -> DataFrame:
    """The three messages of a training row."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return rows.withColumn("messages", F.array(message("system", instruction), message("user", prompt), message("assistant", answer)))


def chat_template(messages: Column) -> Column:
    """All messages between start and end marks."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")


def prompt_and_completion(messages: Column) -> tuple[Column, Column]:
    """All messages but the last, and the last."""
    return F.slice(messages, F.lit(1), F.size(messages) - 1), F.slice(messages, F.size(messages), F.lit(1))


#: Characters that a reader of scans confuses.
CONFUSED = [("O", "0"), ("0", "O"), ("I", "1"), ("1", "l"), ("S", "5"), ("5", "S"), ("B", "8"), ("8", "B"), ("m", "rn"), (".", ","), (":", ";")]


def substitution_noise(text: Column, key: Column, seed: int = 42) -> Column:
    """One to four replacements of a confused pair everywhere in the text, chosen by a hash of key and seed."""
    out = text
    old, new = (F.array(*[F.lit(pair[side]) for pair in CONFUSED]) for side in (0, 1))
    for turn in range(4):
        pick = F.pmod(F.xxhash64(key, F.lit(seed), F.lit(turn)), F.lit(len(CONFUSED))).cast("int")
        used = F.pmod(F.xxhash64(key, F.lit(seed), F.lit("turns")), F.lit(4)) >= turn
        out = F.replace(out, F.when(used, F.get(old, pick)).otherwise(F.lit("")), F.get(new, pick))  # nothing is replaced where nothing is sought
    return out


#: Chance of a changed character, in a thousand.
LEVELS = {"light": 5, "medium": 15, "heavy": 40}


def character_noise(text: Column, key: Column, level: str = "light", seed: int = 42) -> Column:
    """Each character is changed, dropped or kept by a hash of key, place and seed; letters fold to look-alikes."""
    def one(c: Column, k: Column) -> Column:
        dice = F.pmod(F.xxhash64(key, k, F.lit(seed)), F.lit(1000))
        return F.when(dice < LEVELS[level] // 4, F.lit("")).when(dice < LEVELS[level], F.translate(c, "O0I1S5B8", "0O1l5S8B")).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def swap_reference(text: Column, old: Column, new: Column) -> Column:
    """P50: the reference replaced where it stands as a word."""
    quoted = F.concat(F.lit(r"\b\Q"), old, F.lit(r"\E\b"))
    return F.when(old.isNull() | new.isNull(), text).otherwise(F.regexp_replace(text, quoted, new))


#: The features of hard examples and their weights.
DIFFICULTY = {"transport_negative": 10, "turkish": 8, "multi_equipment": 7, "multi_cargo": 7, "long_document": 5, "sparse_optional_fields": 6, "ocr_alphanumeric_noise": 4}


def difficulty_features(instruction: Column, text: Column, turkish_terms: list[str]) -> dict[str, Column]:
    """By name, does a feature hold: nothing about transport; a term of the list as a word; several containers or
    cargo items; 1800 characters; at most four filled fields; a run of letters, a digit and more."""
    filled = lambda c, kind: F.coalesce(F.size(c) > 0 if kind.startswith("array") else (F.trim(c) != "" if kind == "string" else c.isNotNull()), F.lit(False))
    fields = _top_fields()
    words = F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}]+"), F.lit(0)), F.lower)
    populated = sum((filled(instruction[n], kind).cast("int") for n, kind in fields), F.lit(0))
    transport = [filled(instruction[n], kind) for n, kind in fields if n in ("transport_plans", "transport_document_type", "freight_payment_term_code")]
    return {
        "transport_negative": ~(transport[0] | transport[1] | transport[2]),
        "turkish": F.arrays_overlap(words, F.array(*[F.lit(t.lower()) for t in turkish_terms])) if turkish_terms else F.lit(False),
        "multi_equipment": F.coalesce(F.size(instruction["equipment_list"]) > 1, F.lit(False)),
        "multi_cargo": F.coalesce(F.size(instruction["cargo_items"]) > 1, F.lit(False)),
        "long_document": F.length(text) >= 1800,
        "sparse_optional_fields": populated <= 4,
        "ocr_alphanumeric_noise": text.rlike(r"\b[A-Z]{2,}[0-9][A-Z0-9]{2,}\b"),
    }


def _top_fields() -> list[tuple[str, str]]:
    """Names and kinds of an instruction's own fields."""
    from pyspark.sql.types import StructType

    from brindle.plans.schemas import INSTRUCTION

    return [(f.name, f.dataType.simpleString()) for f in StructType.fromDDL(INSTRUCTION.removeprefix("struct<").removesuffix(">"))]


def difficulty(features: dict[str, tuple[Column, int]]) -> tuple[Column, Column]:
    """Names of the features that hold, and their summed weights."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, (c, _) in features.items()]))
    return names, sum((F.when(c, F.lit(w)).otherwise(0) for c, w in features.values()), F.lit(0))


def hard_examples(rows: DataFrame, score: Column, n: int, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The n hardest rows; ties by fingerprint, then key."""
    marked = rows.select(key, score.alias("score"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("hash"))
    return marked.orderBy(F.desc("score"), "hash", key).limit(n).select(key, "score", "hash")


def family_key(reference: Column, shipper: Column, consignee: Column, booking: Column) -> Column:
    """The trimmed reference, else a fingerprint of the parties and the booking."""
    structure = F.upper(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (shipper, consignee, booking)]))
    return F.coalesce(F.nullif(F.trim(reference), F.lit("")), F.concat(F.lit("fp:"), F.sha2(structure, 256)))


def duplicate_key(prompt: Column, answer: Column) -> Column:
    """P54."""
    return F.sha2(F.concat_ws("|", F.trim(prompt), F.trim(answer)), 256)


def field_presence(rows: DataFrame, fields: list[str]) -> DataFrame:
    """In how many rows each field has a non-empty value."""
    counts = rows.agg(*[F.count_if(F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != "")).alias(f) for f in fields])
    return counts.select(F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*fields))).alias("field", "n"))


def collect_candidates(rows: DataFrame, *, query: str, url: str, order: str, most: int) -> DataFrame:
    """Of each query its share of the budget in order, first-seen addresses only, `most` in all."""
    queries = max(1, rows.select(query).distinct().count())
    each = -(-most // queries)
    w = Window.partitionBy(query).orderBy(order)
    firsts = rows.groupBy(F.col(url).alias("__u")).agg(F.min(order).alias("__first"))
    unique = rows.join(firsts, (rows[url] == firsts["__u"]) & (rows[order] == firsts["__first"]), "left_semi")
    return unique.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= each).orderBy(order).limit(most).drop("__r")
