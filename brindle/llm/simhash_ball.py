"""Operator 7: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2*r bits have a value within r bits of both. So every distinct
fingerprint emits all values of its ball of radius r, the values are shuffled, and whoever meets on a value is
a candidate that an exact bit count verifies. A value can be met by the fingerprints of its own ball only, so a
group has at most 1 + 64 + ... members whatever the corpus; exact copies are one fingerprint from the start.
Each group links its members to its smallest; for an even radius 2*r members of a ball always lie within the
radius, so the links join exactly what brute force joins. Components come from rounds of taking the smallest
neighbour and jumping to its label, every round written to the shared checkpoint folder.

Defined results: a text without words has fingerprint zero, linked like any other; fewer words than a shingle
give one shingle of them all; null text is empty; a null key takes part but is never a component id unless all
keys of the component are null; repeated rows are returned each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from brindle.llm.common import slices, stored, texts_of
from brindle.operators.similarity import join_by

_SEED, _BLOCK = 42, 100_000


def words_of(text: str) -> list[bytes]:
    """UTF-8 words: A-Z in lower case, cut at space, tab and line ends only. Bytes do both as asked; str would do more."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _shingles(words: list[bytes], size: int) -> list[bytes]:
    """Runs of `size` words with single spaces; all words if there are fewer."""
    whole = b" ".join(words)
    if len(words) <= size:
        return [whole] if words else []
    ends = list(accumulate(len(w) + 1 for w in words))
    return [whole[a:b] for a, b in zip([0, *ends[: len(words) - size]], (e - 1 for e in ends[size - 1 :]), strict=True)]


def fingerprints(texts: list[str], size: int = 3) -> np.ndarray:
    """The 64-bit SimHash of each text: a bit is one if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), dtype=np.uint64)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for k, text in enumerate(texts):
        shingles = _shingles(words_of(text), size)
        if not shingles:
            continue
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, len(shingles), _BLOCK):
            some = shingles[at : at + _BLOCK]
            counts += bit_counts(np.array([xxh64_intdigest(s, _SEED) for s in some], dtype=np.uint64))
        out[k] = (powers[2 * counts > len(shingles)]).sum(dtype=np.uint64)
    return out


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the values have each bit, lowest first."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def _fingerprint(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rest = [k for k, name in enumerate(batch.schema.names) if name != "text"]
            found = pa.array(fingerprints(texts_of(batch, "text"), size).view(np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in rest], found], names=[*[batch.schema.names[k] for k in rest], "fp"])

    return run


def fingerprint_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, more: list[Column] | None = None) -> DataFrame:
    """key and fp (the fingerprint as a signed long) of every row, and more columns as they are. Texts go no further."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *(more or []))
    schema = StructType([f for f in rows.schema.fields if f.name != "text"] + [StructField("fp", LongType())])
    return rows.mapInArrow(_fingerprint(shingle), schema)


def ball_masks(radius: int) -> list[int]:
    """All 64-bit masks of at most `radius` bits, as signed longs."""
    out = []
    for n in range(radius + 1):
        for bits in combinations(range(64), n):
            m = sum(1 << b for b in bits)
            out.append(m - (1 << 64) if m >> 63 else m)
    return out


def links(distinct: DataFrame, *, radius: int = 2) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints `fp` at `radius` or fewer differing bits. radius is even."""
    if radius % 2:
        raise ValueError("the radius must be even: two balls of half of it must meet")
    masks = F.array(*[F.lit(m) for m in ball_masks(radius // 2)])
    # fingerprints are small and their balls are not: dealt to as many tasks as a shuffle has, however few files hold them
    dealt = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    met = dealt.select("fp", F.explode(masks).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp")
    ends = met.groupBy("variant").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count(F.lit(1)).alias("n"))
    ends = stored(ends.where("n > 1"), "met")
    # of three and more, those between the smallest and the largest are the fingerprints in the variant's own ball
    wide = ends.where("n > 2").select("a", "variant", F.explode(masks).alias("mask")).select("a", F.col("variant").bitwiseXOR(F.col("mask")).alias("fp"))
    pairs = ends.select("a", "b").union(wide.join(distinct, "fp").select("a", F.col("fp").alias("b")))
    near = pairs.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    return near.distinct()


def components(edges: DataFrame) -> DataFrame:
    """fp and root (the smallest fingerprint of its component) for every fingerprint with a link.

    Every round, a node takes the smallest label around it, and then its label's label. Rounds end when no
    label changed, which a count decides; links and labels stay distributed.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("fp"), "root")
    labels = stored(labels, "labels")
    while True:
        around = both.join(labels.withColumnRenamed("fp", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        nearest = labels.join(around, labels.fp == around.a).select("fp", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        nearest = stored(nearest, "nearest")
        jump = nearest.select(F.col("fp").alias("root"), F.col("root").alias("far"))
        new = stored(join_by(nearest, jump, "root", "left").select("fp", "old", F.least("root", F.coalesce("far", "root")).alias("root")), "labels")
        changed = not new.where(F.col("root") != F.col("old")).isEmpty()
        labels = new.select("fp", "root")
        if not changed:
            return labels


def _rooted(classes: DataFrame, radius: int) -> DataFrame:
    """Every class (one fingerprint) with the root of its component."""
    roots = components(links(classes.select("fp"), radius=radius))
    return stored(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """Every row's key, fp and component_id, the smallest key that its links reach."""
    marked = stored(fingerprint_documents(docs, key=key, text=text, shingle=shingle), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("key").alias("first")), "classes")
    rooted = _rooted(classes, radius)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = join_by(rooted, least, "root").select("fp", "component_id")
    return join_by(marked, by_fp, "fp").select(F.col("key").alias(key), "fp", "component_id")


def written(docs: DataFrame) -> DataFrame:
    """docs, if it is no more than a table of Parquet files, else such a table with its rows: each row has a place then."""
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation" and plan.relation().fileFormat().toString() == "Parquet":
        return docs
    return stored(docs, "documents")


def places(docs: DataFrame) -> list[Column]:
    """Of a written table, each row's file (as two hashes of its path) and number in it."""
    meta = docs.metadataColumn("_metadata")
    return [F.xxhash64(meta["file_path"]).alias("file"), F.xxhash64(F.lit("file"), meta["file_path"]).alias("also"), meta["row_index"].alias("row")]


def keep_first(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, broadcast_rows: int = 200_000) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest key (a null key comes last; of
    rows with equal keys the first in its file).

    Fingerprints and places of rows are shuffled, texts are not: rows that go are few, and up to broadcast_rows of
    them (24 bytes each) are sent to the documents. More are met by a shuffle of the documents.
    """
    docs = written(docs)
    marked = stored(fingerprint_documents(docs, key=key, text=text, shingle=shingle, more=places(docs)), "fingerprints")
    place = F.struct("file", "also", "row")
    order = F.struct(F.col("key").isNull().alias("none"), F.col("key"), place.alias("place"))
    classes = stored(marked.groupBy("fp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")), "classes")
    rooted = _rooted(classes, radius)
    least = rooted.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("members"))
    several = join_by(rooted, least.where("members > 1"), "root").select("fp", F.col("keep.place").alias("keep"))
    gone = stored(join_by(marked, several, "fp").where(place != F.col("keep")).select("file", "also", "row"), "gone")
    side = F.broadcast(gone) if gone.count() <= broadcast_rows else gone.hint("shuffle_hash")
    own = places(docs)
    same = (own[0] == side["file"]) & (own[1] == side["also"]) & (own[2] == side["row"])
    return docs.join(side, same, "left_anti")
