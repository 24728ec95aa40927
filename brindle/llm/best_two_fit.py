"""Operator 10: best-two-fit packing of documents into sequences of at most `capacity` tokens.

A document's ids and an end id are cut into pieces only if they exceed the capacity. Packing depends on piece
lengths alone, so the plan is made from the histogram of lengths (at most `capacity` rows, whatever the
corpus): a sequence is filled greedily with the longest lengths that still fit; then its smallest piece is
replaced by the two lengths that fill the widened gap most tightly, if they fill it better. While the counts
allow, the same pattern repeats, and one plan row stands for all these sequences, so a plan has a few times
`capacity` rows at most. Pieces find their place by their rank among the pieces of their length, counted per
partition and summed over partitions: no length's pieces ever meet in one task.

Defined results: null text is an empty document (its end id alone); repeated rows are packed each; an empty
table gives no rows; other columns are ignored; null ids are kept.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import slices, stored
from brindle.llm.tokens import encoder

PIECES = "part int, key long, piece int, start long, length int, ids_crc32 long, own long"


def _cut(vocabulary: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder = encoder(vocabulary, True)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in slices(batches, "text", 2_000_000):
            ids, counts = coder.encode(batch.column("text"))
            whole = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
            counts = counts + 1
            pieces = -(-counts // capacity)
            begin = np.repeat(np.cumsum(counts) - counts, pieces)
            number = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = number * capacity
            length = np.minimum(np.repeat(counts, pieces) - start, capacity)
            order = np.argsort(length, kind="stable")  # the rank of each piece among this partition's pieces of its length
            many = np.bincount(length, minlength=capacity + 1)
            own = np.empty(len(length), dtype=np.int64)
            own[order] = np.arange(len(length)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(seen, many)
            seen += many
            raw = whole.tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((begin + start).tolist(), (begin + start + length).tolist(), strict=True)]
            key = batch.column("key").take(pa.array(np.repeat(np.arange(len(counts)), pieces)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(length), part, dtype=np.int32)), key, pa.array(number.astype(np.int32)), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc, type=pa.int64()), pa.array(own)], names=["part", "key", "piece", "start", "length", "ids_crc32", "own"])

    return run


def cut_pieces(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """The pieces of every document, written to the shared folder with the partition they came from."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(_cut(vocabulary, end_id, capacity), PIECES), "pieces")


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths, each with the number of sequences that follow it; all counts are used up.

    Greedy: the longest remaining length that fits, again and again. Two-fit: the smallest piece of the filled
    sequence gives way to two remaining lengths whose sum is larger than it and closest to the widened gap.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    lengths = sorted(left)
    plan: list[tuple[list[int], int]] = []
    while lengths:
        gap, pattern, used = capacity, [], {}
        top = len(lengths)
        while gap >= lengths[0]:
            k = bisect.bisect_right(lengths, gap, 0, top) - 1
            while k >= 0 and left[lengths[k]] - used.get(lengths[k], 0) <= 0:
                k -= 1
            if k < 0:
                break
            x = lengths[k]
            n = min(gap // x, left[x] - used.get(x, 0))
            pattern += [x] * n
            used[x] = used.get(x, 0) + n
            gap -= n * x
            top = k + 1
        if gap and len(pattern) > 1:
            small = pattern[-1]
            best, pair = small, None
            spare = lambda v: left[v] - used.get(v, 0) - (-1 if v == small else 0)
            i, j = 0, bisect.bisect_right(lengths, gap + small) - 1
            while i <= j:
                a, b = lengths[i], lengths[j]
                total = a + b
                if total > gap + small:
                    j -= 1
                    continue
                if total > best:
                    if a == b:
                        if spare(a) >= 2:
                            best, pair = total, (a, b)
                    elif spare(a) >= 1 and spare(b) >= 1:
                        best, pair = total, (a, b)
                    elif spare(b) < 1:
                        j -= 1
                        continue
                if best == gap + small:
                    break
                i += 1
            if pair:
                pattern = [*pattern[:-1], *sorted(pair, reverse=True)]
                used[small] -= 1
                for v in pair:
                    used[v] = used.get(v, 0) + 1
        used = {k: v for k, v in used.items() if v}
        times = min(left[k] // v for k, v in used.items())
        plan.append((pattern, times))
        for k, v in used.items():
            left[k] -= times * v
            if not left[k]:
                del left[k]
                lengths.pop(bisect.bisect_left(lengths, k))
    return plan


def place_ranges(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, pieces a sequence, offset of the first of them) for each length of a pattern."""
    out, taken, sequence = [], {}, 0
    for pattern, times in plan:
        offset, k = 0, 0
        while k < len(pattern):
            x, n = pattern[k], 1
            while k + n < len(pattern) and pattern[k + n] == x:
                n += 1
            out.append((x, taken.get(x, 0), n * times, sequence, n, offset))
            taken[x] = taken.get(x, 0) + n * times
            offset, k = offset + n * x, k + n
        sequence += times
    return out


def _place(ranges: list[tuple[int, int, int, int, int, int]]):
    by: dict[int, np.ndarray] = {}
    for x in sorted({r[0] for r in ranges}):
        by[x] = np.array([r[1:] for r in ranges if r[0] == x], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                t = by[x]
                row = t[np.searchsorted(t[:, 0], rank[at], side="right") - 1]
                own = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + own // row[:, 3]
                offset[at] = row[:, 4] + own % row[:, 3] * x
            keep = [batch.column(n) for n in ("key", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep[:3], pa.array(length), keep[4], pa.array(sequence), pa.array(offset)], names=["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, *, capacity: int = 4096) -> DataFrame:
    """Each piece with its sequence and the place there. `pieces` must be a written table (cut_pieces gives one)."""
    per_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    per_part = stored(per_part, "lengths")
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    ranges = place_ranges(plan_sequences(counts, capacity))
    # how many pieces of that length are in the partitions before: a running sum of one small row a partition
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "length", "base")
    # the base grows with the partitions, so it is never broadcast; a hot length is many small (part, length) keys
    placed = pieces.join(base.hint("merge"), ["part", "length"]).withColumn("rank", (F.col("own") + F.col("base")).cast("long"))
    return placed.select("key", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(ranges), "key long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
