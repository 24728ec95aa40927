"""Operator 2: binary token shards with a minimal perfect hash index for keyed access.

`write_shards` sorts documents by key into range partitions, tokenizes whole texts and writes one file a
partition: raw unsigned little-endian ids, then the keys, lengths and a footer. `build_index` maps every
(key, copy) to (shard, offset, length): keys are dealt into buckets of a few thousand by their hash; each
bucket gets a cascade of bit arrays in which a key that falls alone on a bit owns it, and the rank of that bit
is its slot (BBHash: minimal, perfect, a constant expected number of probes). A 32-bit fingerprint in the slot
rejects foreign keys. Entries of a bucket whose 64-bit hashes are equal (only copies can have such) are kept beside
it with their keys, so none is lost. `lookup` answers (key, copy) requests from the index and `read_records` reads the ids.

Defined results: null text is an empty document (only the end id); a null key sorts first and is a key of its
own; repeated keys get copy numbers 0, 1, ... in file order, ordered by text; an empty table gives no shards,
an empty index and no rows; other columns are ignored. Shards are named by attempt, so a repeated task leaves
the manifest pointing at a complete file. Memory: one Arrow slice, 24 bytes a document of one shard, or one
bucket of the index.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import file_system, slices, stored
from brindle.llm.tokens import encoder
from brindle.sources.shared import shared_path

#: Of the file format.
MAGIC, FOOTER = b"BRTOKEN1", "<QQI4x"
GAMMA, MOST_LEVELS = 1.6, 48


# -- hashing ------------------------------------------------------------------------------------------------


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection of 64-bit integers."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def key_hash(keys: np.ndarray, valid: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """64 bits of (key, copy); different keys of copy 0 never collide."""
    h = mix(keys.view(np.uint64))
    with np.errstate(over="ignore"):
        h = h ^ mix(copies.astype(np.uint64) + np.uint64(1), 7) * (copies > 0).astype(np.uint64)
    return np.where(valid, h, ~mix(copies.astype(np.uint64), 11))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit values: slots 0..n-1."""

    def __init__(self, hashes: np.ndarray | None = None):
        self.levels: list[np.ndarray] = []
        self.rest = np.zeros(0, dtype=np.uint64)
        left = np.unique(hashes) if hashes is not None else self.rest
        while len(left) and len(self.levels) < MOST_LEVELS:
            size = max(64, int(len(left) * GAMMA))
            at = (mix(left, len(self.levels)) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(at, minlength=size)
            self.levels.append(hits == 1)
            left = left[hits[at] > 1]
        self.rest = np.sort(left)  # only if the levels ran out: kept as they are
        self._rank()

    def _rank(self) -> None:
        base, self.ranks = 0, []
        for bits in self.levels:
            self.ranks.append(base + np.cumsum(bits) - bits)
            base += int(bits.sum())
        self.base = base

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each value; a foreign value gets any slot, or -1."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        open_ = np.arange(len(hashes))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(open_):
                break
            at = (mix(hashes[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, hashes[open_]), len(self.rest) - 1)
            hit = self.rest[at] == hashes[open_]
            out[open_[hit]] = self.base + at[hit]
        return out

    def dump(self) -> bytes:
        parts = [struct.pack("<II", len(self.levels), len(self.rest)), self.rest.tobytes()]
        for bits in self.levels:
            parts += [struct.pack("<I", len(bits)), np.packbits(bits).tobytes()]
        return b"".join(parts)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        out = cls()
        n, rest = struct.unpack_from("<II", data)
        at = 8 + 8 * rest
        out.rest = np.frombuffer(data, dtype=np.uint64, count=rest, offset=8)
        for _ in range(n):
            (size,) = struct.unpack_from("<I", data, at)
            width = (size + 7) // 8
            out.levels.append(np.unpackbits(np.frombuffer(data, dtype=np.uint8, count=width, offset=at + 4))[:size].astype(bool))
            at += 4 + width
        out._rank()
        return out


# -- files --------------------------------------------------------------------------------------------------


class ShardReader:
    """One shard file: its key table, and the ids of any of its records by offset and length."""

    def __init__(self, path: str):
        fs, name = file_system(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        self.n_docs, self.n_ids, self.width = struct.unpack(FOOTER, self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER) - len(MAGIC)))
        if self.file.read_at(len(MAGIC), size - len(MAGIC)) != MAGIC:
            raise ValueError(f"not a token shard: {path}")

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, which of them are not null, and lengths, in file order."""
        at = len(MAGIC) + self.n_ids * self.width
        raw = self.file.read_at(self.n_docs * 17, at)
        return (np.frombuffer(raw, "<i8", self.n_docs), np.frombuffer(raw, np.uint8, self.n_docs, self.n_docs * 16).astype(bool), np.frombuffer(raw, "<i8", self.n_docs, self.n_docs * 8))

    def ids(self, start: int, length: int) -> np.ndarray:
        raw = self.file.read_at(length * self.width, len(MAGIC) + start * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def close(self) -> None:
        self.file.close()


def _writer(folder: str, vocabulary: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder = encoder(vocabulary, False)
        keys, valid, lengths = [], [], []
        out = path = None
        for batch in slices(batches, "text", 2_000_000):
            if out is None:
                path = f"{folder}/shard-{part:06d}-{uuid.uuid4().hex}.bin"
                fs, name = file_system(path)
                fs.create_dir(name.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(name)
                out.write(MAGIC)
            ids, counts = coder.encode(batch.column("text"))
            ends = np.cumsum(counts)
            whole = np.insert(ids, ends, end_id)
            if int(whole.max()) >> 8 * width:
                raise ValueError(f"the id {int(whole.max())} doesn't fit in {width} bytes")
            out.write(whole.astype(f"<u{width}").tobytes())
            column = batch.column("key")
            keys.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            valid.append(column.is_valid().to_numpy(zero_copy_only=False))
            lengths.append((counts + 1).astype("<i8"))
        if out is None:
            return
        key, ok, length = (np.concatenate(x) for x in (keys, valid, lengths))
        out.write(key.tobytes() + length.tobytes() + ok.astype(np.uint8).tobytes())
        out.write(struct.pack(FOOTER, len(key), int(length.sum()), width) + MAGIC)
        out.close()
        alike = lambda k: int(((key == key[k]) & (ok == ok[k])).sum())  # noqa: E731  how long the first and last runs are
        row = {"part": [part], "path": [path], "n_docs": [len(key)], "n_ids": [int(length.sum())], "first_key": [int(key[0]) if ok[0] else None], "first_run": [alike(0)], "last_key": [int(key[-1]) if ok[-1] else None], "last_run": [alike(-1)]}
        yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_key", pa.int64()), ("first_run", pa.int64()), ("last_key", pa.int64()), ("last_run", pa.int64())]))

    return run


@dataclass
class Shards:
    """The manifest: one row a shard (their number is a parameter), with the ids before it and the copies of its first key before it."""

    spark: SparkSession
    rows: list[dict]

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame([(r["shard"], r["path"], r["base"], r["copies_before"], r["first_run"]) for r in self.rows], "shard int, path string, base long, copies_before long, first_run long")

    @property
    def n_docs(self) -> int:
        return sum(r["n_docs"] for r in self.rows)


def write_shards(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", end_id: int = 0, id_bytes: int = 2, shards: int | None = None, shard_bytes: int = 256_000_000) -> Shards:
    """Tokenize whole texts and write them as shard files in ascending key order.

    id_bytes: 2 holds ids below 65,536, 4 any; a larger id is an error. shards: number of files, by default the
    session's number of shuffle partitions, or more so that each has about shard_bytes of text.
    """
    spark = docs.sparkSession
    size = shards or docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    folder = shared_path(spark, "shards")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    # equal rows may be split anywhere: their records are the same
    dealt = rows.repartitionByRange(n, "key", F.xxhash64("text"), F.rand(7)).sortWithinPartitions("key", F.xxhash64("text"), "text")
    schema = "part int, path string, n_docs long, n_ids long, first_key long, first_run long, last_key long, last_run long"
    manifest = stored(dealt.mapInArrow(_writer(folder, vocabulary, end_id, id_bytes), schema), "manifest")
    found = [r.asDict() for r in manifest.orderBy("part").collect()]  # one row a shard
    base = copies = 0
    last = object()
    for k, r in enumerate(found):
        r["shard"], r["base"] = k, base
        r["copies_before"] = copies if r["first_key"] == last else 0
        base += r["n_ids"]
        whole = r["first_run"] == r["n_docs"] and r["first_key"] == last
        copies = r["last_run"] + (r["copies_before"] if whole else 0)
        last = r["last_key"]
    return Shards(spark, found)


def _entries(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path, _, before, first_run in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                reader = ShardReader(path)
                key, ok, length = reader.table()
                reader.close()
                new = np.ones(len(key), dtype=bool)
                new[1:] = (key[1:] != key[:-1]) | (ok[1:] != ok[:-1])
                begin = np.flatnonzero(new)
                copy = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
                copy[:first_run] += before
                h = key_hash(key.astype(np.int64), ok, copy)
                start = np.cumsum(length) - length
                for at in range(0, len(key), 100_000):
                    s = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array((h[s] >> np.uint64(20)) % np.uint64(buckets)).cast(pa.int64()), pa.array(h[s].view(np.int64)), pa.array(np.full(len(h[s]), shard, dtype=np.int32)), pa.array(start[s]), pa.array(length[s]), pa.array(key[s].astype(np.int64), mask=~ok[s]), pa.array(copy[s])], names=["bucket", "hash", "shard", "start", "length", "key", "copy"])

    return run


_BUCKET = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), ("hash_function", pa.binary()), ("slots", pa.binary()), ("alike", pa.binary())])
_LOCATED = pa.schema([("key", pa.int64()), ("copy", pa.int64()), ("shard", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])


def _build(table: pa.Table) -> pa.Table:
    bucket = table.column("bucket")[0].as_py()
    h = table.column("hash").to_numpy().view(np.uint64)
    _, back, many = np.unique(h, return_inverse=True, return_counts=True)
    single = many[back] == 1
    alike = b""
    if not single.all():
        own = table.filter(pa.array(~single)).select(_LOCATED.names).cast(_LOCATED)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _LOCATED) as out:
            out.write_table(own)
        alike, table, h = sink.getvalue().to_pybytes(), table.filter(pa.array(single)), h[single]
    perfect = PerfectHash(h)
    order = np.empty(len(h), dtype=np.int64)
    order[perfect.slots(h)] = np.arange(len(h))
    columns = [table.column("shard").to_numpy()[order].astype("<i4"), table.column("start").to_numpy()[order].astype("<i8"), table.column("length").to_numpy()[order].astype("<i8"), (h[order] & np.uint64(0xFFFFFFFF)).astype("<u4")]
    return pa.table({"bucket": [bucket], "n": [len(h)], "hash_function": [perfect.dump()], "slots": [b"".join(c.tobytes() for c in columns)], "alike": [alike]}, schema=_BUCKET)


def build_index(shards: Shards, *, bucket_keys: int = 4096) -> tuple[DataFrame, int]:
    """One row a bucket: its hash function and its slots. Also returns the number of buckets."""
    buckets = max(1, -(-shards.n_docs // bucket_keys))
    found = shards.frame().repartition(max(1, len(shards.rows)), "shard").mapInArrow(_entries(buckets), "bucket long, hash long, shard int, start long, length long, key long, copy long")
    built = found.groupBy("bucket").applyInArrow(_build, "bucket long, n long, hash_function binary, slots binary, alike binary")
    return stored(built, "index"), buckets


def probe(hash_function: bytes, slots: bytes, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket: (found, shard, start, length) for each hash; a fingerprint that differs means not found."""
    slot = PerfectHash.load(hash_function).slots(hashes)
    shard, start = np.frombuffer(slots, "<i4", n), np.frombuffer(slots, "<i8", n, 4 * n)
    length, mark = np.frombuffer(slots, "<i8", n, 12 * n), np.frombuffer(slots, "<u4", n, 20 * n)
    found = (slot >= 0) & (mark[slot] == (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)) if n else np.zeros(len(hashes), bool)
    return found, shard[slot], start[slot], length[slot]


def _requests(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("key")
            keys = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ok, copies = column.is_valid().to_numpy(zero_copy_only=False), batch.column("copies").to_numpy()
            done = 0
            while done < len(keys) or (done == 0 and len(keys)):
                # so many keys that their copies fill about one batch; a key with more copies goes in parts
                end = max(done + 1, int(np.searchsorted(np.cumsum(copies[done:]), 100_000, side="right")) + done)
                for first in range(0, int(copies[done:end].max()), 100_000):
                    n = np.clip(copies[done:end] - first, 0, 100_000)
                    copy = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first
                    k, v = np.repeat(keys[done:end], n), np.repeat(ok[done:end], n)
                    h = key_hash(k, v, copy)
                    yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(20)) % np.uint64(buckets)).cast(pa.int64()), pa.array(h.view(np.int64)), pa.array(k, mask=~v), pa.array(copy)], names=["bucket", "hash", "key", "copy"])
                done = end

    return run


def _answer(asked: pa.Table, index: pa.Table) -> pa.Table:
    if not asked.num_rows or not index.num_rows:
        return _LOCATED.empty_table()
    one = {k: index.column(k)[0].as_py() for k in ("hash_function", "slots", "n")}
    found, shard, start, length = probe(one["hash_function"], one["slots"], one["n"], asked.column("hash").to_numpy().view(np.uint64))
    keep = pa.array(found)
    columns = [asked.column("key").combine_chunks(), asked.column("copy").combine_chunks(), pa.array(shard), pa.array(start), pa.array(length)]
    out = pa.table([c.filter(keep) for c in columns], schema=_LOCATED)
    alike = index.column("alike")[0].as_py()
    if not alike:
        return out
    # beside the hash function: by key and copy; an answer that the hash function gave for such a request is void
    listed = {(r["key"], r["copy"]): r for r in pa.ipc.open_stream(alike).read_all().to_pylist()}
    wanted = list(zip(asked.column("key").to_pylist(), asked.column("copy").to_pylist(), strict=True))
    rest = [r for r in out.to_pylist() if (r["key"], r["copy"]) not in listed]
    return pa.Table.from_pylist(rest + [listed[w] for w in wanted if w in listed], schema=_LOCATED)


def lookup(keys: DataFrame, index: DataFrame, buckets: int, *, key: str = "doc_id") -> DataFrame:
    """Where each (key, copy) is stored; keys that are not in the index give no row."""
    counted = keys.groupBy(F.col(key).cast("long").alias("key")).agg(F.count(F.lit(1)).alias("copies"))
    asked = counted.mapInArrow(_requests(buckets), "bucket long, hash long, key long, copy long")
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_answer, "key long, copy long, shard int, start long, length long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, at = None, None
    for batch in batches:
        out = []
        for key, copy, shard, start, length, path, base in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if path != at:
                if reader:
                    reader.close()
                reader, at = ShardReader(path), path
            ids = reader.ids(start, length)
            out.append((key, copy, shard, base + start, len(ids), zlib.crc32(ids.tobytes())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["key", "copy", "shard", "start", "n_tokens", "ids_crc32"])
    if reader:
        reader.close()


def read_records(located: DataFrame, shards: Shards) -> DataFrame:
    """Read the located records from their files: the ids before each, their number, and their checksum."""
    dealt = located.repartition(max(1, len(shards.rows)), "shard", F.floor(F.col("start") / F.lit(1 << 20))).sortWithinPartitions("shard", "start")
    # the manifest is broadcast only if it is below the session's threshold
    named = dealt.join(shards.frame().select("shard", "path", "base"), "shard").select("key", "copy", "shard", "start", "length", "path", "base")
    return named.mapInArrow(_read, "key long, copy long, shard int, start long, n_tokens long, ids_crc32 long")
