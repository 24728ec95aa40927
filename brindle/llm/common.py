"""Helpers shared by the operators of this folder: shared storage, text batches, memoised tokenizers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.plans.shipping import ship_package
from brindle.sources import shared

#: Rows in one Arrow batch: texts are long, and a batch stands in the memory of the JVM and of a Python worker.
BATCH_ROWS = 1000

#: Names of Hadoop's file systems that Arrow's file layer knows by another name.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def file_system(path: str):
    """Arrow's file system and the path in it, for workers that read or write files of their own format."""
    import pyarrow.fs as pafs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage, survives lost executors."""
    small_batches(df.sparkSession)
    return shared.stored(df, tag)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless they are bounded lower already; the workers get the package."""
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def read_table(spark: SparkSession, sf_dir: str, name: str, *, dealt: bool = True) -> DataFrame:
    """A table of the folder; documents and pages in as many partitions as there are cores at least, unless not `dealt`."""
    small_batches(spark)
    path = f"{sf_dir}/{name}.parquet"
    return shared.read_texts(spark, path) if dealt and name in ("documents", "pages") else spark.read.parquet(path)


def fold(column: str, modulus: int):
    """crc32 of the id as text, modulo: the folds of the held-out rows. A null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def release_memory() -> None:
    """Give the system back what this worker no longer uses: reused workers else keep what earlier stages needed."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def slices(batches: Iterator[pa.RecordBatch], text_column: str, most_bytes: int = 500_000, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about most_bytes of text; one row may exceed it, never a prefix of it."""
    release_memory()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            end = int(np.searchsorted(ends, base + most_bytes, side="right"))
            end = min(max(end, at + 1), at + most_rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column as Python strings, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def grouped_sum(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run of rows; empty runs give zero."""
    ends = np.cumsum(lengths)
    total = np.concatenate([np.zeros((1, *values.shape[1:]), dtype=np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[ends] - total[ends - lengths]


#: The usual marks and digits at a word's edges; bare_word's pattern handles all others.
_EDGES = ".,;:!?\"'()[]{}<>|/\\@#$%^&*+=~`_-0123456789"
_NO_LETTER = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def bare_word(word: str) -> str:
    """A word without what isn't a letter at its edges; empty if it has none."""
    if word.isalpha():
        return word
    core = word.strip(_EDGES)
    return core if core.isalpha() or not core else _NO_LETTER.sub("", core)


class Memo:
    """A bounded map from words to rows of a numpy array.

    compute(list of new words) returns one row per word. A word that isn't held is looked up by what `stem` makes of
    it, and held so. When more than `cap` words are held, those used only once since the last time go first: memory
    is bounded whatever the vocabulary of the corpus is.
    """

    def __init__(self, compute, cap: int = 200_000, stem=bare_word):
        self.compute, self.cap, self.stem = compute, cap, stem
        self.index: dict[str, int] = {}
        self.values, self.uses = None, np.zeros(0, dtype=np.int64)

    def _shrink(self) -> None:
        for least in (2, 8, 64):
            rows = np.flatnonzero(self.uses >= least)
            if len(rows) <= self.cap // 2:
                break
        else:
            rows = rows[:0]
        kept = np.zeros(len(self.uses), dtype=bool)
        kept[rows] = True
        self.index = {w: k for k, w in enumerate(w for w, keep in zip(self.index, kept.tolist(), strict=True) if keep)}
        self.values, self.uses = self.values[rows], np.zeros(len(rows), dtype=np.int64)

    def __call__(self, words: list[str]) -> np.ndarray:
        """The row of self.values for each word."""
        if len(self.index) > self.cap:
            self._shrink()
        get = self.index.get
        at = np.array([get(w, -1) for w in words], dtype=np.int64)
        gone = np.flatnonzero(at < 0)
        if len(gone):
            stems = [self.stem(words[k]) for k in gone.tolist()]
            fresh = [w for w in dict.fromkeys(stems) if w not in self.index]
            if fresh:
                held = len(self.index)
                new = self.compute(fresh)
                self.values = new if self.values is None else np.concatenate([self.values, new])
                self.uses = np.concatenate([self.uses, np.zeros(len(fresh), dtype=np.int64)])
                self.index.update(zip(fresh, range(held, held + len(fresh)), strict=True))
                get = self.index.get
            at[gone] = [get(w) for w in stems]
        self.uses += np.bincount(at, minlength=len(self.uses))
        return at
