"""Operator 3: benchmark decontamination by latent semantic retrieval.

1. Documents become term numbers of the benchmark's vocabulary (other words are 0: they can match nothing), and
   document frequencies are counted over blocks of all documents; both are written to the shared folder.
2. A distributed randomised SVD of the TF-IDF passages of all documents: each partition multiplies its passages
   with a small random matrix and back, the products are summed over partitions, and the leading right singular
   vectors follow from this sketch of the Gram matrix. Only terms-by-rank matrices travel.
3. Passages and benchmark parts meet in the latent space; pairs above a cosine are candidates. Parts that have
   few telling words besides common ones have no direction of their own there: their runs of `gram` words are
   looked up exactly as well.
4. Each candidate is verified in the words: the longest common subsequence with the whole item around the
   passage, and for paraphrases that the item's answer (the telling words of its last sentence with some) is there.

The benchmark is a stated query set with one vocabulary, one weighting and one latent space. Only one of more than
`block_bytes` of distinct text is cut into blocks with a latent space each; the weights stay those of all documents.

Defined results: null and empty texts hold no passage; benchmark items without a word match nothing; rows of the
benchmark with equal id and text count once, items with equal texts each match; repeated documents are each
reported; of equal shares the first place in the text counts; a null key is kept; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import slices, stored, texts_of

_EDGE = re.compile(r"^\W+|\W+$")
#: The usual marks at a word's edges; the pattern above handles all others.
_MARKS = ".,;:!?\"'()[]{}<>|/\\@#$%^&*+=~`-"
_SENTENCE = re.compile(r"[.!?。！？]+(?:\s+|$)")


@dataclass
class Settings:
    block: int = 12  # words
    blocks: int = 3  # a passage is so many blocks, one block apart
    part: int = 24  # words of a benchmark part
    rank: int = 96
    extra: int = 16  # more columns than the rank in the sketch
    stop_share: float = 0.02  # terms in more of the blocks than this tell nothing,
    least_telling: int = 6  # but the rarest so many of each part do, however often its copies stand in the documents
    gram: int = 6  # words of the runs by which parts with fewer telling terms are looked up
    cosine: float = 0.4
    overlap: float = 0.3  # of a part's telling words that a passage must hold before it is compared in full
    near: float = 0.8  # of an item's words in common order: the passage itself
    paraphrase: float = 0.5  # with the answer present
    answer: float = 0.75  # of the answer's telling words
    block_bytes: int = 64_000_000


def normal_words(text: str) -> list[str]:
    return [_EDGE.sub("", w) for w in text.lower().split()]


class Vocabulary:
    """Numbers 1.. of the benchmark's words."""

    def __init__(self, texts: list[str]):
        self.words = {w: k for k, w in enumerate(sorted({w for t in texts for w in normal_words(t) if w}), 1)}
        self.size = len(self.words) + 1
        self.kind = "<u2" if self.size < 1 << 16 else "<u4"

    def numbers(self, words: list[str]) -> np.ndarray:
        """Of words as they stand in a text: 0 if neither they nor what is left without marks at their edges is known."""
        get = self.words.get
        out = np.array([get(w, -1) for w in words], dtype=np.int64)
        other = np.flatnonzero(out < 0)
        if len(other):
            out[other] = [get(s, 0) if (s := words[k].strip(_MARKS)).isalnum() else get(_EDGE.sub("", s), 0) for k in other.tolist()]
        return out


def _encode(shared, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        frequency, blocks = np.zeros(v.size, dtype=np.int64), 0
        names = ["key", "digest", "terms"]
        for batch in slices(batches, "text", 2_000_000):
            words = [t.lower().split() for t in texts_of(batch, "text")]
            numbers = v.numbers([w for x in words for w in x])
            n = np.array([len(w) for w in words], dtype=np.int64)
            own = np.sort(padded_blocks(numbers, n, block), axis=1)
            first = own > 0
            first[:, 1:] &= own[:, 1:] != own[:, :-1]
            frequency += np.bincount(own[first], minlength=v.size)
            blocks += len(own)
            ends, raw = np.cumsum(n), numbers.astype(v.kind)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("digest"), pa.array([raw[e - m : e].tobytes() for e, m in zip(ends.tolist(), n.tolist(), strict=True)], type=pa.binary())], names=names)
        frequency[0] = blocks
        yield pa.RecordBatch.from_arrays([pa.array([None], type=pa.int64()), pa.array([None], type=pa.int64()), pa.array([zlib.compress(frequency.astype("<i8").tobytes(), 1)], type=pa.binary())], names=names)

    return run


def block_rows(n: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each word, numbered over all texts, and the text of each block; blocks never cross texts."""
    many = -(-n // block)
    first = np.cumsum(many) - many
    own = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(first, n) + own // block, np.repeat(np.arange(len(n)), many)


def padded_blocks(numbers: np.ndarray, n: np.ndarray, block: int) -> np.ndarray:
    """A row for each block of each text; the last of a text is filled up with zeros."""
    rows, owner = block_rows(n, block)
    out = np.zeros((len(owner), block), dtype=np.int32)
    out[rows, (np.arange(len(numbers)) - np.repeat(np.cumsum(n) - n, n)) % block] = numbers
    return out


def _sum_tables(table: pa.Table) -> pa.Table:
    total = 0
    for x in table.column("data").to_pylist():
        total = total + np.frombuffer(zlib.decompress(x), "<f8")
    return pa.table([pa.array([table.column(0)[0].as_py()], type=pa.int32()), pa.array([table.column(1)[0].as_py()], type=pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], type=pa.binary())], schema=_TABLE)


_TABLE = pa.schema([("piece", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])
_PIECES = 8


class Sketch:
    """A random matrix with `kept` entries of either sign for each term; columns of unit length."""

    def __init__(self, size: int, width: int, kept: int = 2, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.width = width
        self.column = rng.integers(0, width, (size, kept))
        self.value = rng.choice([-1.0, 1.0], (size, kept))
        self.value /= np.maximum(np.sqrt((self.dense() ** 2).sum(axis=0)), 1e-9)[self.column]

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self.column), self.width))
        for k in range(self.column.shape[1]):
            np.add.at(out, (np.arange(len(out)), self.column[:, k]), self.value[:, k])
        return out


class Space:
    """Sums of weighted term vectors of blocks and passages."""

    def __init__(self, weights: np.ndarray, s: Settings):
        self.weights, self.s = weights, s

    def blocks_of(self, numbers: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, term) of every weighted word, and the text of each block."""
        rows, owner = block_rows(n, self.s.block)
        keep = self.weights[numbers] > 0
        return rows[keep], numbers[keep], owner

    def sketched(self, basis: Sketch, rows: np.ndarray, terms: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The passages times the sketch: each word counts in the sketch's few columns of its term."""
        one = np.zeros((len(owner), basis.width), dtype=np.float32)
        if len(rows):
            at = (rows[:, None] * basis.width + basis.column[terms]).ravel()
            value = (self.weights[terms][:, None] * basis.value[terms]).ravel()
            one += np.bincount(at, value, minlength=one.size).reshape(one.shape)
        return self._windows(one, owner)

    def _windows(self, one: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Sums of blocks k, k+1, ... of a text."""
        out = one.copy()
        for step in range(1, self.s.blocks):
            if len(owner) > step:
                same = (owner[step:] == owner[:-step]).astype(np.float32)[:, None]
                out[:-step] += one[step:] * same
        return out

    def some_passages(self, vectors: np.ndarray, rows: np.ndarray, terms: np.ndarray, owner: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The passages that begin at the given blocks, and their norms: only their words' vectors are summed."""
        wanted = np.zeros(len(owner), dtype=bool)
        for step in range(self.s.blocks):
            at = live[live + step < len(owner)]
            wanted[at[owner[at + step] == owner[at]] + step] = True
        number = np.cumsum(wanted) - 1  # of the blocks that take part
        keep = wanted[rows]
        sums = np.zeros((int(wanted.sum()) + 1, vectors.shape[1]), dtype=np.float32)
        if keep.any():
            kinds, first = np.unique(number[rows[keep]], return_index=True)
            sums[kinds] = np.add.reduceat(vectors[terms[keep]], first, axis=0)
        out = sums[number[live]] if len(live) else np.zeros((0, vectors.shape[1]), dtype=np.float32)
        for step in range(1, self.s.blocks):
            on = np.minimum(live + step, len(owner) - 1)
            same = (live + step < len(owner)) & (owner[on] == owner[live])
            out = out + sums[np.where(same, number[on], -1)] * same[:, None]
        return out, np.maximum(np.sqrt(np.einsum("ij,ij->i", out, out)), 1e-6)

    def back(self, p: np.ndarray, rows: np.ndarray, terms: np.ndarray, owner: np.ndarray, total: np.ndarray) -> None:
        """Adds transposed passages times p to total, but for the weights: each block takes part in the passages that
        begin at it or just before."""
        both = p.copy()
        for step in range(1, self.s.blocks):
            if len(owner) > step:
                same = (owner[step:] == owner[:-step]).astype(np.float32)[:, None]
                both[step:] += p[:-step] * same
        if len(terms):
            order = np.argsort(terms, kind="stable")
            kinds, first = np.unique(terms[order], return_index=True)
            total[kinds] += np.add.reduceat(both[rows[order]], first, axis=0)


def _numbers(batch: pa.RecordBatch, kind: str) -> tuple[np.ndarray, np.ndarray]:
    raw = batch.column("terms").to_pylist()
    width = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(raw), kind).astype(np.int64), np.array([len(x) // width for x in raw], dtype=np.int64)


def _product(shared, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        space, basis = shared.value
        total = np.zeros((len(space.weights), basis.width))
        for batch in slices(batches, "terms", 200_000):  # so little that the gathered vectors stay in the cache
            numbers, n = _numbers(batch, kind)
            where = space.blocks_of(numbers, n)
            space.back(space.sketched(basis, *where), *where, total)
        total *= space.weights[:, None]
        part = TaskContext.get().partitionId()
        for k, piece in enumerate(np.array_split(total, _PIECES)):
            yield pa.RecordBatch.from_arrays([pa.array([k], type=pa.int32()), pa.array([part], type=pa.int32()), pa.array([zlib.compress(piece.astype("<f8").tobytes(), 1)], type=pa.binary())], schema=_TABLE)

    return run


def gram_times(encoded: DataFrame, space: Space, basis: Sketch, kind: str) -> np.ndarray:
    """(passages' transpose times passages) times basis over all documents, summed in two rounds."""
    schema = "piece int, part int, data binary"
    shared = encoded.sparkSession.sparkContext.broadcast((space, basis))
    parts = encoded.select("terms").mapInArrow(_product(shared, kind), schema)
    some = parts.withColumn("part", F.floor(F.col("part") / 32).cast("int")).groupBy("piece", "part").applyInArrow(_sum_tables, schema)
    rows = some.withColumn("part", F.lit(0)).groupBy("piece", "part").applyInArrow(_sum_tables, schema).collect()  # a fixed number of rows
    got = {r["piece"]: np.frombuffer(zlib.decompress(r["data"]), "<f8") for r in rows}
    return np.concatenate([got[k].reshape(len(x), -1) if k in got else x for k, x in enumerate(np.array_split(np.zeros((len(space.weights), basis.width)), _PIECES))])


def singular_vectors(encoded: DataFrame, space: Space, kind: str) -> np.ndarray:
    """Leading right singular vectors of the passages from one pass over them: a sparse random sketch of their Gram matrix
    and its Nystroem approximation (Tropp, Yurtsever, Udell and Cevher, 2017)."""
    size = len(space.weights)
    basis = Sketch(size, min(space.s.rank + space.s.extra, size))
    return leading_vectors(basis.dense(), gram_times(encoded, space, basis, kind), space.s.rank)


def leading_vectors(start: np.ndarray, sketch: np.ndarray, rank: int) -> np.ndarray:
    shift = np.sqrt(len(start)) * np.spacing(max(np.linalg.norm(sketch), 1e-30)) * 4
    moved = sketch + shift * start
    middle = start.T @ moved
    values, turn = np.linalg.eigh((middle + middle.T) / 2)
    good = values > max(values.max(), 0) * 1e-12
    root = moved @ (turn[:, good] / np.sqrt(values[good]))
    vectors, _, _ = np.linalg.svd(root, full_matrices=False)
    return vectors[:, :rank]


class Item:
    """A benchmark item: its terms, where each stands (as bits), and its answer: the distinct telling terms of its last
    sentence that has some."""

    def __init__(self, key: int, numbers: np.ndarray, answer: np.ndarray):
        self.key, self.size, self.answer = key, len(numbers), set(answer.tolist())
        self.places: dict[int, int] = {}
        for k, x in enumerate(numbers.tolist()):
            self.places[x] = self.places.get(x, 0) | 1 << k


class Members:
    """A set of numbers with a quick test that has false positives and an exact one."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.shift = np.uint64(64 - max(8, len(self.values).bit_length() + 4))
        self.table = np.zeros(1 << int(64 - self.shift), dtype=np.uint8)
        self.table[self._places(self.values)] = 1

    def _places(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def maybe(self, x: np.ndarray) -> np.ndarray:
        return self.table.take(self._places(x))

    def has(self, x: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.zeros(x.shape, dtype=bool)
        return self.values[np.minimum(np.searchsorted(self.values, x), len(self.values) - 1)] == x


@dataclass
class Queries:
    items: list[Item]
    owner: np.ndarray  # item of each part
    offset: np.ndarray  # first word of each part in its item
    latent: np.ndarray  # unit vectors of the parts
    telling: Members  # part times size of the vocabulary plus telling term
    size: int  # of the vocabulary
    many: np.ndarray  # telling words of each part
    group: np.ndarray  # term by group of parts: is it a telling word of one of them
    need: np.ndarray  # of each group: the fewest telling words that one of its parts asks of a passage
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: keys of the runs of parts of common words, sorted; item and place of each


def part_starts(n: int, size: int) -> list[int]:
    """Where the parts of an item of n words begin: they cover it, and the last ends with it."""
    starts = list(range(0, max(1, n - size + 1), size))
    return [*starts, n - size] if starts[-1] + size < n else starts


def too_common(frequency: np.ndarray, s: Settings) -> np.ndarray:
    return (frequency > s.stop_share * max(int(frequency[0]), 1)) & (frequency > 8)


def term_weights(frequency: np.ndarray, items: list[np.ndarray], s: Settings) -> np.ndarray:
    """The weight of each term by the blocks it stands in; frequency[0] is the number of blocks. Frequent terms weigh
    nothing, except the rarest of each part that has few others: copies of a leak can make its own words frequent."""
    blocks = max(int(frequency[0]), 1)
    full = np.log(np.maximum(blocks / np.maximum(frequency, 1.0), 1.5)) ** 2
    weights = full.copy()
    weights[too_common(frequency, s)] = 0
    for numbers in items:
        numbers = numbers[numbers > 0]
        for at in part_starts(len(numbers), s.part):
            own = np.unique(numbers[at : at + s.part])
            rarest = own[np.argsort(frequency[own], kind="stable")][: s.least_telling]
            weights[rarest] = full[rarest]
    weights[0] = 0
    return weights


def answer_terms(text: str, v: Vocabulary, weights: np.ndarray) -> np.ndarray:
    """The distinct telling terms of the last sentence that has some."""
    for sentence in reversed(_SENTENCE.split(text)):
        terms = np.unique(v.numbers(normal_words(sentence)))
        if (weights[terms] > 0).any():
            return terms[weights[terms] > 0]
    return np.zeros(0, dtype=np.int64)


def run_keys(numbers: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit number for each run of so many terms; equal runs have equal ones."""
    base, many = 0x9E3779B97F4A7C15, max(0, len(numbers) - length + 1)
    out, wide = np.zeros(many, dtype=np.uint64), numbers.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = out * np.uint64(base) + wide[k : k + many] + np.uint64(1)
    return out


def make_queries(rows: list[tuple[int, str]], v: Vocabulary, space: Space, vectors: np.ndarray, common: np.ndarray | None = None) -> Queries:
    """common: of each term, is it too frequent to tell anything (though it may have got a weight for want of others)."""
    s = space.s
    items, owner, offset, latent, telling, many = [], [], [], [], [], []
    grams: dict[int, list[tuple[int, int, int]]] = {}
    weighted = space.weights[:, None] * vectors
    for key, text in rows:
        numbers = v.numbers(normal_words(text))
        numbers = numbers[numbers > 0]
        if not len(numbers):
            continue
        for at in part_starts(len(numbers), s.part):
            some = numbers[at : at + s.part]
            x = weighted[some].sum(axis=0)
            latent.append(x / max(np.linalg.norm(x), 1e-9))
            own = np.unique(some)
            own = own[space.weights[own] > 0]
            telling.append(len(owner) * v.size + own)
            many.append(len(own))
            owner.append(len(items))
            offset.append(at)
            if common is not None and (~common[own]).sum() < s.least_telling:
                length = min(s.gram, len(some))
                grams.setdefault(length, []).extend((k, len(items), at + j) for j, k in enumerate(run_keys(some, length).tolist()))
        items.append(Item(key, numbers, answer_terms(text, v, space.weights)))
    listed = {}
    for length, runs in grams.items():
        runs = sorted(set(runs))
        listed[length] = tuple(np.array([r[k] for r in runs], dtype=t) for k, t in enumerate((np.uint64, np.int64, np.int64)))
    number = lambda x: np.array(x, dtype=np.int64)
    groups = -(-min(512, max(64, len(owner))) // 8) * 8
    group, need = np.zeros((v.size, groups), dtype=np.uint8), np.full(groups, 255, dtype=np.uint8)
    for part, terms in enumerate(telling):
        group[terms - part * v.size, part % groups] = 1
        need[part % groups] = min(need[part % groups], _asked(s, many[part]))
    return Queries(items, number(owner), number(offset), np.array(latent, dtype=np.float32).reshape(len(latent), vectors.shape[1]), Members(np.concatenate(telling) if telling else number([])), v.size, number(many), group, need, listed)


def _asked(s: Settings, many: np.ndarray | int) -> np.ndarray:
    """How many of a part's telling words a passage must hold."""
    return np.maximum(1, np.ceil(s.overlap * np.asarray(many) - 1e-9))


def common_length(item: Item, right: list[int]) -> int:
    """Length of the longest common subsequence of an item and a list of terms, by rows of bits in one integer."""
    get, full = item.places.get, (1 << item.size) - 1
    state = full
    for x in right:
        match = get(x)
        if match:
            u = state & match
            state = ((state + u) | (state - u)) & full
    return item.size - state.bit_count()


def verify(numbers: np.ndarray, item: Item, begin: int, s: Settings) -> tuple[bool, float]:
    """Does the text hold the item around word `begin`? Also the share of the item's words in common order."""
    slack = s.block + item.size // 6
    window = numbers[max(0, begin - slack) : max(0, begin + item.size + slack)].tolist()
    own = [x for x in window if x in item.places]  # no other word is common
    if len(own) < s.paraphrase * item.size:
        return False, 0.0
    share = common_length(item, own) / item.size
    if share >= s.near:
        return True, share
    if share < s.paraphrase or not item.answer:
        return False, share
    return len(item.answer.intersection(window)) >= s.answer * len(item.answer), share


def _shared(member, padded: np.ndarray, block: np.ndarray, base: np.ndarray, last: np.ndarray, blocks: int) -> np.ndarray:
    """How many words of the passage that begins at each block are members, as terms of the part that base stands for."""
    out = np.zeros(len(block), dtype=np.int64)
    for step in range(blocks):
        out += member(base[:, None] + padded[block + step]).sum(axis=1, dtype=np.int64) * (last[block + step] == last[block])
    return out


def _candidates(numbers: np.ndarray, n: np.ndarray, q: Queries, space: Space, vectors: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
    """(text, item, first word of the item in the text, cosine) by cosine and shared telling words, then by exact runs."""
    s = space.s
    rows, terms, owner = space.blocks_of(numbers, n)
    first_block, first_word = np.cumsum(-(-n // s.block)) - -(-n // s.block), np.cumsum(n) - n
    if s.block * s.blocks > 255:
        raise ValueError("a passage has at most 255 words")
    padded = np.concatenate([padded_blocks(numbers, n, s.block), np.zeros((s.blocks, s.block), dtype=np.int32)])
    last = np.concatenate([owner, np.full(s.blocks, -1)])
    # the words that a passage shares with any part of a group bound what it shares with one of them; a sum of 64 bits
    # counts for eight groups, as no count reaches 256
    groups = q.group.view(np.uint64)
    held = np.zeros((len(owner) + s.blocks, groups.shape[1]), dtype=np.uint64)
    if len(rows):
        kinds, first = np.unique(rows, return_index=True)
        held[kinds] = np.add.reduceat(groups[terms], first, axis=0)
    shared = held[: len(owner)].copy()
    for step in range(1, s.blocks):
        shared += held[step : step + len(owner)] * (last[step : step + len(owner)] == owner)[:, None].astype(np.uint64)
    live = np.flatnonzero((shared.view(np.uint8) >= q.need).any(axis=1))
    passages, norm = space.some_passages(vectors, rows, terms, owner, live)
    for at in range(0, len(live), 4096):
        some = live[at : at + 4096]
        dots = passages[at : at + 4096] @ q.latent.T
        flat = np.flatnonzero(dots > s.cosine * norm[at : at + 4096][:, None])
        if not len(flat):
            continue
        p, part = np.divmod(flat, dots.shape[1])
        block = some[p]
        value = dots.ravel()[flat] / norm[at + p]
        enough = _asked(s, q.many[part])
        quick = np.flatnonzero(_shared(q.telling.maybe, padded, block, part * q.size, last, s.blocks) >= enough)
        p, part, block, value, enough = p[quick], part[quick], block[quick], value[quick], enough[quick]
        for k in np.flatnonzero(_shared(q.telling.has, padded, block, part * q.size, last, s.blocks) >= enough).tolist():
            doc = int(owner[block[k]])
            yield doc, int(q.owner[part[k]]), int(block[k] - first_block[doc]) * s.block - int(q.offset[part[k]]), float(value[k])
    ends = np.cumsum(n)
    for length, (keys, item, place) in q.grams.items():
        found = run_keys(numbers, length)
        low, high = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
        for at in np.flatnonzero(high > low).tolist():
            doc = int(np.searchsorted(ends, at, "right"))
            if at + length <= ends[doc]:
                for k in range(low[at], high[at]):
                    yield doc, int(item[k]), int(at - first_word[doc] - place[k]), 0.0


def search(numbers: np.ndarray, n: np.ndarray, q: Queries, space: Space, vectors: np.ndarray) -> list[tuple[int, int, float, float]]:
    """(text, item, cosine, share) of every text of a batch that holds an item; one for each text and item. The cosine is
    0 if the place was found by a run of common words."""
    s = space.s
    if not len(numbers) or not len(q.items):
        return []
    first_word = np.cumsum(n) - n
    found: dict[tuple[int, int], tuple[float, float]] = {}
    tried: set[tuple[int, int, int]] = set()
    for doc, item, begin, value in _candidates(numbers, n, q, space, vectors):
        best = found.get((doc, item))
        if best is not None and best[1] >= s.near:
            continue
        if (doc, item, begin // 4) in tried:  # other passages and parts that point to the same place
            continue
        tried.add((doc, item, begin // 4))
        holds, share = verify(numbers[first_word[doc] : first_word[doc] + n[doc]], q.items[item], begin, s)
        if holds and (best is None or share > best[1]):
            found[doc, item] = (value, share)
    return [(d, i, *x) for (d, i), x in sorted(found.items())]


LEAK = "doc_id long, digest long, item_id long, cosine double, lcs_share double"


def _search(shared, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, space, latent = shared.value
        vectors = (space.weights[:, None] * latent).astype(np.float32)
        for batch in slices(batches, "terms", 200_000):
            numbers, n = _numbers(batch, kind)
            got = search(numbers, n, q, space, vectors)
            if got:
                doc = pa.array([g[0] for g in got])
                yield pa.RecordBatch.from_arrays([batch.column("key").take(doc), batch.column("digest").take(doc), pa.array([q.items[g[1]].key for g in got], type=pa.int64()), pa.array([g[2] for g in got], type=pa.float64()), pa.array([g[3] for g in got], type=pa.float64())], names=["doc_id", "digest", "item_id", "cosine", "lcs_share"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", settings: Settings | None = None) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, digest (a hash of the document's text),
    item_id, cosine, lcs_share."""
    s = settings or Settings()
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    bench = stored(benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).alias("t")).where("t IS NOT NULL").distinct(), "benchmark")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // s.block_bytes))
    out = None
    for b in range(n_blocks):
        some = bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == b)
        texts = [(r["i"], r["t"]) for r in some.orderBy("i", "t").collect()]  # about block_bytes of text
        v = Vocabulary([t for _, t in texts])
        if v.size == 1:  # no word to find
            continue
        encoded = stored(rows.mapInArrow(_encode(spark.sparkContext.broadcast(v), s.block), "key long, digest long, terms binary"), "terms")
        # a row without a digest holds a task's counts (xxhash64 is never null)
        counts = encoded.where("digest IS NULL").select(F.lit(0).alias("piece"), F.spark_partition_id().alias("part"), F.col("terms").alias("data"))
        frequency = _sum_counts(counts, v.size)
        encoded = encoded.where("digest IS NOT NULL")
        weights = term_weights(frequency, [v.numbers(normal_words(t)) for _, t in texts], s)
        weights /= max(weights.max(), 1e-9)
        space = Space(weights, s)
        latent = singular_vectors(encoded, space, v.kind)
        q = make_queries(texts, v, space, latent, too_common(frequency, s))
        shared = spark.sparkContext.broadcast((q, space, latent))
        got = encoded.mapInArrow(_search(shared, v.kind), LEAK)
        out = got if out is None else out.union(got)
    return spark.createDataFrame([], LEAK) if out is None else out


def _add_counts(table: pa.Table) -> pa.Table:
    total = 0
    for x in table.column("data").to_pylist():
        total = total + np.frombuffer(zlib.decompress(x), "<i8")
    return pa.table([pa.array([table.column(0)[0].as_py()], type=pa.int32()), pa.array([table.column(1)[0].as_py()], type=pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], type=pa.binary())], schema=_TABLE)


def _sum_counts(counts: DataFrame, size: int) -> np.ndarray:
    schema = "piece int, part int, data binary"
    some = counts.withColumn("part", F.floor(F.col("part") / 32).cast("int")).groupBy("piece", "part").applyInArrow(_add_counts, schema)
    rows = some.withColumn("part", F.lit(0)).groupBy("piece", "part").applyInArrow(_add_counts, schema).collect()
    return sum((np.frombuffer(zlib.decompress(r["data"]), "<i8") for r in rows), np.zeros(size, dtype=np.int64)).astype(float)


def keep_clean(docs: DataFrame, leaks: DataFrame, *, key: str = "doc_id", text: str = "text", broadcast_rows: int = 500_000) -> DataFrame:
    """The documents without a leak, by key and text: a null key matches a null key. Up to broadcast_rows leaks (16 bytes
    each) go to the documents; more are joined by a shuffle."""
    bad = stored(leaks.select(F.col("doc_id").alias("__k"), F.col("digest").alias("__d")).distinct(), "leaks")
    side = F.broadcast(bad) if bad.count() <= broadcast_rows else bad
    same = docs[key].cast("long").eqNullSafe(bad["__k"]) & (F.xxhash64(docs[text]) == bad["__d"])
    return docs.join(side, same, "left_anti")
