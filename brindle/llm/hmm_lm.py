"""Operator 8: a hidden Markov language model over words.

Word counts come from all training rows. The most frequent words are symbols of their own, as many as
`own_growth` times the root of the number of distinct words, so the model grows with the corpus; every other word
is one of a fixed number of classes by its ending, and keeps its own share of its class. Baum-Welch: each
partition gathers expected counts of starts, transitions and symbols over all its whole training texts, the counts
are summed over partitions in two rounds, and the states are estimated anew. The first states come from a
bounded sample (`first_rows` texts, about `first_tokens` tokens). The scaled forward recursion then gives the exact
likelihood of every whole text.

The symbols, and words that occur in at least one in `known_words` training tokens (no more than `known_words` can),
go to the workers. All rarer words are counted exactly by a join on the word, in which no word is frequent. Texts
are trained on and scored whole; of a very long one the forward recursion is repeated span by span, so that the
backward recursion needs the memory of one span.

Defined results: null text is empty (its end alone); with no training row every probability is that of the one
unseen token (score and base 0); repeated rows are scored each; an empty table gives no rows; a null key is
hashed as an empty text for its fold. Words are cut at space, tab and line ends only.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import grouped_sum, slices, stored, texts_of
from brindle.llm.simhash_ball import words_of

END = b" "  # no word holds a space


@dataclass
class Settings:
    states: int = 16
    own_growth: float = 20.0
    classes: int = 500
    known_words: int = 1_000_000
    passes: int = 2
    first_rows: int = 1200
    first_tokens: int = 400_000
    first_passes: int = 15
    flush: int = 150_000


def word_class(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-2:]) % classes


@cache
def _class_table(classes: int) -> np.ndarray:
    """The class of a word by its last two bytes as one number; of a word of one byte, that byte after 65536."""
    both = [zlib.crc32(bytes([a, b])) % classes for a in range(256) for b in range(256)]
    return np.array(both + [zlib.crc32(bytes([b])) % classes for b in range(256)], dtype=np.int64)


def word_classes(words: list[bytes], classes: int) -> np.ndarray:
    """word_class of many words that aren't empty."""
    if not words:
        return np.zeros(0, dtype=np.int64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
    ends = np.cumsum(size)
    last, before = data[ends - 1], data[np.maximum(ends - 2, 0)]
    return _class_table(classes)[np.where(size > 1, before * 256 + last, 65536 + last)]


# -- counts -------------------------------------------------------------------------------------------------


def _count(flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=pa.binary()).cast(pa.string()), pa.array(list(c.values()), type=pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in slices(batches, "text"):
            for t in texts_of(batch, "text"):
                counts.update(words_of(t))
            counts[END] += batch.num_rows
            if len(counts) > flush:  # bounded memory; the frequent words stay for more
                often = {w: n for w, n in counts.items() if n > 8} if len(counts) < 4 * flush else {}
                yield out(Counter({w: n for w, n in counts.items() if w not in often}))
                counts = Counter(often) if len(often) < flush // 2 else (yield out(Counter(often))) or Counter()
        if counts:
            yield out(counts)

    return run


def count_words(rows: DataFrame, flush: int) -> DataFrame:
    """word and c over the training rows: partial counts in each task, then one sum a word."""
    partial = rows.select("text").mapInArrow(_count(flush), "word string, n long")
    return stored(partial.groupBy("word").agg(F.sum("n").alias("c")), "counts")


@dataclass
class Vocabulary:
    settings: Settings
    total: int  # training tokens
    distinct: int
    known: dict[bytes, int]  # the row of each word that is frequent enough
    counts: np.ndarray  # of these words
    own: np.ndarray  # their symbol; -1 if they are none
    n_own: int
    class_total: np.ndarray  # of the words that are not: tokens and distinct words in each class
    class_distinct: np.ndarray

    @property
    def kind(self) -> str:
        """How a symbol is written."""
        return "<u2" if self.n_own + self.settings.classes < 1 << 16 else "<u4"

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def share(self, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        """log10 of a word's share of its class; one unseen word has a share too."""
        return np.log10((c + 0.5) / (self.class_total[k] + 0.5 * (self.class_distinct[k] + 1)))

    def table(self) -> np.ndarray:
        """Columns for each known word: symbol, base score, share score (0 for a symbol of its own)."""
        classes = word_classes(list(self.known), self.settings.classes)
        own = self.own >= 0
        return np.stack([np.where(own, self.own, self.n_own + classes), self.base(self.counts), np.where(own, 0.0, self.share(self.counts, classes))], axis=1)


def class_column(word: Column, classes: int) -> Column:
    return F.pmod(F.crc32(F.substring(word.cast("binary"), -2, 2)), F.lit(classes)).cast("int")


def build_vocabulary(counts: DataFrame, s: Settings) -> Vocabulary:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    wanted = int(np.ceil(s.own_growth * distinct**0.5))
    # words by sixteenths of a doubling of their count: a few hundred rows
    level = F.floor(F.log2("c") * 16)
    lowest, held = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if held >= wanted or held + r["n"] > 4 * wanted:
            break
        lowest, held = r["level"], held + r["n"]
    frequent = F.col("c") * s.known_words >= total  # at most known_words words
    listed = counts.where(frequent if lowest is None else frequent | (level >= lowest)).select(F.col("word").cast("binary").alias("word"), "c").orderBy(F.desc("c"), "word").toArrow()
    words, c = listed.column("word").to_pylist(), listed.column("c").to_numpy().astype(float)
    least = c[min(wanted, held) - 1] if held else np.inf  # words of equal counts are treated alike
    n_own = int((c >= least).sum())  # the first, as the most frequent come first
    own = np.where(np.arange(len(c)) < n_own, np.arange(len(c)), -1)
    rest = counts.where(F.col("c") < float(least)) if n_own else counts
    per_class = rest.groupBy(class_column(F.col("word"), s.classes).alias("k")).agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("d"))
    class_total, class_distinct = np.zeros(s.classes), np.zeros(s.classes)
    for r in per_class.collect():
        class_total[r["k"]], class_distinct[r["k"]] = r["t"], r["d"]
    return Vocabulary(s, total, distinct, {w: k for k, w in enumerate(words)}, c, own, n_own, class_total, class_distinct)


# -- encoding -----------------------------------------------------------------------------------------------

ENCODED = "row long, key long, learn boolean, symbols binary, n_tokens long, n_known long, base double, share double, words array<string>"


def _encode(shared):
    schema = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("learn", pa.bool_()), ("symbols", pa.binary()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("share", pa.float64()), ("words", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v: Vocabulary = shared.value
        table, get, classes = v.table(), v.known.get, v.settings.classes
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            words = [[*words_of(t), END] for t in texts_of(batch, "text")]
            n = np.array([len(w) for w in words], dtype=np.int64)
            flat = [w for x in words for w in x]
            at = np.array([get(w, -1) for w in flat], dtype=np.int64)
            seen = at >= 0
            got = table[at] * seen[:, None] if len(table) else np.zeros((len(at), 3))
            rare = np.flatnonzero(~seen)  # counted by the join
            rare_words = [flat[k] for k in rare.tolist()]
            got[rare, 0] = v.n_own + word_classes(rare_words, classes)
            ends = np.cumsum(n)
            symbols = got[:, 0].astype(v.kind)
            sums = grouped_sum(np.concatenate([got[:, 1:], seen[:, None]], axis=1), n)
            cuts = np.searchsorted(rare, np.concatenate([[0], ends])).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(cuts), pa.array(rare_words, type=pa.binary()).cast(pa.string()))
            columns = [np.arange(row, row + len(n)), batch.column("key"), batch.column("learn"), [symbols[e - m : e].tobytes() for e, m in zip(ends.tolist(), n.tolist(), strict=True)], n, sums[:, 2].round().astype(np.int64), sums[:, 0], sums[:, 1], listed]
            row += len(n)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


# -- the model ----------------------------------------------------------------------------------------------


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states by states
    emit: np.ndarray  # symbols by states

    @classmethod
    def guess(cls, states: int, frequency: np.ndarray, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        emit = frequency[:, None] * rng.gamma(2.0, 1.0, (len(frequency), states))
        return cls(np.full(states, 1 / states), np.full((states, states), 0.5 / states) + 0.5 * np.eye(states), emit / emit.sum(axis=0))

    @classmethod
    def estimate(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, frequency: np.ndarray) -> Model:
        """From expected counts; a little of the overall frequencies keeps every symbol possible in every state."""
        emit = emit + 2.0 * len(frequency) ** 0.5 * frequency[:, None]
        move, start = move + 0.1, start + 0.1
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class Counts:
    """Expected counts of starts, moves and symbols by states."""

    def __init__(self, m: Model):
        self.start, self.move, self.emit = np.zeros(m.start.shape), np.zeros(m.move.shape), np.zeros(m.emit.shape)


class _Side:
    """Whole sequences of symbols side by side, the longest first: the symbols of time t stand together."""

    def __init__(self, texts: list[np.ndarray]):
        texts = sorted(texts, key=len, reverse=True)
        n = np.array([len(t) for t in texts], dtype=np.int64)
        self.width = int(n[0]) if len(n) else 0
        self.active = np.searchsorted(-n, -np.arange(1, self.width + 1), side="right")  # how many are longer than t
        self.first = np.concatenate([[0], np.cumsum(self.active)])
        time = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.symbols = np.empty(len(time), dtype=np.int64)
        self.symbols[self.first[time] + np.repeat(np.arange(len(texts)), n)] = np.concatenate(texts) if texts else []

    def spans(self, most: int) -> list[tuple[int, int]]:
        """Cuts of the time, each with at most about so many symbols."""
        out, at = [], 0
        while at < self.width:
            end = max(at + 1, int(np.searchsorted(self.first, self.first[at] + most, side="right")) - 1)
            out.append((at, end))
            at = end
        return out


def _forward_span(side: _Side, begin: int, end: int, a, start, move, emit):
    """Scaled forward values of the times begin..end-1, their scales and symbol probabilities; a: those before, if any."""
    base, k = side.first[begin], 0
    b = emit[side.symbols[base : side.first[end]]]
    alpha, scale = np.empty_like(b), np.empty((len(b), 1), dtype=b.dtype)
    for t in range(begin, end):
        at, k = side.first[t] - base, side.active[t]
        now = start * b[at : at + k] if a is None else (a[:k] @ move) * b[at : at + k]
        c = np.maximum(now.sum(axis=1, keepdims=True), 1e-30)
        np.divide(now, c, out=alpha[at : at + k])
        scale[at : at + k] = c
        a = alpha[at : at + k]
    return alpha, scale, b


def expected_counts(m: Model, texts: list[np.ndarray], total: Counts, *, span: int = 400_000) -> None:
    """Adds Baum-Welch's expected counts over whole sequences of symbols to total, all of a batch side by side."""
    f = np.float32
    side = _Side([t for t in texts if len(t)])
    if not side.width:
        return
    start, move, emit = m.start.astype(f), m.move.astype(f), m.emit.astype(f)
    spans, before, held = side.spans(span), [], None
    a = None
    for begin, end in spans:  # only the values before each span are kept, and all of the last
        before.append(a)
        held = _forward_span(side, begin, end, a, start, move, emit)
        a = held[0][side.first[end - 1] - side.first[begin] :].copy()
    beta = np.ones((int(side.active[0]), len(start)), dtype=f)
    moves = np.zeros(move.shape)
    for (begin, end), a in zip(reversed(spans), reversed(before), strict=True):
        alpha, scale, b = held or _forward_span(side, begin, end, a, start, move, emit)
        held = None
        base = side.first[begin]
        for t in range(end - 1, begin - 1, -1):
            at, k = side.first[t] - base, side.active[t]
            alpha[at : at + k] *= beta[:k]  # from here on the states' probabilities; the times before are still alpha
            if t:
                right = beta[:k] * b[at : at + k] / scale[at : at + k]
                left = a[:k] if t == begin else alpha[side.first[t - 1] - base :][:k]
                moves += left.T @ right
                beta[:k] = right @ move.T
        flat = side.symbols[base : side.first[end]]
        order = np.argsort(flat, kind="stable")
        kinds, first = np.unique(flat[order], return_index=True)
        total.emit[kinds] += np.add.reduceat(alpha[order], first, axis=0)
        if not begin:
            total.start += alpha[: side.active[0]].sum(axis=0)
    total.move += moves * m.move


def _batches_of_texts(texts: Iterator[np.ndarray], most: int = 250_000, hold: int = 2_000_000) -> Iterator[list[np.ndarray]]:
    """Whole texts, those of like lengths together."""

    def dealt(held: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        out, size = [], 0
        for t in sorted(held, key=len):
            out.append(t)
            size += len(t)
            if size >= most:
                yield out
                out, size = [], 0
        if out:
            yield out

    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= hold:
            yield from dealt(held)
            held, size = [], 0
    yield from dealt(held)


_PART = pa.schema([("state", pa.int32()), ("part", pa.int32()), ("counts", pa.binary())])


def _gather(shared, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m: Model = shared.value
        states, total = len(m.start), Counts(m)
        texts = (np.frombuffer(x, kind) for b in slices(batches, "symbols") for x in b.column("symbols").to_pylist())
        for some in _batches_of_texts(texts):
            expected_counts(m, some, total)
        if total.start.any():
            part = TaskContext.get().partitionId()
            rows = np.concatenate([total.start[:, None], total.move, total.emit.T], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(range(states), type=pa.int32()), pa.array([part] * states, type=pa.int32()), pa.array([zlib.compress(row.astype("<f4").tobytes(), 1) for row in rows], type=pa.binary())], schema=_PART)

    return run


def _add(table: pa.Table) -> pa.Table:
    total = 0.0
    for x in table.column("counts").to_pylist():
        total = total + np.frombuffer(zlib.decompress(x), "<f4").astype(float)
    return pa.table([pa.array([table.column(0)[0].as_py()], type=pa.int32()), pa.array([table.column(1)[0].as_py()], type=pa.int32()), pa.array([zlib.compress(total.astype("<f4").tobytes(), 1)], type=pa.binary())], schema=_PART)


def train_pass(encoded: DataFrame, m: Model, frequency: np.ndarray, kind: str) -> Model:
    """One round of Baum-Welch over all training rows: partitions' counts are added in groups of 32, then all."""
    shared = encoded.sparkSession.sparkContext.broadcast(m)
    schema = "state int, part int, counts binary"
    parts = encoded.where("learn").select("symbols").mapInArrow(_gather(shared, kind), schema)
    some = parts.withColumn("part", F.floor(F.col("part") / 32).cast("int")).groupBy("state", "part").applyInArrow(_add, schema)
    rows = some.withColumn("part", F.lit(0)).groupBy("state", "part").applyInArrow(_add, schema).collect()  # one row a state
    states = len(m.start)
    total = np.zeros((states, 1 + states + len(m.emit)))
    for r in rows:
        total[r["state"]] = np.frombuffer(zlib.decompress(r["counts"]), "<f4")
    return Model.estimate(total[:, 0], total[:, 1 : 1 + states], total[:, 1 + states :].T, frequency)


def log10_likelihood(m: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Of whole sequences by the scaled forward recursion, all of them side by side."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    n = np.array([len(texts[k]) for k in order])
    flat = np.concatenate([texts[k] for k in order]) if order else np.zeros(0, np.int64)
    begin = np.cumsum(n) - n
    logs = np.zeros(len(texts))
    width = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(1, width + 1), side="right")
    a = None
    for t in range(width):
        k = active[t]
        b = m.emit[flat[begin[:k] + t]]
        a = m.start * b if t == 0 else (a[:k] @ m.move) * b
        c = a.sum(axis=1)
        logs[:k] += np.log10(c)
        a = a / c[:, None]
    out = np.empty(len(texts))
    out[order] = logs
    return out


SCORED = "row long, key long, learn boolean, n_tokens long, n_known long, base double, share double, hmm double"


def _forward(shared, kind: str, most: int = 2_500_000):
    names = [x.split()[0] for x in SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value

        def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            logs = log10_likelihood(m, [np.frombuffer(x, kind) for x in t.column("symbols").to_pylist()])
            yield from t.drop_columns(["symbols"]).append_column("hmm", pa.array(logs)).select(names).to_batches()

        held, size = [], 0
        for batch in slices(batches, "symbols", 2 * most, 1 << 30):
            held.append(batch)
            size += sum(batch.column("n_tokens").to_pylist())
            if size >= most:
                yield from out(held)
                held, size = [], 0
        if held:
            yield from out(held)

    return run


def score(docs: DataFrame, learn: Column, *, key: str = "doc_id", text: str = "text", settings: Settings | None = None) -> DataFrame:
    """key, learn, n_tokens, n_known, train_tokens, base_score and score of every row. learn is a condition over column k."""
    s = settings or Settings()
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text")).select("k", "text", learn.alias("learn")).withColumnRenamed("k", "key")
    counts = count_words(rows.where("learn"), s.flush)
    v = build_vocabulary(counts, s)
    shared = spark.sparkContext.broadcast(v)
    encoded = stored(rows.mapInArrow(_encode(shared), ENCODED), "symbols")
    frequency = np.concatenate([v.counts[: v.n_own], v.class_total]) + 0.5
    frequency = frequency / frequency.sum()
    model = Model.guess(s.states, frequency)
    if v.total:
        # about first_rows texts, chosen by a hash; they only set out the states, all texts then train them
        texts_n = float(v.counts[v.known[END]]) if END in v.known else 1.0
        dice = F.pmod(F.xxhash64(F.lit("states"), "row"), F.lit(1_000_000)) / 1_000_000
        rate = min(s.first_rows / texts_n, s.first_tokens / v.total)
        first = [np.frombuffer(r["symbols"], v.kind) for r in encoded.where("learn").where(dice < rate).select("symbols").collect()]
        for _ in range(s.first_passes if first else 0):
            sums = Counts(model)
            for some in _batches_of_texts(iter(first)):
                expected_counts(model, some, sums)
            model = Model.estimate(sums.start, sums.move, sums.emit, frequency)
        for _ in range(s.passes):
            model = train_pass(encoded, model, frequency, v.kind)
    shared_model = spark.sparkContext.broadcast(model)
    chosen = encoded.select("row", "key", "learn", "symbols", "n_tokens", "n_known", "base", "share")
    scored = chosen.mapInArrow(_forward(shared_model, v.kind), SCORED)
    rare = encoded.select("row", F.explode("words").alias("word"))
    width = F.lit(float(v.total + 0.5 * (v.distinct + 1)))
    classes = F.array(*[F.lit(float(a + 0.5 * (b + 1))) for a, b in zip(v.class_total, v.class_distinct, strict=True)])
    joined = rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    tail = joined.groupBy("row").agg(
        F.sum(F.log10((F.col("c") + 0.5) / width)).alias("tail_base"),
        F.sum(F.log10((F.col("c") + 0.5) / F.element_at(classes, class_column(F.col("word"), s.classes) + 1))).alias("tail_share"),
        F.count_if(F.col("c") > 0).alias("tail_known"),
    )
    whole = scored.join(tail, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    if not v.total:  # one unseen token is all there is: its probability is 1
        hmm = F.lit(0.0)
    else:
        hmm = F.col("hmm") + F.col("share") + zero("tail_share")
    return whole.select(F.col("key").alias(key), "learn", "n_tokens", (F.col("n_known") + zero("tail_known")).cast("long").alias("n_known"), F.lit(int(v.total)).cast("long").alias("train_tokens"), (F.col("base") + zero("tail_base")).alias("base_score"), hmm.cast("double").alias("score"))
