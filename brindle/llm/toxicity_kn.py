"""Operator 5: toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary text, give each expression (a run of letters, digits and marks between
spaces) the probability of its characters, spelled as the bytes of UTF-8, so every script has all its characters. The highest order is counted in each class; all lower orders are
continuation counts of both classes together, so expressions that a class has rarely or never seen are spelled
from shared backoff counts and get nearly the same probability from both. The log-likelihoods are normalised by
length; a document is judged by its mean ratio and by the ratios of its most toxic expressions, so a few words
in a long text still count. A logistic function, fitted on labelled rows that the models did not see, turns
these into a score.

Training rows are a bounded sample (`toxic_rows`, `ordinary_rows`); everything else covers all rows and whole
texts. Defined results: null or empty text has no expression and scores by the intercept and the class prior
like a text of neutral words; repeated rows score alike; rows with a null label are not learned from; with no
label of one class the score is the share of the other class; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Memo, bare_word, fold, slices, stored, texts_of

#: No byte of UTF-8 is 255.
ORDER, DISCOUNT, BOUNDARY = 6, 0.75, 255
FEATURES = 6


def expressions(text: str) -> list[str]:
    """Lower-cased runs between white space; the models see what bare_word leaves of them."""
    return text.lower().split()


def codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the words, each word between boundaries: ORDER-1 before it, one after it; and the lengths with the latter."""
    bare = [bare_word(w).encode("utf-8", "surrogatepass") for w in words]
    before, after = bytes([BOUNDARY]) * (ORDER - 1), bytes([BOUNDARY])
    lengths = np.fromiter(map(len, bare), dtype=np.int64, count=len(bare)) + 1
    joined = before + (after + before).join(bare) + after if bare else b""
    return np.frombuffer(joined, dtype=np.uint8), lengths


def grams(chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each byte after the first boundaries: it and the ORDER-1 before it, packed into 64 bits, the newest lowest."""
    n = int(lengths.sum())
    ends = np.cumsum(lengths)
    at = np.arange(n) + np.repeat(np.arange(1, len(lengths) + 1) * (ORDER - 1), lengths)
    packed = np.zeros(n, dtype=np.uint64)
    for k in range(ORDER - 1, -1, -1):
        packed = (packed << np.uint64(8)) | chars[at - k].astype(np.uint64)
    assert not len(ends) or len(packed) == ends[-1]
    return packed


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return np.where(hit, values[at], 0.0), hit


@dataclass
class Models:
    """Of each lower order its n-grams' own part and its contexts' backoff weight; of each class the same for the highest."""

    lower: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    top: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    weights: np.ndarray | None = None

    def log_ratio(self, words: list[str]) -> np.ndarray:
        """Columns: log p(word | toxic) - log p(word | ordinary), and the number of bytes, its end counted."""
        chars, lengths = codes(words)
        g = grams(chars, lengths)
        unique, back = np.unique(g, return_inverse=True)
        p = np.full(len(unique), 1.0 / 256)
        for order, (keys, own, contexts, weight) in enumerate(self.lower, 1):
            p = self._step(unique & np.uint64((1 << 8 * order) - 1), keys, own, contexts, weight, p)
        by_class = [np.log(self._step(unique, *t, p)) for t in self.top]
        ratio = (by_class[1] - by_class[0])[back]
        ends = np.cumsum(lengths)
        total = np.concatenate([[0.0], np.cumsum(ratio)])
        return np.stack([total[ends] - total[ends - lengths], lengths.astype(float)], axis=1)

    @staticmethod
    def _step(g, keys, own, contexts, weight, below):
        """Interpolation: the discounted share of the n-gram, plus its context's free mass times the lower order."""
        share, _ = _lookup(keys, own, g)
        mass, seen = _lookup(contexts, weight, g >> np.uint64(8))
        return share + np.where(seen, mass, 1.0) * below


def _shares(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    contexts, group = np.unique(keys >> np.uint64(8), return_inverse=True)
    total = np.bincount(group, counts)
    kinds = np.bincount(group)
    return keys, np.maximum(counts - DISCOUNT, 0) / total[group], contexts, DISCOUNT * kinds / total


def fit_models(ordinary: Counter, toxic: Counter) -> Models:
    """Kneser-Ney models from word counts of the two classes."""
    by_class = []
    for words in (ordinary, toxic):
        chars, lengths = codes(list(words))
        g = grams(chars, lengths)
        n = np.repeat(np.fromiter(words.values(), dtype=float, count=len(words)), lengths)
        keys, at = np.unique(g, return_inverse=True)
        by_class.append((keys, np.bincount(at, n) if len(keys) else np.zeros(0)))
    kinds = np.unique(np.concatenate([k for k, _ in by_class]))
    lower = []
    for order in range(ORDER - 1, 0, -1):
        kinds_below, counts = np.unique(kinds & np.uint64((1 << 8 * order) - 1), return_counts=True)  # how many characters go before it
        lower.append(_shares(kinds_below, counts.astype(float)))
        kinds = kinds_below
    return Models(lower[::-1], [_shares(*x) for x in by_class])


#: Ratios above this tell no more.
_MOST = 14.0


def features(ratios: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each document: constant, mean ratio a byte, its three most toxic expressions' ratios, log of its length."""
    out = np.zeros((len(counts), FEATURES))
    out[:, 0] = 1
    ends = np.cumsum(counts)
    for k, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
        if n:
            r = ratios[end - n : end]
            best = r[:, 0] if n <= 3 else np.partition(r[:, 0], n - 3)[-3:]
            best = np.sort(np.clip(best, 0, _MOST))[::-1]
            out[k, 1] = np.clip(10 * r[:, 0].sum() / r[:, 1].sum(), -3, 3)
            out[k, 2 : 2 + len(best)] = best
            out[k, 5] = np.log(n) / 8
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Newton's method for the weighted logistic loss with a ridge penalty (not on the constant)."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _document_features(models: Models, words: list[list[str]], memo: Memo) -> np.ndarray:
    flat = [w for x in words for w in x]
    rows = memo(flat)
    values = memo.values[rows] if len(flat) else np.zeros((0, 2))
    return features(values, np.array([len(x) for x in words], dtype=np.int64))


def fit(docs: DataFrame, labels: DataFrame, *, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", toxic_rows: int = 2000, ordinary_rows: int = 3000, sample_bytes: int = 32_000_000, folds: int = 3) -> Models:
    """Learn from labelled rows where `learn` holds: at most about toxic_rows and ordinary_rows of them, chosen by a
    hash of the key at a rate that the class sizes set; fewer if their texts (rows with equal keys and texts count
    once) have more than sample_bytes. The logistic function is fitted on each fold's rows as the
    models of the other folds see them; the models returned know all folds."""
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    marks = marks.where(learn)
    size = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        w = np.zeros(FEATURES)
        w[0] = 30.0 if n1 else -30.0
        return Models([], [], w)
    dice = F.pmod(F.xxhash64(F.lit("toxicity"), "k"), F.lit(1_000_000)) / 1_000_000
    chosen = marks.where(F.when(F.col("y") == 1, dice < toxic_rows / n1).otherwise(dice < ordinary_rows / n0))
    chosen = stored(chosen, "labels")
    # the sample's keys are bounded; rows with one of them may be many, or long
    picked = stored(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").distinct(), "sample")
    size = picked.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    if size > sample_bytes:
        picked = picked.where(F.pmod(F.xxhash64(F.lit("bytes"), "k", "t"), F.lit(1_000_000)) < int(1_000_000 * sample_bytes / size))
    # words as numbers: the sample's texts are gone when the models are made
    number: dict[str, int] = {}
    rows = [(hash_of(r["k"]) % folds, r["y"], np.fromiter((number.setdefault(w, len(number)) for w in expressions(r["t"] or "")), dtype=np.int32)) for r in picked.orderBy("k", "t").toLocalIterator()]
    words = list(number)
    counted = np.zeros((folds, 2, len(words)), dtype=np.int64)
    for f, y, own in rows:
        counted[f, y] += np.bincount(own, minlength=len(words)).astype(np.int64)
    bare = list(map(bare_word, words))

    def fitted(counts: np.ndarray) -> Models:
        by_class = (Counter(), Counter())
        for c, n in zip(by_class, counts, strict=True):
            for k in np.flatnonzero(n).tolist():
                c[bare[k]] += int(n[k])
        return fit_models(*by_class)

    x, y = [], []
    for f in range(folds):
        # features of rows that the models did not see
        some = [r for r in rows if r[0] == f]
        if some:
            models = fitted(counted.sum(axis=0) - counted[f])
            used = np.flatnonzero(counted[f].sum(axis=0))
            values = np.zeros((len(words), 2))
            values[used] = models.log_ratio([words[k] for k in used.tolist()])
            x.append(features(values[np.concatenate([r[2] for r in some])], np.array([len(r[2]) for r in some], dtype=np.int64)))
            y += [r[1] for r in some]
    if not y:
        return Models([], [], np.array([np.log(n1 / n0)] + [0.0] * (FEATURES - 1)))
    y = np.array(y, dtype=float)
    drawn, true = np.array([(y == 0).sum(), y.sum()]), np.array([n0, n1], dtype=float)
    weight = np.where(y == 1, true[1] / max(drawn[1], 1), true[0] / max(drawn[0], 1)) * len(y) / true.sum()
    models = fitted(counted.sum(axis=0))
    models.weights = fit_logistic(np.concatenate(x), y, weight) if drawn.min() else np.array([np.log(n1 / n0)] + [0.0] * (FEATURES - 1))
    return models


def hash_of(key) -> int:
    """A fixed small hash of a key, to split rows."""
    import zlib

    return zlib.crc32(f"calibrate {key}".encode())


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        memo = Memo(models.log_ratio)
        for batch in slices(batches, "t"):
            x = _document_features(models, [expressions(t) for t in texts_of(batch, "t")], memo) if models.top else np.tile([1.0] + [0.0] * (FEATURES - 1), (batch.num_rows, 1))
            s = 1 / (1 + np.exp(-np.clip(x @ models.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(s)], names=["k", "score"])

    return run


def score(docs: DataFrame, models: Models, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the score of every row. The models are as large as the sample they come from, which is bounded."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(models)
    return rows.mapInArrow(_score(shared), "k long, score double").withColumnRenamed("k", key)


def training_rows(modulus: int = 5, held_out: int = 0) -> Column:
    return fold("k", modulus) != held_out


def _below(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, text = shared.value
        memo = Memo(models.log_ratio)
        for batch in slices(batches, text):
            x = _document_features(models, [expressions(t) for t in texts_of(batch, text)], memo) if models.top else np.tile([1.0] + [0.0] * (FEATURES - 1), (batch.num_rows, 1))
            keep = 1 / (1 + np.exp(-np.clip(x @ models.weights, -30, 30))) < threshold
            yield batch.filter(pa.array(keep))

    return run


def keep_below(docs: DataFrame, models: Models, threshold: float = 0.5, *, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast((models, text))
    return docs.mapInArrow(_below(shared, threshold), docs.schema)
