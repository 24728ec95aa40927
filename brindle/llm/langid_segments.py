"""Operator 6: language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary (never trained here) get a probability in each language. A word's
probability is the sum over all its segmentations into pieces of the product of their probabilities, by the
forward algorithm; a text's is the product over its words. Piece probabilities are fitted by
expectation-maximisation on the word counts of a bounded sample of labelled rows of each language
(`rows_per_language`); scoring covers all rows and whole texts. Characters outside the vocabulary are one piece
for each byte. Sums are kept as logarithms, so words of any length are scored whole.

Defined results: `und` with score 0 if the text is null or has no letter; ties go to the first language in
order of name; rows with a null language are not learned from; with nothing to learn from every text is `und`;
repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import Memo, bare_word, grouped_sum, slices, stored, texts_of

SPACE, FLOOR = "▁", 1e-9
#: Characters of the words whose lattices are made at once.
_CHARS = 20_000


def read_pieces(path: str) -> dict[str, int]:
    """Pieces of a sentencepiece vocabulary and their ids; 0 stands for one byte of any other character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, int] = {}
    for k in range(1, model.get_piece_size()):
        if not (model.is_control(k) or model.is_byte(k) or model.is_unknown(k) or model.is_unused(k)):
            out.setdefault(model.id_to_piece(k).lower(), k)  # texts are compared in lower case
    return out


def text_words(text: str) -> list[str]:
    """Lower-cased runs between white space; only what bare_word leaves of them is scored."""
    return text.lower().split()


def prefixes(pieces: dict[str, int]) -> dict[str, int]:
    """The pieces' numbers, and 0 for every other beginning of a piece: where a text leaves this, no piece goes on."""
    out = {p[:k]: 0 for p in pieces for k in range(1, len(p))}
    return out | pieces


def lattice(words: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All edges (word, from, to, piece) of the segmentation lattices; positions count characters after the word mark.
    known: what `prefixes` gives."""
    get = known.get
    word, begin, end, piece = [], [], [], []
    for w, text in enumerate(words):
        text = SPACE + text
        n = len(text)
        for i in range(n):
            k = get(text[i])
            if not k:
                word.append(w)
                begin.append(i)
                end.append(i + 1)
                piece.append(-len(text[i].encode("utf-8", "replace")))  # that many byte pieces
            j = i + 1
            while k is not None:
                if k:
                    word.append(w)
                    begin.append(i)
                    end.append(j)
                    piece.append(k)
                j += 1
                if j > n:
                    break
                k = get(text[i:j])
    return tuple(np.array(x, dtype=np.int64) for x in (word, begin, end, piece))


def edge_logs(piece: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Log-probability of each edge (rows) in each language (columns of log_p); a negative piece is that many bytes."""
    return np.where(piece[:, None] >= 0, log_p[np.maximum(piece, 0)], log_p[0] * np.maximum(-piece, 1)[:, None])


def _sums(edges, logs: np.ndarray, lengths: np.ndarray, backward: bool) -> np.ndarray:
    """Log-sums over all segmentations up to (or, backward, from) each position of each word; the words' positions stand
    one after the other, lengths[w] + 1 of them. Position after position, for all words and languages at once."""
    word, begin, end, _ = edges
    first = np.cumsum(lengths + 1) - (lengths + 1)
    out = np.full((int((lengths + 1).sum()), logs.shape[1]), -np.inf)
    out[first + lengths if backward else first] = 0.0
    target, source = (begin, end) if backward else (end, begin)
    order = np.lexsort((word, target))
    step, own = target[order], word[order]
    to, come = first[own] + step, first[own] + source[order]
    fresh = np.ones(len(order), dtype=bool)  # the first edge into a position
    fresh[1:] = to[1:] != to[:-1]
    width = int(lengths.max()) + 1 if len(lengths) else 0
    cuts = np.searchsorted(step, np.arange(width + 1))
    for t in range(width - 1, -1, -1) if backward else range(width):
        a, b = cuts[t], cuts[t + 1]
        if a == b:
            continue
        values = out[come[a:b]] + logs[order[a:b]]
        at = np.flatnonzero(fresh[a:b])
        most = np.maximum.reduceat(values, at, axis=0)
        many = np.diff(np.append(at, b - a))
        out[to[a:b][at]] = most + np.log(np.add.reduceat(np.exp(values - np.repeat(most, many, axis=0)), at, axis=0))
    return out


def log_probability(edges, lengths: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability in each language; lengths count the word mark."""
    sums = _sums(edges, edge_logs(edges[3], log_p), lengths, False)
    return sums[np.cumsum(lengths + 1) - 1]


def expect(edges, lengths: np.ndarray, counts: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece of one language over all segmentations of all words, weighted by the words' counts."""
    word, begin, end, piece = edges
    logs = edge_logs(piece, log_p)
    before, after = _sums(edges, logs, lengths, False)[:, 0], _sums(edges, logs, lengths, True)[:, 0]
    first = np.cumsum(lengths + 1) - (lengths + 1)
    use = np.exp(before[first[word] + begin] + logs[:, 0] + after[first[word] + end] - before[first + lengths][word]) * counts[word]
    return np.bincount(np.maximum(piece, 0), use * np.where(piece < 0, -piece, 1), minlength=len(log_p))


def portions(words: list[str]) -> Iterator[slice]:
    """Runs of the words of about _CHARS characters; a longer word stands alone, never cut."""
    at = size = 0
    for k, w in enumerate(words):
        if size and size + len(w) > _CHARS:
            yield slice(at, k)
            at, size = k, 0
        size += len(w) + 1
    if at < len(words):
        yield slice(at, len(words))


@dataclass
class Languages:
    """names in order; pieces; probability[language, piece]."""

    names: list[str]
    pieces_path: str
    probability: np.ndarray

    def scorer(self):
        known = prefixes(read_pieces(self.pieces_path))
        log_p = np.log(self.probability).T.copy()

        def compute(words: list[str]) -> np.ndarray:
            out = np.zeros((len(words), len(self.names) + 1))
            for some in portions(words):
                own = words[some]
                out[some, :-1] = log_probability(lattice(own, known), np.array([len(w) + 1 for w in own], dtype=np.int64), log_p)
                out[some, -1] = [bool(w) for w in own]
            return out * out[:, -1:]  # what has no letter counts for nothing

        return compute


def fit_counts(counts: dict[str, Counter], pieces_path: str, *, rounds: int = 4) -> Languages:
    """Expectation-maximisation of the piece probabilities of each language from its word counts."""
    pieces = read_pieces(pieces_path)
    known, size = prefixes(pieces), max(pieces.values()) + 1
    names = sorted(counts)
    table = np.zeros((len(names), size))
    for k, name in enumerate(names):
        listed = sorted(counts[name])
        some = [(lattice(listed[x], known), np.array([len(w) + 1 for w in listed[x]], dtype=np.int64), np.array([counts[name][w] for w in listed[x]], dtype=float)) for x in portions(listed)]
        p = np.full(size, 1 / size)
        for _ in range(rounds):
            log_p = np.log(p)[:, None]
            uses = sum(expect(edges, lengths, n, log_p) for edges, lengths, n in some) + 0.01
            p = uses / uses.sum()
        table[k] = np.maximum(p, FLOOR)
    return Languages(names, pieces_path, table)


def fit(docs: DataFrame, pieces_path: str, *, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_language: int = 600, sample_bytes: int = 32_000_000) -> Languages:
    """Learn from rows where `learn` holds (over columns k, l), about rows_per_language of each language, chosen by a hash
    of the key; fewer if their texts (rows with equal keys and texts count once) have more than sample_bytes."""
    rows = docs.select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t")).where(F.col("l").isNotNull() & F.col("k").isNotNull()).where(learn)
    size = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not size:
        return Languages([], pieces_path, np.zeros((0, 1)))
    rate = F.create_map(*[F.lit(x) for k, n in sorted(size.items()) for x in (k, rows_per_language / n)])
    dice = F.pmod(F.xxhash64(F.lit("language"), "k"), F.lit(1_000_000)) / 1_000_000
    counts = {k: Counter() for k in sorted(size)}
    picked = stored(rows.where(dice < rate[F.col("l")]).distinct(), "sample")
    total = picked.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    if total > sample_bytes:
        picked = picked.where(F.pmod(F.xxhash64(F.lit("bytes"), "k", "t"), F.lit(1_000_000)) < int(1_000_000 * sample_bytes / total))
    for r in picked.select("l", "t").toLocalIterator():
        counts[r["l"]].update(w for w in map(bare_word, text_words(r["t"] or "")) if w)
    return fit_counts({k: c for k, c in counts.items() if c}, pieces_path)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _judge(model: Languages, memo: Memo, texts: list[str]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    words = [text_words(t) for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    flat = [w for x in words for w in x]
    if not model.names or not flat:
        return ["und"] * len(texts), [0.0] * len(texts)
    rows = memo(flat)
    both = grouped_sum(memo.values[rows], n)
    sums, n = both[:, :-1], both[:, -1].round().astype(np.int64)
    best = sums.argmax(axis=1)
    # softmax of the mean log-probability of a word, sharpened by the number of words up to 8
    z = (sums - sums.max(axis=1, keepdims=True)) / np.maximum(n, 1)[:, None] * np.minimum(n, 8)[:, None]
    share = 1 / np.exp(z).sum(axis=1)
    known = [bool(k) and has_letter(t) for k, t in zip(n.tolist(), texts, strict=True)]
    return [model.names[b] if ok else "und" for b, ok in zip(best.tolist(), known, strict=True)], [x if ok else 0.0 for x, ok in zip(share.tolist(), known, strict=True)]


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Languages = shared.value
        memo = Memo(model.scorer())
        for batch in slices(batches, "t"):
            names, scores = _judge(model, memo, texts_of(batch, "t"))
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(names, type=pa.string()), pa.array(scores, type=pa.float64())], names=["k", "lang_pred", "score"])

    return run


def _known(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, text = shared.value
        memo = Memo(model.scorer())
        for batch in slices(batches, text):
            names, _ = _judge(model, memo, texts_of(batch, text))
            yield batch.filter(pa.array([x != "und" for x in names], type=pa.bool_()))

    return run


def keep_known(docs: DataFrame, model: Languages, *, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is not `und`."""
    shared = docs.sparkSession.sparkContext.broadcast((model, text))
    return docs.mapInArrow(_known(shared), docs.schema)


def predict(docs: DataFrame, model: Languages, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score of every row. The model has one number for each language and piece of the vocabulary."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predict(shared), "k long, lang_pred string, score double").withColumnRenamed("k", key)
