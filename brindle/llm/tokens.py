"""Whole texts to token ids with the tokenizers library, memoised by chunks of text.

A chunk never crosses a place where the tokenizer's own pre-tokenizer always cuts, so the ids of a text are the
ids of its chunks one after the other. Chunks are found and compared with numpy on the bytes of an Arrow column;
each distinct chunk is encoded by the library once per worker while it is remembered, and its bytes are compared
with those remembered, so equal hashes of different chunks do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from brindle.llm.common import spread

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_MARK = np.zeros(256, dtype=bool)  # ASCII marks but the underscore
_MARK[[*range(33, 48), *range(58, 65), *range(91, 95), 96, *range(123, 127)]] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: White space that isn't ASCII, and what only some libraries take for white space: such texts go to the library whole.
_RARE_SPACES = [c.encode() for c in "\x1c\x1d\x1e\x1f\x85\xa0 ᠎               　"]
#: The bytes that those begin with.
_SUSPECT = np.zeros(256, dtype=bool)
_SUSPECT[[s[0] for s in _RARE_SPACES]] = True
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def vocabulary_path(name: str) -> str:
    """The file of a public tokenizer on this machine; every worker resolves it for itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Powers:
    """Powers of an odd number modulo 2^64, as far as they are asked for."""

    def __init__(self, base: int):
        self.base, self.table = np.uint64(base), np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            while len(self.table) < n:
                last = self.table[-1] * self.base
                self.table = np.concatenate([self.table, self.table * last])
        return self.table[:n]


class ChunkEncoder:
    """encode(texts) gives the concatenated ids of the texts and the number of ids of each.

    drops_white_space: the vocabulary ignores white space (word BPE), so any white space is a chunk border.
    Otherwise (byte BPE) the one space before a word belongs to its chunk.
    cap: so many chunks are remembered at most; when full, chunks seen only once since the last time go first.
    """

    def __init__(self, path: str, drops_white_space: bool, cap: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # the library makes one id of such a string wherever it stands: texts that hold one go to it whole
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.drops, self.cap = drops_white_space, cap
        # between new chunks: a line end, or where white space has no id a control character between spaces
        self.mark, self.glue = (b"\x00", b" \x00 ") if drops_white_space else (b"\n", b"\n")
        (self.mark_id,) = self.direct([self.glue.decode()])[0]
        self.powers, self.inverse = _Powers(_BASE), _Powers(_INVERSE)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.pool, self.lengths, self.begins = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.bytes, self.sizes, self.places = np.zeros(0, dtype=np.uint8), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.uses, self.firsts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

    def _shrink(self) -> None:
        """Keep what was used again, if that is at most half of the cap; else what was used often; else nothing."""
        for least in (2, 8, 64):
            rows = np.flatnonzero(self.uses >= least)
            if len(rows) <= self.cap // 2:
                break
        else:
            return self._forget()
        self.pool = self.pool[spread(self.begins[rows], self.lengths[rows])]
        self.bytes = self.bytes[spread(self.places[rows], self.sizes[rows])]
        self.hashes, self.lengths, self.sizes, self.firsts, self.uses = self.hashes[rows], self.lengths[rows], self.sizes[rows], self.firsts[rows], np.zeros(len(rows), dtype=np.int64)
        self.begins, self.places = np.cumsum(self.lengths) - self.lengths, np.cumsum(self.sizes) - self.sizes
        self.known = dict(zip(self.hashes.tolist(), range(len(rows)), strict=True))

    def direct(self, texts: list[str]) -> list[list[int]]:
        """Ids straight from the library; the chunked way must give the same."""
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)] if texts else []

    def _borders(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last + 1 byte of every chunk, in order. Texts are not empty."""
        white, mark = _WHITE[data], _MARK[data]
        letter = _ALNUM[data]
        # also the Latin letters of two bytes that begin with C3
        latin = (data >= 0x80) & (data != 0x97) & (data != 0xB7)
        letter[1:] |= latin[1:] & (data[:-1] == 0xC3) & (data[1:] < 0xC0)
        first = np.zeros(len(data) + 1, dtype=bool)
        first[begins] = True
        first[ends] = True
        first[1:-1] |= mark[1:] & letter[:-1]  # marks after a letter or digit are a pre-token of their own
        if self.drops:
            first[1:-1] |= white[1:] != white[:-1]
        else:
            inner = np.zeros(len(data), dtype=bool)  # white space alone between two other characters of a text
            inner[1:-1] = white[1:-1] & ~white[:-2] & ~white[2:]
            inner[begins] = False
            inner[ends - 1] = False
            first[:-1] |= inner
            line = np.flatnonzero(inner & (data != 32))  # of these only a space belongs to what follows
            first[line + 1] = True
        at = np.flatnonzero(first)
        begin, end = at[:-1], at[1:]
        if self.drops:
            keep = ~white[begin]
            begin, end = begin[keep], end[keep]
        return begin, end

    def _learn(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> None:
        """Encode new chunks, many side by side in one text with a mark between them whose id no other chunk has."""
        raw = data.tobytes()
        chunks = [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        plain = np.array([self.mark not in c and c.strip() == c[c[:1] == b" " :] and c != b" " for c in chunks], dtype=bool)
        joint, rest = np.flatnonzero(plain), np.flatnonzero(~plain).tolist()
        pool, lengths = [], []
        if len(joint):
            glued = (self.glue.join([chunks[k] for k in joint.tolist()]) + self.glue).decode("utf-8")
            own = np.array(self.tokenizer.encode(glued, add_special_tokens=False).ids, dtype=np.uint32)
            marks = np.flatnonzero(own == self.mark_id)
            pool.append(np.delete(own, marks))
            lengths.append(np.diff(marks, prepend=-1) - 1)
        if rest:
            ids = self.direct([chunks[k].decode("utf-8") for k in rest])
            pool.append(np.array([i for x in ids for i in x], dtype=np.uint32))
            lengths.append(np.array([len(x) for x in ids], dtype=np.int64))
        order = np.concatenate([joint, np.array(rest, dtype=np.int64)])
        length, back = np.concatenate(lengths), np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        new = np.concatenate(pool)
        start = (np.cumsum(length) - length)[back]
        self.begins = np.concatenate([self.begins, len(self.pool) + start])
        self.lengths, self.pool = np.concatenate([self.lengths, length[back]]), np.concatenate([self.pool, new])
        sizes = end - begin
        self.places = np.concatenate([self.places, len(self.bytes) + np.cumsum(sizes) - sizes])
        self.sizes, self.bytes = np.concatenate([self.sizes, sizes]), np.concatenate([self.bytes, data[spread(begin, sizes)]])
        self.uses, self.firsts = np.concatenate([self.uses, np.zeros(len(sizes), dtype=np.int64)]), np.concatenate([self.firsts, first_bytes(data, begin, sizes)])
        held = len(self.hashes)
        self.hashes = np.concatenate([self.hashes, hashes])
        self.known.update(zip(hashes.tolist(), range(held, held + len(hashes)), strict=True))

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(texts, list):
            texts = pa.array(texts, type=pa.string())
        if len(self.known) > self.cap:
            self._shrink()
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        whole = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        data = whole[offsets[0] : offsets[-1]] if len(offsets) else whole[:0]
        offsets = offsets - offsets[0]
        size = np.diff(offsets)  # null texts have no bytes
        if not texts.null_count == 0:
            size = size * texts.is_valid().to_numpy(zero_copy_only=False)
        strange = np.zeros(len(texts), dtype=bool)
        raw = data.tobytes()
        rare = [s for s in self.added if s in raw]
        if not self.drops and _SUSPECT[data].any():
            rare += [s for s in _RARE_SPACES if s in raw]
        if rare:
            strange = np.array([any(s in raw[a : a + n] for s in rare) for a, n in zip(offsets[:-1].tolist(), size.tolist(), strict=True)], dtype=bool)
        usual = np.flatnonzero((size > 0) & ~strange)
        counts, ids = np.zeros(len(texts), dtype=np.int64), np.zeros(0, dtype=np.uint32)
        if len(usual):
            if len(usual) < len(texts):
                data = data[spread(offsets[usual], size[usual])]
            ends = np.cumsum(size[usual])
            ids, counts[usual] = self._encode(data, ends - size[usual], ends)
        if strange.any():
            return self._mixed(texts, counts, ids, strange)
        return ids, counts

    def _mixed(self, texts, counts, ids, strange):
        edges = np.concatenate([[0], np.cumsum(counts)])
        some = np.flatnonzero(strange).tolist()
        got = dict(zip(some, self.direct([texts[k].as_py() for k in some]), strict=True))
        out = [np.array(got[k], dtype=np.uint32) if k in got else ids[edges[k] : edges[k + 1]] for k in range(len(texts))]
        return np.concatenate(out), np.array([len(x) for x in out], dtype=np.int64)

    def _encode(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, end = self._borders(data, begins, ends)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers.upto(len(data)), out=sums[1:])
            h = (sums[end] - sums[begin]) * self.inverse.upto(len(data))[begin]
            h ^= h >> np.uint64(29)
        unique, sample, back = np.unique(h, return_index=True, return_inverse=True)
        get = self.known.get
        rows = np.array([get(x, -1) for x in unique.tolist()], dtype=np.int64)
        new = np.flatnonzero(rows < 0)
        if len(new):
            held = len(self.hashes)
            self._learn(data, begin[sample[new]], end[sample[new]], unique[new])
            rows[new] = np.arange(held, held + len(new))
        at = rows[back]
        self.uses += np.bincount(at, minlength=len(self.uses))
        lengths = self.lengths[at]
        ids = self.pool[spread(self.begins[at], lengths)]
        text = np.searchsorted(ends, begin, side="right")
        counts = np.bincount(text, lengths, minlength=len(ends)).astype(np.int64)
        wrong = self._wrong(data, begin, end, at)
        if wrong is not None:  # two chunks with one hash: take the texts to the library
            raw, edges = data.tobytes(), np.concatenate([[0], np.cumsum(counts)])
            bad = set(text[wrong].tolist())
            out = [np.array(self.direct([raw[begins[k] : ends[k]].decode()])[0], dtype=np.uint32) if k in bad else ids[edges[k] : edges[k + 1]] for k in range(len(ends))]
            return np.concatenate(out), np.array([len(x) for x in out], dtype=np.int64)
        return ids, counts

    def _wrong(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray | None:
        """The chunks whose bytes are not those of the row that their hash found; None if there is none."""
        size = end - begin
        bad = (size != self.sizes[at]) | (first_bytes(data, begin, size) != self.firsts[at])
        long = np.flatnonzero((size > 8) & ~bad)  # the first eight bytes are compared already
        if len(long):
            rest = size[long] - 8
            same = data[spread(begin[long] + 8, rest)] == self.bytes[spread(self.places[at[long]] + 8, rest)]
            if not same.all():
                bad[long[np.unique(np.searchsorted(np.cumsum(rest), np.flatnonzero(~same), side="right"))]] = True
        return np.flatnonzero(bad) if bad.any() else None


def first_bytes(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Up to eight bytes from each place on, as one number."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    keep = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
    return eight[begin] & keep[np.minimum(size, 8)]


_encoders: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, drops_white_space: bool) -> ChunkEncoder:
    """One encoder for each vocabulary and worker process."""
    key = (path, drops_white_space)
    if key not in _encoders:
        _encoders[key] = ChunkEncoder(path, drops_white_space)
    return _encoders[key]
