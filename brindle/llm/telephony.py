"""Operator 9: telephony audio as a media column.

Codes of 8 bits are stored losslessly in a RIFF/WAVE container (mu-law, A-law or IMA ADPCM blocks) in a binary
column. Decoding expands mu-law and A-law through lookup tables of 256 entries that a rule builds, and decodes
ADPCM with numpy across blocks: one step handles the same sample of every block of a batch. The PCM is resampled
by a polyphase windowed-sinc filter in integers, so results are the same on every machine, and stored losslessly packed
(`pack_pcm`) beside the media (`store_texts`) or made from any media column (`decode_media`).

Defined results: null media and media that are no WAVE file of a known format decode to null; an empty payload, and
an ADPCM payload without a whole block, give an empty PCM; a text's payload is its UTF-8
bytes, null as empty, padded with spaces to a positive multiple of the block; repeated rows give equal values;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import slices, stored

#: Fixed values of the formats: WAVE format tags; step sizes and index changes of IMA ADPCM.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17, "pcm": 1}
STEPS = [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]
CHANGES = [-1, -1, -1, -1, 2, 4, 6, 8]
TAPS = 8


@cache
def mulaw_table() -> np.ndarray:
    """ITU-T G.711: complement, 3 bits of exponent, 4 of mantissa, bias 132."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 0x80, -size, size).astype(np.int16)


@cache
def alaw_table() -> np.ndarray:
    """ITU-T G.711: every second bit inverted, 3 bits of exponent, 4 of mantissa."""
    code = np.arange(256) ^ 0x55
    mantissa, exponent = (code & 15) << 4, (code >> 4) & 7
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Mono IMA ADPCM: an array of blocks by bytes to blocks by samples. A block begins with its first sample and step index."""
    n, width = blocks.shape
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8) << 16 >> 16
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    steps = np.array(STEPS, dtype=np.int32)
    nibbles = np.arange(16)
    part = (nibbles & 7) * 2 + 1
    # for each step index and nibble: the change of the value, and the next step index
    change = np.where(nibbles & 8, -1, 1) * sum(np.where(nibbles & bit, steps[:, None] >> shift, 0) for bit, shift in ((4, 0), (2, 1), (1, 2))) + np.where(nibbles & 8, -1, 1) * (steps[:, None] >> 3)
    follow = np.clip(np.arange(len(STEPS))[:, None] + np.array(CHANGES * 2)[None, :], 0, len(STEPS) - 1).ravel().astype(np.int32)
    change = change.ravel().astype(np.int32)
    assert part.shape == (16,)
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * (width - 4), n), dtype=np.int16)
    out[0] = value
    for k in range(width - 4):
        for half in (0, 1):
            at = index * 16 + ((data[k] >> 4) if half else (data[k] & 15))
            value = np.clip(value + change[at], -32768, 32767)
            index = follow[at]
            out[1 + 2 * k + half] = value
    return out.T


@cache
def filter_bank(up: int, down: int) -> np.ndarray:
    """Phases by taps in units of 2^-15: a Hann-windowed sinc that cuts at the lower of the two rates."""
    cut = min(1.0, up / down)
    t = np.arange(TAPS)[None, :] - (TAPS // 2 - 1) - np.arange(up)[:, None] / up
    h = cut * np.sinc(cut * t) * (0.5 + 0.5 * np.cos(np.pi * t / (TAPS / 2 + 0.5)))
    return np.round(h / h.sum(axis=1, keepdims=True) * 32768).astype(np.int32)


def resample(pcm: np.ndarray, up: int, down: int) -> np.ndarray:
    """Integer polyphase resampling of one signal by up/down; zeros stand before and after it."""
    n = -(-len(pcm) * up // down)
    x = np.concatenate([np.zeros(TAPS, np.int32), pcm.astype(np.int32), np.zeros(TAPS + down, np.int32)])
    bank = filter_bank(up, down)
    out = np.empty(n, dtype=np.int16)
    for first in range(min(up, n)):
        many = len(range(first, n, up))
        base, phase = divmod(first * down, up)
        at = TAPS + base - (TAPS // 2 - 1)
        total = np.full(many, 1 << 14, dtype=np.int64 if down > up else np.int32)
        for k in range(TAPS):
            total += x[at + k : at + k + (many - 1) * down + 1 : down] * bank[phase, k]
        out[first::up] = np.clip(total >> 15, -32768, 32767)
    return out


def container(payload: bytes, codec: str, rate: int = 8000, block: int = 192) -> bytes:
    """A WAVE file around the codes; for mu-law and A-law a code is a sample, for ADPCM `block` bytes are a block."""
    tag = TAGS[codec]
    if codec == "adpcm":
        per = 1 + 2 * (block - 4)
        form = struct.pack("<HHIIHHHH", tag, 1, rate, rate * block // per, block, 4, 2, per)
        samples = len(payload) // block * per
    else:
        form = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
        samples = len(payload)
    data = payload + b"\0" * (len(payload) & 1)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def open_container(media: bytes) -> tuple[str, int, int, bytes]:
    """codec, rate, block and codes of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, (size,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIH", media, at + 8)
        elif name == b"data":
            codec = next((k for k, v in TAGS.items() if form and v == form[0]), None)
            if codec is None:
                raise ValueError("unknown WAVE format")
            return codec, form[2], form[4], media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data in the WAVE file")


def decode(media: bytes) -> tuple[np.ndarray, int]:
    """Samples and rate of a WAVE file of one of the three codecs, or of 16-bit PCM."""
    codec, rate, block, payload = open_container(media)
    codes = np.frombuffer(payload, np.uint8)
    if codec == "adpcm":
        if block < 5:
            raise ValueError("an ADPCM block has a header of four bytes and samples")
        return decode_adpcm(codes[: len(codes) // block * block].reshape(-1, block)).ravel(), rate
    if codec == "pcm":
        return np.frombuffer(payload[: len(payload) & ~1], "<i2"), rate
    return (mulaw_table() if codec == "mulaw" else alaw_table())[codes], rate


def at_rate(pcm: np.ndarray, own: int, rate: int) -> bytes:
    """Samples of one rate as 16-bit little-endian samples of another."""
    g = gcd(own, rate)
    return (resample(pcm, rate // g, own // g) if own != rate else pcm).astype("<i2").tobytes()


def _between(even: np.ndarray, n: int) -> np.ndarray:
    """What the twofold resampling filter expects at the n odd samples between the even ones."""
    return resample(even, 2, 1)[1 : 2 * n : 2]


def pack_pcm(pcm: bytes) -> bytes:
    """16-bit samples in a lossless form that stands alone: their number, the even samples (one byte each if mu-law has
    them all), and the odd ones as differences from the filter's value between the even ones, left out if all are zero."""
    x = np.frombuffer(pcm, "<i2")
    even, odd = x[::2], x[1::2]
    table = mulaw_table()
    order = np.argsort(table, kind="stable")
    at = order[np.minimum(np.searchsorted(table[order], even), 255)]
    told = bool((table[at] == even).all())
    rest = odd - _between(even, len(odd))  # modulo 2^16
    return struct.pack("<IB", len(x), told | bool(rest.any()) << 1) + (at.astype(np.uint8) if told else even).tobytes() + (rest.astype("<i2").tobytes() if rest.any() else b"")


def unpack_pcm(packed: bytes) -> bytes:
    """The samples that `pack_pcm` got."""
    n, form = struct.unpack_from("<IB", packed)
    out, half = np.empty(n, dtype="<i2"), (n + 1) // 2
    out[::2] = mulaw_table()[np.frombuffer(packed, np.uint8, half, 5)] if form & 1 else np.frombuffer(packed, "<i2", half, 5)
    out[1::2] = _between(out[::2], n // 2)
    if form & 2:
        out[1::2] += np.frombuffer(packed, "<i2", n // 2, 5 + half * (1 if form & 1 else 2))
    return out.tobytes()


def to_pcm(media: bytes | None, rate: int) -> bytes | None:
    if media is None:
        return None
    try:
        pcm, own = decode(media)
    except (ValueError, struct.error):  # not a WAVE file, or cut off in its header
        return None
    return at_rate(pcm, own, rate) if own > 0 else None


def _decode_column(rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, "media", 1_000_000):
            yield pa.RecordBatch.from_arrays([some.column("key"), pa.array([to_pcm(m, rate) for m in some.column("media").to_pylist()], type=pa.binary())], names=["key", "pcm"])

    return run


def decode_media(media: DataFrame, *, key: str = "doc_id", column: str = "media", rate: int = 16000) -> DataFrame:
    """key and pcm: 16-bit little-endian samples at `rate`."""
    rows = media.select(F.col(key).alias("key"), F.col(column).alias("media"))
    return rows.mapInArrow(_decode_column(rate), f"key {dict(media.dtypes)[key]}, pcm binary").withColumnRenamed("key", key)


def _store(block: int, codec: str, rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1_000_000):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            media = [container(r + b" " * (max(block, -(-len(r) // block) * block) - len(r)), codec, block=block) for r in raw]
            pcm = [pack_pcm(to_pcm(m, rate)) for m in media]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(list(map(len, raw)), type=pa.int64()), pa.array(media, type=pa.binary()), pa.array(pcm, type=pa.binary())], names=["key", "n_bytes", "media", "pcm"])

    return run


def store_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", block: int = 192, codec: str = "mulaw", rate: int = 16000) -> DataFrame:
    """Texts as telephony payloads in a media column, and their sound as 16-bit PCM of `rate`, losslessly packed, written
    to the shared folder and read again."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return stored(rows.mapInArrow(_store(block, codec, rate), "key long, n_bytes long, media binary, pcm binary"), "media")


def _measure(pcm: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """For each run of samples: root mean square, peak, sign changes."""
    wide = pcm.astype(np.int64)
    n = np.maximum(np.diff(edges), 1)
    begin = edges[:-1]
    rms = np.floor(np.sqrt(np.add.reduceat(wide * wide, begin) / n)).astype(np.int64)
    peak = np.maximum.reduceat(np.abs(wide), begin)
    change = np.zeros(len(pcm), dtype=np.int64)
    change[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
    change[begin] = 0
    return [rms, peak, np.add.reduceat(change, begin)]


def _digest(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 2_000_000, 1024):
            media = batch.column("media").to_pylist()
            payloads = [open_container(m)[3] for m in media]
            sizes = np.array(list(map(len, payloads)), dtype=np.int64)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            codes = np.frombuffer(b"".join(payloads), np.uint8)
            pcm = [unpack_pcm(x) for x in batch.column("pcm").to_pylist()]
            samples = np.concatenate([[0], np.cumsum([len(x) // 2 for x in pcm])])
            per = 1 + 2 * (block - 4)
            adpcm = decode_adpcm(codes.reshape(-1, block)).ravel()
            found = [_measure(np.frombuffer(b"".join(pcm), "<i2"), samples), _measure(alaw_table()[codes], edges), _measure(adpcm, edges // block * per)]
            checks = [zlib.crc32(x) for x in pcm]
            feature = [f"pcm rms={a} peak={b} crossings={c} crc32={crc:08x}; alaw rms={d} peak={e} crossings={f}; adpcm rms={g} peak={h} crossings={i}" for a, b, c, d, e, f, g, h, i, crc in zip(*(x.tolist() for y in found for x in y), checks, strict=True)]
            columns = [batch.column("key"), batch.column("n_bytes"), pa.array(sizes), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([zlib.crc32(p[-16:]) for p in payloads], type=pa.int64()), pa.array(list(map(len, media)), type=pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(feature)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return run


DIGEST = "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(media: DataFrame, *, block: int = 192) -> DataFrame:
    """Read stored media and PCM back: checksums of codes and container, features of the stored PCM and of the codes
    as A-law and as ADPCM."""
    return media.mapInArrow(_digest(block), DIGEST)
