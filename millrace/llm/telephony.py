"""Media columns for telephony audio: mu-law and A-law by lookup tables, ADPCM blocks with numpy, resampled PCM.

A media column holds WAV bytes of 8-bit companded samples or of ADPCM blocks; decoding gives 16-bit PCM at 8 kHz, and at
another rate by linear interpolation between integer samples. ``stored`` makes the media, ``decoded_column`` the
resampled PCM, ``features`` reads both. Everything is per row, within one map; the query writes the media as a table,
decodes what it reads back, and returns the resampled PCM as a column beside the features, to be stored with them.

Texts take the kinds mu-law, A-law and ADPCM in turn, by a checksum of their payload, so that equal texts have equal
media and each kind's decoder runs on media of its own.

Nulls: a null payload counts as empty text and becomes one padding block; a null media value gives null PCM. An empty
text is one padding block as well. A text of any length is one media value, in a block of its own where it is longer
than a block; WAV sizes end at 4 GB. Bytes that are no WAV of a known kind end in a ValueError with that row's doc_id.
Repeated rows give equal values. An empty table gives an empty result. Extra columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import blocks

#: Payload bytes come in multiples of this, filled up with this byte.
FRAME, FILL, RATE = 576, 255, 8000
#: Format tags of WAV files.
ALAW, MULAW, IMA_ADPCM = 6, 7, 17
#: Bytes and samples of an ADPCM block: 4 bytes of header with the first sample, then two samples a byte.
BLOCK_BYTES = 36
BLOCK_SAMPLES = 1 + 2 * (BLOCK_BYTES - 4)
#: Media bytes of a block of rows.
BLOCK = 1 << 20


def mulaw_table() -> np.ndarray:
    """PCM value of each mu-law code: inverted bits, sign, exponent, mantissa with bias 132."""
    code = ~np.arange(256, dtype=np.int32) & 255
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM value of each A-law code: every other bit inverted, sign, exponent, mantissa."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, (code & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def step_table() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM: each about 1.1 times the one before, from 7 up to 32767."""
    # Fixed values, as the standard rounds them.
    steps = [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73,
        80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
        544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499,
        2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
        12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ]
    return np.array(steps, np.int32)


#: How a code moves the step index.
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
MULAW_PCM, ALAW_PCM, STEPS = mulaw_table(), alaw_table(), step_table()


def wav(codes: bytes, tag: int = MULAW, rate: int = RATE) -> bytes:
    """A mono WAV file of 8-bit companded samples, or of ADPCM blocks."""
    if tag == IMA_ADPCM:
        align, bits, samples = BLOCK_BYTES, 4, len(codes) // BLOCK_BYTES * BLOCK_SAMPLES
        form = struct.pack("<HHIIHHHH", tag, 1, rate, rate * align // BLOCK_SAMPLES, align, bits, 2, BLOCK_SAMPLES)
    else:
        samples = len(codes)
        form = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
    chunks = b"".join((b"fmt ", struct.pack("<I", len(form)), form, b"fact", struct.pack("<II", 4, samples), b"data", struct.pack("<I", len(codes)), codes, b"\0" * (len(codes) % 2)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def parsed(media: bytes) -> tuple[int, int, memoryview]:
    """(format tag, rate, data) of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate = 12, None, RATE
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        if name == b"data":
            if tag not in (ALAW, MULAW, IMA_ADPCM) or at + 8 + size > len(media):
                raise ValueError("a WAV file of another kind, or cut off")
            return tag, rate, memoryview(media)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without data")


def adpcm(data: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks (n, BLOCK_BYTES): one step of all blocks at a time, as samples depend on each other
    only within a block."""
    n = len(data)
    out = np.empty((BLOCK_SAMPLES, n), np.int16)
    value = data[:, 0].astype(np.int32) | (data[:, 1].astype(np.int8).astype(np.int32) << 8)
    index = np.minimum(data[:, 2], 88).astype(np.int32)
    nibbles = np.empty((2 * (BLOCK_BYTES - 4), n), np.uint8)
    body = data[:, 4:].T
    nibbles[0::2], nibbles[1::2] = body & 15, body >> 4
    out[0] = value
    # a code's difference for every step index, once
    code = np.arange(16)
    size = (STEPS[:, None] >> 3) + np.where(code & 4, STEPS[:, None], 0) + np.where(code & 2, STEPS[:, None] >> 1, 0) + np.where(code & 1, STEPS[:, None] >> 2, 0)
    change = np.where(code & 8, -size, size).astype(np.int32).ravel()
    for t in range(len(nibbles)):
        value = np.clip(value + change[index * 16 + nibbles[t]], -32768, 32767)
        index = np.clip(index + INDEX_MOVES[nibbles[t]], 0, 88)
        out[t + 1] = value
    return out.T.reshape(-1)


def adpcm_encoded(pcm: np.ndarray) -> bytes:
    """IMA ADPCM blocks of PCM samples, filled up with the last sample; all blocks at a time."""
    count = max(1, -(-len(pcm) // BLOCK_SAMPLES))
    last = pcm[-1:] if len(pcm) else np.zeros(1, np.int16)
    rows = np.concatenate([pcm, np.repeat(last, count * BLOCK_SAMPLES - len(pcm))]).reshape(count, -1).astype(np.int32)
    value, index = rows[:, 0].copy(), np.zeros(count, np.int32)
    out = np.zeros((count, BLOCK_BYTES), np.uint8)
    out[:, 0], out[:, 1] = value & 255, (value >> 8) & 255
    for t in range(1, BLOCK_SAMPLES):
        step, gap = STEPS[index], rows[:, t] - value
        code, size, rest = np.where(gap < 0, 8, 0), STEPS[index] >> 3, np.abs(gap)
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            hit = rest >= part
            code, rest, size = code | np.where(hit, bit, 0), rest - np.where(hit, part, 0), size + np.where(hit, part, 0)
        value = np.clip(value + np.where(code & 8, -size, size), -32768, 32767)
        index = np.clip(index + INDEX_MOVES[code], 0, 88)
        out[:, 4 + (t - 1) // 2] |= (code << (4 * ((t - 1) % 2))).astype(np.uint8)
    return out.tobytes()


def decoded(media: bytes) -> tuple[np.ndarray, int]:
    """PCM samples and rate of a WAV file."""
    tag, rate, data = parsed(media)
    codes = np.frombuffer(data, np.uint8)
    if tag == IMA_ADPCM:
        return adpcm(codes[: len(codes) // BLOCK_BYTES * BLOCK_BYTES].reshape(-1, BLOCK_BYTES)), rate
    return (MULAW_PCM if tag == MULAW else ALAW_PCM)[codes], rate


def resampled(pcm: np.ndarray, rate: int, target: int) -> np.ndarray:
    """PCM at another rate: integer positions in units of 1 / target, linear between neighbours, rounded down."""
    if rate == target or len(pcm) < 2:
        return pcm
    place = np.arange((len(pcm) - 1) * target // rate + 1, dtype=np.int64) * rate
    left, part = place // target, place % target
    wide = np.append(pcm, pcm[-1]).astype(np.int64)
    return ((wide[left] * (target - part) + wide[left + 1] * part) // target).astype(np.int16)


KINDS = (MULAW, ALAW, IMA_ADPCM)


def kind_of(payload: bytes) -> int:
    """The media kind of a payload."""
    return KINDS[zlib.crc32(payload) % len(KINDS)]


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, filled up to whole frames, as a WAV file of 8-bit samples or
    of ADPCM blocks."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sizes, media = [], []
            for text in block.column("text").cast(pa.binary()).to_pylist():
                payload = text or b""
                sizes.append(len(payload))
                payload += bytes([FILL]) * (max(FRAME, -(-len(payload) // FRAME) * FRAME) - len(payload))
                media.append(wav(payload, kind_of(payload)))
            yield pa.record_batch([block.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(store, "doc_id long, n_bytes long, media binary")


def _decoded(batches: Iterator[pa.RecordBatch], target: int) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, n_bytes, media) with rate and pcm. The ADPCM blocks of all media of a block of rows are decoded
    together."""
    for block in blocks(batches, "media", BLOCK):
        found: list = []
        for name, media in zip(block.column("doc_id").to_pylist(), block.column("media").to_pylist()):
            try:
                found.append(None if media is None else parsed(media))
            except ValueError as e:
                raise ValueError(f"doc_id {name}: {e}") from e
        several = [np.frombuffer(x[2], np.uint8)[: len(x[2]) // BLOCK_BYTES * BLOCK_BYTES] for x in found if x and x[0] == IMA_ADPCM]
        ends = np.cumsum([len(x) // BLOCK_BYTES * BLOCK_SAMPLES for x in several])
        parts = iter(np.split(adpcm(np.concatenate(several).reshape(-1, BLOCK_BYTES)), ends[:-1]) if several else [])
        out = []
        for x in found:
            if x is None:
                out.append(None)
                continue
            tag, rate, data = x
            pcm = next(parts) if tag == IMA_ADPCM else (MULAW_PCM if tag == MULAW else ALAW_PCM)[np.frombuffer(data, np.uint8)]
            out.append(resampled(pcm, rate, target).astype("<i2").tobytes())
        yield pa.record_batch(
            [block.column(c) for c in ("doc_id", "n_bytes", "media")] + [pa.array([target] * len(out), pa.int32()), pa.array(out, pa.binary())],
            ["doc_id", "n_bytes", "media", "rate", "pcm"],
        )


def decoded_column(rows: DataFrame, target: int = 16000) -> DataFrame:
    """``rows`` (doc_id, n_bytes, media) with rate and pcm: the media as 16-bit little-endian PCM at the target rate."""
    return rows.select("doc_id", "n_bytes", "media").mapInArrow(lambda batches: _decoded(batches, target), "doc_id long, n_bytes long, media binary, rate int, pcm binary")


def feature_of(tag: int, pcm: np.ndarray, rate: int) -> str:
    """In integers only: the media's kind, and of its PCM the rate, length, mean size, sign changes, greatest size and
    checksum."""
    size = np.abs(pcm.astype(np.int32))
    turns = int(((pcm[1:] < 0) != (pcm[:-1] < 0)).sum())
    name = {MULAW: "mulaw", ALAW: "alaw", IMA_ADPCM: "adpcm"}[tag]
    mean, peak = (int(size.sum()) // len(size), int(size.max())) if len(size) else (0, 0)
    return f"{name};rate={rate};samples={len(pcm)};mean={mean};turns={turns};peak={peak};crc32={zlib.crc32(pcm.astype('<i2').tobytes())}"


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, rate int, pcm binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "pcm", BLOCK * 4):
        media = block.column("media").to_pylist()
        kinds = [None if m is None else parsed(m) for m in media]
        pcm = [None if x.as_buffer() is None else np.frombuffer(x.as_buffer(), "<i2") for x in block.column("pcm")]
        data = [None if x is None else x[2] for x in kinds]
        of = lambda f, values: [None if v is None else f(v) for v in values]
        yield pa.record_batch(
            [
                block.column("doc_id"),
                block.column("n_bytes"),
                pa.array(of(len, data), pa.int64()),
                pa.array(of(lambda x: hashlib.sha256(x).hexdigest(), data), pa.string()),
                pa.array(of(lambda x: zlib.crc32(x[-32:]), data), pa.int64()),
                pa.array(of(len, media), pa.int64()),
                pa.array(of(lambda m: hashlib.sha256(m).hexdigest(), media), pa.string()),
                pa.array([None if k is None or p is None else feature_of(k[0], p, r) for k, p, r in zip(kinds, pcm, block.column("rate").to_pylist())], pa.string()),
                block.column("rate"),
                block.column("pcm"),
            ],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "rate", "pcm"],
        )


def features(rows: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, rate, pcm), from
    stored media and their PCM (doc_id, n_bytes, media, rate, pcm). Null media give null in all columns of theirs."""

    return rows.select("doc_id", "n_bytes", "media", "rate", "pcm").mapInArrow(_features, FEATURES)


def decoded_features(rows: DataFrame, target: int = 16000) -> DataFrame:
    """``features`` of stored media (doc_id, n_bytes, media) in one pass: PCM leaves the workers once, as a result, in
    batches of one block each."""
    return rows.select("doc_id", "n_bytes", "media").mapInArrow(lambda batches: _features(_decoded(batches, target)), FEATURES)
