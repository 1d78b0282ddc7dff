"""Telephony audio columns.

Mu-law and A-law bytes are expanded by lookup tables of 256 samples.  IMA ADPCM
blocks depend on nothing outside themselves, so numpy decodes all blocks of a
batch side by side, one nibble position at a time.  PCM is resampled by a
windowed-sinc polyphase filter and stored as WAV in a binary column.

Media are WAV files in one channel: format tag 7 (mu-law) and 6 (A-law) with
8-bit samples, 17 (IMA ADPCM) with blocks of the size that the header names, 1
(PCM) with 8-bit unsigned or 16-bit signed samples.  This library writes ADPCM in
64-byte blocks.

Edge cases: null media give null results; media that is no WAV file of a known
codec and sample width gives null PCM and features and, from ``to_pcm``, the
reason in ``error``; empty audio decodes to no samples; an ADPCM block cut short
at the end is dropped.  Repeated rows, ties, further columns and empty tables
pass through, but a column of the name of an added one is replaced; long media
are decoded, measured and resampled in slices of ``SLICE`` samples, so that a
task holds a medium, its samples and no wider copy of them.  Equal bytes give
equal results.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracewright.llm import scratch
from tracewright.llm.arrow import chunks

PCM, ALAW, MULAW, ADPCM = 1, 6, 7, 17
CODECS = {"mulaw": MULAW, "alaw": ALAW, "adpcm": ADPCM}
BLOCK_BYTES = 64
#: Bits of a sample that each codec may have.
WIDTHS = {PCM: (8, 16), ALAW: (8,), MULAW: (8,), ADPCM: (4,)}
#: ADPCM blocks decoded side by side, and samples measured or resampled at once; both bound memory.
BLOCKS_AT_ONCE = 16_384
SLICE = 1 << 20

# Fixed values of the IMA ADPCM format.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
# fmt: off
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
# fmt: on


def mulaw_table() -> np.ndarray:
    """Linear samples of the 256 mu-law codes (ITU-T G.711)."""
    code = ~np.arange(256) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear samples of the 256 A-law codes (ITU-T G.711)."""
    code = np.arange(256) ^ 0x55
    segment, low = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MU, A = mulaw_table(), alaw_table()


# --- WAV --------------------------------------------------------------------


def wav(data: bytes, tag: int, rate: int = 8000) -> bytes:
    """A WAV file in one channel."""
    align = {PCM: 2, ADPCM: BLOCK_BYTES}.get(tag, 1)
    bits = {PCM: 16, ADPCM: 4}.get(tag, 8)
    per_block = (BLOCK_BYTES - 4) * 2 + 1 if tag == ADPCM else 1
    extra = struct.pack("<HH", 2, per_block) if tag == ADPCM else b"" if tag == PCM else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", tag, 1, rate, rate * align // per_block, align, bits) + extra
    samples = len(data) // align * per_block
    fact = b"" if tag == PCM else b"fact" + struct.pack("<II", 4, samples)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


@dataclass(frozen=True)
class Sound:
    """What the header says, and the data."""

    tag: int
    rate: int
    #: Bytes of a block (of a sample, if the codec has no blocks) and bits of a sample.
    align: int
    bits: int
    data: memoryview


def unwav(media: bytes) -> Sound:
    """Parse a WAV file."""
    view = memoryview(media)
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE header")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if bits not in WIDTHS.get(tag, ()) or channels != 1:
                raise ValueError(f"unknown codec {tag} with {bits} bits in {channels} channels")
            if tag == ADPCM and align < 5:
                raise ValueError(f"blocks of {align} bytes")
            form = tag, rate, align, bits
        if name == b"data":
            if form is None:
                raise ValueError("data before format")
            return Sound(*form, view[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def readable(media: bytes | None) -> Sound | None:
    """Parsed, or null where there is no WAV file of a known codec."""
    try:
        return None if media is None else unwav(media)
    except (ValueError, struct.error):
        return None


# --- decoding ---------------------------------------------------------------


@lru_cache(1)
def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By step index and nibble: the difference and the next step index."""
    steps, nibble = STEPS[:, None], np.arange(16)[None, :]
    size = (steps >> 3) + np.where(nibble & 1, steps >> 2, 0) + np.where(nibble & 2, steps >> 1, 0) + np.where(nibble & 4, steps, 0)
    diff = np.where(nibble & 8, -size, size).astype(np.int32)
    after = np.clip(np.arange(len(STEPS))[:, None] + INDEX_STEP[None, :], 0, len(STEPS) - 1).astype(np.int32)
    return diff.ravel(), (after * 16).ravel()


def decode_adpcm(data: np.ndarray, align: int = BLOCK_BYTES) -> np.ndarray:
    """Samples of whole blocks: int16, one row per block (121 columns for 64 bytes)."""
    blocks = data[: len(data) // align * align].reshape(-1, align)
    out = np.empty(((align - 4) * 2 + 1, len(blocks)), np.int16)
    diff, after = adpcm_tables()
    for start in range(0, len(blocks), BLOCKS_AT_ONCE):
        part = blocks[start : start + BLOCKS_AT_ONCE]
        span = slice(start, start + len(part))
        value = np.ascontiguousarray(part[:, :2]).view("<i2").ravel().astype(np.int32)
        index = np.minimum(part[:, 2], len(STEPS) - 1).astype(np.int32) * 16
        packed = np.ascontiguousarray(part[:, 4:].T)
        out[0, span] = value
        for i in range(2 * len(packed)):
            nibble = packed[i >> 1] >> 4 if i & 1 else packed[i >> 1] & 15
            at = index + nibble
            value += diff.take(at)
            np.clip(value, -32768, 32767, out=value)
            index = after.take(at)
            out[i + 1, span] = value
    return np.ascontiguousarray(out.T)


def encode_adpcm(samples: np.ndarray) -> bytes:
    """Blocks whose decoding follows ``samples`` (padded to whole blocks by the last)."""
    per = (BLOCK_BYTES - 4) * 2 + 1
    short = -len(samples) % per
    rows = np.concatenate([samples, np.repeat(samples[-1:], short)]).astype(np.int32).reshape(-1, per)
    diff, after = adpcm_tables()
    value, index = rows[:, 0].copy(), np.zeros(len(rows), np.int32)
    out = np.zeros((len(rows), BLOCK_BYTES), np.uint8)
    out[:, :2] = rows[:, 0].astype("<i2").view(np.uint8).reshape(-1, 2)
    for i in range(per - 1):
        options = value[:, None] + diff[index[:, None] + np.arange(16)]
        nibble = np.abs(np.clip(options, -32768, 32767) - rows[:, i + 1 : i + 2]).argmin(1)
        at = index + nibble
        value = np.clip(value + diff[at], -32768, 32767)
        index = after[at]
        out[:, 4 + i // 2] |= (nibble << (4 * (i & 1))).astype(np.uint8)
    return out.tobytes()


def decode(data: memoryview | bytes, tag: int, align: int = BLOCK_BYTES, bits: int = 16) -> np.ndarray:
    """Linear 16-bit samples."""
    raw = np.frombuffer(data, np.uint8)
    if tag == MULAW:
        return MU.take(raw)
    if tag == ALAW:
        return A.take(raw)
    if tag == ADPCM:
        return decode_adpcm(raw, align).ravel()
    if bits == 8:
        return (raw.astype(np.int16) - 128) << 8
    return raw[: len(raw) // 2 * 2].view("<i2")


@lru_cache(16)
def phases(up: int, down: int, taps: int = 8) -> np.ndarray:
    """Polyphase branches of a Hann-windowed sinc, each with unit gain."""
    cut = min(1.0, up / down)
    span = math.ceil(taps / cut)
    offset = np.arange(span) - (span - 1) // 2
    x = offset[None, :] - np.arange(up)[:, None] / up
    window = 0.5 * (1 + np.cos(np.clip(2 * np.pi * x / (span + 1), -np.pi, np.pi)))
    bank = np.sinc(cut * x) * window
    return (bank / bank.sum(1, keepdims=True)).astype(np.float32)


def resample(samples: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Samples at another rate; edges are padded with zeros."""
    if rate == target or not len(samples):
        return samples.astype(np.int16)
    common = math.gcd(rate, target)
    up, down = target // common, rate // common
    bank = phases(up, down)
    span = bank.shape[1]
    before = (span - 1) // 2
    n = -(-len(samples) * up // down)
    out = np.empty(n, np.int16)
    step = max(1, SLICE // up) * up
    for at in range(0, n, step):
        to = min(at + step, n)
        # Inputs that the outputs at ... to - 1 look at, zeros beyond both ends.
        low, high = at * down // up - before, (to - 1) * down // up - before + span
        near = np.zeros(high - low, np.float32)
        a, b = max(0, low), min(len(samples), high)
        near[a - low : b - low] = samples[a:b]
        if down == 1:
            # All branches of a whole factor: one row of outputs per input sample.
            count = -(-(to - at) // up)
            rows = np.zeros((up, count), np.float32)
            for k in range(span):
                part = near[k : k + count]
                for p in range(up):
                    rows[p] += bank[p, k] * part
            flat = rows.T.ravel()[: to - at]
        else:
            place = np.arange(at, to, dtype=np.int64) * down
            first, phase = place // up - before - low, place % up
            flat = np.zeros(to - at, np.float32)
            for k in range(span):
                flat += bank[phase, k] * near[first + k]
        out[at:to] = np.clip(np.rint(flat), -32768, 32767)
    return out


# --- columns ----------------------------------------------------------------


def to_pcm(df: DataFrame, column: str = "media", rate: int = 16_000, out: str = "pcm", error: str = "error") -> DataFrame:
    """Add each row's audio as 16-bit PCM WAV at ``rate``, or the reason why not."""
    kept = [f for f in df.schema.fields if f.name not in (out, error)]
    schema = T.StructType([*kept, T.StructField(out, T.BinaryType()), T.StructField(error, T.StringType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, column):
                pcm, why = [], []
                for media in part.column(part.schema.get_field_index(column)).to_pylist():
                    got, said = None, None
                    if media is not None:
                        try:
                            sound = unwav(media)
                            got = wav(resample(decode(sound.data, sound.tag, sound.align, sound.bits), sound.rate or 8000, rate).astype("<i2").tobytes(), PCM, rate)
                        except (ValueError, struct.error) as e:
                            said = str(e)
                    pcm.append(got)
                    why.append(said)
                cols = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(pcm, pa.binary()), pa.array(why, pa.string())], names=schema.names)

    return df.mapInArrow(kernel, schema)


def payload(text: str) -> bytes:
    """UTF-8 bytes, padded with bytes 0 to a positive multiple of 64."""
    raw = text.encode("utf-8")
    return raw.ljust(max(1, -(-len(raw) // BLOCK_BYTES)) * BLOCK_BYTES, b"\0")


def store_texts(df: DataFrame, codec: str = "mulaw", key: str = "doc_id", column: str = "text") -> DataFrame:
    """Each text's padded bytes as the samples of a WAV file: key, n_bytes, media."""
    schema = T.StructType([df.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    tag = CODECS[codec]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, column):
                texts = [t or "" for t in part.column(part.schema.get_field_index(column)).to_pylist()]
                media = [wav(payload(t), tag) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(key)), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=schema.names)

    return df.select(key, column).mapInArrow(kernel, schema)


FEATURES = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]


def _levels(samples: np.ndarray) -> str:
    """Peak, mean square and sign changes, summed over slices."""
    peak = power = turns = 0
    for at in range(0, len(samples), SLICE):
        wide = samples[at : at + SLICE].astype(np.int64)
        peak = max(peak, int(np.abs(wide).max()))
        power += int((wide * wide).sum())
        turns += int(np.count_nonzero(np.diff(np.signbit(samples[max(0, at - 1) : at + SLICE]))))
    return f"{peak}/{power // max(1, len(samples))}/{turns}"


def feature(sound: Sound, rate: int, blocks: np.ndarray | None = None) -> str:
    """Levels of the data expanded as mu-law, as A-law and as 64-byte ADPCM blocks, then length and crc32 of the stored codec's samples at ``rate``.

    ``blocks``: the samples of the ADPCM blocks, where they are decoded already.
    """
    said = []
    for name, tag in CODECS.items():
        said.append(f"{name}:{_levels(blocks if tag == ADPCM and blocks is not None else decode(sound.data, tag))}")
    pcm = resample(decode(sound.data, sound.tag, sound.align, sound.bits), sound.rate or 8000, rate).astype("<i2", copy=False)
    return " ".join([*said, f"pcm{rate}:{len(pcm)}/{zlib.crc32(pcm.data):08x}"])


def features(df: DataFrame, column: str = "media", rate: int = 16_000) -> DataFrame:
    """Replace stored media by digests of what is read back and by audio features, null where there is no readable WAV file."""
    names = [n for n, _ in FEATURES]
    kept = [f for f in df.schema.fields if f.name != column and f.name not in names]
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in FEATURES]])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, column):
                media = part.column(part.schema.get_field_index(column)).to_pylist()
                sounds = [readable(m) for m in media]
                counts = [len(s.data) // BLOCK_BYTES if s else 0 for s in sounds]
                # The blocks of all rows are decoded side by side.
                blocks = decode_adpcm(np.frombuffer(b"".join(s.data[: n * BLOCK_BYTES] for s, n in zip(sounds, counts) if s), np.uint8))
                rows, at = [], 0
                for m, sound, n in zip(media, sounds, counts):
                    if sound is None:
                        rows.append((None,) * len(FEATURES))
                        continue
                    data = sound.data
                    said = feature(sound, rate, blocks[at : at + n].reshape(-1))
                    at += n
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(m), hashlib.sha256(m).hexdigest(), said))
                cols = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                made = [pa.array(c, pa.int64() if isinstance(t, T.LongType) else pa.string()) for c, (_, t) in zip(zip(*rows), FEATURES)]
                yield pa.RecordBatch.from_arrays(cols + made, names=schema.names)

    return df.mapInArrow(kernel, schema)


def text_features(df: DataFrame, codec: str = "mulaw") -> DataFrame:
    """Store every text as telephony media in a table, read it back, compute features."""
    return features(scratch.store(store_texts(df, codec), "media"))
