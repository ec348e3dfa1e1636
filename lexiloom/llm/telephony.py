"""Media columns of telephony audio: mu-law and A-law by lookup tables, ADPCM blocks by numpy, resampled PCM.

``media`` columns hold RIFF/WAVE files of 8-bit companded samples (format tags 7 mu-law, 6 A-law) or of IMA ADPCM
blocks (tag 0x11). Companded samples become 16-bit PCM by a table of 256 entries. ADPCM is sequential within a
block and independent between blocks, so a step of all blocks of a batch is one numpy operation. PCM is resampled
by a polyphase windowed-sinc filter of whole-number weights, so that equal samples give equal bytes anywhere. PCM of
twice the rate is packed without loss: its two phases apart, the odd one as differences from what the even one lets expect.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.shared import documents, new_folder
from lexiloom.llm.workers import blocks, release

MULAW, ALAW, ADPCM = 7, 6, 0x11
#: Samples a second of telephony, and of the PCM that is made from it.
RATE, PCM_RATE = 8_000, 16_000
#: Bytes of an ADPCM block with its header of four.
BLOCK = 64
#: Payloads are padded to a multiple of this.
PAD = 64


@lru_cache
def mulaw_table() -> np.ndarray:
    """PCM of each mu-law byte: sign, segment and step, all bits inverted; ITU-T G.711."""
    b = ~np.arange(256) & 0xFF
    size = (((b & 0x0F) << 3) + 0x84 << (b >> 4 & 7)) - 0x84
    return np.where(b & 0x80, -size, size).astype(np.int16)


@lru_cache
def alaw_table() -> np.ndarray:
    """PCM of each A-law byte: even bits inverted; ITU-T G.711."""
    b = np.arange(256) ^ 0x55
    segment, low = b >> 4 & 7, (b & 0x0F) << 4
    size = np.where(segment == 0, low + 8, low + 0x108 << np.maximum(segment - 1, 0))
    return np.where(b & 0x80, size, -size).astype(np.int16)


@lru_cache
def _companded(law: int) -> np.ndarray:
    """For each 16-bit value, shifted by 32768, the byte whose PCM is nearest to it; of two, that of the lower byte."""
    table = (mulaw_table() if law == MULAW else alaw_table()).astype(np.int64)
    order = np.lexsort((np.arange(256), table))
    values, first = np.unique(table[order], return_index=True)
    codes = order[first]
    x = np.arange(-32768, 32768)
    right = np.clip(np.searchsorted(values, x), 1, len(values) - 1)
    near = np.where(x - values[right - 1] <= values[right] - x, right - 1, right)
    return codes[near].astype(np.uint8)


def expand(samples: np.ndarray, law: int = MULAW) -> np.ndarray:
    """8-bit samples to 16-bit PCM."""
    return (mulaw_table() if law == MULAW else alaw_table())[samples]


def compress(pcm: np.ndarray, law: int = MULAW) -> np.ndarray:
    """16-bit PCM to the nearest 8-bit samples."""
    return _companded(law)[pcm.astype(np.int64) + 32768]


# Fixed values of IMA ADPCM: the change of the step index for each code's low three bits, and the steps.
_INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8])
_STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767])


@lru_cache
def _moves() -> np.ndarray:
    """The change of the predictor for each (step index, code)."""
    step, code = _STEPS[:, None], np.arange(16)[None, :]
    size = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -size, size).astype(np.int32)


@lru_cache
def _next_index() -> np.ndarray:
    return np.clip(np.arange(len(_STEPS))[:, None] + _INDEX_CHANGE[np.arange(16) & 7][None, :], 0, len(_STEPS) - 1).astype(np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks, (blocks, bytes) to (blocks, 2 * bytes - 7): the header's sample, then one for each
    code, low half of a byte first. A step index out of range counts as the nearest in it."""
    n, size = blocks.shape
    out = np.empty((2 * (size - 4) + 1, n), dtype=np.int16)
    value = blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8
    value = np.where(value >= 32768, value - 65536, value)
    index = np.minimum(blocks[:, 2], len(_STEPS) - 1).astype(np.int32)
    out[0] = value
    body = np.ascontiguousarray(blocks[:, 4:].T)
    moves, nexts = _moves().ravel(), _next_index().ravel()
    for k in range(size - 4):
        for half, code in enumerate((body[k] & 15, body[k] >> 4)):
            at = index * 16 + code
            value = np.clip(value + moves[at], -32768, 32767)
            index = nexts[at]
            out[1 + 2 * k + half] = value
    return out.T


def encode_adpcm(pcm: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """Blocks of PCM that decode_adpcm turns into nearly the same samples; the last block is filled with its last sample."""
    width = 2 * (size - 4) + 1
    pcm = np.pad(pcm.astype(np.int32), (0, -len(pcm) % width), mode="edge") if len(pcm) else np.zeros(width, np.int32)
    rows = pcm.reshape(-1, width)
    spread = np.abs(np.diff(rows, axis=1)).max(axis=1)
    index = np.clip(np.searchsorted(_STEPS, spread // 4), 0, len(_STEPS) - 1).astype(np.int32)
    out = np.zeros((len(rows), size), dtype=np.uint8)
    value = rows[:, 0].copy()
    out[:, 0], out[:, 1], out[:, 2] = value & 255, value >> 8 & 255, index
    moves, nexts = _moves(), _next_index()
    for k in range(1, width):
        reach = np.clip(value[:, None] + moves[index], -32768, 32767)
        code = np.abs(reach - rows[:, k, None]).argmin(axis=1)
        value = reach[np.arange(len(rows)), code]
        index = nexts[index, code]
        out[:, 4 + (k - 1) // 2] |= (code << (4 * ((k - 1) % 2))).astype(np.uint8)
    return out


def wav(samples: bytes, tag: int = MULAW, rate: int = RATE, block: int = 1) -> bytes:
    """A RIFF/WAVE file of one channel; losslessly holds the bytes given."""
    bits, extra = (4, struct.pack("<HH", 2, 2 * (block - 4) + 1)) if tag == ADPCM else (16, b"") if tag == 1 else (8, struct.pack("<H", 0))
    block = block if tag == ADPCM else bits // 8
    per_second = rate * block // (2 * (block - 4) + 1) if tag == ADPCM else rate * block
    head = struct.pack("<HHIIHH", tag, 1, rate, per_second, block, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, rate, block size and the data of a RIFF/WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate, _, block, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            form = tag, rate, block
        elif name == b"data" and form:
            return *form, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data in the RIFF/WAVE file")


def pcm_of(media: bytes) -> tuple[int, np.ndarray]:
    """Rate and 16-bit samples of a file of any of the four formats."""
    tag, rate, block, data = read_wav(media)
    raw = np.frombuffer(data, dtype=np.uint8)
    if tag == 1:
        return rate, raw[: len(raw) // 2 * 2].view("<i2")
    if tag in (MULAW, ALAW):
        return rate, expand(raw, tag)
    if tag == ADPCM:
        return rate, decode_adpcm(raw[: len(raw) // block * block].reshape(-1, block)).ravel()
    raise ValueError(f"format {tag} is not known")


#: Taps on either side, and the bits of a whole-number weight.
_TAPS, _BITS = 8, 14


@lru_cache
def _weights(up: int, down: int) -> np.ndarray:
    """Windowed-sinc weights for each of the up phases: (phases, taps), whole numbers that add up to 2 ** _BITS."""
    cut = min(1.0, up / down)
    at = np.arange(-_TAPS + 1, _TAPS + 1)[None, :] - np.arange(up)[:, None] / up
    w = np.sinc(at * cut) * cut * (0.5 + 0.5 * np.cos(np.pi * np.clip(at / _TAPS, -1, 1)))
    whole = np.rint(w / w.sum(axis=1, keepdims=True) * 2**_BITS).astype(np.int64)
    whole[np.arange(up), whole.argmax(axis=1)] += 2**_BITS - whole.sum(axis=1)
    return whole


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """PCM at another rate: ceil(n * to / rate) samples; silence stands before and after."""
    shared = math.gcd(rate, to)
    up, down = to // shared, rate // shared
    if up == down or not len(pcm):
        return pcm.astype(np.int16)
    n = -(-len(pcm) * up // down)
    padded = np.pad(pcm.astype(np.int32), (_TAPS - 1, _TAPS + 1))
    out = np.empty(n, dtype=np.int16)
    weights = _weights(up, down)
    for phase in range(min(up, n)):  # outputs of a phase share their weights, and their inputs lie at equal distances
        first, fraction = divmod(phase * down, up)
        count = len(range(phase, n, up))
        out[phase::up] = _filtered(padded[first:], weights[fraction], count, down)
    return out


def _filtered(padded: np.ndarray, weights: np.ndarray, count: int, step: int = 1) -> np.ndarray:
    """For each of count places of padded samples, step apart, the weighted sum of those from there on, rounded and clipped."""
    total = np.full(count, 1 << (_BITS - 1), dtype=np.int32 if _BITS <= 14 else np.int64)
    for k, w in enumerate(weights.tolist()):
        if w:
            total += w * padded[k : k + (count - 1) * step + 1 : step]
    return np.clip(total >> _BITS, -32768, 32767)


def to_media(payload: bytes, tag: int = MULAW) -> bytes:
    """A payload as it is, as the samples (or blocks) of a WAVE file."""
    return wav(payload, tag, RATE, BLOCK if tag == ADPCM else 1)


#: Bytes of payload whose blocks are decoded at once.
BATCH_BYTES = 4_000_000


def decoded_blocks(payloads: Sequence[bytes], block: int = BLOCK) -> Iterator[np.ndarray]:
    """The PCM of each payload's whole ADPCM blocks: those of many payloads are decoded together."""
    first = 0
    while first < len(payloads):
        last, size = first, 0
        while last < len(payloads) and (last == first or size + len(payloads[last]) <= BATCH_BYTES):
            size += len(payloads[last])
            last += 1
        counts = [len(p) // block for p in payloads[first:last]]
        raw = np.frombuffer(b"".join(p[: n * block] for p, n in zip(payloads[first:last], counts, strict=True)), dtype=np.uint8)
        pcm = np.ascontiguousarray(decode_adpcm(raw.reshape(-1, block)))
        at = 0
        for n in counts:
            yield pcm[at : at + n].ravel()
            at += n
        first = last


def features(media: Sequence[bytes]) -> list[str]:
    """What is heard in each file: samples, peak, root mean square and sign changes; and the crc32 of the same bytes' PCM
    when taken as A-law and as ADPCM blocks."""
    data = [read_wav(m)[3] for m in media]
    out = []
    for m, payload, coded in zip(media, data, decoded_blocks(data), strict=True):
        pcm = pcm_of(m)[1]
        x = pcm.astype(np.int64)
        rms = math.isqrt(int((x * x).sum()) // max(1, len(x)))
        turns = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
        other = expand(np.frombuffer(payload, dtype=np.uint8), ALAW)
        out.append(f"n={len(pcm)};peak={int(np.abs(x).max(initial=0))};rms={rms};turns={turns};alaw={zlib.crc32(other.tobytes()):08x};adpcm={zlib.crc32(coded.tobytes()):08x}")
    return out


def pcm_file(media: bytes, rate: int = PCM_RATE) -> bytes:
    """The PCM of a file of any of the known formats, resampled, as a WAVE file of 16-bit samples."""
    own, pcm = pcm_of(media)
    return wav(resample(pcm, own, rate).astype("<i2").tobytes(), 1, rate)


def _between(even: np.ndarray, count: int) -> np.ndarray:
    """The first count samples half-way after each of the even ones, as resampling to twice the rate gives them."""
    padded = np.pad(even.astype(np.int32), (_TAPS - 1, _TAPS + 1))
    return _filtered(padded, _weights(2, 1)[1], count) if count else np.zeros(0, np.int32)


def _planes(x: np.ndarray) -> bytes:
    """16-bit values as all their low bytes, then all their high ones."""
    return np.ascontiguousarray(x.astype("<i2").view(np.uint8).reshape(-1, 2).T).tobytes()


def _joined(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(2, -1).T).reshape(-1).view("<i2")


def pack_pcm(pcm: np.ndarray, rate: int) -> tuple[bytes, bytes]:
    """16-bit PCM of any kind in two strings from which unpack_pcm makes the same samples.

    The first has format, rate, the number of samples and those at even places: as 8-bit codes where a table of mu-law or A-law has all
    of them, else as byte planes. The second has, for those at odd places, their differences (modulo 2 ** 16) from the samples between
    the even ones, as byte planes. PCM resampled to twice its rate has differences of zero, which any compression takes to nothing;
    other PCM has others, and is kept all the same.
    """
    even, odd = pcm[::2], pcm[1::2]
    tag, body = 1, b""
    for law in (MULAW, ALAW):
        codes = compress(even, law)
        if (expand(codes, law) == even).all():
            tag, body = law, codes.tobytes()
            break
    else:
        body = _planes(even)
    return struct.pack("<HIQ", tag, rate, len(pcm)) + body, _planes(odd.astype(np.int32) - _between(even, len(odd)))


def unpack_pcm(even: bytes, odd: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples of packed PCM."""
    tag, rate, n = struct.unpack_from("<HIQ", even)
    body = even[struct.calcsize("<HIQ") :]
    out = np.empty(n, dtype=np.int16)
    out[::2] = _joined(body) if tag == 1 else expand(np.frombuffer(body, np.uint8), tag)
    out[1::2] = _joined(odd) + _between(out[::2], n // 2)  # the 16 low bits are the sample
    return rate, out


def with_media(df: DataFrame, payload: str, tag: int = MULAW, media: str = "media") -> DataFrame:
    """df with a media column of WAVE files whose data is the binary payload column as it is; null stays null."""
    return df.withColumn(media, F.pandas_udf(_maker(tag), "binary")(F.col(f"`{payload}`")))


def _maker(tag: int):
    def make(column: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else to_media(bytes(b), tag) for b in column], dtype=object)

    return make


def store_pcm(df: DataFrame, path: str, media: str = "media", rate: int = PCM_RATE) -> DataFrame:
    """Writes df with ``pcm`` (16-bit little-endian samples at that rate, as a WAVE file) in place of the media column
    as Parquet at path, and gives the table there. Files of any of the known formats may be mixed; null stays null; an old
    ``pcm`` is replaced."""

    @F.pandas_udf("binary")
    def make(column: pd.Series) -> pd.Series:
        return pd.Series([None if m is None else pcm_file(bytes(m), rate) for m in column], dtype=object)

    out = df.withColumn("pcm", make(F.col(f"`{media}`"))).drop(media)
    return _stored(out, path)


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def padded(text: str = "text") -> Column:
    """The text's UTF-8 bytes (null: none), and zeros up to a positive multiple of PAD."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    size = F.octet_length(raw)
    zeros = F.when(size == 0, PAD).otherwise((PAD - size % PAD) % PAD)
    return F.concat(raw, F.substring(F.lit(bytes(PAD)), F.lit(1), zeros))


_HEARD = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, heard string, even binary, odd binary"
#: Media whose PCM leaves a worker at once, in bytes.
SENT_BYTES = 8_000_000


def heard(stored: DataFrame, rate: int = PCM_RATE) -> DataFrame:
    """Digests and features of media files (doc_id, n_bytes, media) and their PCM at that rate, packed. A null doc_id is kept as such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in blocks(pc.binary_length(whole.column("media")).to_numpy(zero_copy_only=False), SENT_BYTES):
                batch = whole.slice(a, b - a)
                media = batch.column("media").to_pylist()
                data = [read_wav(m)[3] for m in media]
                packed = [pack_pcm(resample(pcm, own, rate), rate) for own, pcm in map(pcm_of, media)]
                columns = {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": batch.column("n_bytes"),
                    "payload_bytes": pa.array(map(len, data), pa.int64()),
                    "payload_sha256": [hashlib.sha256(x).hexdigest() for x in data],
                    "tail_crc32": pa.array([zlib.crc32(x[-PAD:]) for x in data], pa.int64()),
                    "media_bytes": pa.array(map(len, media), pa.int64()),
                    "media_sha256": [hashlib.sha256(m).hexdigest() for m in media],
                    "heard": features(media),
                    "even": pa.array([even for even, _ in packed], pa.binary()),
                    "odd": pa.array([odd for _, odd in packed], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(columns)
                del batch, media, data, packed, columns
        release()

    return stored.mapInArrow(run, _HEARD)


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def measured(stored: DataFrame) -> DataFrame:
    """What ``heard`` gave, with size and crc32 of the WAVE file of the PCM that is read back at the end of the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feature = []
            for text, even, odd in zip(*(batch.column(c) for c in ("heard", "even", "odd")), strict=True):
                rate, pcm = unpack_pcm(even.as_py(), odd.as_py())
                file = wav(pcm.astype("<i2").tobytes(), 1, rate)
                feature.append(f"{text.as_py()};pcm={len(file)}:{zlib.crc32(file):08x}")
            kept = batch.select([c.split()[0] for c in _READ.split(", ")[:-1]])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(feature, pa.string())], [*kept.schema.names, "feature"])
        release()

    return stored.mapInArrow(run, _READ)


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as mu-law audio: stored as media files, read back, expanded and measured; all samples of their resampled
    PCM are stored too, packed without loss, and its size and crc32, of what was read back, end the feature.

    A null or empty text is a payload of 64 zeros; rows that repeat are rows; a null doc_id stays null.
    """
    payloads = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), padded().alias("payload"))
    media = _stored(with_media(payloads, "payload").drop("payload"), new_folder(spark, "media"))
    return measured(_stored(heard(media), new_folder(spark, "pcm")))
