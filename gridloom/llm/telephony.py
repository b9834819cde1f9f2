"""Telephony audio in media columns.

Coded audio is kept as WAV bytes in a binary column: G.711 mu-law and A-law (one byte a sample) and IMA ADPCM blocks
(two samples a byte). G.711 is expanded by a lookup table of 256 entries, ADPCM step by step for all blocks at once,
and the samples are resampled from 8 to 16 kHz and stored as 16-bit PCM, every sample of them. Files in which the PCM is coded
as ``halves`` are still read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textbytes as tb
from gridloom.session import new_path

UNIT = 64  # bytes; also the ADPCM block size
RATE = 8000
# Format tags of the container.
TAGS = {"pcm": 1, "alaw": 6, "mulaw": 7, "adpcm": 17, "halves": 0xFFFF}  # the last: a tag for forms of one's own
# The step sizes and index changes of IMA ADPCM.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130,
    143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282,
    1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
    10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
# Half-band interpolation: weights of the samples left and right of the new one, in 1 / 32768.
TAPS = (20480, -5461, 1792, -427)
LEVEL = 6  # of zstd, for media and PCM


def _mulaw() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)
    return np.where(code & 0x80, 0x84 - size, size - 0x84).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    step, size = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(step == 0, size + 8, (size + 0x108) << np.maximum(step - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


EXPAND = {"mulaw": _mulaw(), "alaw": _alaw()}
LAWS = (None, "mulaw", "alaw")  # how the first samples are coded; None: 16 bits each


def _levels(table: np.ndarray) -> np.ndarray:
    """The code of each 16-bit value, -1 for those that are no level."""
    out = np.full(1 << 16, -1, np.int16)
    out[table.view(np.uint16)] = np.arange(256)
    return out


LEVELS = {law: _levels(table) for law, table in EXPAND.items()}


def adpcm_blocks(data: np.ndarray, block: int = UNIT) -> np.ndarray:
    """Samples of mono IMA ADPCM blocks, one row per block; the loop runs over the samples of a block, not over blocks.

    A block starts with its first sample (16 bits) and step index; an index beyond the table counts as the last.
    """
    blocks = data.reshape(-1, block)
    out = np.empty((len(blocks), 1 + 2 * (block - 4)), np.int16)
    value = blocks[:, :2].copy().view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    out[:, 0] = value
    for k in range(block - 4):
        byte = blocks[:, 4 + k]
        for half, code in enumerate((byte & 0x0F, byte >> 4)):
            step = STEPS[index]
            change = step >> 3
            change = change + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
            index = np.clip(index + MOVES[code & 7], 0, len(STEPS) - 1)
            out[:, 1 + 2 * k + half] = value
    return out


def between(samples: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sample interpolated behind each one. ``sizes`` are the lengths of the signals that lie one after another; beyond
    its ends a signal is silent."""
    if not len(samples):
        return np.zeros(0, np.int16)
    reach = len(TAPS)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(samples)) + reach * (owner + 1)
    wide = np.zeros(len(samples) + reach * (len(sizes) + 1), np.int32)
    wide[place] = samples
    total = np.full(len(wide) - 2 * reach + 1, 1 << 14, np.int32)  # the taps' sizes sum to 28,160: 32 bits hold any sum
    for k, tap in enumerate(TAPS):
        total += tap * (wide[reach - 1 - k : len(wide) - reach - k] + wide[reach + k : len(wide) - reach + 1 + k])
    return np.clip(total >> 15, -32768, 32767).astype(np.int16)[place - reach + 1]


def doubled(samples: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the one interpolated behind it."""
    out = np.empty(2 * len(samples), np.int16)
    out[0::2] = samples
    out[1::2] = between(samples, sizes)
    return out


def halves(pcm: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """PCM signals of even lengths, coded without loss: a byte for the law of the first samples of each two and one that tells
    whether differences follow, the first samples, and unless all are zero the differences of the second ones from
    ``between``, modulo 65,536."""
    first, second = pcm[0::2], pcm[1::2]
    rest = second - between(first, sizes // 2)
    out, low = [], 0
    for size in sizes // 2:
        high, own = low + int(size), 0
        body = first[low:high].astype("<i2")
        for k, law in enumerate(LAWS[1:], 1):
            code = LEVELS[law][first[low:high].view(np.uint16)]
            if (code >= 0).all():
                own, body = k, code.astype(np.uint8)
                break
        differ = bool(rest[low:high].any())
        out.append(bytes([own, differ]) + body.tobytes() + (rest[low:high].astype("<i2").tobytes() if differ else b""))
        low = high
    return out


def joined(coded: list) -> list[np.ndarray]:
    """The PCM signals that ``halves`` has coded."""
    firsts, rests = [np.zeros(0, np.int16)], []
    for c in coded:
        law, view = LAWS[c[0]], np.frombuffer(c, np.uint8)[2:]
        width = (1 if law else 2) + 2 * c[1]
        size = len(view) // width
        firsts.append(EXPAND[law][view[:size]] if law else view[: 2 * size].view("<i2"))
        rests.append(view[len(view) - 2 * size :].view("<i2") if c[1] else None)
    sizes = np.array([len(f) for f in firsts[1:]], np.int64)
    pcm = doubled(np.concatenate(firsts), sizes)
    out = np.split(pcm, np.cumsum(2 * sizes)[:-1]) if len(sizes) else []
    for signal, rest in zip(out, rests):
        if rest is not None:
            signal[1::2] += rest
    return out


def wav(data: bytes, codec: str = "mulaw", rate: int = RATE) -> bytes:
    """A mono WAV file."""
    width, block = {"pcm": (16, 2), "halves": (16, 2), "adpcm": (4, UNIT)}.get(codec, (8, 1))
    per_second = rate * block if codec != "adpcm" else rate * UNIT // (1 + 2 * (UNIT - 4))
    extra = struct.pack("<HH", 2, 1 + 2 * (UNIT - 4)) if codec == "adpcm" else b"" if codec == "pcm" else struct.pack("<H", 0)
    if codec == "halves":
        count = 2 * ((len(data) - 2) // ((1 if data[0] else 2) + 2 * data[1]))
    else:
        count = len(data) // 2 if codec == "pcm" else len(data) if codec != "adpcm" else len(data) // UNIT * (1 + 2 * (UNIT - 4))
    form = struct.pack("<HHIIHH", TAGS[codec], 1, rate, per_second, block, width) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, count) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(media: bytes) -> tuple[str, int, memoryview]:
    """Codec, rate and data of a mono WAV file, PCM decoded if it is coded; raises ValueError for anything else."""
    codec, rate, data = parsed(media)
    if codec == "halves":
        return "pcm", rate, memoryview(joined([data])[0].astype("<i2").view(np.uint8))
    return codec, rate, data


def parsed(media: bytes) -> tuple[str, int, memoryview]:
    """Codec, rate and data of a mono WAV file as they are stored."""
    view = memoryview(media)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate = 12, None, 0
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if name == b"fmt ":
            tag, channels, rate = struct.unpack_from("<HHI", view, at + 8)
            codec = {v: k for k, v in TAGS.items()}.get(tag)
            if codec is None or channels != 1:
                raise ValueError(f"format {tag} with {channels} channels")
        elif name == b"data":
            if codec is None:
                raise ValueError("data before format")
            return codec, rate, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data")


def samples_of(codec: str, data) -> np.ndarray:
    data = np.frombuffer(data, np.uint8)
    return data.view("<i2") if codec == "pcm" else adpcm_blocks(data).ravel() if codec == "adpcm" else EXPAND[codec][data]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", codec: str = "mulaw") -> DataFrame:
    """``doc_id, n_bytes, media``: the text's bytes, filled up with zeros to a positive multiple of 64, as a WAV file.

    A null text counts as empty; every row is kept as it is, so repeated rows give repeated media.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.column(batch.column(1))
            for i, j in tb.slices(offsets):
                media = []
                for k in range(i, j):
                    body = data[offsets[k] : offsets[k + 1]].tobytes()
                    media.append(wav(body + bytes(-len(body) % UNIT if body else UNIT), codec))
                yield pa.record_batch(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), pa.array(media, pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def resampled(media: DataFrame, media_col: str = "media") -> DataFrame:
    """The table with ``pcm`` (16 kHz, 16 bits, WAV) and ``pcm_samples`` appended; a null media gives a null PCM."""
    fields = [f for f in media.schema.fields if f.name not in ("pcm", "pcm_samples")]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index(media_col))
            for i, j in tb.slices(tb.column(column)[1], tb.SLICE // 4):
                rates, heard = [], []
                for value in column.slice(i, j - i):
                    if value.is_valid:
                        codec, rate, data = unwav(value.as_py())
                        rates.append(2 * rate), heard.append(samples_of(codec, data))
                sizes = np.array([len(x) for x in heard], np.int64)
                whole = memoryview(doubled(np.concatenate([np.zeros(0, np.int16), *heard]), sizes).astype("<i2").view(np.uint8))
                ends = 4 * np.cumsum(sizes)
                made = zip((wav(bytes(whole[a:b]), "pcm", r) for a, b, r in zip(ends - 4 * sizes, ends, rates)), (2 * sizes).tolist())
                pcm, counts = zip(*(next(made) if valid else (None, None) for valid in column.slice(i, j - i).is_valid().to_pylist()))
                rows = batch.slice(i, j - i)
                yield pa.record_batch([*rows.columns, pa.array(pcm, pa.binary()), pa.array(counts, pa.int64())], names=[*names, "pcm", "pcm_samples"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return media.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, shape + ", pcm binary, pcm_samples long")


def store_pcm(media: DataFrame, path: str, media_col: str = "media") -> None:
    """Write the resampled table; each row carries its PCM."""
    to = resampled(media, media_col).write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", LEVEL)
    to.parquet(path)


def _traits(samples: np.ndarray, sizes: np.ndarray, stored: list | None = None) -> list[str]:
    """Per signal: samples, peak, energy, sign changes and the CRC of the resampled PCM (``stored``, or made here)."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    wide = samples.astype(np.int64)
    peak = np.maximum.reduceat(np.abs(wide), starts)
    energy = np.add.reduceat(wide * wide, starts)
    turn = np.zeros(len(samples), np.int64)
    turn[1:] = (samples[1:] < 0) != (samples[:-1] < 0)
    turn[starts] = 0
    turns = np.add.reduceat(turn, starts)
    if stored is None:
        pcm = memoryview(doubled(samples, sizes).astype("<i2").view(np.uint8))
        stored = [pcm[4 * a : 4 * b] for a, b in zip(starts, ends)]
    return [f"{n}:{p}:{e}:{t}:{zlib.crc32(c)}" for n, p, e, t, c in zip(sizes, peak, energy, turns, stored)]


def features(media: DataFrame) -> DataFrame:
    """What the stored media hold: payload and media hashes, and traits of the payload under each of the three codecs.

    ``media`` has mu-law ``media`` and their ``pcm``, as ``store_pcm`` writes them. The mu-law traits
    (``codec:samples:peak:energy:sign changes:CRC of the 16 kHz PCM``) come from the stored PCM; the others read the payload's
    bytes as A-law and as ADPCM blocks. Whole signals throughout.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs, offsets = tb.column(batch.column(2))
            for i, j in tb.slices(offsets, tb.SLICE // 4):
                wavs = [blobs[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]
                payloads = [unwav(w)[2] for w in wavs]
                pcm = [unwav(p.as_py())[2] for p in batch.column(3).slice(i, j - i)]
                heard = np.concatenate([np.frombuffer(p, "<i2")[::2] for p in pcm])
                sizes = np.array([len(p) for p in payloads])
                data = np.concatenate([np.frombuffer(p, np.uint8) for p in payloads])
                traits = [
                    _traits(heard, np.array([len(p) // 4 for p in pcm]), pcm), _traits(EXPAND["alaw"][data], sizes),
                    _traits(adpcm_blocks(data).ravel(), sizes // UNIT * (1 + 2 * (UNIT - 4))),
                ]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(sizes),
                        pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([zlib.crc32(p[-UNIT:]) for p in payloads], pa.int64()),
                        pa.array([len(w) for w in wavs], pa.int64()), pa.array([hashlib.sha256(w).hexdigest() for w in wavs]),
                        pa.array([f"mulaw:{m};alaw:{a};adpcm:{d}" for m, a, d in zip(*traits)]),
                    ],
                    names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def stored_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, resample, store media and PCM below the shared folder, read back and describe."""
    path = new_path(docs.sparkSession, "media")
    store_pcm(encode(docs, id_col, text_col), path)
    return features(docs.sparkSession.read.parquet(path))
