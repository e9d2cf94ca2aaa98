"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAVE files, decoded to linear PCM and resampled.

mu-law and A-law bytes are expanded by 256-entry lookup tables built from the published rules (ITU-T G.711). ADPCM blocks are
independent of each other, so numpy decodes all blocks of a batch at once, one sample position at a time.

Defined cases: a null or empty text becomes one padded unit of 192 blanks; other columns pass through; columns named like added ones
are refused; equal texts give equal values; an empty table gives an empty result; a damaged file raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.llm._common import batch_bytes
from gridloom.llm.tokens import slices, texts_of

UNIT = 192
RATE, OUT_RATE = 8000, 16000
ALAW, MULAW, ADPCM = 6, 7, 17  # WAVE format tags

# Step sizes and index moves of IMA ADPCM.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253,
    279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026,
    4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.uint8)
    size = (((code & 15).astype(np.int32) << 3) + 0x84 << ((code >> 4 & 7).astype(np.int32))) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    power, low = (code >> 4 & 7).astype(np.int32), (code & 15).astype(np.int32) << 4
    size = np.where(power == 0, low + 8, low + 0x108 << np.maximum(power - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = mulaw_table(), alaw_table()


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Signed change and next index (times 16) for (index, code)."""
    step = np.array(STEPS, np.int32)[:, None]
    code = np.arange(16)[None, :]
    size = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
    index = np.clip(np.arange(len(STEPS))[:, None] + np.array(MOVES)[code & 7], 0, len(STEPS) - 1)
    return np.where(code & 8, -size, size).astype(np.int32).ravel(), (index * 16).astype(np.int32).ravel()


CHANGE, NEXT = adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (blocks x samples) of mono IMA blocks (blocks x bytes): first sample and step index lead, then two codes a byte, low half first."""
    n, size = blocks.shape
    head = np.ascontiguousarray(blocks[:, :4])
    value = head[:, 0].astype(np.int32) | head[:, 1].astype(np.int32) << 8
    value = np.where(value >= 32768, value - 65536, value)
    index = np.minimum(head[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    data = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    out[0] = value
    row = 1
    for byte in data:
        for code in (byte & 15, byte >> 4):
            at = index + code
            value = value + CHANGE[at]
            np.minimum(value, 32767, out=value)
            np.maximum(value, -32768, out=value)
            index = NEXT[at]
            out[row] = value
            row += 1
    return out.T


def to_wave(data: bytes, tag: int, rate: int = RATE, block: int = UNIT) -> bytes:
    """A mono WAVE file around coded bytes."""
    if tag == ADPCM:
        per = 2 * (block - 4) + 1
        form = struct.pack("<HHIIHHHH", tag, 1, rate, rate * block // per, block, 4, 2, per)
        samples = len(data) // block * per
    else:
        form = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
        samples = len(data)
    body = b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


def from_wave(media: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, rate, block size and coded bytes of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            raise ValueError("a chunk is cut short")
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if form is None or form[1] != 1 or form[0] not in (ALAW, MULAW, ADPCM):
                raise ValueError("not mono mu-law, A-law or ADPCM")
            return form[0], form[2], form[4], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode(media: bytes) -> tuple[np.ndarray, int]:
    """Linear samples and rate of a WAVE file."""
    tag, rate, block, data = from_wave(media)
    if tag == ADPCM:
        if len(data) % block:
            raise ValueError("a block is cut short")
        return decode_adpcm(np.frombuffer(data, np.uint8).reshape(-1, block)).ravel(), rate
    return (MULAW_TABLE if tag == MULAW else ALAW_TABLE)[np.frombuffer(data, np.uint8)], rate


def resample(pcm: np.ndarray, rate: int, to: int = OUT_RATE) -> np.ndarray:
    """Linear interpolation to another rate, rounding down; the last sample is held."""
    if rate == to or not len(pcm):
        return pcm
    x = pcm.astype(np.int32)
    if to == 2 * rate:
        out = np.empty(2 * len(x), np.int16)
        out[::2] = x
        out[1:-1:2] = x[:-1] + x[1:] >> 1
        out[-1] = x[-1]
        return out
    at = np.arange(len(x) * to // rate, dtype=np.int64) * rate
    low = at // to
    high = np.minimum(low + 1, len(x) - 1)
    part = at - low * to
    return (x[low] + (x[high] - x[low]).astype(np.int64) * part // to).astype(np.int16)


def code_pcm(pcm: np.ndarray) -> bytes:
    """Samples in a form that compresses well: those at even places as they are, then those at odd places less the mean of their neighbours (modulo 2^16)."""
    even, odd = pcm[::2], pcm[1::2]
    return np.concatenate([even, odd - between(even)[: len(odd)]]).astype("<i2").tobytes()


def decode_pcm(data: bytes) -> np.ndarray:
    """Samples of code_pcm()."""
    coded = np.frombuffer(data, "<i2")
    even, rest = np.split(coded, [(len(coded) + 1) // 2])
    out = np.empty(len(coded), np.int16)
    out[::2] = even
    out[1::2] = rest + between(even)[: len(rest)]
    return out


def between(even: np.ndarray) -> np.ndarray:
    """Mean of each sample and the next, rounded down; the last one is its own."""
    wide = even.astype(np.int32)
    return (wide + np.append(wide[1:], wide[-1:]) >> 1).astype(np.int16)


def feature(pcm: np.ndarray) -> str:
    """Loudness, mean, peak and sign changes of samples, in whole numbers."""
    x = pcm.astype(np.int64)
    return f"{int(x @ x) // len(x)},{int(x.sum()) // len(x)},{int(np.abs(x).max())},{int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))}"


def payload_of(text: str) -> tuple[int, bytes]:
    """UTF-8 size, and the bytes padded by blanks to a positive multiple of the unit."""
    data = text.encode()
    return len(data), data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")


ADDED = {"n_bytes": T.LongType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType(), "media": T.BinaryType(), "pcm": T.BinaryType()}


def files_of(texts: list[str]) -> dict[str, list]:
    """UTF-8 sizes of texts, their mu-law files, and the files' audio as 16-bit samples at OUT_RATE, coded by code_pcm."""
    out: dict[str, list] = {"n_bytes": [], "media": [], "pcm": []}
    for t in texts:
        n, data = payload_of(t)
        file = to_wave(data, MULAW)
        for c, v in zip(out, (n, file, code_pcm(resample(*decode(file))))):
            out[c].append(v)
    return out


def figures_of(files: list[bytes], pcms: list[bytes]) -> dict[str, list]:
    """Sizes, digests and features of files and of their coded samples."""
    out: dict[str, list] = {c: [] for c in ADDED if c not in ("n_bytes", "media", "pcm")}
    loads = [from_wave(f)[3] for f in files]
    heard = decode_adpcm(np.frombuffer(b"".join(loads), np.uint8).reshape(-1, UNIT))
    at = 0
    for file, load, pcm in zip(files, loads, pcms):
        k = len(load) // UNIT
        heard_as = (decode(file)[0], ALAW_TABLE[np.frombuffer(load, np.uint8)], heard[at : at + k].ravel())
        at += k
        marks = "|".join(map(feature, heard_as)) + f"|{zlib.crc32(decode_pcm(pcm).astype('<i2').tobytes())}"
        for c, v in zip(out, (len(load), hashlib.sha256(load).hexdigest(), zlib.crc32(load[-16:]), len(file), hashlib.sha256(file).hexdigest(), marks)):
            out[c].append(v)
    return out


def checked(docs: DataFrame, added: list[str], text: str) -> tuple[list[T.StructField], T.StructType]:
    """The columns of docs that pass through, and the schema with the added ones."""
    if clash := [c for c in added if c in docs.columns and c != text]:
        raise ValueError(f"columns {clash} are already there")
    kept = [f for f in docs.schema.fields if f.name != text]
    return kept, T.StructType([*kept, *(T.StructField(c, ADDED[c]) for c in added)])


def audio_columns(docs: DataFrame, text: str = "text", keep_media: bool = True) -> DataFrame:
    """docs without the text, with its mu-law file, what is read back from it, and features.

    media is the file; pcm is its audio as 16-bit samples at OUT_RATE, which decode_pcm gives back. feature joins the figures of the payload heard as
    mu-law, as A-law and as ADPCM blocks of UNIT bytes, and the CRC of those samples. keep_media=False leaves the two binary columns out.
    """
    added = [c for c in ADDED if keep_media or c not in ("media", "pcm")]
    kept, schema = checked(docs, added, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in slices(texts_of(batch.column(text)), 1_000_000):
                files = files_of(some)
                found = files | figures_of(files["media"], files["pcm"])
                part = batch.slice(at, len(some))
                at += len(some)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *(pa.array(found[c], T_ARROW[c]) for c in added)], [*(f.name for f in kept), *added])

    return docs.mapInArrow(run, schema)


#: How files and samples are written: level 6 and larger pages take a tenth less room than the defaults.
STORED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6", "parquet.page.size": str(4 << 20), "parquet.block.size": str(16 << 20)}


def store_media(docs: DataFrame, path: str, text: str = "text") -> None:
    """Write docs without the text, with n_bytes, media and pcm, at path."""
    added = ["n_bytes", "media", "pcm"]
    kept, schema = checked(docs, list(ADDED), text)
    schema = T.StructType([f for f in schema.fields if f.name not in ADDED or f.name in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in slices(texts_of(batch.column(text)), 1_000_000):
                found = files_of(some)
                part = batch.slice(at, len(some))
                at += len(some)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *(pa.array(found[c], T_ARROW[c]) for c in added)], [*(f.name for f in kept), *added])

    with batch_bytes(docs.sparkSession):
        docs.mapInArrow(run, schema).write.options(**STORED).parquet(path)


def read_media(stored: DataFrame) -> DataFrame:
    """What audio_columns gives without the binary columns, from the files and samples of a table that store_media wrote."""
    added = [c for c in ADDED if c not in ("media", "pcm")]
    kept = [f for f in stored.schema.fields if f.name not in ADDED]
    schema = T.StructType([*kept, *(T.StructField(c, ADDED[c]) for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # As many rows at a time as hold about a megabyte of payload; pcm is four times that.
            rows = max(1, batch.num_rows * 5_000_000 // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found = figures_of(part.column("media").to_pylist(), part.column("pcm").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *(part.column(c) if c == "n_bytes" else pa.array(found[c], T_ARROW[c]) for c in added)], [*(f.name for f in kept), *added])

    return stored.mapInArrow(run, schema)


T_ARROW = {c: {T.LongType: pa.int64(), T.StringType: pa.string(), T.BinaryType: pa.binary()}[type(t)] for c, t in ADDED.items()}
