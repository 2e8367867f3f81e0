"""Telephony audio in media columns: mu-law, A-law and IMA ADPCM, expanded with NumPy and stored as resampled PCM.

G.711 codes are expanded by lookup tables.  ADPCM is decoded across blocks: a step of the loop
decodes one nibble of all blocks of a batch.  Media are RIFF files with one fmt and one data chunk.

``store`` puts any bytes into such a file as 8-bit mu-law codes without loss; ``measure`` reads a media column back: digests of the
payload and of the file, and of what the codes expand to by both laws and as ADPCM, resampled to twice the rate; ``pcm_columns`` returns
that PCM itself, 16-bit, at twice or the same rate, for a media column in any of the formats.

Defined results: null text is empty and gives one block of zeros; null or broken media give null PCM and the reason in ``error``;
equal inputs give equal bytes; rows of any length are handled whole, in slices of bounded memory; an empty table has no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import common

RATE = 8000
BLOCK = 64
#: Bytes of payload that are expanded at a time, a multiple of the block.
SLICE = 1 << 20
#: Format tags of RIFF audio.
PCM, A_LAW, MU_LAW, IMA_ADPCM = 1, 6, 7, 17

#: The step sizes of IMA ADPCM.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411,
        1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
        12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    dtype=np.int32,
)
#: How a nibble moves the step index.
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int8)


def mu_law_table() -> np.ndarray:
    """16-bit sample of each code: a 4-bit mantissa, a 3-bit exponent and a sign, all bits inverted."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """16-bit sample of each code: every second bit inverted; the lowest two segments share a step."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment, size = code >> 4 & 7, (code & 15) << 4
    size = np.where(segment == 0, size + 8, size + 264 << np.maximum(segment - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks, one row for each; a block is a 16-bit sample, an index, a spare byte, and nibbles, low ones first."""
    n, size = blocks.shape
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int16)
    nibbles = np.empty((2 * (size - 4), n), dtype=np.uint8)
    nibbles[0::2] = blocks[:, 4:].T & 15
    nibbles[1::2] = blocks[:, 4:].T >> 4
    out = np.empty((1 + len(nibbles), n), dtype=np.int16)
    out[0] = value
    for k, nibble in enumerate(nibbles, 1):
        step, low = STEPS[index], nibble & 7
        change = step * (2 * low.astype(np.int32) + 1) >> 3
        value += np.where(nibble & 8, -change, change)
        np.clip(value, -32768, 32767, out=value)
        out[k] = value
        index += MOVES[low]
        np.clip(index, 0, len(STEPS) - 1, out=index)
    return out.T


def doubled(samples: np.ndarray, after: int | None = None) -> np.ndarray:
    """Twice the rate: the mean of neighbours between them, the last one's neighbour being itself if none comes after."""
    wide = samples.astype(np.int32)
    follow = np.append(wide[1:], wide[-1:] if after is None else after)
    return np.stack([wide, wide + follow >> 1], axis=-1).reshape(-1).astype("<i2")


def wrap(data: bytes, tag: int = MU_LAW, rate: int = RATE, block: int = 1) -> bytes:
    """A RIFF file of one channel around the data."""
    bits = {PCM: 16, IMA_ADPCM: 4}.get(tag, 8)
    extra = struct.pack("<HH", 2, 2 * (block - 4) + 1) if tag == IMA_ADPCM else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * block if tag != IMA_ADPCM else rate * block // (2 * (block - 4) + 1), block, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwrap(media: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, rate, block size and data of a RIFF file; ValueError if it is broken."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF wave file")
    at, fmt = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        body = media[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("a chunk goes beyond the end")
        if name == b"fmt ":
            if size < 16:
                raise ValueError("fmt chunk too short")
            fmt = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data" and fmt:
            return fmt[0], fmt[2], fmt[4], body
        at += 8 + size + size % 2
    raise ValueError("no data chunk after a fmt chunk")


def samples(media: bytes) -> tuple[int, np.ndarray]:
    """Rate and 16-bit samples of a file in any of the four formats."""
    tag, rate, block, data = unwrap(media)
    raw = np.frombuffer(data, dtype=np.uint8)
    if tag in TABLES:
        return rate, TABLES[tag][raw]
    if tag == IMA_ADPCM:
        if block <= 4 or len(raw) % block:
            raise ValueError("data is not whole blocks")
        return rate, decode_ima(raw.reshape(-1, block)).reshape(-1)
    if tag == PCM and len(raw) % 2 == 0:
        return rate, raw.view("<i2")
    raise ValueError(f"format {tag} is not handled")


def pcm_columns(table: DataFrame, media_column: str = "media", id_column: str = "doc_id", double: bool = True) -> DataFrame:
    """id, rate, pcm (little-endian 16-bit, at twice the rate if double) and error for each row of a media column."""
    narrow = table.select(F.col(id_column).alias("doc_id"), F.col(media_column).alias("media"))

    def one(media: bytes | None) -> tuple[int | None, bytes | None, str | None]:
        if media is None:
            return None, None, "null"
        try:
            rate, found = samples(media)
        except ValueError as e:
            return None, None, str(e)
        return (2 * rate, doubled(found).tobytes(), None) if double and len(found) else (rate, found.astype("<i2").tobytes(), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, "media"):
            rate, pcm, error = zip(*map(one, piece.column("media").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(rate, pa.int32()), pa.array(pcm, pa.binary()), pa.array(error, pa.string())], names=["doc_id", "rate", "pcm", "error"])

    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.mapInArrow(run, f"doc_id {kind}, rate int, pcm binary, error string").withColumnRenamed("doc_id", id_column)


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row with zeros up to a positive multiple of the block, and the new offsets."""
    sizes = np.diff(offsets)
    to = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum(np.maximum(1, -(-sizes // BLOCK)) * BLOCK, out=to[1:])
    out = np.zeros(to[-1], dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(to[:-1] - offsets[:-1], sizes)] = data
    return out, to


def features(payload: np.ndarray, to: np.ndarray) -> list[str]:
    """For each row: peak, mean size and sign changes of its mu-law samples; checksums of the doubled PCM by both laws and of its blocks as ADPCM."""
    n = len(to) - 1
    peak, total, turned = (np.zeros(n, dtype=np.int64) for _ in range(3))
    sums = {"pcm16k": [0] * n, "alaw16k": [0] * n, "adpcm": [0] * n}
    for at in range(0, len(payload), SLICE):
        stop = min(at + SLICE, len(payload))
        first, last = int(np.searchsorted(to, at, side="right")) - 1, int(np.searchsorted(to, stop, side="left"))
        starts = np.maximum(to[first:last], at) - at
        wide = {tag: TABLES[tag][payload[at : stop + 1]] for tag in TABLES}  # one sample beyond, for the mean at the slice's end
        mu = wide[MU_LAW][: stop - at]
        size, turns = np.abs(mu.astype(np.int32)), np.zeros(len(mu), dtype=np.int64)
        turns[1:] = (mu[1:] < 0) != (mu[:-1] < 0)
        turns[0] = (mu[0] < 0) != (TABLES[MU_LAW][payload[at - 1]] < 0) if to[first] < at else 0
        turns[starts[to[first:last] >= at]] = 0
        peak[first:last] = np.maximum(peak[first:last], np.maximum.reduceat(size, starts))
        total[first:last] += np.add.reduceat(size, starts, dtype=np.int64)
        turned[first:last] += np.add.reduceat(turns, starts)
        blocks = decode_ima(payload[at:stop].reshape(-1, BLOCK)).astype("<i2")
        for r, a in zip(range(first, last), starts.tolist(), strict=True):
            b = min(int(to[r + 1]), stop) - at
            for name, tag in (("pcm16k", MU_LAW), ("alaw16k", A_LAW)):
                after = int(wide[tag][b]) if at + b < to[r + 1] else None
                sums[name][r] = zlib.crc32(doubled(wide[tag][a:b], after), sums[name][r])
            sums["adpcm"][r] = zlib.crc32(np.ascontiguousarray(blocks[a // BLOCK : b // BLOCK]), sums["adpcm"][r])
    sizes = np.diff(to)
    return [f"peak={peak[r]};mean={total[r] // sizes[r]};turns={turned[r]};" + ";".join(f"{name}={x[r]:08x}" for name, x in sums.items()) for r in range(n)]


def store(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: id, n_bytes, and media, its text as a file of mu-law codes."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, "text"):
            data, offsets = common.utf8(piece.column("text"))
            payload, to = padded(data, offsets)
            media = [wrap(payload[a:b].tobytes()) for a, b in zip(to[:-1], to[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary").withColumnRenamed("doc_id", id_column)


def measure(stored: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """One row for each row of store(): sizes and digests of the file and of the payload that is read back from it, and its features."""
    narrow = stored.select(F.col(id_column).alias("doc_id"), "n_bytes", "media")
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, "media"):
            media = piece.column("media").to_pylist()
            back = [unwrap(m)[3] for m in media]
            columns = [
                piece.column("doc_id"),
                piece.column("n_bytes"),
                pa.array([len(b) for b in back], pa.int64()),
                pa.array([hashlib.sha256(b).hexdigest() for b in back]),
                pa.array([zlib.crc32(b[-BLOCK:]) for b in back], pa.int64()),
                pa.array([len(m) for m in media], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in media]),
                pa.array(features(np.frombuffer(b"".join(back), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(b) for b in back]))))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("doc_id", id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_telephony: every document of the table stored as mu-law in a table of the shared folder, and read back from it."""
    return measure(common.written(store(common.read(spark, sf_dir, "documents")), "media"))
