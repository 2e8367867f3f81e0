"""Functions of payload bytes.  Built-in expressions where Spark has them, Arrow-batched functions where it has not."""

from __future__ import annotations

import functools
import math
import os
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def batched(kind: str) -> Callable:
    """A function over Arrow batches, made when it is first applied: importing this module needs no session."""

    def wrap(f: Callable) -> Callable[..., Column]:
        made: list = []

        def function() -> Callable[..., Column]:
            if not made:
                made.append(F.pandas_udf(f, kind))
            return made[0]

        def apply(*columns: Column | str) -> Column:
            return function()(*columns)

        apply.__name__, apply.__doc__, apply.function = f.__name__, f.__doc__, function
        return apply

    return wrap


# -- hashes -----------------------------------------------------------------------------------


def crc32(payload: Column) -> Column:
    return F.crc32(payload)


#: Fixed value: the polynomial of the 64-bit checksum, used as it stands in a reflected loop.
CRC64_POLYNOMIAL = 0x42F0E1EBA9EA3693


def crc64_table() -> list[int]:
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (CRC64_POLYNOMIAL if value & 1 else 0)
        table.append(value)
    return table


_CRC64 = crc64_table()
#: Bytes that are taken through the table in step with all other blocks of a batch.
CRC64_BLOCK = 256


def _crc64_step(state: int, data: bytes) -> int:
    for byte in data:
        state = _CRC64[(state ^ byte) & 0xFF] ^ state >> 8
    return state


@functools.cache
def _crc64_skip() -> list[list[int]]:
    """What a state becomes after a block of zeros, by each of its bytes: the checksum is linear."""
    ones = [_crc64_step(1 << bit, bytes(CRC64_BLOCK)) for bit in range(64)]
    table = []
    for k in range(8):
        row = [0] * 256
        for value in range(1, 256):
            low = value & -value
            row[value] = row[value ^ low] ^ ones[8 * k + low.bit_length() - 1]
        table.append(row)
    return table


def crc64_all(payloads: list[bytes]) -> list[int]:
    """Checksums of many payloads: all their whole blocks step through the table together, then each payload's blocks are chained."""
    counts = [len(p) // CRC64_BLOCK for p in payloads]
    blocks = np.frombuffer(b"".join(p[: n * CRC64_BLOCK] for p, n in zip(payloads, counts, strict=True)), dtype=np.uint8).reshape(-1, CRC64_BLOCK)
    table, states = np.array(_CRC64, dtype=np.uint64), np.zeros(len(blocks), dtype=np.uint64)
    for column in np.ascontiguousarray(blocks.T):
        states = table[(states ^ column) & np.uint64(0xFF)] ^ states >> np.uint64(8)
    of_block, (t0, t1, t2, t3, t4, t5, t6, t7) = iter(states.tolist()), _crc64_skip()
    out = []
    for payload, n in zip(payloads, counts, strict=True):
        s = (1 << 64) - 1
        for _ in range(n):
            s = t0[s & 255] ^ t1[s >> 8 & 255] ^ t2[s >> 16 & 255] ^ t3[s >> 24 & 255] ^ t4[s >> 32 & 255] ^ t5[s >> 40 & 255] ^ t6[s >> 48 & 255] ^ t7[s >> 56] ^ next(of_block)
        out.append(_crc64_step(s, payload[n * CRC64_BLOCK :]) ^ (1 << 64) - 1)
    return out


@batched("string")
def crc64(payload: pd.Series) -> pd.Series:
    """The 64-bit checksum as a decimal number (it may pass a signed long); null for null."""
    there = payload.notna()
    out = pd.Series([None] * len(payload), index=payload.index, dtype=object)
    out[there] = [str(c) for c in crc64_all([bytes(b) for b in payload[there]])]
    return out


@batched("long")
def adler32(payload: pd.Series) -> pd.Series:
    return payload.map(lambda b: None if b is None else zlib.adler32(b)).astype("Int64")


def digests(payload: Column) -> Column:
    """struct(crc32, adler32, crc64, md5, sha1, sha256) of a binary column."""
    return F.struct(F.crc32(payload).alias("crc32"), adler32(payload).alias("adler32"), crc64(payload).alias("crc64"), F.md5(payload).alias("md5"), F.sha1(payload).alias("sha1"), F.sha2(payload, 256).alias("sha256"))


@functools.cache
def _crc32_skips() -> list[np.ndarray]:
    """What a 32-bit state becomes after 1, 2, 4 ... zero bytes, by each of its bytes: the checksum is linear, and each table is the last one applied twice."""
    ones = np.array([zlib.crc32(b"\0", 1 << bit ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for bit in range(32)], dtype=np.uint32)
    out = []
    for _ in range(62):
        table = np.zeros((4, 256), dtype=np.uint32)
        for bit in range(32):
            have = np.arange(256) >> bit % 8 & 1 == 1
            table[bit // 8, have] ^= ones[bit]
        out.append(table)
        ones = _skipped(table, ones)
    return out


def _skipped(table: np.ndarray, states: np.ndarray) -> np.ndarray:
    return table[0][states & 255] ^ table[1][states >> 8 & 255] ^ table[2][states >> 16 & 255] ^ table[3][states >> 24]


def shifted_crc32(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The part of a whole's checksum that a piece's checksum has, so many bytes before the end."""
    states = crcs.astype(np.uint32)
    for k, table in enumerate(_crc32_skips()):
        moved = lengths >> k & 1 == 1
        if moved.any():
            states[moved] = _skipped(table, states[moved])
    return states


def combine_crc32(first: int, second: int, second_length: int) -> int:
    """The checksum of two parts together, from theirs."""
    return int(shifted_crc32(np.array([first]), np.array([second_length]))[0]) ^ second


@batched("long")
def crc32_before(crc: pd.Series, tail: pd.Series) -> pd.Series:
    """shifted_crc32 of columns; null for null."""
    there = crc.notna() & tail.notna()
    out = pd.Series(pd.NA, index=crc.index, dtype="Int64")
    out[there] = shifted_crc32(crc[there].to_numpy(np.int64), tail[there].to_numpy(np.int64)).astype(np.int64)
    return out


def combined_crc32(chunks: DataFrame, key: str, order: str, crc: str = "crc32", size: str = "size") -> DataFrame:
    """key and crc32 of every payload, from the checksums and sizes of its chunks: each moved past what follows it, then summed bit by bit."""
    after = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    moved = chunks.select(key, crc32_before(F.col(crc), F.coalesce(F.sum(size).over(after), F.lit(0))).alias("part"))
    return moved.groupBy(key).agg(F.bit_xor("part").alias("crc32"))


# -- entropy ----------------------------------------------------------------------------------


def entropy_of(counts: np.ndarray) -> float:
    """Bits a byte of 256 counts; 0 for none."""
    total = counts.sum()
    if not total:
        return 0.0
    p = counts[counts > 0] / total
    return float(min(8.0, max(0.0, -(p * np.log2(p)).sum())))


def byte_counts(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)


@batched("array<long>")
def byte_histogram(payload: pd.Series) -> pd.Series:
    return payload.map(lambda b: None if b is None else byte_counts(b))


def entropies_of(payloads: list[bytes]) -> np.ndarray:
    """Bits a byte of each payload, all counted over one buffer."""
    sizes = np.fromiter(map(len, payloads), dtype=np.int64, count=len(payloads))
    out, at = np.zeros(len(payloads)), 0
    ends = np.cumsum(sizes)
    while at < len(payloads):  # some payloads at a time, so that keys stay in bounded memory
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 22), side="right")))
        data = np.frombuffer(b"".join(payloads[at:stop]), dtype=np.uint8)
        if stop == at + 1:
            out[at] = entropy_of(np.bincount(data, minlength=256))
        else:
            rows = np.repeat(np.arange(stop - at, dtype=np.int64), sizes[at:stop])
            counts = np.bincount(rows << 8 | data, minlength=(stop - at) << 8).reshape(-1, 256)
            total = np.maximum(sizes[at:stop], 1)
            p = counts / total[:, None]
            out[at:stop] = np.clip(-(p * np.log2(np.where(counts > 0, p, 1.0))).sum(axis=1), 0.0, 8.0)
        at = stop
    return out


@batched("double")
def entropy(payload: pd.Series) -> pd.Series:
    there = payload.notna()
    out = pd.Series(pd.NA, index=payload.index, dtype="Float64")
    out[there] = entropies_of(payload[there].tolist())
    return out


def strided(data: bytes, limit: int) -> bytes:
    """Every len // limit-th byte, limit of them; all bytes of shorter data."""
    return data if len(data) <= limit else bytes(np.frombuffer(data, dtype=np.uint8)[: limit * (len(data) // limit) : len(data) // limit])


def sampled_entropy(limit: int = 65_536) -> object:
    @batched("double")
    def run(payload: pd.Series) -> pd.Series:
        return payload.map(lambda b: None if b is None else entropy_of(byte_counts(strided(b, limit))))

    return run


#: Payloads of this size and sampled entropy are not worth compressing.
BYPASS_BYTES, BYPASS_ENTROPY = 1 << 20, 7.90


def bypass_compression(payload: Column) -> Column:
    return (F.length(payload) >= BYPASS_BYTES) & (sampled_entropy()(payload) > BYPASS_ENTROPY)


def text_entropy(text: Column) -> Column:
    """Bits a character, in expressions only: every distinct character's share."""
    size = F.length(text)
    chars = F.array_distinct(F.split(text, ""))
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    return F.when(size == 0, 0.0).otherwise(F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c))))


# -- compressibility --------------------------------------------------------------------------

SLICE, MOST_SLICES = 16_384, 4


def trial_ratio_of(data: bytes, pad: bool = False) -> float:
    """Deflated size over size of at most four slices spread over the data; pad fills short data up with zeros."""
    if not data:
        return 1.0
    count = min(MOST_SLICES, max(1, len(data) // SLICE))
    step = len(data) // count
    some = b"".join(data[(at := min(i * step, max(0, len(data) - SLICE))) : at + SLICE] for i in range(count))
    if pad:
        some = some.ljust(count * SLICE, b"\0")
    made = zlib.compressobj(1, zlib.DEFLATED, -15)
    return len(made.compress(some) + made.flush()) / len(some)


def trial_ratio(pad: bool = False) -> object:
    @batched("double")
    def run(payload: pd.Series) -> pd.Series:
        return payload.map(lambda b: None if b is None else trial_ratio_of(b, pad))

    return run


def scenario(text: Column) -> Column:
    """instant, cold or balanced, by words in a free text."""
    low = F.lower(text)
    any_of = lambda *words: low.rlike("|".join(words))
    return F.when(any_of("airdrop", "instant", "lan", "fast"), "instant").when(any_of("cold", "max", "backup", "archive"), "cold").otherwise("balanced")


#: The thresholds, levels, speeds and factors of the recommendation below.
def recommendation(entropy_bits: Column, ratio: Column, kind: Column) -> Column:
    """struct(algorithm, level, throughput_mbs, savings_pct) by entropy, trial ratio and scenario."""

    def row(algorithm: str, level: int, speed: float, factor: float | None) -> Column:
        saved = F.lit(0.0) if factor is None else F.greatest(F.lit(0.0), (1 - ratio * factor) * 100)
        return F.struct(F.lit(algorithm).alias("algorithm"), F.lit(level).alias("level"), F.lit(speed).alias("throughput_mbs"), saved.alias("savings_pct"))

    return (
        F.when((entropy_bits > 7.92) & (ratio > 0.98), row("store", 0, 6500.0, None))
        .when((kind == "instant") & (ratio < 0.5), row("zstd", 1, 3000.0, 1.0))
        .when(kind == "instant", row("lz4", 1, 4000.0, 1.0))
        .when(kind == "cold", row("lzma2", 9, 500.0, 0.75))
        .when(ratio < 0.4, row("zstd", 3, 1800.0, 0.9))
        .otherwise(row("deflate", 6, 1200.0, 1.0))
    )


# -- text encodings ---------------------------------------------------------------------------

#: Tried in this order when bytes are no UTF-8; a candidate must decode strictly.
CJK = ("gb18030", "shift_jis", "euc_kr", "big5", "euc_jp")
_BOMS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def charset_of(data: bytes) -> str:
    """ascii, a byte-order mark's encoding, utf-8, or the CJK encoding whose text has most characters of common scripts; else latin-1."""
    if data.isascii():
        return "ascii"
    for mark, name in _BOMS:
        if data.startswith(mark):
            return name
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    best, best_score = "latin-1", 0.5
    for name in CJK:
        try:
            text = data.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
        wide = [c for c in text if not c.isascii()]
        common = sum(0x4E00 <= ord(c) <= 0x9FFF or 0x3040 <= ord(c) <= 0x30FF or 0xAC00 <= ord(c) <= 0xD7A3 or 0x3000 <= ord(c) <= 0x303F or 0xFF00 <= ord(c) <= 0xFF60 for c in wide)
        kana = sum(0x3040 <= ord(c) <= 0x30FF for c in wide)
        score = (common + 0.5 * kana * (name in ("shift_jis", "euc_jp"))) / max(1, len(wide))
        if score > best_score + 1e-9:
            best, best_score = name, score
    return best


@batched("string")
def charset(payload: pd.Series) -> pd.Series:
    return payload.map(lambda b: None if b is None else charset_of(b))


@batched("string")
def decoded(payload: pd.Series) -> pd.Series:
    """Text of bytes in their detected encoding; undecodable bytes become U+FFFD."""
    return payload.map(lambda b: None if b is None else b.decode(charset_of(b), "replace"))


@batched("string")
def safe_filename(payload: pd.Series) -> pd.Series:
    """A file name from raw bytes: decoded, composed, control characters as underscores."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        text = unicodedata.normalize("NFC", raw.decode(charset_of(raw), "replace"))
        return "".join("_" if unicodedata.category(c) == "Cc" else c for c in text)

    return payload.map(one)


# -- paths ------------------------------------------------------------------------------------

#: Device names that Windows keeps for itself.
DEVICES = frozenset(["CON", "PRN", "AUX", "NUL", "CLOCK$", *[f"COM{i}" for i in range(10)], *[f"LPT{i}" for i in range(10)]])
LONG_PATH = 260


def _is_device(name: str) -> bool:
    return name.upper().startswith("PHYSICALDRIVE") or name.split(".", 1)[0].rstrip(" .").upper() in DEVICES


def sanitized_path(raw: str) -> dict[str, object]:
    """The path with ``.`` and ``..`` resolved, streams cut and characters composed, and what was wrong with it."""
    drive = len(raw) > 1 and raw[0].isascii() and raw[0].isalpha() and raw[1] == ":"
    unc = raw.startswith(("\\\\", "//"))
    escapes, device, stream, kept = "\0" in raw, "PHYSICALDRIVE" in raw.upper(), None, []
    for k, name in enumerate(unicodedata.normalize("NFC", raw).replace("\\", "/").split("/")):
        root = k == 0 and drive and len(name) == 2
        if not root and ":" in name:
            name, tail = name.split(":", 1)
            stream = stream or f":{tail}"
        if name in ("", "."):
            continue
        if name == "..":
            if not kept or len(kept) == 1 and len(kept[0]) == 2 and kept[0][1] == ":" and kept[0][0].isascii() and kept[0][0].isalpha():
                escapes = True
            else:
                kept.pop()
            continue
        device = device or _is_device(name)
        kept.append(name)
    path = "/".join(kept)
    return {"path": path, "traversal": escapes, "absolute": drive or raw.startswith(("/", "\\")), "unc": unc, "long": len(path.encode("utf-16-le", "surrogatepass")) // 2 > LONG_PATH, "device": device, "stream": stream}


@batched("path string, traversal boolean, absolute boolean, unc boolean, long boolean, device boolean, stream string")
def sanitize(path: pd.Series) -> pd.DataFrame:
    keys = ["path", "traversal", "absolute", "unc", "long", "device", "stream"]
    return pd.DataFrame([sanitized_path(p) if p is not None else dict.fromkeys(keys) for p in path], columns=keys)


# -- SQL --------------------------------------------------------------------------------------


def register(spark: SparkSession) -> None:
    """Makes the functions that Spark lacks known to SQL, by their own names."""
    for f in (crc64, adler32, entropy, byte_histogram, charset, decoded, safe_filename, sanitize, hex_diff, t_pvalue):
        spark.udf.register(f.__name__, f.function())


# -- differences ------------------------------------------------------------------------------


def first_difference(a: bytes, b: bytes) -> int | None:
    """Where two byte strings part; None if they are equal."""
    if a == b:
        return None
    return len(os.path.commonprefix([a, b]))


def hex_diff_of(a: bytes, b: bytes, context: int = 32) -> str | None:
    """Both strings in hex around their first difference."""
    at = first_difference(a, b)
    if at is None:
        return None
    start = max(0, at - context // 2)
    line = lambda x: " ".join(f"{v:02x}" for v in x[start : start + context])
    return f"offset {at}\n- {line(a)}\n+ {line(b)}"


@batched("offset long, diff string")
def hex_diff(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if x is None or y is None else (first_difference(x, y), hex_diff_of(x, y)) for x, y in zip(a, b, strict=True)]
    out = pd.DataFrame(rows, columns=["offset", "diff"])
    return out.astype({"offset": "Int64"})


# -- statistics of one-dimensional tests -------------------------------------------------------


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t: with t = sqrt(df) tan(angle) the density is a power of a cosine, integrated by Gauss-Legendre."""
    if df <= 0 or math.isnan(t):
        return 1.0
    low = math.atan(abs(t) / math.sqrt(df))
    high = min(math.pi / 2, low + 40 / math.sqrt(df + 1))
    x, w = np.polynomial.legendre.leggauss(200)
    angle = (high - low) / 2 * x + (high + low) / 2
    with np.errstate(divide="ignore"):
        density = np.exp((df - 1) * np.log(np.maximum(np.cos(angle), 1e-300)))
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return float(min(1.0, max(0.0, 2 * scale * (high - low) / 2 * (w * density).sum())))


@batched("double")
def t_pvalue(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for t, df in batches:
        yield pd.Series([None if pd.isna(a) or pd.isna(b) else t_tail(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")
