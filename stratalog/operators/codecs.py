"""A matrix of codecs and levels over payloads: sizes, times, and whether everything comes back."""

from __future__ import annotations

import bz2
import contextlib
import ctypes
import lzma
import time
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions import paths


def _arrow(name: str, level: int | None = None) -> tuple[Callable, Callable]:
    codec = pa.Codec(name, level) if level is not None else pa.Codec(name)
    return lambda b: codec.compress(b, asbytes=True), lambda b, n: codec.decompress(b, n, asbytes=True)


def codec(name: str, level: int) -> tuple[Callable[[bytes], bytes], Callable[[bytes, int], bytes]]:
    """Compressor and decompressor (which is told the length)."""
    match name:
        case "deflate":
            return lambda b: zlib.compress(b, level), lambda b, n: zlib.decompress(b)
        case "zstd":
            reader = zstandard.ZstdDecompressor()
            return zstandard.ZstdCompressor(level=level).compress, lambda b, n: reader.decompress(b, max_output_size=max(1, n))
        case "bzip2":
            return lambda b: bz2.compress(b, level), lambda b, n: bz2.decompress(b)
        case "lzma":
            # a dictionary beyond the payload finds nothing more, and making one is what short payloads would cost
            return lambda b: lzma.compress(b, filters=[{"id": lzma.FILTER_LZMA2, "preset": level, "dict_size": dictionary(level, len(b))}]), lambda b, n: lzma.decompress(b)
        case "lz4":
            return _arrow("lz4_raw")
        case "snappy":
            return _arrow("snappy")
        case "brotli":
            return _arrow("brotli", level)
    raise ValueError(f"unknown codec {name!r}")


#: Dictionary sizes of the LZMA presets.
DICTIONARIES = [1 << n for n in (18, 20, 21, 22, 22, 23, 23, 24, 25, 26)]
#: Those that are at hand here: 9 deflate, 22 zstd, 9 bzip2, 10 lzma, 12 brotli, lz4 and snappy.
CONFIGS = [("deflate", n) for n in range(1, 10)] + [("zstd", n) for n in range(1, 23)] + [("bzip2", n) for n in range(1, 10)] + [("lzma", n) for n in range(10)] + [("brotli", n) for n in range(12)] + [("lz4", 1), ("snappy", 1)]


#: Payload bytes of a task: half a minute's work for all configurations.  Small tables are cut finer, for 32 tasks a core, but not below the least.
TASK_BYTES, LEAST_TASK_BYTES = 4 << 20, 64 << 10


def dictionary(level: int, size: int) -> int:
    """Bytes of the LZMA dictionary for a payload of so many."""
    return max(4096, min(DICTIONARIES[level], 1 << size.bit_length()))


def maker(name: str, level: int, size: int) -> int:
    """The lowest level that makes the same stream of any payload of so many bytes.

    LZMA's presets from 6 on differ in their dictionaries only.  A bzip2 level is the size of a block, of which each holds 100,000 bytes a level
    less 19, in which runs of four can take five: what fits one block differs in the level's digit in the header only.
    """
    if name == "lzma" and level > 6:
        return next(n for n in range(6, level + 1) if dictionary(n, size) == dictionary(level, size))
    if name == "bzip2":
        return min(level, (size * 5 // 4 + 32) // 100_000 + 1)
    return level


@contextlib.contextmanager
def _heap_kept() -> Iterator[None]:
    """Meanwhile, memory that is freed stays with the process, where the C library knows how: brotli's level 9 asks for 32 MiB a payload, whose page faults cost several times its work."""
    try:
        libc = ctypes.CDLL(None)
        mallopt, trim = libc.mallopt, libc.malloc_trim
    except (OSError, AttributeError, TypeError):
        yield
        return
    # M_MMAP_MAX and M_TRIM_THRESHOLD, and at the end their defaults
    mallopt(-4, 0), mallopt(-1, (1 << 31) - 1)
    try:
        yield
    finally:
        mallopt(-4, 65_536), mallopt(-1, 128 << 10), trim(0)


def measured(configs: list[tuple[str, int]], payloads: list[bytes]) -> Iterator[tuple[str, int, list[tuple[int, float, float, bool]]]]:
    """Each configuration with, for each payload, its compressed size, seconds there and back, and whether the same bytes came back.

    A stream that another level has made of the payload is not made again, and counts with the seconds it took.  Each different stream is read back: one
    with another header by itself, one of the same bytes once.
    """
    kept: dict[tuple[str, int, int], tuple[bytes, float]] = {}
    read: dict[tuple[str, int, int], tuple[float, bool]] = {}
    for name, level in configs:
        there, back = codec(name, level)
        out = []
        for i, payload in enumerate(payloads):
            by = maker(name, level, len(payload))
            if (name, by, i) in kept:
                made, took = kept[name, by, i]
                if name == "bzip2":
                    made = b"BZh%d" % level + made[4:]
            else:
                began = time.perf_counter()
                made = there(payload)
                took = time.perf_counter() - began
                if name in ("lzma", "bzip2") and by == maker(name, 9, len(payload)):
                    kept[name, by, i] = made, took
            if (name, by, i) in read:
                back_s, same = read[name, by, i]
            else:
                began = time.perf_counter()
                same = back(made, len(payload)) == payload
                back_s = time.perf_counter() - began
                if name == "lzma":
                    read[name, by, i] = back_s, same
            out.append((len(made), took, back_s, same))
        yield name, level, out


def matrix(payloads: DataFrame, key: str, configs: list[tuple[str, int]] | None = None, column: str = "payload", sized: DataFrame | None = None) -> DataFrame:
    """A row for each payload, codec and level.  A payload goes to Python once, for all configurations; tasks get like shares of the payloads, however the table is stored.

    How many tasks, the bytes of the column say in `sized`, a table of about that size which costs less to read than payloads that are made by a shuffle.
    """
    configs = configs or CONFIGS
    rows = payloads.where(F.length(column) > 0).select(key, column)
    size = (rows if sized is None else sized).agg(F.coalesce(F.sum(F.length(column)), F.lit(0))).first()[0]
    tasks = max(size // TASK_BYTES, min(size // LEAST_TASK_BYTES, 32 * rows.sparkSession.sparkContext.defaultParallelism)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _heap_kept():
            for batch in batches:
                payloads = [bytes(b) for b in batch.column(1).to_pylist()]
                for name, level, found in measured(configs, payloads) if payloads else ():
                    compressed, there, back, same = zip(*found, strict=True)
                    columns = [batch.column(0), pa.array([name] * len(found)), pa.array([level] * len(found), pa.int32()), pa.array(map(len, payloads), pa.int64()), pa.array(compressed, pa.int64()), pa.array(there), pa.array(back), pa.array(same)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    names = [key, "codec", "level", "original", "compressed", "compress_s", "decompress_s", "round_trip"]
    return rows.repartition(tasks).mapInArrow(run, f"`{key}` {dict(payloads.dtypes)[key]}, codec string, level int, original long, compressed long, compress_s double, decompress_s double, round_trip boolean")


def copies(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Each different payload with the number of its copies, for matrix with "copies" as its key: equal payloads are measured once."""
    return payloads.groupBy(column).agg(F.count("*").alias("copies"))


def matrix_points(measured: DataFrame, weight: str | None = None) -> DataFrame:
    """One point for each codec and level over all payloads: rates in MB/s, ratio, savings.  A row counts as often as its weight says."""
    total = lambda c: F.sum(F.col(c) * F.col(weight) if weight else F.col(c))
    out = measured.groupBy("codec", "level").agg(total("original").alias("original"), total("compressed").alias("compressed"), total("compress_s").alias("cs"), total("decompress_s").alias("ds"), F.bool_and("round_trip").alias("round_trip"))
    rate = lambda s: F.try_divide(F.col("original") / 1e6, F.col(s))
    return out.select("codec", "level", "original", "compressed", "round_trip", (F.col("compressed") / F.col("original")).alias("ratio"), paths.savings(F.col("original"), F.col("compressed")).alias("savings_pct"), rate("cs").alias("compress_mbs"), rate("ds").alias("decompress_mbs"))
