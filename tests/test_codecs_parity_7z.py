import lzma
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.functions import parity
from stratalog.operators import bench, codecs
from stratalog.sources import archives, containers, sevenz

FILES = [("a/é.txt", b"hello " * 100), ("b.bin", bytes(range(256)) + b"\xe8\x10\x20\0\0" * 30), ("empty", b""), ("d", None)]


def number(n):
    for extra in range(9):
        if n < 1 << 7 * (extra + 1) or extra == 8:
            head = 0xFF << 8 - extra & 0xFF | (n >> 8 * extra if extra < 8 else 0)
            return bytes([head]) + (n & (1 << 8 * extra) - 1).to_bytes(extra, "little")


def write_7z(files, packed_header=False, method="lzma2"):
    """A 7z file with one folder: the counterpart of the reader, for these tests."""
    chain = [{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}]
    full = [(n, b) for n, b in files if b]
    plain = b"".join(b for _, b in full)
    filters = {"x86+lzma2": {"id": lzma.FILTER_X86}, "delta+lzma2": {"id": lzma.FILTER_DELTA, "dist": 3}}
    body = plain if method == "copy" else lzma.compress(plain, lzma.FORMAT_RAW, filters=[*([filters[method]] if method in filters else []), *chain])
    coder = b"\x21\x21\x01\x10" if method != "copy" else b"\x01\x00"
    # two coders: the filter's input is what the second gives
    first = {"x86+lzma2": b"\x04\x03\x03\x01\x03", "delta+lzma2": b"\x21\x03\x01\x02"}.get(method)
    coders = number(1) + coder if first is None else number(2) + first + coder + number(0) + number(1)
    sizes = number(len(plain)) * (1 if first is None else 2)
    streams = b"\x04\x06" + number(0) + number(1) + b"\x09" + number(len(body)) + b"\x00\x07\x0b" + number(1) + b"\x00" + coders + b"\x0c" + sizes + b"\x00"
    streams += b"\x08\x0d" + number(len(full)) + b"\x09" + b"".join(number(len(b)) for _, b in full[:-1]) + b"\x0a\x01" + b"".join(struct.pack("<I", zlib.crc32(b)) for _, b in full) + b"\x00\x00"
    bits = lambda flags: bytes(sum(f << 7 - i % 8 for i, f in enumerate(flags[k : k + 8])) for k in range(0, len(flags), 8))
    prop = lambda kind, raw: bytes([kind]) + number(len(raw)) + raw
    without = [not b for _, b in files]
    listing = b"\x05" + number(len(files)) + prop(14, bits(without)) + prop(15, bits([b is not None for _, b in files if not b]))
    listing += prop(17, b"\0" + "".join(n + "\0" for n, _ in files).encode("utf-16-le")) + prop(20, b"\x01\0" + struct.pack("<Q", 116_444_736_000_000_000 + 10_000_000 * 1_600_000_000) * len(files)) + b"\x00"
    header = b"\x01" + streams + listing + b"\x00"
    if packed_header:
        raw = lzma.compress(header, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16, "lc": 3, "lp": 0, "pb": 2}])
        outer = b"\x17\x06" + number(len(body)) + number(1) + b"\x09" + number(len(raw)) + b"\x00\x07\x0b" + number(1) + b"\x00" + number(1) + b"\x23\x03\x01\x01\x05\x5d" + struct.pack("<I", 1 << 16) + b"\x0c" + number(len(header)) + b"\x00\x00"
        body, header = body + raw, outer
    start = struct.pack("<QQI", len(body), len(header), zlib.crc32(header))
    return sevenz.MAGIC + b"\0\x04" + struct.pack("<I", zlib.crc32(start)) + start + body + header


@pytest.mark.parametrize("packed_header", [False, True])
@pytest.mark.parametrize("method", ["lzma2", "copy", "x86+lzma2", "delta+lzma2"])
def test_7z_entries(packed_header, method):
    data = write_7z(FILES, packed_header, method)
    rows = list(sevenz.entries(data, with_payload=True))
    assert [(r["path"], r["payload"]) for r in rows] == [(n + "/" * (b is None), b) for n, b in FILES]
    assert rows[0]["crc32"] == zlib.crc32(FILES[0][1]) and rows[1]["extra"] == {"folder": "0", "offset": "600"} and rows[0]["mtime_epoch"] == 1_600_000_000
    assert rows[0]["method"] == method and containers.issues(data, "7z") == []


def test_7z_in_a_table(spark):
    broken = bytearray(write_7z(FILES))
    broken[-1] ^= 1
    rows = archives.entries(spark.createDataFrame([("good", write_7z(FILES)), ("bad", bytes(broken))], "path string, content binary")).collect()
    assert sum(r.error is None for r in rows) == 4 and [r.archive_id for r in rows if r.error] == ["bad"]


def mutated(data, rng):
    """One of ten kinds of damage."""
    out, n = bytearray(data), len(data)
    kind = rng.randrange(10)
    at = rng.randrange(n)
    if kind == 0:
        out[at] ^= 1 << rng.randrange(8)
    elif kind == 1:
        out[at] = rng.choice([0, 255])
    elif kind == 2:
        out[:4] = bytes(b ^ 255 for b in out[:4])
    elif kind == 3:
        out[14:18] = bytes(b ^ 255 for b in out[14:18])
    elif kind == 4:
        del out[at:]
    elif kind == 5:
        out[30:30] = b"../../../etc/passwd\0"
    elif kind == 6:
        out[26:30] = b"\xff\xff\xff\xff"
    elif kind == 7:
        out[at : at + 1] = b"\xff"
    elif kind == 8:
        m = rng.randrange(n)
        out[at : at + 16], out[m : m + 16] = out[m : m + 16], out[at : at + 16]
    else:
        out[at : at + 32] = bytes(len(out[at : at + 32]))
    return bytes(out)


def test_damage_never_raises():
    rng = random.Random(8)
    rows = [(n, b or b"", 1_600_000_000) for n, b in FILES[:3]]
    whole = [containers.pack_zip(rows), containers.pack_tar(rows), write_7z(FILES), write_7z(FILES, True)]
    for _ in range(1500):
        data = mutated(rng.choice(whole), rng)
        kind, found, error = containers.entries(data, with_payload=True)
        assert error is None or isinstance(error, str)
        list(containers.salvage_zip(data, True)), list(containers.salvage_tar(data))
        containers.issues(data, kind)


def test_field():
    a = np.arange(1, 256, dtype=np.uint8)
    assert (parity.times(a, parity.inverse(a)) == 1).all() and parity.times(np.array([0x80]), np.array([2]))[0] == 0x1D
    assert (parity.times(a, parity.times(a[::-1], a)) == parity.times(parity.times(a, a[::-1]), a)).all()


def test_any_lost_slices_come_back():
    rng = random.Random(5)
    for k, m in ((1, 1), (4, 2), (16, 5), (200, 56)):
        data = rng.randbytes(rng.choice([k, 1000, 7]))
        parts, sums = parity.protect(data, k, m)
        size = parts.shape[1]
        lost = rng.sample(range(k + m), min(m, k))
        hurt, kept = bytearray(data.ljust(k * size, b"\0")), parts.copy()
        for s in lost:
            if s < k:
                hurt[s * size : (s + 1) * size] = bytes(b ^ 0x5A for b in hurt[s * size : (s + 1) * size])
            else:
                kept[s - k] ^= 1
        fixed = parity.repair(bytes(hurt[: len(data)]), len(data), k, kept, sums)
        # zeros that fill the last slice up are known, so damage there does not count
        assert fixed == data
    parts, sums = parity.protect(b"x" * 100, 10, 1)
    assert parity.repair(b"y" * 100, 100, 10, parts, sums) is None
    with pytest.raises(ValueError):
        parity.cauchy(200, 100)


def test_recovery_records(spark):
    rows = spark.createDataFrame([(1, b"a" * 1000), (2, b""), (3, None)], "k long, payload binary")
    records = parity.recovery_records(rows, "k")
    hurt = spark.createDataFrame([(1, b"a" * 500 + b"b" * 50 + b"a" * 450), (2, b"")], "k long, payload binary")
    assert {r.k: bytes(r.payload) for r in parity.repaired(hurt, records, "k").collect()} == {1: b"a" * 1000, 2: b""}


def test_streams_that_levels_share():
    """What is not made again is what the level would have made, also where bzip2's blocks end and LZMA's dictionaries differ."""
    rng = random.Random(5)
    runs = lambda n: b"".join(bytes([k % 251]) * 4 for k in range(n // 4 + 1))[:n]
    words = lambda n: b" ".join(rng.choice([b"strata", b"log", b"row", b"file"]) for _ in range(n))[:n]
    made = [rng.randbytes(1), words(5000), runs(5000), runs(79_950), runs(79_990), rng.randbytes(99_981), runs(160_000)]
    shared = [(name, level) for name, level in codecs.CONFIGS if name in ("bzip2", "lzma")]
    for payload in made:
        levels = shared if len(payload) < 10_000 else shared[:9]
        for order in (levels, levels[::-1]):
            for name, level, [(size, *_, same)] in codecs.measured(order, [payload]):
                there, back = codecs.codec(name, level)
                by = codecs.maker(name, level, len(payload))
                alike = codecs.codec(name, by)[0](payload)
                assert there(payload) == (b"BZh%d" % level + alike[4:] if name == "bzip2" else alike)
                assert same and size == len(alike) and by <= level
    assert {codecs.maker("lzma", n, 5 << 20) for n in (6, 7, 8, 9)} == {6} and [codecs.maker("lzma", n, 40 << 20) for n in (5, 6, 7, 8, 9)] == [5, 6, 7, 8, 9]
    # contexts that are used again make what new ones make
    texts = [rng.randbytes(300), words(20_000), b"a", words(7000), runs(30_000)]
    for name, level, found in codecs.measured([c for c in codecs.CONFIGS if c[0] == "zstd"], texts):
        assert [size for size, *_ in found] == [len(codecs.codec(name, level)[0](t)) for t in texts] and all(r[-1] for r in found)


def test_different_streams_are_read_back_once(monkeypatch):
    """LZMA's levels 6 to 9 make the same bytes of a short payload, bzip2's have different headers; what does not come back fails at each level that made it."""
    plain, read = codecs.codec, []

    def hurt(name, level):
        there, back = plain(name, level)
        return there, lambda b, n: (read.append((name, bytes(b))), back(b, n)[: 600 if name == "lzma" else None])[1]

    monkeypatch.setattr(codecs, "codec", hurt)
    payloads = [b"strata " * 80, b"a log of rows " * 50]
    found = {(name, level): [r[-1] for r in rows] for name, level, rows in codecs.measured([c for c in codecs.CONFIGS if c[0] in ("bzip2", "lzma")], payloads)}
    assert len(read) == 2 * 9 + 2 * 7 and sum(name == "bzip2" for name, _ in read) == 18 == len({r for r in read if r[0] == "bzip2"})
    assert found == {(name, level): [True, name == "bzip2"] for name, level in codecs.CONFIGS if name in ("bzip2", "lzma")}


def test_codec_matrix_sizes_its_tasks_before_copies_are_found(spark):
    """The number of tasks comes from a scan; the payloads are grouped once, when they are measured."""
    rows = spark.createDataFrame([(k, b"payload %d" % (k % 5)) for k in range(50)], "k long, payload binary")
    spark.sparkContext.setJobGroup("sizes", "")
    try:
        found = codecs.matrix(codecs.copies(rows), "copies", [("lz4", 1)], sized=rows)
    finally:
        spark.sparkContext.setJobGroup("", "")
    tracker = spark.sparkContext.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup("sizes") for s in tracker.getJobInfo(job).stageIds}
    assert 0 < len(stages) <= 3
    assert sorted((r.copies, r.original, r.round_trip) for r in found.collect()) == [(10, 9, True)] * 5


def test_codec_matrix_deals_payloads_out(spark):
    """Rows of one partition become several tasks, and Python gets each payload once."""
    rows = spark.range(300).select("id", F.repeat(F.lit("text "), 1000).cast("binary").alias("payload")).coalesce(1)
    found = codecs.matrix(rows, "id", [("lz4", 1), ("zstd", 1)])
    parts = [len(p) for p in found.rdd.glom().collect() if p]
    assert sum(parts) == 600 and len(parts) >= 8 and "Generate" not in found._jdf.queryExecution().toString()
    assert {(r.id, r.codec, r.original, r.round_trip) for r in found.collect()} == {(k, c, 5000, True) for k in range(300) for c in ("lz4", "zstd")}


def test_copies_count_in_the_codec_matrix(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([b"some text " * 30] * 7 + [b"other", None, b""])], "k long, payload binary")
    configs = [("lz4", 1), ("bzip2", 1), ("bzip2", 9), ("lzma", 9)]
    once = codecs.matrix(codecs.copies(rows), "copies", configs)
    assert once.count() == 8
    numbers = lambda points: {(r.codec, r.level, r.original, r.compressed, r.ratio, r.round_trip) for r in points.collect()}
    assert numbers(codecs.matrix_points(once, "copies")) == numbers(codecs.matrix_points(codecs.matrix(rows, "k", configs)))


def test_codec_matrix(spark):
    rows = spark.createDataFrame([(1, b"some text " * 300), (2, b""), (3, None)], "k long, payload binary")
    points = codecs.matrix_points(codecs.matrix(rows, "k"))
    found = points.collect()
    assert len(found) == len(codecs.CONFIGS) >= 50 and all(r.round_trip and r.ratio < 0.5 for r in found)
    front = bench.pareto(points.selectExpr("'all' suite", "concat(codec, level) codec", "savings_pct x", "compress_mbs y", "original", "compressed", "compress_mbs", "decompress_mbs"), "suite")
    assert bench.matrix_summary(front).first().passed
    with pytest.raises(ValueError):
        codecs.codec("none", 1)
