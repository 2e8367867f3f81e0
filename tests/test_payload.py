import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.functions import payload, signatures
from stratalog.operators import audit


def lcg(n, state=0x853C49E6748FEA9B):
    out = bytearray()
    for _ in range(n):
        state = (state * 6364136223846793005 + 1) & (1 << 64) - 1
        out.append(state >> 56)
    return bytes(out)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(0, b""), (1, bytes(1024)), (2, bytes(range(256)) * 100), (3, b"123456789"), (4, None), (5, b"hello " * 2000), (6, lcg(1 << 20))]
    return spark.createDataFrame(data, "k long, payload binary")


def test_checksums(rows):
    found = {r.k: r.d for r in rows.select("k", payload.digests(F.col("payload")).alias("d")).collect()}
    assert found[3].crc64 == "13288015728624077471" and found[3].crc32 == zlib.crc32(b"123456789") and found[3].adler32 == zlib.adler32(b"123456789")
    assert found[5].sha256 == hashlib.sha256(b"hello " * 2000).hexdigest() and found[4].crc64 is None and found[0].adler32 == 1


def test_checksums_in_step():
    rng = random.Random(2)
    data = [rng.randbytes(n) for n in (0, 1, 255, 256, 257, 1000, 5120)]
    assert payload.crc64_all(data) == [payload._crc64_step((1 << 64) - 1, d) ^ (1 << 64) - 1 for d in data]


def test_checksums_combine():
    rng = random.Random(1)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(300)), rng.randbytes(rng.randrange(300))
        assert payload.combine_crc32(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_entropies(rows):
    found = {r.k: r for r in rows.select("k", payload.entropy("payload").alias("e"), payload.sampled_entropy()("payload").alias("s"), payload.bypass_compression(F.col("payload")).alias("b"), payload.byte_histogram("payload").alias("h")).collect()}
    assert found[0].e == 0 and found[1].e == 0 and found[2].e == 8.0 and found[6].e > 7.9 and found[5].e < 5 and found[4].e is None
    assert found[6].b and not found[5].b and found[6].s > 7.9
    assert sum(found[2].h) == 25_600 and len(found[2].h) == 256


def test_recommendations(rows):
    def of(kind):
        return {r.k: (r.algorithm, r.level) for r in audit.recommendations(rows.where("payload is not null"), "k", F.lit(kind)).collect()}

    assert of("instant")[5] == ("zstd", 1) and of("balanced")[5] == ("zstd", 3) and of("cold")[5] == ("lzma2", 9)
    assert of("balanced")[6] == of("instant")[6] == ("store", 0)
    assert payload.trial_ratio_of(b"") == 1.0 and payload.trial_ratio_of(b"a" * 100, pad=True) < payload.trial_ratio_of(b"a" * 100)


def test_scenarios(spark):
    texts = ["AirDrop", "my LAN", "Cold", "MAX please", "daily"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(payload.scenario(F.col("t"))).collect()
    assert [r[0] for r in found] == ["instant", "instant", "cold", "cold", "balanced"]


def test_charsets():
    assert payload.charset_of(b"plain") == "ascii" and payload.charset_of("é".encode()) == "utf-8"
    assert payload.charset_of("\ufeffx".encode("utf-16")) == "utf-16" and payload.charset_of(b"\xef\xbb\xbfx") == "utf-8-sig"
    assert payload.charset_of("日本語テキストのファイル名です".encode("shift_jis")) == "shift_jis"
    assert payload.charset_of("这是一个中文文件名称测试".encode("gb18030")) == "gb18030"
    assert payload.charset_of(b"\xff\x00\x81") == "latin-1"


PATHS = [
    ("a/./b/../c", "a/c", {}),
    ("../x", "x", {"traversal"}),
    ("C:\\dir\\x", "C:/dir/x", {"absolute"}),
    ("C:/..", "C:", {"absolute", "traversal"}),
    ("//srv/share", "srv/share", {"absolute", "unc"}),
    ("a/con.txt", "a/con.txt", {"device"}),
    ("a/b:stream", "a/b", {"stream"}),
    ("e\u0301", "é", {}),
    ("x" * 261, "x" * 261, {"long"}),
    ("a\0b", "a\0b", {"traversal"}),
    ("", "", {}),
]


def test_sanitizing(spark):
    found = spark.createDataFrame([(p,) for p, _, _ in PATHS] + [(None,)], "p string").select(payload.sanitize("p").alias("s")).select("s.*").collect()
    for r, (raw, clean, flags) in zip(found, PATHS, strict=False):
        assert r.path == clean and {k for k in ("traversal", "absolute", "unc", "device", "long") if r[k]} | ({"stream"} if r.stream else set()) == set(flags), raw
    assert found[-1].path is None


def test_differences(spark):
    rows = spark.createDataFrame([(b"abc", b"abd"), (b"x", b"x"), (b"ab", b"abc"), (None, b"")], "a binary, b binary")
    found = [r.d for r in rows.select(payload.hex_diff("a", "b").alias("d")).collect()]
    assert [f.offset for f in found] == [2, None, 2, None] and "63" in found[0].diff and found[1].diff is None


def test_signatures(spark):
    tar = bytearray(600)
    tar[257:263] = b"ustar\0"
    dmg = bytearray(600)
    dmg[-512:-508] = b"koly"
    cases = [(b"7z\xbc\xaf\x27\x1c", "7z"), (b"PK\x03\x04", "zip"), (b"\x1f\x8b", "gzip"), (b"BZh9", "bzip2"), (bytes(tar), "tar"), (bytes(dmg), "dmg"), (b"Rar!\x1a\x07\x00", "rar"), (b"", "unknown"), (None, "unknown"), (b"plain text", "unknown")]
    cases += [(b"junk" * 10 + b"PK\x05\x06" + bytes(18), "zip"), (b"MZ" + bytes(100) + b"Rar!\x1a\x07", "rar"), (b"MSWIM\0\0\0", "unknown"), (b"\x00\x01-lh5-" + bytes(20), "lzh")]
    found = spark.createDataFrame([(c, "a.tar.gz") for c, _ in cases], "c binary, n string").select(signatures.sniff(F.col("c"), F.col("n")).alias("s")).collect()
    assert [r.s.format for r in found] == [f for _, f in cases]
    assert found[2].s.compound == "tar.gzip" and found[11].s.embedded_at == 102 and found[11].s.confidence == 95


def test_embedded_archives_anywhere(spark):
    """Behind stubs of any length, at the borders of the pieces that are searched, among bytes of any value; the first place counts."""
    kinds = {"zip": b"PK\x03\x04", "7z": b"7z\xbc\xaf\x27\x1c", "rar": b"Rar!\x1a\x07"}
    places = [64, 65, 65_000, *range(65_530, 65_540), *range(65_594, 65_604), 131_135, 1_000_003]
    stub = b"MZ" + bytes(range(255, 127, -1)) * 8000
    cases = [(kind, at, stub[:at] + magic + stub[:100] + magic) for kind, magic in kinds.items() for at in places]
    cases += [("zip", 200_000, stub[:100_000] + kinds["rar"] + stub[: 99_994] + kinds["zip"]), ("unknown", None, stub), ("unknown", None, b"MZ" + kinds["zip"] + bytes(100)), ("unknown", None, b"MZ"), ("unknown", None, b"mz" + stub + kinds["7z"])]
    found = spark.createDataFrame([(n, c) for n, (_, _, c) in enumerate(cases)], "n int, c binary").select("n", signatures.sniff(F.col("c")).alias("s")).collect()
    assert {r.n: (r.s.format, r.s.embedded_at) for r in found} == {n: (kind, at) for n, (kind, at, _) in enumerate(cases)}


def test_segments_and_divergence(spark, rows):
    pieces = audit.segments(rows.where("k in (2, 5, 6)"), "k", size=4096)
    got = {r.k: r for r in audit.segment_summary(pieces, "k").collect()}
    assert got[2].n_segments == 7 and got[5].n_compressible == 3 and got[6].n_compressible == 0
    pair = spark.createDataFrame([("a", b"xxxx"), ("a", None), ("b", b"xxyy"), ("c", b"zz")], "g string, payload binary")
    counts = audit.byte_counts(pair, "g")
    assert audit.divergence(counts, "g", "a", "b").first()[0] == 0.5 and audit.divergence(counts, "g", "a", "c").first()[0] == 1.0 and audit.divergence(counts, "g", "a", "a").first()[0] is not None


def test_t_tail():
    # exact: one degree of freedom is Cauchy, two have a closed form
    for t in (0.0, 0.3, 2.0, 15.0):
        assert abs(payload.t_tail(t, 1) - (1 - 2 * np.arctan(t) / np.pi)) < 1e-9
        assert abs(payload.t_tail(t, 2) - (1 - t / np.sqrt(2 + t * t))) < 1e-9
    assert abs(payload.t_tail(1.959963985, 1e7) - 0.05) < 1e-6 and payload.t_tail(5, 0) == 1.0


def test_checksums_of_chunks_add_up(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.randbytes(rng.choice([0, 1, 7, 1000]))) for k in range(20) for i in range(rng.randint(1, 9))]
    chunks = spark.createDataFrame([(k, i, zlib.crc32(b), len(b)) for k, i, b in rows], "id long, i int, crc32 long, size long")
    wanted = {k: zlib.crc32(b"".join(b for x, _, b in rows if x == k)) for k in range(20)}
    assert {r.id: r.crc32 for r in payload.combined_crc32(chunks, "id", "i").collect()} == wanted
    assert payload.combine_crc32(zlib.crc32(b"a" * 3), zlib.crc32(bytes(1 << 20)), 1 << 20) == zlib.crc32(b"aaa" + bytes(1 << 20))


def test_entropies_of_many_payloads():
    rng = random.Random(5)
    rows = [b"", b"\0" * 1024, bytes(range(256)) * 100, rng.randbytes(5_000_000), b"ab"] + [rng.randbytes(rng.randint(0, 300)) for _ in range(500)]
    assert np.allclose(payload.entropies_of(rows), [payload.entropy_of(payload.byte_counts(b)) for b in rows])
    assert payload.entropies_of([]).tolist() == []
