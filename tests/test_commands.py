import zlib

import pytest
from pyspark.sql import functions as F

from stratalog.functions import payload
from stratalog.plans import commands
from stratalog.sources import containers

FILES = [("a/x.txt", b"hello " * 40, 10**9), ("a/y.rs", b"fn main", 10**9), ("../evil", b"no", 10**9)]


@pytest.fixture(scope="module")
def where(tmp_path_factory):
    at = tmp_path_factory.mktemp("commands")
    (at / "one.zip").write_bytes(containers.pack_zip(FILES))
    (at / "two.tar").write_bytes(containers.pack_tar([FILES[0], ("a/y.rs", b"fn mane", 10**9), ("new", b"1", 10**9)]))
    (at / "bad.zip").write_bytes(containers.pack_zip(FILES)[:-22])
    return at


def test_reading_commands(spark, where):
    assert [r.path for r in commands.list_(spark, f"{where}/one.zip", "ext:rs").collect()] == ["a/y.rs"]
    assert commands.info(spark, f"{where}/one.zip").first().n_entries == 3
    assert [r.path for r in commands.show_tree(spark, f"{where}/two.tar", 1).collect()] == ["a", "new"]
    assert [(r.path, r.status) for r in commands.compare(spark, f"{where}/one.zip", f"{where}/two.tar").collect()] == [("a/y.rs", "modified"), ("../evil", "only_a"), ("new", "only_b")]
    assert commands.hashes(spark, f"{where}/one.zip").first().crc32 == zlib.crc32((where / "one.zip").read_bytes())
    assert {r.archive_id.rsplit("/", 1)[1]: r.status for r in commands.check(spark, str(where)).collect()} == {"one.zip": "PASSED", "two.tar": "PASSED", "bad.zip": "CORRUPTED"}
    assert bytes(commands.cat(spark, f"{where}/one.zip", "/a/y.rs").first().payload) == b"fn main"
    assert {r.path: r.reason for r in commands.extract(spark, f"{where}/one.zip").collect()} == {"a/x.txt": None, "a/y.rs": None, "../evil": "unsafe path"}
    assert commands.repair(spark, f"{where}/bad.zip").count() == 3


def test_writing_commands(spark, where, tmp_path):
    parts = commands.split(spark, f"{where}/one.zip", 100).collect()
    assert b"".join(bytes(r.bytes) for r in sorted(parts, key=lambda r: r.volume)) == (where / "one.zip").read_bytes()
    for r in parts:
        (tmp_path / r.path).write_bytes(r.bytes)
    assert bytes(commands.join(spark, str(tmp_path)).first().content) == (where / "one.zip").read_bytes()
    made = commands.convert(spark, f"{where}/one.zip", "tar.xz").first()
    assert [r["path"] for r in containers.entries(bytes(made.content))[1]] == sorted(p for p, _, _ in FILES)
    rows = spark.createDataFrame([("a.txt", 1, 5, 7), ("b.rs", 2, 5, 7)], "path string, uncompressed_size long, mtime_epoch long, crc32 long")
    assert [r.path for r in commands.delete(rows, "ext:rs").collect()] == ["a.txt"]
    changed = rows.withColumn("crc32", F.when(F.col("path") == "b.rs", 8).otherwise(F.col("crc32"))).union(spark.createDataFrame([("c", 1, 1, 1)], rows.schema))
    assert sorted((r.path, r.crc32) for r in commands.update(rows, changed).collect()) == [("a.txt", 7), ("b.rs", 8), ("c", 1)]


def test_bench_and_batches(spark):
    rows = spark.createDataFrame([(1, b"text " * 500)], "k long, payload binary")
    assert {r.codec for r in commands.bench_matrix(rows, "k", [("deflate", 1), ("zstd", 3)]).collect()} == {"deflate-1", "zstd-3"}
    out = {r.task: r for r in commands.batch(spark, {"good": lambda: rows, "bad": lambda: rows.selectExpr("raise_error('x')"), "worse": lambda: rows.select("nope")}, tag="batch").collect()}
    assert out["good"].n_rows == 1 and not out["worse"].success and "nope" in out["worse"].error
    assert commands.cancel(spark, "no-such-tag") == []


def test_functions_in_sql(spark):
    payload.register(spark)
    row = spark.sql("select crc64(cast('123456789' as binary)) c, entropy(cast('aaaa' as binary)) e, sanitize('a/../b').path p").first()
    assert tuple(row) == ("13288015728624077471", 0.0, "b")
