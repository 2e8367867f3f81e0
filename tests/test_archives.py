import bz2
import gzip
import io
import lzma
import struct
import tarfile
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalog.operators import security, volumes
from stratalog.sources import archives, containers, reports
from stratalog.streaming import ingest

FILES = [("docs/readme.txt", b"hello " * 50, 1_600_000_000), ("src/é.py", b"print()", 1_600_000_002), ("empty/", b"", 1_600_000_004)]


def broken_zip():
    return containers.pack_zip(FILES)[:-22]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("archives")
    (where / "a.zip").write_bytes(containers.pack_zip(FILES))
    (where / "b.tar").write_bytes(containers.pack_tar(FILES))
    (where / "c.tar.xz").write_bytes(containers.pack_tar(FILES, "xz"))
    (where / "broken.zip").write_bytes(broken_zip())
    (where / "notes.txt").write_bytes(b"nothing")
    (where / ".hidden").write_bytes(b"x")
    (where / "sub").mkdir()
    (where / "sub" / "._junk").write_bytes(b"x")
    (where / "sub" / "d.txt").write_bytes(b"x")
    return str(where)


def test_entries_of_all_containers(spark, folder):
    rows = archives.entries(archives.files(spark, folder), with_payload=True).collect()
    good = [r for r in rows if r.error is None]
    assert {r.archive_id.rsplit("/", 1)[1] for r in good} == {"a.zip", "b.tar", "c.tar.xz"} and len(good) == 9
    for r in good:
        wanted = {p: (b, m) for p, b, m in FILES}[r.path]
        assert r.uncompressed_size == len(wanted[0]) and r.mtime_epoch == wanted[1] and r.is_directory == r.path.endswith("/")
        assert r.is_directory or bytes(r.payload) == wanted[0]
    assert {r.path for r in rows if r.error} == {None}
    assert {r.ext for r in good} == {"txt", "py", ""}


def test_integrity_and_risk(spark, folder):
    entries = archives.entries(archives.files(spark, folder, "a.zip"), with_payload=True)
    assert security.integrity(entries).first().status == "PASSED"
    assert security.integrity(entries.withColumn("crc32", F.col("crc32") + 1)).first().status == "CORRUPTED"
    assert security.integrity(entries.drop("payload").withColumn("payload", F.lit(None).cast("binary"))).first().status == "UNVERIFIED"
    assert security.risk(entries).first().level == "SAFE"
    bad = spark.createDataFrame([("x/../../y", 1, 1), ("big", 2_000_000, 10), ("run.EXE", 1, 1), ("run.EXE", 1, 1)], "path string, uncompressed_size long, compressed_size long")
    r = security.risk(bad).first()
    assert (r.level, r.n_traversal, r.n_bombs, r.n_suspicious) == ("CRITICAL", 1, 1, 3)
    assert security.risk(bad.where("path = 'big'")).first().level == "WARNING"
    assert security.risk(bad.where("path = 'big'").withColumn("path", F.lit("a:b")), strict=True).first().level == "CRITICAL"


def test_layouts(spark):
    rows = spark.createDataFrame([("one", "a/b"), ("one", "a/c"), ("one", "__MACOSX/x"), ("two", "a"), ("two", "./b/c"), ("none", ".DS_Store"), ("none", "/")], "g string, path string")
    assert {r.g: (r.n_roots, r.mode, r.single_root) for r in security.root_layout(rows, "g").collect()} == {"one": (1, "direct", "a"), "two": (2, "wrap", None), "none": (0, "empty", None)}


def test_salvage():
    found = list(containers.salvage_zip(broken_zip(), with_payload=True))
    assert [(r["path"], r["payload"]) for r in found] == [(p, b) for p, b, _ in FILES]
    cut = containers.pack_zip(FILES)[:60]
    assert [r["path"] for r in containers.salvage_zip(cut)] == ["docs/readme.txt"]
    tar = containers.pack_tar([("a", b"x" * 700, 1), ("b", b"y", 2)])
    assert [r["path"] for r in containers.salvage_tar(b"\1" * 512 + tar)] == ["a", "b"]
    assert list(containers.salvage_zip(b"")) == list(containers.salvage_tar(b"")) == []


def test_extra_fields():
    raw = struct.pack("<HHBI", 0x5455, 5, 1, 77) + struct.pack("<HHBBHBH", 0x7875, 7, 1, 2, 500, 2, 20) + struct.pack("<HHHHBH", 0x9901, 7, 2, 0, 3, 8) + struct.pack("<HHQ", 1, 8, 1 << 40) + struct.pack("<HHBI", 0x7075, 7, 1, 0) + b"xy"
    assert containers.extra_fields(raw) == {"mtime": "77", "uid": "500", "gid": "20", "aes_strength": "3", "aes_method": "8", "zip64": str(1 << 40), "unicode_path": "xy"}
    assert containers.extra_fields(b"\1\0\xff\xff") == {}


def test_long_names_and_links_in_tar():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as tar:
        tar.addfile(tarfile.TarInfo("d/" * 80 + "x"))
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "target"
        tar.addfile(link)
    rows = list(containers.tar_entries(out.getvalue()))
    assert rows[0]["path"] == "d/" * 80 + "x" and rows[1]["link_target"] == "target"


def test_compliance(spark, folder):
    found = {(r.archive_id.rsplit("/", 1)[1], r.severity, r.section) for r in archives.compliance(archives.files(spark, folder, "*.{zip,tar,xz}")).collect()}
    assert found == {("broken.zip", "ERROR", "end record")}
    bad = bytearray(containers.pack_tar(FILES))
    bad[0] ^= 1
    assert containers.issues(bytes(bad), "tar")[0][1] == "header" and containers.issues(b"x", "tar")[0][0] == "ERROR"
    wrong = bytearray(containers.pack_zip(FILES))
    wrong[0:4] = b"XXXX"
    assert ("WARNING", "local header") in {i[:2] for i in containers.issues(bytes(wrong), "zip")}
    assert containers.issues(b"\x1f\x8b\x09" + bytes(20), "gzip")[0][0] == "ERROR" and containers.issues(b"BZh0", "bzip2") and containers.issues(b"\xfd7zXZ\0", "xz")
    assert containers.issues(b"!<arch>\n" + b"x/".ljust(48) + b"2".ljust(10) + b"`\nab", "ar") == [] and containers.issues(b"!<arch>\nshort", "ar")
    assert containers.issues(b"\x04\x22\x4d\x18\x64", "lz4") == [] and containers.issues(b"\x04\x22\x4d\x18\x24", "lz4") and containers.issues(b"LZIP\1\x0c", "lzip") == []
    for kind in containers._HEADERS:
        assert all(i[0] in ("ERROR", "WARNING") for i in containers.issues(b"", kind))
    assert containers.issues(b"x", "nothing")[0][1] == "format"
    rows = spark.createDataFrame([("a", "ERROR"), ("a", "WARNING")], "id string, severity string")
    r = security.issue_summary(rows, "id").first()
    assert (r.n_errors, r.n_warnings, r.is_compliant) == (1, 1, False)


def test_walk(spark, folder):
    names = lambda **o: {r.rel_path for r in archives.walk(spark, folder, **o).collect()}
    assert names() == {"a.zip", "b.tar", "c.tar.xz", "broken.zip", "notes.txt", "sub/d.txt"}
    assert names(max_depth=1) == names() - {"sub/d.txt"} and "sub/._junk" in names(hidden=True, junk=True) | {"sub/._junk"}


def test_data_source_pushes_filters(spark, folder):
    archives.register(spark)
    table = spark.read.format("archive").load(f"{folder}/*.zip")
    assert table.where("error is null").count() == 3
    assert [r.path for r in table.where("ext = 'py' and path like 'src/%'").select("path").collect()] == ["src/é.py"]


def test_pack_by_group(spark):
    rows = spark.createDataFrame([("g1", "b", b"2", 5), ("g1", "a", b"1", None), ("g2", "c", b"3", 5)], "g string, path string, payload binary, mtime_epoch long")
    for container in ("zip", "tar", "tar.gz"):
        packed = {r.g: bytes(r.content) for r in archives.pack(rows, "g", container).collect()}
        assert [e["path"] for e in containers.entries(packed["g1"])[1]] == ["a", "b"] and len(packed) == 2
    assert zipfile.ZipFile(io.BytesIO(containers.pack_zip([("x", b"", 0)], 0))).testzip() is None


def test_volumes(spark):
    names = [("d/a.zip.001", 5), ("d/a.zip.002", 5), ("d/a.zip.004", 5), ("d/b.z01", 1), ("d/b.zip", 2), ("d/c.zip", 3), ("d/e.part1.rar", 1), ("d/e.part2.rar", 1), ("d/f.000", 1), ("d/f.001", 1), ("d/g.part2.rar", 1), ("plain", 1)]
    rows = volumes.chains(spark.createDataFrame(names, "path string, size long")).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.chain, r.volume)):
        by.setdefault(r.chain, []).append((r.path.rsplit("/", 1)[-1], r.position))
    assert by["d/a.zip"] == [("a.zip.001", 0), ("a.zip.002", 5)] and by["d/a.zip.004"] == [("a.zip.004", 0)]
    assert by["d/b.z*"] == [("b.z01", 0), ("b.zip", 1)] and by["d/c.zip"] == [("c.zip", 0)]
    assert [n for n, _ in by["d/e.part*.rar"]] == ["e.part1.rar", "e.part2.rar"] and [n for n, _ in by["d/f"]] == ["f.000", "f.001"]
    assert by["d/g.part2.rar"] and by["plain"] and sum(map(len, by.values())) == len(names)


def test_split_and_join_again(spark):
    data = bytes(range(256)) * 10
    plan = volumes.split_plan(spark.createDataFrame([("x.7z", len(data)), ("none.zip", 0)], "name string, size long"), 1000)
    parts = [(r.path, data[r.start : r.start + r.length], r.volume) for r in plan.where("name = 'x.7z'").collect()]
    assert [p for p, _, _ in sorted(parts)] == ["x.7z.001", "x.7z.002", "x.7z.003"] and plan.where("name = 'none.zip'").first().length == 0
    files = spark.createDataFrame([(p, b, len(b)) for p, b, _ in parts], "path string, content binary, size long")
    assert bytes(archives.join_volumes(files, volumes.chains(files.select("path", "size"))).first().content) == data
    names = lambda naming: [r.path for r in volumes.split_plan(spark.createDataFrame([("x.zip", 25)], "name string, size long"), 10, naming).orderBy("volume").collect()]
    assert names("spanned") == ["x.z01", "x.z02", "x.zip"] and names("part") == ["x.part1.zip", "x.part2.zip", "x.part3.zip"]


def test_arriving_archives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.zip").write_bytes(containers.pack_zip(FILES))
    go = lambda: ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), "*.zip").awaitTermination(120)
    go()
    (tmp_path / "in" / "b.zip").write_bytes(containers.pack_zip(FILES[:1]))
    go()
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_log_of_runs(spark):
    log = ingest.run_row(spark, "1", "create", ["a"], True, 1.0, "2024-01-01").union(ingest.run_row(spark, "2", "delete", ["b"], True, 1.0, "2024-01-02")).union(ingest.run_row(spark, "3", "undo", [], True, 0.1, "2024-01-03", {"run_id": "2"}))
    assert [r.run_id for r in ingest.undone(log).collect()] == ["1"]


def test_reports(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"format":"zip","dimensionName":"small","level":1,"isEncrypted":false,"toolCompressMBs":10.5}]')
    (tmp_path / "m.json").write_text('{"zip|small|1|true":[1.0,2.0]}')
    assert reports.benchmark_json(spark, str(tmp_path / "r.json"), own="tool").first().ownCompressMBs == 10.5
    row = reports.benchmark_json(spark, str(tmp_path / "m.json")).first()
    assert (row.format, row.level, row.isEncrypted, row.ownExtractMBs) == ("zip", 1, True, 2.0)
    lines = spark.createDataFrame([("crc: 12.5 MB/s",), ("sort ... 3.25 ms",), ("sniff: 4.5 M ops/s",), ("bla",)], "value string")
    assert sorted((r.metric, r.unit, r.number) for r in reports.log_metrics(lines).collect()) == [("crc", "mb_s", 12.5), ("sniff", "mops_s", 4.5), ("sort", "ms", 3.25)]
    table = spark.createDataFrame([("a|b", 1.5, 2.0, True), ("<c>", None, 1.0, False)], "codec string, x double, y double, is_optimal boolean")
    assert "a\\|b" in reports.markdown(table) and "&lt;c&gt;" in reports.as_html(table, "T") and reports.svg(table.fillna(0.0)).count("<circle") == 2
    assert reports.svg(table.where("false")).startswith("<svg") and "█" in reports.bars(table.fillna(0.0), "codec", "x")
    diff_rows = spark.createDataFrame([("p", None)], "path string, status string")
    assert reports.as_json(diff_rows, "diff").first()[0] == '{"path":"p","status":null}'
    assert reports.corpus(spark, "noise", 2).where("length(payload) = 2048").count() == 2 and reports.corpus(spark, "xml", 1).first().payload[:7] == b"<items>"


def test_compressed_streams(spark):
    codecs = {c: pa.Codec(c) for c in ("brotli", "zstd", "snappy")}
    plain, tar = b"hello " * 20_000, containers.pack_tar(FILES)

    def snappy(data):
        out = containers.SNAPPY_MAGIC
        for at in range(0, len(data), 65_536):
            body = containers._masked_crc32c(data[at : at + 65_536]).to_bytes(4, "little") + codecs["snappy"].compress(data[at : at + 65_536], asbytes=True)
            out += b"\0" + len(body).to_bytes(3, "little") + body
        return out

    pack = {"br": lambda b: codecs["brotli"].compress(b, asbytes=True), "zst": lambda b: codecs["zstd"].compress(b, asbytes=True), "sz": snappy, "gz": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress}
    assert containers._masked_crc32c(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF
    rows = [(f"/in/{what}.{e}", f(data)) for e, f in pack.items() for what, data in (("notes.txt", plain), ("all.tar", tar))]
    rows += [(f"/in/cut.{e}", f(plain)[:-9]) for e, f in pack.items()]
    found = archives.entries(spark.createDataFrame(rows, "path string, content binary"), with_payload=True).collect()
    for e in pack:
        (one,) = [r for r in found if r.archive_id == f"/in/notes.txt.{e}"]
        assert (one.path, one.uncompressed_size, bytes(one.payload), one.error) == ("notes.txt", len(plain), plain, None), e
        assert [(r.path, r.error) for r in found if r.archive_id == f"/in/all.tar.{e}"] == [(p, None) for p, _, _ in FILES], e
        assert [r.path for r in found if r.archive_id == f"/in/cut.{e}" and r.error] == [None], e
