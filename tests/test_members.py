"""Containers written by hand, from their formats' rules, and read again."""

import bz2
import lzma
import struct
import zlib
from datetime import UTC, datetime

import pyarrow as pa
import pytest

from stratalog.sources import archives, containers, members

FILES = [("readme.txt", b"hello " * 50), ("a_long_name_of_more_than_sixteen.bin", bytes(range(255))), ("empty", b"")]


def write_ar(style):
    out, table = b"!<arch>\n", b""
    header = lambda name, size: name.ljust(16) + b"1600000000  7     8     100644  " + str(size).encode().ljust(10) + b"`\n"
    rows = []
    for name, body in FILES:
        raw = name.encode()
        if style == "bsd" and len(raw) > 15:
            rows.append((b"#1/" + str(len(raw)).encode(), raw + body))
        elif len(raw) > 15:
            rows.append((b"/" + str(len(table)).encode(), body))
            table += raw + b"/\n"
        else:
            rows.append((raw + b"/" * (style == "gnu"), body))
    if style == "gnu":
        rows = [(b"/", b"\0\0\0\0"), (b"//", table), *rows]
    for name, body in rows:
        out += header(name, len(body)) + body + b"\n" * (len(body) % 2)
    return out


def write_cpio(octal):
    out = b""
    for k, (name, mode, body) in enumerate([*[(n, 0o100640, b) for n, b in FILES], ("d", 0o040755, b""), ("link", 0o120777, b"readme.txt"), ("TRAILER!!!", 0, b"")]):
        raw = name.encode() + b"\0"
        if octal:
            out += b"070707" + b"".join(b"%06o" % v for v in (1, k, mode, 7, 8, 1, 0)) + b"%011o" % 1_600_000_000 + b"%06o" % len(raw) + b"%011o" % len(body) + raw + body
        else:
            head = b"070701" + b"".join(b"%08X" % v for v in (k, mode, 7, 8, 1, 1_600_000_000, len(body), 0, 0, 0, 0, len(raw), 0)) + raw
            out += head + b"\0" * (-len(head) % 4) + body + b"\0" * (-len(body) % 4)
    return out


def write_iso():
    when = bytes([120, 9, 13, 12, 26, 40, 0])

    def record(name, extent, size, directory, rock=None):
        area = b"" if rock is None else b"NM" + bytes([5 + len(rock), 1, 0]) + rock
        body = bytes(1) + struct.pack("<I", extent) + struct.pack(">I", extent) + struct.pack("<I", size) + struct.pack(">I", size) + when + bytes([2 * directory, 0, 0]) + struct.pack("<HH", 1, 1)[:4] + bytes([len(name)]) + name
        body += bytes(1 - len(name) % 2) + area
        body += bytes((len(body) + 1) % 2)
        return bytes([len(body) + 1]) + body

    small, other = b"small file", b"x" * 3000
    root = record(b"\0", 18, 2048, True) + record(b"\1", 18, 2048, True) + record(b"README.TXT;1", 20, len(small), False, b"ReadMe.text") + record(b"SUB", 19, 2048, True)
    sub = record(b"\0", 19, 2048, True) + record(b"\1", 18, 2048, True) + record(b"DATA.;1", 21, len(other), False) + record(b"LOOP", 18, 2048, True)
    volume = (b"\x01CD001\x01" + bytes(149) + b"")[:156] + record(b"\0", 18, 2048, True)
    sectors = [volume, b"\xffCD001\x01", root, sub, small, other]
    return bytes(16 * 2048) + b"".join(s.ljust(-(-len(s) // 2048) * 2048, b"\0") for s in sectors), small, other


def write_cab(method, reserve=False):
    plain, blocks, last = b"".join(b for _, b in FILES) * 150, [], b""
    for at in range(0, len(plain), 32_768):
        piece = plain[at : at + 32_768]
        packed = piece
        if method == 1:
            made = zlib.compressobj(9, zlib.DEFLATED, -15, zdict=last) if last else zlib.compressobj(9, zlib.DEFLATED, -15)
            packed, last = b"CK" + made.compress(piece) + made.flush(), piece
        blocks.append(struct.pack("<IHH", 0, len(packed), len(piece)) + b"r" * (3 * reserve) + packed)
    listing, offset, each = b"", 0, []
    for name, body in FILES:
        each.append((name, body * 150))
    plain_at = {}
    whole = b"".join(b for _, b in each)
    # the data is the repeated sequence, so files are cut out of it by place
    for name, size in (("dir\\one.txt", 1000), ("two.bin", 70_000)):
        plain_at[name.replace("\\", "/")] = plain[offset : offset + size]
        listing += struct.pack("<IIHHHH", size, offset, 0, (40 << 9) | (9 << 5) | 13, (12 << 11) | (26 << 5) | 20, 0x80) + name.encode() + b"\0"
        offset += size
    extra = struct.pack("<HBB", 0, 2, 3) if reserve else b""
    folder_at = 36 + len(extra)
    files_at = folder_at + 8 + 2 * reserve
    data_at = files_at + len(listing)
    head = b"MSCF" + struct.pack("<IIIIIBBHHHHH", 0, data_at + sum(map(len, blocks)), 0, files_at, 0, 3, 1, 1, 2, 4 * reserve, 0, 0)
    assert len(whole) == len(plain)
    return head + extra + struct.pack("<IHH", data_at, len(blocks), method) + b"zz" * reserve + listing + b"".join(blocks), plain_at


def write_xar():
    heap, files = b"", ""
    for k, (name, body) in enumerate(FILES):
        style, packed = [("application/x-gzip", zlib.compress(body)), ("application/x-bzip2", bz2.compress(body)), ("application/octet-stream", body)][k]
        files += f"<file id='{k}'><name>{name}</name><type>file</type><mode>0644</mode><mtime>2020-09-13T12:26:40Z</mtime><data><length>{len(packed)}</length><offset>{len(heap)}</offset><size>{len(body)}</size><encoding style='{style}'/></data></file>"
        heap += packed
    toc = f"<?xml version='1.0'?><xar><toc><file id='9'><name>d</name><type>directory</type>{files}</file></toc></xar>".encode()
    raw = zlib.compress(toc)
    return struct.pack(">4sHHQQI", b"xar!", 28, 1, len(raw), len(toc), 0) + raw + heap


def read(data):
    kind, rows, error = containers.entries(data, True)
    assert error is None, error
    return kind, {r["path"]: r for r in rows}


@pytest.mark.parametrize("style", ["gnu", "bsd"])
def test_ar(style):
    kind, rows = read(write_ar(style))
    assert kind == "ar" and {p: r["payload"] for p, r in rows.items()} == dict(FILES)
    assert {(r["mtime_epoch"], r["mode"], r["extra"]["uid"]) for r in rows.values()} == {(1_600_000_000, 0o644, "7")}


@pytest.mark.parametrize("octal", [False, True])
def test_cpio(octal):
    kind, rows = read(write_cpio(octal))
    assert kind == "cpio" and {p: r["payload"] for p, r in rows.items() if r["payload"] is not None} == dict(FILES)
    assert rows["d/"]["is_directory"] and rows["link"]["link_target"] == "readme.txt" and rows["empty"]["mode"] == 0o640


def test_iso():
    data, small, other = write_iso()
    kind, rows = read(data)
    assert kind == "iso" and list(rows) == ["ReadMe.text", "SUB/", "SUB/DATA", "SUB/LOOP/"]
    assert (rows["ReadMe.text"]["payload"], rows["SUB/DATA"]["payload"]) == (small, other)
    assert rows["ReadMe.text"]["mtime_epoch"] == int(datetime(2020, 9, 13, 12, 26, 40, tzinfo=UTC).timestamp())


@pytest.mark.parametrize("reserve", [False, True])
@pytest.mark.parametrize("method", [0, 1])
def test_cab(method, reserve):
    data, plain = write_cab(method, reserve)
    kind, rows = read(data)
    assert kind == "cab" and {p: r["payload"] for p, r in rows.items()} == plain
    assert rows["two.bin"]["mtime_epoch"] == 1_600_000_000 and rows["two.bin"]["method"] == ["store", "mszip"][method]


def test_xar():
    kind, rows = read(write_xar())
    assert kind == "xar" and {p: r["payload"] for p, r in rows.items() if not r["is_directory"]} == {f"d/{n}": b for n, b in FILES}
    assert rows["d/readme.txt"]["mtime_epoch"] == 1_600_000_000 and rows["d/empty"]["method"] == "store"


def lzip(body):
    filters = [{"id": lzma.FILTER_LZMA1, "dict_size": 1 << 16, "lc": 3, "lp": 0, "pb": 2}]
    made = lzma.compress(body, lzma.FORMAT_ALONE, filters=filters)[13:]  # this form ends with a marker
    return b"LZIP\x01\x10" + made + struct.pack("<IQQ", zlib.crc32(body), len(body), 26 + len(made))


def test_lz4_and_lzip_streams():
    tar = containers.pack_tar([("a.txt", b"one", 0), ("b.txt", b"two" * 999, 0)])
    for name, data in (("x.tar.lz4", pa.Codec("lz4").compress(tar, asbytes=True)), ("x.tar.lz", lzip(tar[:2000]) + lzip(tar[2000:]))):
        _, rows, error = containers.entries(data, True, name)
        assert error is None and [(r["path"], r["payload"]) for r in rows] == [("a.txt", b"one"), ("b.txt", b"two" * 999)], name
    (row,) = containers.entries(lzip(b"plain"), True, "d/notes.lz")[1]
    assert (row["path"], row["payload"], row["method"]) == ("notes", b"plain", "lzip")


def test_damage_gives_errors_not_exceptions():
    for data in (write_ar("gnu"), write_cpio(False), write_cpio(True), write_iso()[0], write_cab(1)[0], write_xar(), lzip(b"plain" * 90)):
        for cut in range(0, len(data), max(1, len(data) // 60)):
            containers.entries(data[:cut], True)
            hurt = bytearray(data)
            hurt[cut] ^= 0x55
            containers.entries(bytes(hurt), True)
    assert containers.entries(b"!<arch>\n" + b"x" * 60, True)[2]


def test_members_in_a_table(spark):
    rows = [("a.a", write_ar("gnu")), ("b.cpio", write_cpio(False)), ("c.cab", write_cab(1)[0]), ("d.xar", write_xar()), ("e.iso", write_iso()[0]), ("f", b"nothing")]
    found = archives.entries(spark.createDataFrame(rows, "path string, content binary")).groupBy("archive_id").count().collect()
    assert {r.archive_id: r["count"] for r in found} == {"a.a": 3, "b.cpio": 5, "c.cab": 2, "d.xar": 4, "e.iso": 4, "f": 1}
    assert members.kind_of(b"") is None
