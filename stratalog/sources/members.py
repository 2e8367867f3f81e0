"""Containers that hold members one after the other or by a table: ar, cpio, ISO 9660, cabinets and XAR.  Plain Python, no Spark."""

from __future__ import annotations

import bz2
import io
import lzma
import struct
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

SECTOR = 2048
_DIRECTORY, _LINK, _KIND = 0o040000, 0o120000, 0o170000


def row(k: int, path: str, size: int, body: bytes | None, with_payload: bool, **more: object) -> dict:
    """An entry; what a format does not say is unknown."""
    out = {"entry_idx": k, "path": path, "uncompressed_size": size, "compressed_size": None, "crc32": None, "mtime_epoch": None, "mode": None, "is_directory": path.endswith("/"), "is_encrypted": False, "method": "store", "link_target": None, "extra": {}}
    return out | more | ({"payload": body} if with_payload else {})


def whole(data: bytes, at: int, size: int) -> bytes:
    if at < 0 or size < 0 or at + size > len(data):
        raise ValueError("a member goes beyond the file")
    return data[at : at + size]


# -- ar ---------------------------------------------------------------------------------------


def ar_entries(data: bytes, with_payload: bool = False) -> Iterator[dict]:
    """Members of a Unix archive; long names by the GNU table or, as BSD has them, in front of the data.  Symbol tables are left out."""
    at, k, names = 8, 0, b""
    while at + 1 < len(data):
        header = whole(data, at, 60)
        if header[58:] != b"`\n":
            raise ValueError("a member's header is not closed")
        name, size = header[:16].rstrip(b" "), int(header[48:58])
        body = whole(data, at + 60, size)
        at += 60 + size + size % 2
        if name == b"//":
            names = body
        if name in (b"/", b"//", b"/SYM64/"):
            continue
        if name.startswith(b"#1/"):
            long = int(name[3:])
            name, body = body[:long].rstrip(b"\0"), body[long:]
        elif name.startswith(b"/") and name[1:].isdigit():
            name = names[int(name[1:]) :].split(b"\n", 1)[0]
        if name.startswith(b"__.SYMDEF"):
            continue
        number = lambda raw, base: int(raw, base) if raw.strip() else None
        owner = {"uid": header[28:34].strip().decode("latin-1"), "gid": header[34:40].strip().decode("latin-1")}
        mode = number(header[40:48], 8)
        yield row(k, name.removesuffix(b"/").decode("utf-8", "replace"), len(body), body, with_payload, mtime_epoch=number(header[16:28], 10), mode=None if mode is None else mode & 0o7777, extra=owner)
        k += 1


# -- cpio -------------------------------------------------------------------------------------


def cpio_entries(data: bytes, with_payload: bool = False) -> Iterator[dict]:
    """Members of a cpio archive with hexadecimal (070701, 070702) or octal (070707) headers."""
    at, k = 0, 0
    while True:
        magic = data[at : at + 6]
        if magic in (b"070701", b"070702"):
            f = [int(whole(data, at + 6 + 8 * i, 8), 16) for i in range(13)]
            mode, uid, gid, mtime, size, long, step, head = f[1], f[2], f[3], f[5], f[6], f[11], 4, 110
        elif magic == b"070707":
            f = [int(whole(data, at + 6 + 6 * i, 6), 8) for i in range(7)]
            mtime, long, size = (int(whole(data, at + a, n), 8) for a, n in ((48, 11), (59, 6), (65, 11)))
            mode, uid, gid, step, head = f[2], f[3], f[4], 1, 76
        else:
            raise ValueError(f"no header at {at}")
        name = whole(data, at + head, long).rstrip(b"\0").decode("utf-8", "replace")
        start = at + head + long + -(head + long) % step
        if name == "TRAILER!!!":
            return
        body = whole(data, start, size)
        at = start + size + -size % step
        is_dir, is_link = mode & _KIND == _DIRECTORY, mode & _KIND == _LINK
        yield row(k, name + "/" * is_dir, size, None if is_dir or is_link else body, with_payload, mtime_epoch=mtime, mode=mode & 0o7777, link_target=body.decode("utf-8", "replace") if is_link else None, extra={"uid": str(uid), "gid": str(gid)})
        k += 1


# -- ISO 9660 ---------------------------------------------------------------------------------


def _iso_time(raw: bytes) -> int | None:
    try:
        zone = struct.unpack("b", raw[6:7])[0]
        return int(datetime(1900 + raw[0], *raw[1:6], tzinfo=UTC).timestamp()) - 900 * zone
    except ValueError:
        return None


def _rock_ridge_name(area: bytes) -> str | None:
    """The name in a record's system area, if there is one."""
    parts, at = [], 0
    while at + 5 <= len(area) and area[at + 2] >= 4:
        if area[at : at + 2] == b"NM":
            parts.append(area[at + 5 : at + area[at + 2]])
        at += area[at + 2]
    return b"".join(parts).decode("utf-8", "replace") if parts else None


def iso_entries(data: bytes, with_payload: bool = False) -> Iterator[dict]:
    """Files and directories of an image, in the order of its directories; every directory is read once, so that loops end."""
    first = whole(data, 16 * SECTOR, SECTOR)
    if first[:6] != b"\x01CD001":
        raise ValueError("no primary volume descriptor")
    todo, seen, k = [("", *struct.unpack_from("<I4xI", first, 158))], set(), 0
    while todo:
        parent, extent, size = todo.pop(0)
        if extent in seen:
            continue
        seen.add(extent)
        directory, at = whole(data, extent * SECTOR, size), 0
        while at < size:
            n = directory[at]
            if not n:  # records do not cross sectors
                at += SECTOR - at % SECTOR
                continue
            record = directory[at : at + n]
            at += n
            if len(record) < 34 or len(record) < 33 + record[32]:
                raise ValueError("a directory record is cut")
            name = record[33 : 33 + record[32]]
            if name in (b"\0", b"\1"):
                continue
            place, length = struct.unpack_from("<I4xI", record, 2)
            area = record[33 + record[32] + (1 - record[32] % 2) :]
            text = _rock_ridge_name(area) or name.decode("latin-1").split(";", 1)[0].removesuffix(".")
            if record[25] & 2:
                todo.append((f"{parent}{text}/", place, length))
                yield row(k, f"{parent}{text}/", 0, None, with_payload, mtime_epoch=_iso_time(record[18:25]))
            else:
                yield row(k, parent + text, length, whole(data, place * SECTOR, length) if with_payload else None, with_payload, mtime_epoch=_iso_time(record[18:25]), extra={"extent": str(place)})
            k += 1


# -- cabinets ---------------------------------------------------------------------------------

_CAB_METHODS = {0: "store", 1: "mszip", 2: "quantum", 3: "lzx"}


def _cab_folder(data: bytes, at: int, blocks: int, method: int, extra: int) -> bytes | None:
    """The bytes of a folder: stored, or blocks of deflate of which each knows the one before; None for other methods."""
    out, last = [], b""
    for _ in range(blocks):
        packed, size = struct.unpack_from("<HH", whole(data, at, 8), 4)
        body = whole(data, at + 8 + extra, packed)
        at += 8 + extra + packed
        if method == 1:
            if body[:2] != b"CK":
                raise ValueError("a block has no signature")
            unpack = zlib.decompressobj(-15, zdict=last) if last else zlib.decompressobj(-15)
            body = unpack.decompress(body[2:])
        elif method:
            return None
        if len(body) != size:
            raise ValueError("a block has another size than it says")
        out.append(body)
        last = body[-32_768:]
    return b"".join(out)


def cab_entries(data: bytes, with_payload: bool = False) -> Iterator[dict]:
    """Files of a cabinet."""
    files_at, folders, files, flags = struct.unpack_from("<16xI6xHHH", whole(data, 0, 36))
    at, per_folder, per_block = 36, 0, 0
    if flags & 4:
        reserve, per_folder, per_block = struct.unpack_from("<HBB", whole(data, at, 4))
        at += 4 + reserve
    for _ in range(2 * bool(flags & 1) + 2 * bool(flags & 2)):  # names of the cabinets before and after
        at = data.index(b"\0", at) + 1
    parts = []
    for _ in range(folders):
        parts.append(struct.unpack_from("<IHH", whole(data, at, 8)))
        at += 8 + per_folder
    made: dict[int, bytes | None] = {}
    at = files_at
    for k in range(files):
        size, offset, folder, date, time, attributes = struct.unpack_from("<IIHHHH", whole(data, at, 16))
        end = data.index(b"\0", at + 16)
        name = data[at + 16 : end].decode("utf-8" if attributes & 0x80 else "latin-1", "replace").replace("\\", "/")
        at = end + 1
        method = parts[folder][2] & 15 if folder < len(parts) else -1
        body = None
        if with_payload and method >= 0:
            if folder not in made:
                made[folder] = _cab_folder(data, parts[folder][0], parts[folder][1], method, per_block)
            body = None if made[folder] is None else whole(made[folder], offset, size)
        try:
            when = int(datetime((date >> 9) + 1980, date >> 5 & 15, date & 31, time >> 11, time >> 5 & 63, (time & 31) * 2, tzinfo=UTC).timestamp())
        except ValueError:
            when = None
        yield row(k, name, size, body, with_payload, mtime_epoch=when, method=_CAB_METHODS.get(method, "unknown"), extra={"folder": str(folder), "offset": str(offset)})


# -- XAR --------------------------------------------------------------------------------------

_XAR = {"application/octet-stream": ("store", bytes), "application/x-gzip": ("deflate", zlib.decompress), "application/x-bzip2": ("bzip2", bz2.decompress), "application/x-lzma": ("lzma", lzma.decompress)}


def xar_entries(data: bytes, with_payload: bool = False) -> Iterator[dict]:
    """Files of an XAR archive, by its packed XML table."""
    size, _, packed, length = struct.unpack_from(">4xHHQQ", whole(data, 0, 28))
    text = zlib.decompressobj().decompress(whole(data, size, packed), length)
    if b"<!ENTITY" in text:
        raise ValueError("the table declares entities")
    heap, k = size + packed, 0
    try:
        root = ET.parse(io.BytesIO(text)).getroot()
    except ET.ParseError as e:
        raise ValueError(f"the table is no XML: {e}") from e
    todo = [("", f) for f in root.findall("toc/file")]
    while todo:
        parent, f = todo.pop(0)
        path, kind = parent + (f.findtext("name") or ""), f.findtext("type")
        if kind == "directory":
            todo = [(f"{path}/", x) for x in f.findall("file")] + todo
        part, mode = f.find("data"), f.findtext("mode")
        style = part.find("encoding").get("style", "") if part is not None and part.find("encoding") is not None else "application/octet-stream"
        method, unpack = _XAR.get(style, (style, None))
        number = lambda name: int(part.findtext(name) or 0) if part is not None else 0  # noqa: E731, B023
        body = None
        if with_payload and part is not None and unpack is not None:
            body = unpack(whole(data, heap + number("offset"), number("length")))
        when = f.findtext("mtime")
        yield row(k, path + "/" * (kind == "directory"), number("size"), b"" if body is None and kind == "file" and part is None else body, with_payload, compressed_size=number("length") if part is not None else None, mode=int(mode, 8) & 0o7777 if mode else None, method=method, link_target=f.findtext("link"), mtime_epoch=int(datetime.fromisoformat(when).timestamp()) if when else None)
        k += 1


READERS = {"ar": ar_entries, "cpio": cpio_entries, "iso": iso_entries, "cab": cab_entries, "xar": xar_entries}


def kind_of(head: bytes) -> str | None:
    """By the first bytes; an ISO image's mark is in its seventeenth sector."""
    for kind, magic in (("ar", b"!<arch>\n"), ("cpio", b"070701"), ("cpio", b"070702"), ("cpio", b"070707"), ("cab", b"MSCF"), ("xar", b"xar!")):
        if head.startswith(magic):
            return kind
    return "iso" if head[16 * SECTOR + 1 : 16 * SECTOR + 6] == b"CD001" else None


def file_kind(file: BinaryIO) -> str | None:
    file.seek(0)
    head = file.read(17 * SECTOR)
    file.seek(0)
    return kind_of(head)
