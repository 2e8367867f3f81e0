"""ZIP, TAR, 7z and other catalogues from bytes: entries, payloads, extra fields, salvage and compliance issues.  Plain Python, no Spark."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
import zstandard

from stratalog.sources import members, sevenz

#: Columns of an entry, in the order of the entries schema.
FIELDS = ("entry_idx", "path", "uncompressed_size", "compressed_size", "crc32", "mtime_epoch", "mode", "is_directory", "is_encrypted", "method", "link_target", "extra")
ENTRY_DDL = "entry_idx int, path string, uncompressed_size long, compressed_size long, crc32 long, mtime_epoch long, mode int, is_directory boolean, is_encrypted boolean, method string, link_target string, extra map<string,string>"
METHODS = {0: "store", 8: "deflate", 9: "deflate64", 12: "bzip2", 14: "lzma", 93: "zstd", 95: "xz", 99: "aes"}


# -- zip --------------------------------------------------------------------------------------


def extra_fields(raw: bytes) -> dict[str, str]:
    """Known extra fields as text: zip64, extended times, Unicode path, Unix owner, AES; broken ones are left out."""
    out, at = {}, 0
    while at + 4 <= len(raw):
        kind, size = struct.unpack_from("<HH", raw, at)
        body = raw[at + 4 : at + 4 + size]
        at += 4 + size
        if len(body) < size:
            break
        if kind == 0x0001:
            out["zip64"] = ",".join(str(v) for (v,) in struct.iter_unpack("<Q", body[: size // 8 * 8]))
        elif kind == 0x5455 and size >= 5 and body[0] & 1:
            out["mtime"] = str(int.from_bytes(body[1:5], "little", signed=True))
        elif kind == 0x7075 and size >= 5 and body[0] == 1:
            out["unicode_path"] = body[5:].decode("utf-8", "replace")
        elif kind == 0x7875 and size >= 3 and body[0] == 1:
            n = body[1]
            out["uid"] = str(int.from_bytes(body[2 : 2 + n], "little"))
            if 2 + n < size:
                m = body[2 + n]
                out["gid"] = str(int.from_bytes(body[3 + n : 3 + n + m], "little"))
        elif kind == 0x9901 and size >= 7:
            out["aes_strength"], out["aes_method"] = str(body[4]), str(int.from_bytes(body[5:7], "little"))
    return out


def _civil(parts: tuple[int, ...]) -> int | None:
    try:
        return int(datetime(*parts, tzinfo=UTC).timestamp())
    except ValueError:
        return None


def zip_entries(data: bytes | BinaryIO, with_payload: bool = False) -> Iterator[dict]:
    """Rows of the central directory; payloads, where asked for, are None if encrypted, broken or of an unknown method."""
    with zipfile.ZipFile(_file(data)) as archive:
        for k, info in enumerate(archive.infolist()):
            extra = extra_fields(info.extra)
            method = METHODS.get(int(extra.get("aes_method", info.compress_type)), str(info.compress_type))
            row = {
                "entry_idx": k, "path": extra.get("unicode_path", info.filename), "uncompressed_size": info.file_size, "compressed_size": info.compress_size, "crc32": info.CRC,
                "mtime_epoch": int(extra["mtime"]) if "mtime" in extra else _civil(info.date_time), "mode": info.external_attr >> 16 & 0o7777, "is_directory": info.is_dir(),
                "is_encrypted": bool(info.flag_bits & 1), "method": method, "link_target": None, "extra": extra,
            }
            if with_payload:
                row["payload"] = None
                if not info.flag_bits & 1 and not info.is_dir():
                    try:
                        row["payload"] = archive.read(info)
                    except (zipfile.BadZipFile, NotImplementedError, zlib.error, lzma.LZMAError, EOFError, OSError):
                        pass
            yield row


_LOCAL = struct.Struct("<4sHHHHHIIIHH")


def salvage_zip(data: bytes, with_payload: bool = False) -> Iterator[dict]:
    """Rows of whatever local headers a damaged ZIP file still has; payloads are cut at the next header or the end."""
    at, k = data.find(b"PK\x03\x04"), 0
    while 0 <= at and at + _LOCAL.size <= len(data):
        _, _, flags, method, time, date, crc, packed, size, name_size, extra_size = _LOCAL.unpack_from(data, at)
        start = at + _LOCAL.size + name_size + extra_size
        name = data[at + _LOCAL.size : at + _LOCAL.size + name_size]
        if start > len(data):
            return
        stop = start + packed
        follows = data.find(b"PK\x03\x04", start)
        if flags & 8 and not packed or stop > len(data):
            ends = [e for e in (follows, data.find(b"PK\x01\x02", start), data.find(b"PK\x07\x08", start)) if e >= 0]
            stop = min(ends, default=len(data))
        body = data[start:stop]
        plain = None
        if not flags & 1:
            try:
                plain = body if method == 0 else zlib.decompressobj(-15).decompress(body) if method == 8 else bz2.decompress(body) if method == 12 else None
            except (zlib.error, OSError, ValueError):
                plain = None
        when = _civil((1980 + (date >> 9), date >> 5 & 15, date & 31, time >> 11, time >> 5 & 63, min(59, (time & 31) * 2)))
        path = name.decode("utf-8" if flags & 0x800 else "cp437", "replace")
        row = {
            "entry_idx": k, "path": path, "uncompressed_size": size if size or plain is None else len(plain), "compressed_size": len(body), "crc32": crc if crc or plain is None else zlib.crc32(plain), "mtime_epoch": when,
            "mode": None, "is_directory": path.endswith("/"), "is_encrypted": bool(flags & 1), "method": METHODS.get(method, str(method)), "link_target": None, "extra": {"whole": str(plain is not None and zlib.crc32(plain) == (crc or zlib.crc32(plain))).lower()},
        }
        if with_payload:
            row["payload"] = plain
        yield row
        k, at = k + 1, data.find(b"PK\x03\x04", max(stop, at + 4))


# -- tar --------------------------------------------------------------------------------------


def tar_entries(data: bytes | BinaryIO, with_payload: bool = False, mode: str = "r:*") -> Iterator[dict]:
    """Rows of a TAR file, plain or compressed; sizes packed and checksums are unknown in this format."""
    with tarfile.open(fileobj=_file(data), mode=mode) as archive:
        for k, info in enumerate(archive):
            extra = {key: str(value) for key, value in info.pax_headers.items()}
            extra |= {"uid": str(info.uid), "gid": str(info.gid), "uname": info.uname, "gname": info.gname, "typeflag": info.type.decode("latin-1")}
            row = {
                "entry_idx": k, "path": info.name + "/" * info.isdir(), "uncompressed_size": info.size, "compressed_size": None, "crc32": None, "mtime_epoch": int(info.mtime), "mode": info.mode & 0o7777,
                "is_directory": info.isdir(), "is_encrypted": False, "method": "store", "link_target": info.linkname or None, "extra": extra,
            }
            if with_payload:
                row["payload"] = archive.extractfile(info).read() if info.isreg() else None
            yield row


def tar_checksum_ok(header: bytes) -> bool:
    """Whether the stored sum is that of the header's bytes, read unsigned or signed."""
    try:
        stored = int(header[148:156].split(b"\0")[0].strip() or b"0", 8)
    except ValueError:
        return False
    blank = header[:148] + b" " * 8 + header[156:512]
    return stored in (sum(blank), sum(b - 256 if b > 127 else b for b in blank))


def salvage_tar(data: bytes) -> Iterator[dict]:
    """Rows of every block that is a header with a good checksum."""
    at, k = 0, 0
    while at + 512 <= len(data):
        header = data[at : at + 512]
        at += 512
        if header[0] and tar_checksum_ok(header):
            try:
                info = tarfile.TarInfo.frombuf(header, "utf-8", "replace")
            except tarfile.HeaderError:
                continue
            size = min(info.size, len(data) - at)
            yield {"entry_idx": k, "path": info.name, "uncompressed_size": size, "compressed_size": None, "crc32": None, "mtime_epoch": int(info.mtime), "mode": info.mode & 0o7777, "is_directory": info.isdir(), "is_encrypted": False, "method": "store", "link_target": info.linkname or None, "extra": {"whole": str(size == info.size).lower()}}
            k += 1
            at += -(-size // 512) * 512 if info.isreg() else 0


# -- single streams ---------------------------------------------------------------------------

SNAPPY_MAGIC = b"\xff\x06\0\0sNaPpY"
ENDINGS = {"gzip": ("gz", "gzip"), "bzip2": ("bz2", "bz"), "xz": ("xz",), "zstd": ("zst", "zstd"), "snappy": ("sz", "snappy"), "brotli": ("br",), "lz4": ("lz4",), "lzip": ("lz",)}


def stream_kind(head: bytes, name: str = "") -> str | None:
    """The codec of a compressed stream by its first bytes; Brotli has none and goes by name."""
    for kind, magic in (("gzip", b"\x1f\x8b"), ("bzip2", b"BZh"), ("xz", b"\xfd7zXZ\0"), ("zstd", b"\x28\xb5\x2f\xfd"), ("lz4", b"\x04\x22\x4d\x18"), ("lzip", b"LZIP"), ("snappy", SNAPPY_MAGIC)):
        if head.startswith(magic):
            return kind
    return "brotli" if name.lower().endswith(".br") else None


_CRC32C = []
for _n in range(256):
    for _ in range(8):
        _n = _n >> 1 ^ (0x82F63B78 if _n & 1 else 0)
    _CRC32C.append(_n)


def _masked_crc32c(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = _CRC32C[(crc ^ b) & 255] ^ crc >> 8
    crc ^= 0xFFFFFFFF
    return (crc >> 15 | crc << 17) + 0xA282EAD8 & 0xFFFFFFFF


class _Snappy(io.RawIOBase):
    """Reads the framed format chunk by chunk."""

    def __init__(self, file: BinaryIO) -> None:
        self.file, self.rest, self.codec = file, b"", pa.Codec("snappy")

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        while not self.rest:
            head = self.file.read(4)
            if not head:
                return 0
            size = int.from_bytes(head[1:4], "little")
            body = self.file.read(size)
            if len(head) < 4 or len(body) < size:
                raise EOFError("snappy stream is cut")
            if head[0] in (0, 1):
                plain = body[4:]
                if head[0] == 0:
                    length = shift = 0
                    for b in plain[:5]:
                        length, shift = length | (b & 127) << shift, shift + 7
                        if b < 128:
                            break
                    if length > 65_536:
                        raise ValueError("snappy chunk is too long")
                    plain = self.codec.decompress(plain, length, asbytes=True)
                if _masked_crc32c(plain) != int.from_bytes(body[:4], "little"):
                    raise ValueError("snappy chunk has the wrong checksum")
                self.rest = plain
            elif head[0] < 0x80:
                raise ValueError("unknown snappy chunk")
        n = min(len(into), len(self.rest))
        into[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


class _Lent(io.RawIOBase):
    """A file that stays open when its reader is closed."""

    def __init__(self, file: BinaryIO) -> None:
        self.file = file

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        found = self.file.read(len(into))
        into[: len(found)] = found
        return len(found)


def lzip_bytes(data: bytes) -> bytes:
    """The members of an lzip file, each checked against its trailer."""
    out = []
    while data:
        if len(data) < 26 or data[:4] != b"LZIP" or data[4] > 1:
            raise ValueError("no lzip member")
        base = 1 << (data[5] & 31)
        unpack = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA1, "dict_size": max(4096, base - base // 16 * (data[5] >> 5)), "lc": 3, "lp": 0, "pb": 2}])
        body = unpack.decompress(data[6:])
        if not unpack.eof or len(unpack.unused_data) < 20:
            raise EOFError("an lzip member is cut")
        crc, size = struct.unpack_from("<IQ", unpack.unused_data)
        if crc != zlib.crc32(body) or size != len(body):
            raise ValueError("an lzip member has the wrong checksum or size")
        out.append(body)
        data = unpack.unused_data[20:]
    return b"".join(out)


def opened(file: BinaryIO, kind: str) -> BinaryIO:
    """The plain bytes of a compressed stream."""
    if kind == "snappy":
        return io.BufferedReader(_Snappy(file))
    if kind == "lzip":
        return io.BytesIO(lzip_bytes(file.read()))
    if kind in ("zstd", "brotli", "lz4"):
        return pa.CompressedInputStream(pa.PythonFile(_Lent(file), mode="r"), kind)
    return {"gzip": gzip.open, "bzip2": bz2.open, "xz": lzma.open}[kind](file)


def stream_entries(file: BinaryIO, kind: str, name: str = "", with_payload: bool = False) -> Iterator[dict]:
    """Rows of the TAR file in a compressed stream, or else one row for what the stream holds."""
    packed = file.seek(0, io.SEEK_END)
    file.seek(0)
    head = opened(file, kind).read(512)
    file.seek(0)
    stream = opened(file, kind)
    if len(head) == 512 and (head[257:262] == b"ustar" or not any(head) or tar_checksum_ok(head)):
        yield from tar_entries(stream, with_payload, "r|")
        return
    size, crc, kept = 0, 0, []
    while piece := stream.read(1 << 20):
        size, crc = size + len(piece), zlib.crc32(piece, crc)
        if with_payload:
            kept.append(piece)
    base = name.rsplit("/", 1)[-1]
    stem, _, ending = base.rpartition(".")
    row = {
        "entry_idx": 0, "path": stem if stem and ending.lower() in ENDINGS[kind] else base or "data", "uncompressed_size": size, "compressed_size": packed, "crc32": crc, "mtime_epoch": None, "mode": None,
        "is_directory": False, "is_encrypted": False, "method": kind, "link_target": None, "extra": {},
    }
    yield row | {"payload": b"".join(kept)} if with_payload else row


# -- both -------------------------------------------------------------------------------------


def _file(data: bytes | BinaryIO) -> BinaryIO:
    return io.BytesIO(data) if isinstance(data, bytes) else data


#: What a container that is broken, cut or of an unknown kind makes the parsers raise.
BROKEN = (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, ValueError, zlib.error, lzma.LZMAError, struct.error, NotImplementedError, IndexError, MemoryError, RuntimeError)


def file_entries(file: BinaryIO, name: str = "") -> Iterator[dict]:
    """Rows of an open file; of ZIP files only the directory is read, of plain TAR files only the headers.  Raises what is in BROKEN."""
    size = file.seek(0, io.SEEK_END)
    file.seek(max(0, size - 65_557))
    tail = file.read()
    file.seek(0)
    head = file.read(512)
    file.seek(0)
    kind = kind_of(head + tail)
    if kind in ("tar", "unknown") and (stream := stream_kind(head, name)):
        return stream_entries(file, stream, name)
    if kind == "7z":
        return sevenz.entries(file.read())
    if kind == "unknown":
        other = members.file_kind(file)
        if other is None:
            raise ValueError("unknown format")
        return members.READERS[other](file.read())
    return zip_entries(file) if kind == "zip" else tar_entries(file)


def kind_of(data: bytes) -> str:
    if data[:2] == b"PK" or b"PK\x05\x06" in data[-65_557:]:
        return "zip"
    if data[:6] == sevenz.MAGIC:
        return "7z"
    if data[257:262] == b"ustar" or data[:2] in (b"\x1f\x8b", b"BZ") or data[:6] == b"\xfd7zXZ\0":
        return "tar"
    return "unknown"


def entries(data: bytes, with_payload: bool = False, name: str = "") -> tuple[str, list[dict], str | None]:
    """Kind, rows and error of a container; a broken one gives an error, never an exception."""
    kind = kind_of(data)
    try:
        if kind in ("tar", "unknown") and (stream := stream_kind(data[:512], name)):
            return kind if kind == "tar" else stream, list(stream_entries(io.BytesIO(data), stream, name, with_payload)), None
        if kind == "zip":
            return kind, list(zip_entries(data, with_payload)), None
        if kind == "tar":
            return kind, list(tar_entries(data, with_payload)), None
        if kind == "7z":
            return kind, list(sevenz.entries(data, with_payload)), None
        if other := members.kind_of(data):
            return other, list(members.READERS[other](data, with_payload)), None
    except BROKEN as e:
        return kind, [], f"{type(e).__name__}: {e}"
    return kind, [], "unknown format"


# -- compliance -------------------------------------------------------------------------------


def issues(data: bytes, kind: str) -> list[tuple[str, str, str, int | None]]:
    """(severity, section, message, offset) for what breaks the format's rules."""
    return {"zip": _zip_issues, "tar": _tar_issues, "gzip": _gzip_issues, "bzip2": _bzip2_issues, "xz": _xz_issues, "zstd": _zstd_issues, "7z": _sevenz_issues, "ar": _ar_issues}.get(kind, lambda d: _header_issues(d, kind))(data)


def _number(data: bytes, at: int, size: int, order: str = "little") -> int:
    return int.from_bytes(data[at : at + size], order)


#: Rules of formats that are checked by their headers: (where, what must hold, severity, message).
_HEADERS: dict[str, list[tuple[int, Callable[[bytes], bool], str, str]]] = {
    "rar": [(0, lambda d: d[:6] == b"Rar!\x1a\x07", "ERROR", "no signature"), (7, lambda d: len(d) >= 20, "ERROR", "no main header")],
    "cab": [(4, lambda d: _number(d, 4, 4) == 0, "ERROR", "reserved field is not zero"), (8, lambda d: _number(d, 8, 4) <= len(d), "ERROR", "size goes beyond the file"), (24, lambda d: d[24:26] == b"\3\1", "WARNING", "version is not 1.3")],
    "xar": [(4, lambda d: _number(d, 4, 2, "big") >= 28, "ERROR", "header is too short"), (6, lambda d: _number(d, 6, 2, "big") == 1, "WARNING", "version is not 1"), (8, lambda d: 28 + _number(d, 8, 8, "big") <= len(d), "ERROR", "table of contents goes beyond the file")],
    "wim": [(8, lambda d: _number(d, 8, 4) >= 208, "ERROR", "header is too short"), (12, lambda d: _number(d, 12, 4) in (0x10D00, 0xE00), "WARNING", "unusual version")],
    "iso": [(0x8000, lambda d: d[0x8000:0x8001] == b"\1", "WARNING", "first descriptor is not the primary one"), (0x8006, lambda d: d[0x8006:0x8007] == b"\1", "WARNING", "descriptor version is not 1"), (0x8080, lambda d: _number(d, 0x8080, 2) == 2048, "WARNING", "blocks are not of 2048 bytes")],
    "dmg": [(-508, lambda d: _number(d, len(d) - 508, 4, "big") == 4, "WARNING", "trailer version is not 4"), (-504, lambda d: _number(d, len(d) - 504, 4, "big") == 512, "ERROR", "trailer size is not 512")],
    "lz4": [(4, lambda d: len(d) > 4 and d[4] >> 6 == 1, "ERROR", "frame version is not 1"), (4, lambda d: len(d) > 4 and not d[4] & 2, "ERROR", "reserved flag is set")],
    "lzip": [(4, lambda d: d[4:5] == b"\1", "ERROR", "version is not 1"), (5, lambda d: len(d) > 5 and 12 <= d[5] & 31 <= 29, "ERROR", "dictionary size out of range")],
    "lrzip": [(4, lambda d: d[4:5] == b"\0", "WARNING", "major version is not 0")],
    "snappy": [(0, lambda d: d[:10] == b"\xff\x06\0\0sNaPpY", "ERROR", "no stream identifier")],
    "lzfse": [(0, lambda d: d.rstrip(b"\0")[-4:] == b"bvx$", "WARNING", "no end block")],
    "aar": [(4, lambda d: len(d) >= 6 and 6 <= _number(d, 4, 2) <= len(d) or d[:4] == b"AEA1", "ERROR", "header size goes beyond the file")],
    "lzh": [(0, lambda d: d[6:7] == b"-", "ERROR", "method is not closed by a dash"), (20, lambda d: len(d) > 20 and d[20] <= 3, "WARNING", "header level is above 3")],
}


def _header_issues(data: bytes, kind: str) -> list:
    if kind not in _HEADERS:
        return [("WARNING", "format", "no checker for this format", None)]
    return [(severity, "header", message, at if at >= 0 else len(data) + at) for at, holds, severity, message in _HEADERS[kind] if not holds(data)]


def _ar_issues(data: bytes) -> list:
    at = 8
    while at < len(data):
        header = data[at : at + 60]
        if len(header) < 60 or header[58:60] != b"`\n":
            return [("ERROR", "member", "header is cut or not closed", at)]
        if not header[48:58].strip().isdigit():
            return [("ERROR", "member", "size is no number", at + 48)]
        at += 60 + int(header[48:58]) + int(header[48:58]) % 2
    return [("ERROR", "member", "goes beyond the file", at)] if at > len(data) + 1 else []


def _zip_issues(data: bytes) -> list:
    at = data.rfind(b"PK\x05\x06", max(0, len(data) - 65_557))
    if at < 0 or at + 22 > len(data):
        return [("ERROR", "end record", "missing", None)]
    out = []
    disk, cd_disk, here, total, size, start, comment = struct.unpack_from("<HHHHIIH", data, at + 4)
    if at + 22 + comment > len(data):
        out.append(("ERROR", "end record", "comment goes beyond the file", at + 20))
    if disk or cd_disk or here != total:
        out.append(("WARNING", "end record", "archive spans several disks", at + 4))
    if 0xFFFFFFFF in (size, start) or total == 0xFFFF:
        if data.find(b"PK\x06\x07", max(0, at - 20), at) < 0:
            out.append(("ERROR", "zip64", "placeholder without a zip64 locator", at))
        return out
    if start + size > at:
        return [*out, ("ERROR", "central directory", "goes beyond the end record", start)]
    p = start
    for _ in range(total):
        if p + 46 > at or data[p : p + 4] != b"PK\x01\x02":
            out.append(("ERROR", "central directory", "entry goes beyond the directory", p))
            break
        method, = struct.unpack_from("<H", data, p + 10)
        packed, plain = struct.unpack_from("<II", data, p + 20)
        name, extra, note = struct.unpack_from("<HHH", data, p + 28)
        local, = struct.unpack_from("<I", data, p + 42)
        if 0xFFFFFFFF in (packed, plain, local) and "zip64" not in extra_fields(data[p + 46 + name : p + 46 + name + extra]):
            out.append(("ERROR", "zip64", "placeholder without a zip64 field", p))
        elif data[local : local + 4] != b"PK\x03\x04":
            out.append(("WARNING", "local header", "is not where the directory says", local))
        elif data[local + 30 : local + 30 + name] != data[p + 46 : p + 46 + name]:
            out.append(("WARNING", "local header", "has another name than the directory", local))
        if method not in METHODS:
            out.append(("WARNING", "method", f"method {method} is uncommon", p + 10))
        p += 46 + name + extra + note
    return out


def _tar_issues(data: bytes) -> list:
    if len(data) < 512:
        return [("ERROR", "header", "shorter than a block", 0)]
    out, at = [], 0
    while at + 512 <= len(data) and data[at]:
        header = data[at : at + 512]
        if not tar_checksum_ok(header):
            return [*out, ("ERROR", "header", "wrong checksum", at + 148)]
        if header[257:262] != b"ustar":
            out.append(("WARNING", "header", "legacy header without magic", at + 257))
        try:
            size = int.from_bytes(header[125:136], "big") if header[124] & 0x80 else int(header[124:136].split(b"\0")[0].strip() or b"0", 8)
        except ValueError:
            return [*out, ("ERROR", "header", "size is no number", at + 124)]
        at += 512 + -(-size // 512) * 512
    if data[at : at + 1024] != bytes(1024):
        out.append(("WARNING", "end", "two zero blocks are missing", at))
    return out


def _gzip_issues(data: bytes) -> list:
    if len(data) < 18 or data[:2] != b"\x1f\x8b":
        return [("ERROR", "header", "no gzip header", 0)]
    return [("ERROR", "header", "unknown method", 2)] * (data[2] != 8) + [("WARNING", "header", "reserved flags are set", 3)] * bool(data[3] & 0xE0)


def _bzip2_issues(data: bytes) -> list:
    if data[:3] != b"BZh":
        return [("ERROR", "header", "no bzip2 header", 0)]
    out = [] if data[3:4] in b"123456789" and data[3:4] else [("ERROR", "header", "block size is not 1 to 9", 3)]
    return out + [("ERROR", "block", "no block magic", 4)] * (data[4:10] not in (b"1AY&SY", b"\x17rE8P\x90"))


def _xz_issues(data: bytes) -> list:
    if data[:6] != b"\xfd7zXZ\0":
        return [("ERROR", "header", "no xz header", 0)]
    out = [("ERROR", "header", "flags have the wrong checksum", 8)] * (len(data) < 12 or zlib.crc32(data[6:8]) != int.from_bytes(data[8:12], "little"))
    return out + [("ERROR", "footer", "no footer magic", len(data) - 2)] * (data.rstrip(b"\0")[-2:] != b"YZ")


def _zstd_issues(data: bytes) -> list:
    if data[:4] != b"\x28\xb5\x2f\xfd":
        return [("ERROR", "header", "no frame magic", 0)]
    return [("ERROR", "header", "reserved bit is set", 4)] if len(data) < 5 or data[4] & 8 else []


def _sevenz_issues(data: bytes) -> list:
    if len(data) < 32 or data[:6] != b"7z\xbc\xaf\x27\x1c":
        return [("ERROR", "header", "no signature header", 0)]
    if zlib.crc32(data[12:32]) != int.from_bytes(data[8:12], "little"):
        return [("ERROR", "header", "start header has the wrong checksum", 8)]
    start, size, crc = struct.unpack_from("<QQI", data, 12)
    body = data[32 + start : 32 + start + size]
    if len(body) < size:
        return [("ERROR", "header", "next header goes beyond the file", 12)]
    return [("ERROR", "header", "next header has the wrong checksum", 28)] * (zlib.crc32(body) != crc)


# -- writing ----------------------------------------------------------------------------------


def pack_zip(rows: list[tuple[str, bytes, int | None]], level: int = 6) -> bytes:
    """A ZIP file of (path, payload, mtime), level 0 stored; equal rows give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if level else zipfile.ZIP_STORED, compresslevel=level or None) as archive:
        for path, body, mtime in rows:
            when = datetime.fromtimestamp(max(315_532_800, mtime or 0), UTC).timetuple()[:6]
            info = zipfile.ZipInfo(path, when)
            info.compress_type = zipfile.ZIP_DEFLATED if level and body else zipfile.ZIP_STORED
            info.external_attr = (0o40755 << 16 | 16) if path.endswith("/") else 0o100644 << 16
            archive.writestr(info, body or b"")
    return out.getvalue()


def pack_tar(rows: list[tuple[str, bytes, int | None]], stream: str = "") -> bytes:
    """A PAX TAR file, plain or through gz, bz2, xz or zst."""
    plain = io.BytesIO()
    with tarfile.open(fileobj=plain, mode="w", format=tarfile.PAX_FORMAT) as archive:
        for path, body, mtime in rows:
            info = tarfile.TarInfo(path.rstrip("/"))
            info.mtime, info.type = mtime or 0, tarfile.DIRTYPE if path.endswith("/") else tarfile.REGTYPE
            info.size, info.mode = 0 if info.isdir() else len(body or b""), 0o755 if info.isdir() else 0o644
            archive.addfile(info, None if info.isdir() else io.BytesIO(body or b""))
    raw = plain.getvalue()
    if stream == "gz":
        made = zlib.compressobj(6, zlib.DEFLATED, 31)
        return made.compress(raw) + made.flush()
    return {"": lambda x: x, "bz2": bz2.compress, "xz": lzma.compress, "zst": lambda x: zstandard.ZstdCompressor(level=3).compress(x)}[stream](raw)
