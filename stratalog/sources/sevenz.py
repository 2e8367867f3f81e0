"""7z headers: entries, where each lies, and payloads of folders whose coders form a chain.  Plain Python, no Spark."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

MAGIC = b"7z\xbc\xaf\x27\x1c"
END, HEADER, ARCHIVE, STREAMS, FILES, PACK, UNPACK, SUBSTREAMS, SIZE, CRC, FOLDER, CODERS_SIZE, NUM_STREAMS = 0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13
EMPTY_STREAM, EMPTY_FILE, NAMES, MTIME, ATTRIBUTES, ENCODED = 14, 15, 17, 20, 21, 23
#: Coder ids.
CODERS = {b"\x00": "copy", b"\x21": "lzma2", b"\x03\x01\x01": "lzma", b"\x04\x01\x08": "deflate", b"\x04\x02\x02": "bzip2", b"\x06\xf1\x07\x01": "aes"}
#: Ids of the filters that go before a coder, by the name liblzma has for them.
FILTERS = {b"\x03\x03\x01\x03": "X86", b"\x03\x03\x02\x05": "POWERPC", b"\x03\x03\x04\x01": "IA64", b"\x03\x03\x05\x01": "ARM", b"\x03\x03\x07\x01": "ARMTHUMB", b"\x03\x03\x08\x05": "SPARC", b"\x03": "DELTA"}
CODERS |= {k: v.lower() for k, v in FILTERS.items()}
_EPOCH = 116_444_736_000_000_000


class SevenZipError(ValueError):
    """A header that is broken, encrypted or of a kind that is not read."""


class Coder(NamedTuple):
    name: str
    properties: bytes


class Folder(NamedTuple):
    """coders as listed, the order to undo them in (None if they are no chain), packed streams, and the sizes that each coder gives, the folder's own first."""

    coders: list[Coder]
    chain: list[int] | None
    packed: int
    sizes: list[int]
    size: int


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise SevenZipError("a field goes beyond the header")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """The leading ones of the first byte count the bytes that follow; its other bits are the highest."""
        first, extra = self.byte(), 0
        while extra < 8 and first & 0x80 >> extra:
            extra += 1
        low = int.from_bytes(self.take(extra), "little")
        return low + ((first & (0x7F >> extra)) << 8 * extra)

    def count(self) -> int:
        """A number of things, each of which takes a bit of the header at least."""
        n = self.number()
        if n > 8 * len(self.data):
            raise SevenZipError("a count goes beyond the header")
        return n

    def bits(self, n: int) -> list[bool]:
        raw = self.take(-(-n // 8))
        return [bool(raw[i // 8] & 0x80 >> i % 8) for i in range(n)]

    def flags(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)

    def checksums(self, n: int) -> list[int | None]:
        return [int.from_bytes(self.take(4), "little") if known else None for known in self.flags(n)]

    def expect(self, kind: int) -> None:
        if self.byte() != kind:
            raise SevenZipError(f"expected property {kind} at {self.at - 1}")


class Streams(NamedTuple):
    start: int
    packed: list[int]
    folders: list[Folder]
    counts: list[int]
    sizes: list[int]
    checksums: list[int | None]


def read_streams(r: Reader) -> Streams:
    start, packed, folders, sizes, known = 0, [], [], [], []
    counts: list[int] | None = None
    sub_sizes: list[int] = []
    sub_checksums: list[int | None] = []
    while (kind := r.byte()) != END:
        if kind == PACK:
            start, n = r.number(), r.count()
            while (inner := r.byte()) != END:
                if inner == SIZE:
                    packed = [r.number() for _ in range(n)]
                elif inner == CRC:
                    r.checksums(n)
        elif kind == UNPACK:
            r.expect(FOLDER)
            n = r.count()
            if r.byte():
                raise SevenZipError("folders outside the header are not read")
            coders = [read_coders(r) for _ in range(n)]
            r.expect(CODERS_SIZE)
            sizes = [[r.number() for _ in made] for made, _, _ in coders]
            known = [None] * n
            while (inner := r.byte()) != END:
                if inner == CRC:
                    known = r.checksums(n)
            folders = [Folder(made, chain, streams, s, s[chain[-1]] if chain else s[0] if s else 0) for (made, chain, streams), s in zip(coders, sizes, strict=True)]
        elif kind == SUBSTREAMS:
            counts = [1] * len(folders)
            inner = r.byte()
            if inner == NUM_STREAMS:
                counts = [r.count() for _ in folders]
                inner = r.byte()
            for folder, n in zip(folders, counts, strict=True):
                each = [r.number() for _ in range(n - 1)] if inner == SIZE else []
                sub_sizes += [*each, folder.size - sum(each)] if n else []
            if inner == SIZE:
                inner = r.byte()
            open_ = [k for k, n in enumerate(counts) if n != 1 or known[k] is None]
            digests = r.checksums(sum(counts[k] for k in open_)) if inner == CRC else [None] * sum(counts)
            for k, n in enumerate(counts):
                sub_checksums += digests[:n] if k in open_ else [known[k]]
                digests = digests[n:] if k in open_ else digests
            while inner != END:
                inner = r.byte()
        else:
            raise SevenZipError(f"unknown property {kind}")
    if counts is None:
        counts, sub_sizes, sub_checksums = [1] * len(folders), [f.size for f in folders], list(known)
    return Streams(start, packed, folders, counts, sub_sizes, sub_checksums)


def read_coders(r: Reader) -> tuple[list[Coder], list[int] | None, int]:
    """The coders of a folder, the order in which they are undone, and the number of its packed streams."""
    coders, ins, outs = [], 0, 0
    for _ in range(r.count()):
        flag = r.byte()
        name = r.take(flag & 15)
        n_in, n_out = (r.count(), r.count()) if flag & 16 else (1, 1)
        ins, outs = ins + n_in, outs + n_out
        coders.append(Coder(CODERS.get(name, name.hex()), r.take(r.number()) if flag & 32 else b""))
    bound = {}  # the input that each output goes to
    for _ in range(outs - 1):
        into, out = r.number(), r.number()
        bound[out] = into
    packed = ins - (outs - 1)
    if packed > 1:
        [r.number() for _ in range(packed)]
    if ins != len(coders) or outs != len(coders) or packed != 1:
        return coders, None, packed
    chain = [k for k in range(ins) if k not in bound.values()][:1]
    while chain and chain[-1] in bound and len(chain) <= len(coders):
        chain.append(bound[chain[-1]])
    return coders, chain if len(chain) == len(coders) == len(set(chain)) else None, packed


def unpacked(folder: Folder, raw: bytes) -> bytes:
    """The bytes of a folder, its coders undone one after the other."""
    if folder.chain is None:
        raise SevenZipError("the folder's coders are no chain")
    for k in folder.chain:
        raw = decoded(folder.coders[k], raw, folder.sizes[k])
    return raw


def unfiltered(name: str, properties: bytes, data: bytes) -> bytes:
    """What a filter made of data is undone by liblzma, which has filters before LZMA2 only: data is packed by that, and unpacked through both."""
    kind = {"id": getattr(lzma, f"FILTER_{name.upper()}")}
    if name == "delta":
        kind["dist"] = properties[0] + 1 if properties else 1
    last = {"id": lzma.FILTER_LZMA2, "preset": 0}
    return lzma.decompress(lzma.compress(data, lzma.FORMAT_RAW, filters=[last]), lzma.FORMAT_RAW, filters=[kind, last])


def decoded(coder: Coder, raw: bytes, size: int) -> bytes:
    """size bytes that a coder gives."""
    match coder.name:
        case "copy":
            return raw[:size]
        case name if name.upper() in FILTERS.values():
            return unfiltered(name, coder.properties, raw[:size])
        case "deflate":
            return zlib.decompressobj(-15).decompress(raw, size)
        case "bzip2":
            return bz2.decompress(raw)[:size]
        case "lzma":
            first, dictionary = coder.properties[0], int.from_bytes(coder.properties[1:5], "little")
            chain = [{"id": lzma.FILTER_LZMA1, "dict_size": max(4096, dictionary), "lc": first % 9, "lp": first // 9 % 5, "pb": first // 45}]
        case "lzma2":
            p = coder.properties[0]
            chain = [{"id": lzma.FILTER_LZMA2, "dict_size": 0xFFFFFFFF if p == 40 else (2 | p & 1) << p // 2 + 11}]
        case other:
            raise SevenZipError(f"coder {other} is not read")
    return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=chain).decompress(raw, size)


def header(data: bytes) -> Reader:
    """The header proper, unpacked if it is packed."""
    if len(data) < 32 or data[:6] != MAGIC:
        raise SevenZipError("no signature header")
    start, size, checksum = struct.unpack_from("<QQI", data, 12)
    raw = data[32 + start : 32 + start + size]
    if len(raw) < size or zlib.crc32(raw) != checksum:
        raise SevenZipError("the header is cut or has the wrong checksum")
    r = Reader(raw)
    while size and (kind := r.byte()) == ENCODED:
        s = read_streams(r)
        if len(s.folders) != 1 or len(s.packed) != 1:
            raise SevenZipError("the header is in several streams")
        r = Reader(unpacked(s.folders[0], data[32 + s.start : 32 + s.start + s.packed[0]]))
    if size and kind != HEADER:
        raise SevenZipError("no header")
    return r


def entries(data: bytes, with_payload: bool = False) -> Iterator[dict]:
    """Rows of the archive, with the place of each file: ``folder`` and ``offset`` in it, in extra."""
    r = header(data)
    if not r.data:
        return
    streams = Streams(0, [], [], [], [], [])
    kind = r.byte()
    if kind == ARCHIVE:
        while r.byte() != END:
            r.take(r.number())
        kind = r.byte()
    if kind == STREAMS:
        streams = read_streams(r)
        kind = r.byte()
    if kind != FILES:
        return
    n = r.count()
    names, times, attributes, without, empty = [""] * n, [None] * n, [None] * n, [False] * n, []
    while (kind := r.byte()) != END:
        part = Reader(r.take(r.number()))
        if kind == EMPTY_STREAM:
            without = part.bits(n)
        elif kind == EMPTY_FILE:
            empty = part.bits(sum(without))
        elif kind == NAMES and not part.byte():
            names = part.data[1:].decode("utf-16-le", "replace").split("\0")[:n]
        elif kind in (MTIME, ATTRIBUTES):
            known = part.flags(n)
            if not part.byte():
                values = [int.from_bytes(part.take(8 if kind == MTIME else 4), "little") if k else None for k in known]
                times, attributes = (values, attributes) if kind == MTIME else (times, values)
    names += [""] * (n - len(names))
    if sum(streams.counts) != n - sum(without) or len(streams.sizes) != sum(streams.counts) or len(streams.checksums) != len(streams.sizes) or sum(f.packed for f in streams.folders) != len(streams.packed):
        raise SevenZipError("streams and files do not match")
    empty_file = iter(empty + [False] * (sum(without) - len(empty)))
    places = iter(_places(streams))
    starts, at = [], 32 + streams.start
    packed = iter(streams.packed)
    for folder in streams.folders:
        sizes = [next(packed) for _ in range(folder.packed)]
        starts.append((at, sizes[0] if sizes else 0))
        at += sum(sizes)
    cache: tuple[int, bytes | None] = (-1, None)
    for k in range(n):
        folder, offset, size, checksum = (None, None, 0, None) if without[k] else next(places)
        is_dir = without[k] and not next(empty_file)
        coders = streams.folders[folder].coders if folder is not None else []
        mode = attributes[k] >> 16 & 0o7777 if attributes[k] is not None and attributes[k] & 0x8000 else None
        row = {
            "entry_idx": k, "path": names[k] + "/" * is_dir, "uncompressed_size": size, "compressed_size": None, "crc32": checksum, "mtime_epoch": (times[k] - _EPOCH) // 10_000_000 if times[k] else None, "mode": mode, "is_directory": is_dir,
            "is_encrypted": any(c.name == "aes" for c in coders), "method": "+".join(c.name for c in coders) or "store", "link_target": None, "extra": {} if folder is None else {"folder": str(folder), "offset": str(offset)},
        }
        if with_payload:
            row["payload"] = None if is_dir else b""
            if folder is not None:
                if cache[0] != folder:
                    where, length = starts[folder]
                    try:
                        cache = (folder, unpacked(streams.folders[folder], data[where : where + length]))
                    except (SevenZipError, lzma.LZMAError, zlib.error, OSError):
                        cache = (folder, None)
                row["payload"] = None if cache[1] is None else cache[1][offset : offset + size]
        yield row


def _places(s: Streams) -> Iterator[tuple[int, int, int, int | None]]:
    """folder, offset, size and checksum of each file that has a stream, in order."""
    each = zip(s.sizes, s.checksums, strict=True)
    for folder, n in enumerate(s.counts):
        offset = 0
        for _ in range(n):
            size, checksum = next(each)
            yield folder, offset, size, checksum
            offset += size
