"""Format detection by magic bytes, as one CASE over slices of the payload."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Signature(NamedTuple):
    """magic stands at ``offset`` (from the end if negative) of payloads of at least ``least`` bytes."""

    format: str
    offset: int
    magic: str
    least: int
    description: str


#: Signatures by falling priority.
SIGNATURES = (
    Signature("7z", 0, "377ABCAF271C", 6, "7-Zip archive"),
    Signature("xz", 0, "FD377A585A00", 6, "XZ stream"),
    Signature("rar", 0, "526172211A070100", 8, "RAR 5 archive"),
    Signature("rar", 0, "526172211A0700", 7, "RAR 4 archive"),
    Signature("zstd", 0, "28B52FFD", 4, "Zstandard stream"),
    Signature("xar", 0, "78617221", 4, "XAR archive"),
    Signature("wim", 0, "4D5357494D000000", 208, "Windows image"),
    Signature("cab", 0, "4D534346", 4, "Cabinet archive"),
    Signature("ar", 0, "213C617263683E0A", 8, "Unix archive"),
    Signature("snappy", 0, "FF060000734E61507059", 10, "Snappy framed stream"),
    Signature("lzip", 0, "4C5A4950", 6, "Lzip stream"),
    Signature("lrzip", 0, "4C525A49", 6, "Long-range zip stream"),
    Signature("aar", 0, "41413031", 4, "Apple archive"),
    Signature("aar", 0, "41454131", 4, "Apple encrypted archive"),
    Signature("lz4", 0, "04224D18", 4, "LZ4 framed stream"),
    Signature("lzfse", 0, "6276782D", 4, "LZFSE stream"),
    Signature("zip", 0, "504B0304", 4, "ZIP archive"),
    Signature("zip", 0, "504B0506", 4, "empty ZIP archive"),
    Signature("gzip", 0, "1F8B", 2, "gzip stream"),
    Signature("bzip2", 0, "425A68", 3, "bzip2 stream"),
    Signature("tar", 257, "757374617200", 512, "POSIX tar archive"),
    Signature("tar", 257, "7573746172202000", 512, "GNU tar archive"),
    Signature("iso", 0x8001, "4344303031", 32768 + 2048, "ISO 9660 image"),
    Signature("dmg", -512, "6B6F6C79", 512, "Apple disk image"),
    Signature("lzh", 2, "2D6C68", 24, "LHA archive"),
)
COMPOUND = {"gzip": (".tar.gz", ".tgz"), "bzip2": (".tar.bz2", ".tbz2", ".tbz"), "xz": (".tar.xz", ".txz"), "zstd": (".tar.zst", ".tzst"), "lz4": (".tar.lz4",)}
#: The end record of a ZIP file lies in so many last bytes; an embedded archive is looked for in the whole payload, so many bytes at a time.
END_WINDOW, EMBEDDED_STEP = 65_557, 65_536
_EMBEDDED = (("zip", b"PK\x03\x04"), ("7z", b"7z\xbc\xaf\x27\x1c"), ("rar", b"Rar!\x1a\x07"))


def _bytes(payload: Column, start: int, size: int) -> Column:
    return F.substring(payload, start + 1 if start >= 0 else start, size)


def _latin(payload: Column) -> Column:
    """Whole bytes as Latin-1 text, so that string functions search them."""
    return F.decode(payload, "ISO-8859-1")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which value is computed once however often it is named."""
    return F.transform(F.array(value), use)[0]


def _first(payload: Column, magic: bytes, start: int) -> Column:
    """Where magic first stands in payload from start on, or NULL."""

    def within(at: Column) -> Column:
        return F.nullif(F.instr(_latin(F.substring(payload, at + 1, F.lit(EMBEDDED_STEP + len(magic) - 1))), magic.decode("latin-1")), F.lit(0)) + at - 1

    return F.array_min(F.transform(F.sequence(F.lit(start), F.greatest(F.length(payload), F.lit(start)), F.lit(EMBEDDED_STEP)), within))


def sniff(payload: Column, name: Column | None = None) -> Column:
    """struct(format, compound, description, confidence, embedded_at) of a binary column."""

    def row(kind: str, description: str, confidence: int, at: Column | None = None) -> Column:
        compound = F.lit(None).cast("string")
        if name is not None and kind in COMPOUND:
            tar = F.lower(name).rlike("(" + "|".join(e.replace(".", r"\.") for e in COMPOUND[kind]) + ")$")
            compound = F.when(tar, f"tar.{kind}")
        return F.struct(F.lit(kind).alias("format"), compound.alias("compound"), F.lit(description).alias("description"), F.lit(confidence).alias("confidence"), (at if at is not None else F.lit(None).cast("int")).alias("embedded_at"))

    def inside(places: Column) -> Column:
        out = row("unknown", "unknown", 0)
        for kind, _ in reversed(_EMBEDDED):
            out = F.when(places[kind].isNotNull(), row(kind, f"self-extracting {kind} archive", 95, places[kind])).otherwise(out)
        return out

    size = F.length(payload)
    places = _with(payload, lambda p: F.struct(*[_first(p, magic, 64).alias(kind) for kind, magic in _EMBEDDED]))
    out = F.when((size >= 64) & (_bytes(payload, 0, 2) == F.unhex(F.lit("4D5A"))), _with(places, inside)).otherwise(row("unknown", "unknown", 0))
    tail = _latin(F.substring(payload, -END_WINDOW, END_WINDOW))
    out = F.when((size >= 22) & (F.instr(tail, "PK\x05\x06") > 0), row("zip", "ZIP archive by its end record", 90)).otherwise(out)
    for s in reversed(SIGNATURES):
        here = _bytes(payload, s.offset, len(s.magic) // 2)
        out = F.when((size >= s.least) & (here == F.unhex(F.lit(s.magic))), row(s.format, s.description, 100)).otherwise(out)
    return F.when(payload.isNull() | (size == 0), row("unknown", "unknown", 0)).otherwise(out)
