"""Derived columns of archive paths, sizes and times, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- names ------------------------------------------------------------------------------------


def basename(path: Column) -> Column:
    """What follows the last slash; empty for ``dir/``."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the name; empty for dot files and trailing dots."""
    return F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1)


def parent(path: Column) -> Column:
    """The path without its last component; empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def completion_parts(text: Column) -> tuple[Column, Column]:
    """What a completion looks in, and what it looks for: split after the last slash."""
    return F.regexp_extract(text, r"^(.*/)?[^/]*$", 1), basename(text)


def segments(path: Column) -> Column:
    """Non-empty components."""
    return F.filter(F.split(path, "/"), lambda s: s != "")


def depth(path: Column) -> Column:
    return F.size(segments(path))


def strip_components(path: Column, count: int) -> Column:
    """Without the first components (leading slashes and one ``./`` go first); null if nothing is left."""
    if count == 0:
        return path
    return F.nullif(F.regexp_extract(F.regexp_replace(path, r"^/*(\./+)?", ""), rf"^(?:[^/]+/+){{{count}}}(.*)$", 1), F.lit(""))


def normalised(path: Column) -> Column:
    """Backslashes as slashes, doubled slashes once, no ``./`` in front, no slash at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/{2,}", "/"), r"^(\./)+", ""), "(?<=.)/$", "")


def expand_home(path: Column, home: str) -> Column:
    return F.when(path == "~", F.lit(home)).when(path.startswith("~/"), F.concat(F.lit(home), F.substring(path, 2, 1 << 20))).otherwise(path)


# -- numbers ----------------------------------------------------------------------------------


def compression_ratio(compressed: Column, size: Column) -> Column:
    """Per cent; null where the size is 0."""
    return F.try_divide(compressed * 100.0, size)


def savings(original: Column, compressed: Column) -> Column:
    """Per cent saved, never negative; 0 where there was nothing."""
    return F.coalesce(F.greatest(F.lit(0.0), (1 - F.try_divide(compressed, original)) * 100.0), F.lit(0.0))


def human_size(size: Column, trim: bool = True) -> Column:
    """``1 KB`` or, without trim, ``1.0 KB``; two digits from GB on."""

    def in_unit(unit: int, name: str) -> Column:
        value = size / float(unit)
        one = F.format_string(f"%.1f {name}", F.bround(value, 1))  # ties to even
        if not trim:
            return one
        whole = F.round((value - F.floor(value)) * 10) == 0
        return F.when(whole, F.format_string(f"%.0f {name}", value)).otherwise(one)

    return (
        F.when(size < 1 << 10, F.format_string("%d B", size))
        .when(size < 1 << 20, in_unit(1 << 10, "KB"))
        .when(size < 1 << 30, in_unit(1 << 20, "MB"))
        .otherwise(F.format_string("%.2f GB", F.bround(size / float(1 << 30), 2)))
    )


# -- kinds ------------------------------------------------------------------------------------

#: Media types by extension.
MIME = {
    "swift": "text/x-swift", "js": "application/javascript", "json": "application/json", "html": "text/html", "css": "text/css",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "pdf": "application/pdf",
    "zip": "application/zip", "7z": "application/x-7z-compressed", "tar": "application/x-tar", "gz": "application/gzip", "zst": "application/zstd",
    "txt": "text/plain", "md": "text/markdown", "c": "text/x-c", "cpp": "text/x-c++", "h": "text/x-chdr", "py": "text/x-python",
    "rs": "text/x-rust", "go": "text/x-go", "xml": "application/xml", "mp3": "audio/mpeg", "mp4": "video/mp4", "mov": "video/quicktime",
}


def lookup(key: Column, table: dict[str, str], otherwise: str | None = None) -> Column:
    """A small constant table as a map literal."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(pairs, key)
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def mime(path: Column) -> Column:
    return lookup(F.lower(extension(path)), MIME, "application/octet-stream")


#: Container and filter by file name ending.
ENDINGS = {
    ".tar.gz": ("tar", "gzip"), ".tgz": ("tar", "gzip"), ".tar.bz2": ("tar", "bzip2"), ".tbz2": ("tar", "bzip2"), ".tbz": ("tar", "bzip2"),
    ".tar.xz": ("tar", "xz"), ".txz": ("tar", "xz"), ".tar.zst": ("tar", "zstd"), ".tzst": ("tar", "zstd"), ".tar.lz4": ("tar", "lz4"),
    ".tar.br": ("tar", "brotli"), ".tar.lz": ("tar", "lzip"), ".tar.lrz": ("tar", "lrzip"),
    ".zip": ("zip", "none"), ".zipx": ("zip", "none"), ".7z": ("7z", "none"), ".tar": ("tar", "none"), ".cpio": ("cpio", "none"),
    ".a": ("ar", "none"), ".ar": ("ar", "none"), ".iso": ("iso", "none"), ".wim": ("wim", "none"),
    ".gz": ("raw", "gzip"), ".bz2": ("raw", "bzip2"), ".xz": ("raw", "xz"), ".zst": ("raw", "zstd"), ".lz4": ("raw", "lz4"),
    ".br": ("raw", "brotli"), ".lz": ("raw", "lzip"), ".lrz": ("raw", "lrzip"),
}


def container_and_filter(path: Column) -> Column:
    """struct(container, filter) by the longest known ending; a plain zip where none is known."""
    out = F.struct(F.lit("zip").alias("container"), F.lit("none").alias("filter"))
    low = F.lower(path)
    for ending in sorted(ENDINGS, key=lambda e: (len(e), e)):
        container, stream = ENDINGS[ending]
        out = F.when(low.endswith(ending), F.struct(F.lit(container).alias("container"), F.lit(stream).alias("filter"))).otherwise(out)
    return out


# -- times ------------------------------------------------------------------------------------


def dos_to_epoch(date: Column, time: Column) -> Column:
    """Seconds since 1970 of a packed date and time, read as UTC; null for impossible ones."""
    made = F.try_make_timestamp(
        (F.shiftright(date, 9) + 1980).cast("int"), F.shiftright(date, 5).bitwiseAND(15), date.bitwiseAND(31), F.shiftright(time, 11).cast("int"), F.shiftright(time, 5).bitwiseAND(63), (time.bitwiseAND(31) * 2).cast("decimal(8,6)"), F.lit("UTC")
    )
    return made.cast("long")


def epoch_to_dos(epoch: Column) -> tuple[Column, Column]:
    """Packed date and time of seconds since 1970, in UTC; years outside 1980 to 2107 are held at the ends, seconds go down to even."""
    held = F.greatest(F.lit(315_532_800), F.least(F.lit(4_354_819_198), epoch))
    at, day = F.timestamp_seconds(held), held % 86_400
    date = F.shiftleft(F.year(at) - 1980, 9).bitwiseOR(F.shiftleft(F.month(at), 5)).bitwiseOR(F.dayofmonth(at))
    time = F.shiftleft((day / 3600).cast("int"), 11).bitwiseOR(F.shiftleft((day % 3600 / 60).cast("int"), 5)).bitwiseOR((day % 60 / 2).cast("int"))
    return date, time


def pax_time(text: Column) -> Column:
    """struct(secs, nanos) of ``secs[.fraction]``, the fraction cut or filled to nine digits; null for anything else."""
    good = text.rlike(r"^-?\d+(\.\d*)?$")
    secs = F.regexp_extract(text, r"^(-?\d+)", 1).try_cast("long")
    nanos = F.rpad(F.substring(F.regexp_extract(text, r"\.(\d*)$", 1), 1, 9), 9, "0").try_cast("int")
    return F.when(good, F.struct(secs.alias("secs"), F.coalesce(nanos, F.lit(0)).alias("nanos")))


# -- junk and metadata ------------------------------------------------------------------------

#: Names of version-control and system files.
VCS_NAMES = (".git", ".svn", ".hg", ".bzr", "CVS", "_darcs", ".hgignore", ".gitignore", ".gitmodules", ".gitattributes", ".gitkeep", ".hgtags", ".svnignore", ".bzrignore")
JUNK_NAMES = (".DS_Store", "__MACOSX", ".Spotlight-V100", ".Trashes", ".fseventsd", ".TemporaryItems", ".VolumeIcon.icns", "Thumbs.db", "$RECYCLE.BIN", "ehthumbs.db", "Desktop.ini")
JUNK_PARTS = (".DS_Store", "__MACOSX", "Thumbs.db", ".Spotlight-V100", ".Trashes")
JUNK_FILES = (".DS_Store", ".localized", ".VolumeIcon.icns")
JUNK_STARTS = ("._", ".Spotlight-V100", ".Trashes", ".fseventsd", ".TemporaryItems", "PaxHeader")
JUNK_ANY_CASE = ("thumbs.db", "desktop.ini", "ehthumbs.db")


def has_component(path: Column, names: Iterable[str]) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def is_vcs(path: Column) -> Column:
    return has_component(path, VCS_NAMES)


def is_junk(path: Column, variant: str = "components") -> Column:
    """Four readings of what system junk is: by components, by substrings, by archive entry name, and by what a reader hides."""
    if variant == "components":
        return has_component(path, JUNK_NAMES) | F.exists(F.split(path, "/"), lambda s: s.startswith("._"))
    if variant == "substrings":
        out = basename(path).startswith("._")
        for part in JUNK_PARTS:
            out = out | path.contains(part)
        return out
    if variant == "entry":
        clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(\./)+", ""), "^/+|/+$", "")
        name = basename(clean)
        out = (clean == "__MACOSX") | clean.startswith("__MACOSX/") | name.isin(*JUNK_FILES) | F.lower(name).isin(*JUNK_ANY_CASE)
        for start in JUNK_STARTS:
            out = out | name.startswith(start)
        return out
    if variant == "reader":
        name = basename(path)
        return name.startswith("._") | (name == ".DS_Store") | path.startswith("PaxHeader") | path.contains("/PaxHeader")
    raise ValueError(f"unknown variant {variant!r}")


# -- safety as expressions --------------------------------------------------------------------


def is_extractable(path: Column) -> Column:
    """The strict check before extraction: relative, no drive, no scheme, no parent, no dots only, not empty."""
    slashes = F.regexp_replace(path, r"\\", "/")
    names = F.filter(F.split(slashes, "/"), lambda s: (s != "") & (s != "."))
    bad = F.exists(names, lambda s: s.contains("..") | s.rlike(r"^\.+$"))
    return ~(path.rlike(r"^[A-Za-z]:|^[/\\]|://|\x00") | bad) & (F.size(names) > 0)
