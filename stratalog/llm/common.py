"""What the operators of this subpackage share: tables, shared folders, and NumPy over Arrow text.

Text columns are worked on as the UTF-8 bytes of an Arrow batch.  A batch is cut into pieces of a
bounded number of bytes first, so that memory does not follow the batch size Spark chose.
"""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a piece of a batch holds at most (one row may be longer).
PIECE_BYTES = 2 << 20
#: Values hashed at a time, and white space of the word contracts: the space and the five control characters 0x09 to 0x0D.
BLOCK = 4 << 20
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the rows no model may learn from: crc32 of the decimal id leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


# -- shared folders ---------------------------------------------------------------------------


def shared_root(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir.  Where it is unset, a session on one machine gets one of its own; a cluster must name one."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stratalog-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)


#: Removes a query's shuffle files when it ends, so that steps do not add up on disk; a table is all that is read again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
#: What sessions had set, and how many writes go on in them.
_WRITING: dict[str, list] = {}


@contextlib.contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """The cleanup holds while any write goes on in the session: the first sets it, the last puts back what was there."""
    key = spark._jsparkSession.sessionUUID()
    with _LOCK:
        state = _WRITING.setdefault(key, [spark.conf.get(_CLEANUP, "false"), 0])
        state[1] += 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            state[1] -= 1
            if not state[1]:
                spark.conf.set(_CLEANUP, state[0])
                del _WRITING[key]


def written(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, in one folder for each value of a column if asked.

    The folder goes when its successor is written (``discard``), or else when the JVM ends, also if the session was stopped before.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/stratalog-{what}-{uuid.uuid4().hex[:12]}"
    try:
        with cleaning(spark):
            writer = df.write.option("compression", "zstd")
            (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        files, where = _file_system(spark, path)
        files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables of written() that no plan reads any more."""
    for table in tables:
        # a column of that name is no path
        if isinstance(path := getattr(table, "scratch_path", None), str):
            delete(table.sparkSession, path)


def free_name(columns: list[str], name: str) -> str:
    """The name, with as many underscores more as it takes to clash with no column, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(columns: list[str]) -> list[Column]:
    """Columns by their exact names, dots and back quotes included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def undotted(df: DataFrame) -> DataFrame:
    """df with plain names for the columns that Python functions cannot be given by name; toDF with the old names turns it back."""
    names = list(df.columns)
    for k, name in enumerate(names):
        if "." in name or "`" in name:
            names[k] = free_name(names, f"__column{k}")
    return df.toDF(*names)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -- text of Arrow batches --------------------------------------------------------------------


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches where the text of a column would pass the limit."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows; a null is an empty row."""
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def byte_class(members: bytes | range | list[int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


class Words:
    """Where the words of a piece are.

    starts, ends: byte positions; of: n + 1 offsets into them, by row.  Words do not cross rows.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        inside = np.zeros(len(data) + 1, dtype=bool)
        inside[:-1] = is_word[data]
        before = np.zeros(len(data) + 1, dtype=bool)
        before[1:] = inside[:-1]
        before[offsets] = False  # a row starts anew
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(data) + 1, dtype=bool)
        after[:-1] = inside[1:]
        cuts = offsets[offsets > 0] - 1
        after[cuts] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.of = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def row_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))

    def hashes(self, seed: int = 1) -> np.ndarray:
        """64 bits for each word."""
        return _span_hashes(self.data, self.starts, self.ends, seed)

    def some_hashes(self, some: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
        """64 bits for the beginnings of some words, up to the given ends."""
        return _span_hashes(self.data, self.starts[some], ends, seed)

    def windows(self, word_hashes: np.ndarray, n: int, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each n-word window that lies in one row, and the window's 64-bit hash."""
        m = len(word_hashes)
        if m < n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        left = np.repeat(self.of[1:], np.diff(self.of)) - np.arange(m)
        first = np.flatnonzero(left >= n)
        out = np.empty(len(first), dtype=np.uint64)
        for at in range(0, len(first), BLOCK):
            some = first[at : at + BLOCK]
            if len(some):
                base = some[0]
                out[at : at + BLOCK] = _spans(word_hashes[base : some[-1] + n], some - base, some + n - base, seed)
        return first, out

    def text(self, first: int, n: int) -> bytes:
        """n words from the first one on, joined by one space."""
        data = self.data
        return b" ".join(data[a:b].tobytes() for a, b in zip(self.starts[first : first + n], self.ends[first : first + n], strict=True))


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64 bits for each span of bytes, from sums of byte codes times powers modulo 2^64 (in blocks, so that long rows need no long tables)."""
    codes, out = _codes(seed), np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        out[at:stop] = _spans(codes[data[base : ends[stop - 1]]], starts[at:stop] - base, ends[at:stop] - base, seed)
        at = stop
    return out


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A hash of values[start:end] for each span, that does not depend on where the span is."""
    up, down = _powers(len(values), seed)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: all output bits depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_CODES: dict[int, np.ndarray] = {}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _codes(seed: int) -> np.ndarray:
    if seed not in _CODES:
        _CODES[seed] = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return _CODES[seed]


def _powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, n + 1 at least."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) <= n:
        base = int(mixed(np.array([seed * 2 + 11], dtype=np.uint64))[0]) | 5
        size = 1 << max(16, (n + 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        have = _POWERS[seed] = (made[0], made[1])
    return have


def covered(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """True for the words that a window of n words starting at one of the given words covers."""
    edge = np.zeros(size + 1, dtype=np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(first + n, size), -1)
    return np.cumsum(edge[:-1]) > 0


def per_row(mask: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many of each row's words are marked."""
    sums = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[of[1:]] - sums[of[:-1]]


# -- bounded training samples -----------------------------------------------------------------


def hash_rank(*columns: str) -> Column:
    """A number in [0, 1) that the values of the columns decide."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / float(1 << 53)


def sampled(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most limit rows, chosen by the hash of a key, alike on every run; a sieve by expected share goes first."""
    share = min(1.0, 1.2 * limit / max(1, df.count()))
    return df.withColumn("__rank", hash_rank(key)).where(F.col("__rank") < share).orderBy("__rank", key).limit(limit).drop("__rank")


def within(df: DataFrame, size: Column, room: int, *order: str) -> DataFrame:
    """The first rows in an order, as long as the sizes of those before them add up to less than the room: what goes to the driver is bounded here, in Spark.

    df has a bounded number of rows already (see sampled); the window is over those.
    """
    before = F.coalesce(F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__before", before).where(F.col("__before") < room).drop("__before")
