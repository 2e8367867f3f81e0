"""Benchmark decontamination: a broadcast hash set of normalised n-grams of the test items.

Words are runs of digits, ASCII letters (lower-cased) and characters from U+0080 on.  A window is
``width`` consecutive words of an item; an item with fewer words, but some, is one window.  Training
text is scanned once: windows whose hash is in the set are compared word by word, and the words
under a confirmed window are hit.

The set is one buffer of normalised text and, for each window, its hash, its place in the buffer and its item: 28 bytes a window
and the text once.  ``remove_documents`` drops contaminated rows, ``remove_passages`` cuts the hit words out of all.

Defined results: null text has no words and no hits, and stays null; items without words or without an id are left
out; repeated items or rows are judged like any other; an empty benchmark hits nothing, and an empty table has no rows; texts of any
length are scanned whole.  Columns other than the id and the text are not read, so clashing names do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from stratalog.llm import common

WIDTH = 13
#: The set is broadcast up to so many bytes of benchmark text (about seven times that in memory); beyond, window hashes are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Bytes 0x30-0x39 and 0x61-0x7A, and all of a character beyond ASCII.
WORD_BYTES = common.byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


class Hits(NamedTuple):
    """One row: its words, hit words, items, and the byte spans to cut."""

    n_words: int
    n_hit: int
    items: list[str]
    spans: list[tuple[int, int]]


class Windows(NamedTuple):
    """All windows of one width, sorted by hash: where each is in the buffer, and the number of its item."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    items: np.ndarray


class WindowSet:
    """The normalised windows of a benchmark."""

    def __init__(self, rows: list[tuple[str, str]], width: int = WIDTH) -> None:
        words = words_of(pa.array([text for _, text in rows], pa.large_string()))
        sizes = words.ends - words.starts
        place = np.concatenate(([0], np.cumsum(sizes + 1)))
        buffer = np.full(place[-1], 32, dtype=np.uint8)
        inside = np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.arange(sizes.sum()) - inside
        buffer[np.repeat(place[:-1], sizes) + at] = words.data[np.repeat(words.starts, sizes) + at]
        self.buffer = buffer.tobytes()
        self.items = list(dict.fromkeys(item for item, _ in rows))
        known = {item: k for k, item in enumerate(self.items)}
        number = np.array([known[item] for item, _ in rows], dtype=np.int32)
        counts, hashed, self.windows = np.diff(words.of), words.hashes(), {}
        for n in sorted({min(width, c) for c in counts.tolist() if c}):
            first, h = words.windows(hashed, n)
            row = np.searchsorted(words.of, first, side="right") - 1
            if n < width:
                mine = counts[row] == n
                first, h, row = first[mine], h[mine], row[mine]
            order = np.lexsort((number[row], h))
            self.windows[n] = self._distinct(Windows(h[order], place[first][order], (place[first + n - 1] + sizes[first + n - 1])[order], number[row][order]))
        self.marks = {n: marks(w.hashes) for n, w in self.windows.items()}

    def _distinct(self, w: Windows) -> Windows:
        """Without windows that an item has already."""
        keep = np.ones(len(w.hashes), dtype=bool)
        for k in np.flatnonzero((w.hashes[1:] == w.hashes[:-1]) & (w.items[1:] == w.items[:-1])).tolist():
            keep[k + 1] = self.buffer[w.starts[k] : w.ends[k]] != self.buffer[w.starts[k + 1] : w.ends[k + 1]]
        return Windows(*(x[keep] for x in w))

    def items_of(self, n: int, h: np.uint64, text: bytes) -> list[str]:
        """The items that have a window with this text."""
        w = self.windows[n]
        a, b = np.searchsorted(w.hashes, h, side="left"), np.searchsorted(w.hashes, h, side="right")
        return [self.items[w.items[k]] for k in range(a, b) if self.buffer[w.starts[k] : w.ends[k]] == text]

    def scan(self, words: common.Words) -> list[Hits]:
        """Hits of each row of a piece."""
        hit = np.zeros(len(words), dtype=bool)
        rows = len(words.of) - 1
        items: list[set[str]] = [set() for _ in range(rows)]
        if len(words) and self.windows:
            hashed = words.hashes()
            for n, known in self.windows.items():
                first, h = words.windows(hashed, n)
                near = np.flatnonzero(self.marks[n][h >> np.uint64(44)])
                near = near[known.hashes[np.minimum(np.searchsorted(known.hashes, h[near]), len(known.hashes) - 1)] == h[near]]
                found, seen = [], {}
                for i, x, row in zip(first[near].tolist(), h[near], (np.searchsorted(words.of, first[near], side="right") - 1).tolist(), strict=True):
                    text = words.text(i, n)
                    who = seen.get(text)
                    if who is None:
                        who = seen[text] = self.items_of(n, x, text)
                    if who:
                        found.append(i)
                        items[row].update(who)
                if found:
                    hit |= common.covered(np.array(found), n, len(words))
        return hits_of(words, hit, items)


def hits_of(words: common.Words, hit: np.ndarray, items: list[set[str]]) -> list[Hits]:
    n_words, n_hit, out = np.diff(words.of), common.per_row(hit, words.of), []
    for r, (n, k) in enumerate(zip(n_words.tolist(), n_hit.tolist(), strict=True)):
        spans: list[tuple[int, int]] = []
        if k:
            lo, hi, base = words.of[r], words.of[r + 1], words.offsets[r]
            edge = np.diff(np.concatenate(([0], hit[lo:hi].view(np.int8), [0])))
            spans = [(int(words.starts[lo + a] - base), int(words.ends[lo + b - 1] - base)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
        out.append(Hits(n, k, sorted(items[r]), spans))
    return out


def marks(hashes: np.ndarray) -> np.ndarray:
    """One flag for each value of a hash's upper 20 bits."""
    table = np.zeros(1 << 20, dtype=bool)
    table[hashes >> np.uint64(44)] = True
    return table


def split(text: str | None) -> common.Words:
    return words_of(pa.array([text], pa.string()))


def words_of(column: pa.Array) -> common.Words:
    data, offsets = common.utf8(column)
    return common.Words(common.lower_table()[data], offsets, WORD_BYTES)


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:long,end:long>>"
_ARROW = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def contaminated(n_hit: int, n_words: int) -> bool:
    """A twentieth of the words or more are hit."""
    return n_hit > 0 and 20 * n_hit >= n_words


def result(hits: list[Hits]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([h.n_words for h in hits], pa.int64()),
            pa.array([h.n_hit for h in hits], pa.int64()),
            pa.array([len(h.items) for h in hits], pa.int64()),
            pa.array([hashlib.sha256(",".join(h.items).encode()).hexdigest() for h in hits], pa.string()),
            pa.array([contaminated(h.n_hit, h.n_words) for h in hits], pa.bool_()),
            pa.array([h.items for h in hits], _ARROW.field("items").type),
            pa.array([[{"start": a, "end": b} for a, b in h.spans] for h in hits], _ARROW.field("spans").type),
        ],
        schema=_ARROW,
    )


def benchmark_rows(benchmark: DataFrame, limit: int) -> list[tuple[str, str]] | None:
    """Ids and texts of the items, or None if they are larger than the limit; the size is asked for first."""
    kept = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = kept.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    if size > limit:
        return None
    return [(r.item_id, r.text) for r in kept.collect()]


def scan(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, limit: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each document: id, word and hit counts, item list and its digest, verdict, and byte spans of the hits."""
    spark = docs.sparkSession
    rows = benchmark_rows(benchmark, limit)
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    if rows is None:
        return scan_by_join(narrow, benchmark, width).withColumnRenamed("doc_id", id_column)
    shared = spark.sparkContext.broadcast(WindowSet(rows, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, "text"):
            out = result(shared.value.scan(words_of(piece.column("text"))))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *out.columns], names=["doc_id", *out.schema.names])

    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.mapInArrow(run, f"doc_id {kind}, {RESULT}").withColumnRenamed("doc_id", id_column)


def scan_by_join(narrow: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """The same for a benchmark of any size: windows of both sides meet in a shuffle join on their hash.

    The texts of the windows are compared in the join.  Documents are told apart by id and text digest.
    """

    def windows(batches: Iterator[pa.RecordBatch], widths: range | list[int], whole: bool) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, "text", 1 << 18):
            words = words_of(piece.column("text"))
            hashed, counts = words.hashes(), np.diff(words.of)
            for n in widths:
                first, h = words.windows(hashed, n)
                rows = np.searchsorted(words.of, first, side="right") - 1
                if whole and n < width:
                    keep = counts[rows] == n
                    first, h, rows = first[keep], h[keep], rows[keep]
                yield pa.RecordBatch.from_arrays([piece.column("key").take(pa.array(rows)), pa.array(first - words.of[rows], pa.int64()), pa.array(np.full(len(first), n, np.int32)), pa.array(h.view(np.int64)), pa.array([words.text(int(i), n) for i in first], pa.binary())], names=["key", "pos", "n", "h", "w"])

    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("key"), "text")
    theirs = items.mapInArrow(lambda b: windows(b, range(1, width + 1), True), "key string, pos long, n int, h long, w binary").groupBy("n", "h", "w").agg(F.collect_set("key").alias("items"))
    theirs = common.written(theirs, "bench")
    present = sorted(r.n for r in theirs.select("n").distinct().collect())
    keyed = narrow.withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2(F.coalesce("text", F.lit("")), 256)))
    ours = keyed.dropDuplicates(["key"]).mapInArrow(lambda b: windows(b, present, False), "key string, pos long, n int, h long, w binary")
    # a window that a third of the documents have is a skewed key, which adaptive execution splits; items are made distinct as rows
    hits = common.written(ours.join(theirs, ["n", "h", "w"]).select("key", "pos", "n", "items"), "hits")
    who = hits.select("key", F.explode("items").alias("item")).distinct().groupBy("key").agg(F.collect_list("item").alias("who"))
    found = hits.groupBy("key").agg(F.collect_set(F.struct("pos", "n")).alias("at")).join(who, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, "text"):
            words = words_of(piece.column("text"))
            hit, items = np.zeros(len(words), dtype=bool), []
            for r, (at, who) in enumerate(zip(piece.column("at").to_pylist(), piece.column("who").to_pylist(), strict=True)):
                for x in at or ():
                    hit[words.of[r] + x["pos"] : words.of[r] + x["pos"] + x["n"]] = True
                items.append(set(who or ()))
            out = result(hits_of(words, hit, items))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *out.columns], names=["doc_id", *out.schema.names])

    kind = dict(narrow.dtypes)["doc_id"]
    return keyed.join(found, "key", "left").select("doc_id", "text", "at", "who").mapInArrow(run, f"doc_id {kind}, {RESULT}")


def remove_documents(docs: DataFrame, benchmark: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """docs without contaminated rows, all columns as they were.  Rows are judged one by one, so rows with one id may differ."""
    plain = common.undotted(docs)
    judged, hit, _ = _judged(plain, benchmark, limit)
    return judged.where(~F.col(hit)).select(plain.columns).toDF(*docs.columns)


def remove_passages(docs: DataFrame, benchmark: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """docs without the words under windows of the benchmark, contaminated or not, and what is between two such words; other columns as they were."""
    plain = common.undotted(docs)
    names = plain.columns
    judged, _, spans = _judged(plain, benchmark, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, "text"):
            found = piece.column(spans).to_pylist()
            texts = [remove_spans(t, [(x["start"], x["end"]) for x in some]) if some else t for t, some in zip(piece.column("text").to_pylist(), found, strict=True)]
            columns = {name: piece.column(name) for name in names}
            columns["text"] = pa.array(texts, piece.schema.field("text").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return judged.select(*names, spans).mapInArrow(run, plain.schema).toDF(*docs.columns)


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """text without the byte spans."""
    if text is None or not spans:
        return text
    raw, out, at = text.encode(), [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]).decode()


_SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


def _judged(docs: DataFrame, benchmark: DataFrame, limit: int) -> tuple[DataFrame, str, str]:
    """docs with a verdict and the spans of hit words in two columns more, and the names of these."""
    rows = benchmark_rows(benchmark, limit)
    hit, spans, key = (common.free_name(docs.columns, name) for name in ("__hit", "__spans", "__key"))
    if rows is None:
        keyed = docs.withColumn(key, F.sha2(F.coalesce("text", F.lit("")), 256))
        found = scan_by_join(keyed.select(F.col(key).alias("doc_id"), "text").dropDuplicates(["doc_id"]), benchmark, WIDTH).where("n_hit > 0")
        bad = found.select(F.col("doc_id").alias(key), F.col("contaminated").alias(hit), F.col("spans").alias(spans))
        return keyed.join(bad, key, "left").withColumn(hit, F.coalesce(hit, F.lit(False))), hit, spans
    shared = docs.sparkSession.sparkContext.broadcast(WindowSet(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, "text"):
            out = result(shared.value.scan(words_of(piece.column("text"))))
            yield pa.RecordBatch.from_arrays([*piece.columns, out.column("contaminated"), out.column("spans")], names=[*piece.schema.names, hit, spans])

    schema = StructType([*docs.schema.fields, StructField(hit, BooleanType()), StructField(spans, _SPANS)])
    return docs.mapInArrow(run, schema), hit, spans


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_decontaminate: the verdict on every document of the table."""
    return scan(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
