"""Substring dedup by a log-structured index of window fingerprints.

A window is ``WIDTH`` consecutive words.  Its fingerprint is the smallest hash of the five-word
sequences in it, so that equal windows have equal fingerprints and neighbours mostly share one: about
two in nine words start a new one, and only those are indexed.

Batches are taken in one after the other.
1. Each piece of text sends, for each of its fingerprints, the document that has it, or that several do.
   They are merge-joined, bucket by bucket, with the index's sorted immutable runs.  Fingerprints of
   more than one document are wanted in the documents that have them.
2. The batch's fingerprints become a new run; beyond ``MOST_RUNS`` the runs are compacted into one, and the old ones deleted.
3. Wanting documents are verified by their own words: a 128-bit BLAKE2 digest of the text of each window with a wanted fingerprint,
   one place for each digest of a text, so that a line that a text repeats is sent once.  Digests meet in buckets; a window is
   a repeat if its digest is in an earlier batch, or in a smaller id of its own; and with it, in ``deduplicate``, all windows of the text with the same words.

``Index.add`` does all three for a batch that arrives, and keeps runs of digests too.  A table that is there as a whole is
filled in batch by batch (1 and 2) and verified once: no text is read again for each later batch.

A run says of a fingerprint which document has it, or that several do; so a fingerprint that millions of documents share has one
entry a run, and one a piece on the way.  Buckets are as many as the text needs (``BUCKET_BYTES``), and a run has as many rows a bucket
as it needs (``ROW_ENTRIES``): no task and no cell grows with the table.

Defined results: null texts have no words; documents without an id are neither source nor repeat; rows that
repeat an id are one document, and each is cut by its own text; windows never cross rows; a text of any length is cut whole; an empty table
has no rows; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import common

WIDTH, GRAM = 13, 5
MOST_RUNS = 3
#: Batches that the query cuts the table into, of about as many rows each, by id.
BATCHES = 5
#: Text that is combined before anything is sent, text a bucket stands for, and entries in one row of a run.
PIECE, BUCKET_BYTES, ROW_ENTRIES = 8 << 20, 24 << 20, 1 << 20
_WORD = common.byte_class([b for b in range(256) if b not in common.SPACES])
#: Rows of both steps are parallel arrays as bytes.  First step: wants (docs, fps), entries and runs (fps, docs, many).
_FOUND = {"kind": pa.int32(), "bucket": pa.int32(), "fps": pa.binary(), "docs": pa.binary(), "many": pa.binary()}
_WANT, _RUN, _ENTRY = 0, 1, 2
#: Second step: hits (docs, keys, starts), places seen (the same, digests and old) and runs (digests).
_SEEN_ROW = {"kind": pa.int32(), "bucket": pa.int32(), "docs": pa.binary(), "keys": pa.binary(), "starts": pa.binary(), "digests": pa.binary(), "old": pa.binary()}
_CHECKED = {k: v for k, v in _SEEN_ROW.items() if k != "old"}
_HIT, _DIGESTS, _SEEN = 0, 1, 2
_SPARK = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}


def ddl(columns: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{name} {_SPARK[kind]}" for name, kind in columns.items())


def batch_of(rows: list[dict], columns: dict[str, pa.DataType]) -> pa.RecordBatch:
    """Rows as a batch; what a row lacks is null."""
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kind) for c, kind in columns.items()], names=list(columns))


def array_of(table: pa.Table, kind: int, column: str, dtype: object) -> np.ndarray:
    """The arrays of all rows of a kind, one after the other."""
    return np.frombuffer(b"".join(table.filter(pc.equal(table.column("kind"), kind)).column(column).to_pylist()), dtype=dtype)


def begins(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key begins in sorted columns."""
    new = np.zeros(len(sorted_keys[0]), dtype=bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def ends(starts: np.ndarray, n: int) -> np.ndarray:
    return np.append(starts[1:], n)[: len(starts)]


def slices(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """key, start, end of each run of equal keys."""
    starts = begins(sorted_keys)
    yield from zip(sorted_keys[starts].tolist(), starts.tolist(), ends(starts, len(sorted_keys)).tolist(), strict=True)


def window_fingerprints(words: common.Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and fingerprint of each window of a piece."""
    hashed = words.hashes()
    left = np.repeat(words.of[1:], np.diff(words.of)) - np.arange(len(words))
    first = np.flatnonzero(left >= WIDTH)
    grams = np.full(len(hashed) + WIDTH, np.iinfo(np.uint64).max)
    at, h = words.windows(hashed, GRAM)
    grams[at] = h
    two = np.minimum(grams[:-1], grams[1:])
    four = np.minimum(two[:-2], two[2:])
    eight = np.minimum(four[:-4], four[4:])
    return first, common.mixed(np.minimum(eight[first], grams[first + WIDTH - GRAM]))


def window_digests(raw: bytes, starts: list[int]) -> bytes:
    """BLAKE2 digests of the windows of a text that start with the given words."""
    words = raw.split()
    text = b" ".join(words)
    edge = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)))
    return b"".join([hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip(edge[starts].tolist(), (edge[np.asarray(starts) + WIDTH] - 1).tolist(), strict=True)])


def run_rows(kind: int, bucket: int, **columns: np.ndarray) -> list[dict]:
    """A sorted run of a bucket, in rows of a bounded number of entries."""
    n = len(next(iter(columns.values())))
    return [{"kind": kind, "bucket": bucket, **{c: v[at : at + ROW_ENTRIES].tobytes() for c, v in columns.items()}} for at in range(0, n, ROW_ENTRIES)]


def dealt(kind: int, where: np.ndarray, **columns: np.ndarray) -> list[dict]:
    """Parallel arrays as one row for each bucket."""
    order = np.argsort(where, kind="stable")
    where, columns = where[order], {c: v[order] for c, v in columns.items()}
    return [{"kind": kind, "bucket": k, **{c: v[a:b].tobytes() for c, v in columns.items()}} for k, a, b in slices(where)]


def shard(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (common.mixed(docs.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def wants_by_document(table: pa.Table) -> pa.Table:
    """A row for each document of a shard: doc_id and its wanted fingerprints."""
    docs, fps = array_of(table, _WANT, "docs", np.int64), array_of(table, _WANT, "fps", np.uint64)
    order = np.argsort(docs, kind="stable")
    docs, fps = docs[order], fps[order]
    cut = list(slices(docs))
    return pa.table({"doc_id": pa.array([d for d, _, _ in cut], pa.int64()), "wanted": pa.array([fps[a:b].tobytes() for _, a, b in cut], pa.binary())})


def hits_by_document(table: pa.Table) -> pa.Table:
    """A row for each text of a shard: doc_id, text_key and the starts of its repeats."""
    docs, keys, at = (array_of(table, _HIT, c, t) for c, t in (("docs", np.int64), ("keys", np.int64), ("starts", np.int32)))
    order = np.lexsort((at, keys, docs))
    docs, keys, at = docs[order], keys[order], at[order]
    starts = begins(docs, keys)
    blobs = [at[a:b].tobytes() for a, b in zip(starts.tolist(), ends(starts, len(docs)).tolist(), strict=True)]
    return pa.table({"doc_id": pa.array(docs[starts]), "text_key": pa.array(keys[starts]), "starts": pa.array(blobs, pa.binary())})


def repeats(digests: np.ndarray, docs: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by digest, old ones first, then id; which of the sorted are repeats; where an old one leads its digest."""
    order = np.lexsort((docs, ~old, digests[:, 1], digests[:, 0]))
    docs, old = docs[order], old[order]
    starts = begins(digests[order, 0], digests[order, 1])
    sizes = np.diff(np.append(starts, len(order)))
    return order, ~old & (np.repeat(old[starts], sizes) | (docs > np.repeat(docs[starts], sizes))), starts[old[starts]]


class Index:
    """A fingerprint index in the shared folder, filled batch by batch.

    buckets: fixed for the life of the index; buckets_for() tells how many a number of bytes of text needs.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None) -> None:
        self.spark, self.buckets = spark, buckets or common.shuffle_partitions(spark)
        self.runs: list[DataFrame] = []
        self.digests: list[DataFrame] = []
        self.history: DataFrame | None = None
        self.compactions = 0

    def _by_bucket(self, rows: DataFrame) -> GroupedData:
        """As many tasks as buckets, so that what a task reads does not grow with the table."""
        return rows.repartition(self.buckets, "bucket").groupBy("bucket")

    def fill(self, docs: DataFrame) -> DataFrame:
        """Takes a batch in; returns its wants, one table of many rows a document.  Repeats are found by verify()."""
        found = common.written(self._find(narrow(docs)), "found", by="kind")
        self.runs.append(part(found, _RUN))
        if len(self.runs) > MOST_RUNS:
            self.compact()
        return part(found, _WANT)

    def verify(self, docs: DataFrame, wants: DataFrame) -> DataFrame:
        """The repeats of all batches at once: docs and wants are those of all; smaller ids come first."""
        checked = common.written(self._verify(narrow(docs), wants, keep=False), "checked", by="kind")
        return self._by_bucket(checked.where(F.col("kind") == _HIT)).applyInArrow(hits_by_document, "doc_id long, text_key long, starts binary")

    def add(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """Repeats in a batch that arrives (doc_id, text): doc_id, text_key, and starts, the 32-bit numbers of the windows' first words, one for each different window.

        Earlier batches come before this one, whatever their ids; of them, the documents that share a fingerprint with it are
        verified.  keep: the batch becomes part of the index.
        """
        docs = narrow(docs)
        found = common.written(self._find(docs), "found", by="kind")
        checked = common.written(self._verify(docs, found.where(F.col("kind") == _WANT)), "checked", by="kind")
        if keep:
            self.runs.append(part(found, _RUN))
            self.digests.append(part(checked, _DIGESTS))
            self.history = docs if self.history is None else self.history.unionByName(docs)
            if len(self.runs) > MOST_RUNS:
                self.compact()
        return self._by_bucket(checked.where(F.col("kind") == _HIT)).applyInArrow(hits_by_document, "doc_id long, text_key long, starts binary")

    def _find(self, docs: DataFrame) -> DataFrame:
        """Wants of the batch and its run."""
        buckets = self.buckets

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in common.pieces(batches, "text", PIECE):
                words = common.Words(*common.utf8(piece.column("text")), _WORD)
                first, fps = window_fingerprints(words)
                docs = piece.column("doc_id").to_numpy()[np.searchsorted(words.of, first, side="right") - 1]
                lone = begins(docs, fps)  # neighbours mostly share one
                docs, fps = docs[lone], fps[lone]
                order = np.lexsort((docs, fps))
                docs, fps = docs[order], fps[order]
                lone = begins(fps, docs)
                docs, fps = docs[lone], fps[lone]
                starts = begins(fps)
                sizes = np.diff(np.append(starts, len(fps)))
                shared = np.repeat(sizes > 1, sizes)
                rows = dealt(_WANT, shard(docs[shared], buckets), docs=docs[shared], fps=fps[shared])
                docs, fps, many = docs[starts], fps[starts], sizes > 1
                rows += dealt(_ENTRY, (fps % np.uint64(buckets)).astype(np.int64), fps=fps, docs=docs, many=many)
                yield batch_of(rows, _FOUND)

        def merge(table: pa.Table) -> pa.Table:
            passed = table.filter(pc.equal(table.column("kind"), _WANT))
            fps, docs, many = (array_of(table, _ENTRY, c, t) for c, t in (("fps", np.uint64), ("docs", np.int64), ("many", bool)))
            if not len(fps):
                return passed
            order = np.lexsort((docs, fps))
            fps, docs, many = fps[order], docs[order], many[order]
            starts = begins(fps)
            sizes = np.diff(np.append(starts, len(fps)))
            unique, least = fps[starts], docs[starts]
            several = np.logical_or.reduceat(many, starts) | (least != docs[starts + sizes - 1])
            asked_docs, asked_fps = [], []
            for run in table.filter(pc.equal(table.column("kind"), _RUN)).to_pylist():
                theirs = np.frombuffer(run["fps"], dtype=np.uint64)
                place = np.minimum(np.searchsorted(theirs, unique), len(theirs) - 1)
                met = theirs[place] == unique
                several |= met
                alone = met & ~np.frombuffer(run["many"], dtype=bool)[place]
                asked_docs.append(np.frombuffer(run["docs"], dtype=np.int64)[place[alone]])
                asked_fps.append(unique[alone])
            asked = np.repeat(several, sizes) & ~many  # pieces in which several have it have asked already
            who, what = np.concatenate([docs[asked], *asked_docs]), np.concatenate([fps[asked], *asked_fps])
            rows = dealt(_WANT, shard(who, buckets), docs=who, fps=what)
            rows += run_rows(_RUN, table.column("bucket")[0].as_py(), fps=unique, docs=least, many=several)
            return pa.concat_tables([passed, pa.Table.from_batches([batch_of(rows, _FOUND)]).cast(passed.schema)])

        sent = docs.select("doc_id", "text").mapInArrow(send, ddl(_FOUND))
        for run in self.runs:
            sent = sent.unionByName(run.select(list(_FOUND)))
        return self._by_bucket(sent).applyInArrow(merge, ddl(_FOUND))

    def _verify(self, docs: DataFrame, wanted: DataFrame, keep: bool = True) -> DataFrame:
        """Hits of the batch and, if they are to be kept, its run of digests."""
        buckets = self.buckets
        texts = docs.withColumn("fresh", F.lit(True))
        if self.history is not None:
            texts = texts.unionByName(self.history.withColumn("fresh", F.lit(False)))
        asked = self._by_bucket(wanted).applyInArrow(wants_by_document, "doc_id long, wanted binary")

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in common.pieces(batches, "text", PIECE):
                words = common.Words(*common.utf8(piece.column("text")), _WORD)
                first, fps = window_fingerprints(words)
                bounds = np.searchsorted(first, words.of)
                raw, at, row = [], [], []
                for r, mine_wanted in enumerate(piece.column("wanted").to_pylist()):
                    mine = slice(bounds[r], bounds[r + 1])
                    starts = first[mine][np.isin(fps[mine], np.frombuffer(mine_wanted, dtype=np.uint64))] - words.of[r]
                    if len(starts):
                        made = np.frombuffer(window_digests(words.data[words.offsets[r] : words.offsets[r + 1]].tobytes(), starts), dtype=np.uint64).reshape(-1, 2)
                        lone = np.unique(made, axis=0, return_index=True)[1] if len(starts) > 1 else np.zeros(1, np.int64)
                        raw.append(made[lone])
                        at.append(starts[lone])
                        row.append(np.full(len(lone), r))
                if not raw:
                    continue
                digests, at, row = np.concatenate(raw), np.concatenate(at).astype(np.int32), np.concatenate(row)
                docs, keys, old = (piece.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc_id", "text_key", "fresh"))
                order, hit, led = repeats(digests, docs, old := ~old)
                digests, docs, keys, at, old = digests[order], docs[order], keys[order], at[order], old[order]
                rows = dealt(_HIT, shard(docs[hit], buckets), docs=docs[hit], keys=keys[hit], starts=at[hit])
                # on go the fresh places that are not decided yet, and one old place of a digest that has any
                on = ~hit & ~old
                on[led] = True
                digests, docs, keys, at, old = digests[on], docs[on], keys[on], at[on], old[on]
                # by place again: what is alike lies together, and is packed better
                order = np.lexsort((at, docs))
                where = (digests[order, 0] % np.uint64(buckets)).astype(np.int64)
                rows += dealt(_SEEN, where, docs=docs[order], keys=keys[order], starts=at[order], digests=digests[order], old=old[order])
                yield batch_of(rows, _SEEN_ROW)

        def merge(table: pa.Table) -> pa.Table:
            passed = table.filter(pc.equal(table.column("kind"), _HIT)).select(list(_CHECKED))
            digests, past = (array_of(table, k, "digests", np.uint64).reshape(-1, 2) for k in (_SEEN, _DIGESTS))
            if not len(digests):
                return passed
            docs, keys, at, old = (array_of(table, _SEEN, c, t) for c, t in (("docs", np.int64), ("keys", np.int64), ("starts", np.int32), ("old", bool)))
            n = len(past)
            order, hit, _ = repeats(np.concatenate([past, digests]), np.concatenate([np.zeros(n, np.int64), docs]), np.concatenate([np.ones(n, dtype=bool), old]))
            mine = order[hit] - n
            rows = dealt(_HIT, shard(docs[mine], buckets), docs=docs[mine], keys=keys[mine], starts=at[mine])
            if keep:
                rows += run_rows(_DIGESTS, table.column("bucket")[0].as_py(), digests=np.unique(digests, axis=0))
            return pa.concat_tables([passed, pa.Table.from_batches([batch_of(rows, _CHECKED)]).cast(passed.schema)])

        sent = texts.join(asked, "doc_id").select("doc_id", "text_key", "text", "fresh", "wanted").mapInArrow(send, ddl(_SEEN_ROW))
        for run in self.digests:
            sent = sent.unionByName(run, allowMissingColumns=True)
        return self._by_bucket(sent).applyInArrow(merge, ddl(_CHECKED))

    def compact(self) -> None:
        """Merges the runs into one, bucket by bucket."""

        def merge_runs(table: pa.Table) -> pa.Table:
            fps, docs, many = (array_of(table, _RUN, c, t) for c, t in (("fps", np.uint64), ("docs", np.int64), ("many", bool)))
            order = np.lexsort((docs, fps))
            fps, docs, many = fps[order], docs[order], many[order]
            starts = begins(fps)
            several = np.logical_or.reduceat(many, starts) | (docs[starts] != docs[ends(starts, len(fps)) - 1])
            rows = run_rows(_RUN, table.column("bucket")[0].as_py(), fps=fps[starts], docs=docs[starts], many=several)
            return pa.Table.from_batches([batch_of(rows, _FOUND)])

        def merge_digests(table: pa.Table) -> pa.Table:
            digests = np.unique(array_of(table, _DIGESTS, "digests", np.uint64).reshape(-1, 2), axis=0)
            return pa.Table.from_batches([batch_of(run_rows(_DIGESTS, table.column("bucket")[0].as_py(), digests=digests), _CHECKED)])

        self.compactions += 1
        for name, runs, merge, columns in (("runs", self.runs, merge_runs, _FOUND), ("digests", self.digests, merge_digests, _CHECKED)):
            if not runs:
                continue
            together = runs[0].select(list(columns))
            for run in runs[1:]:
                together = together.unionByName(run.select(list(columns)))
            merged = common.written(self._by_bucket(together).applyInArrow(merge, ddl(columns)), name)
            common.discard(*runs)  # the other rows of those tables may still be read
            setattr(self, name, [merged])

    def close(self) -> None:
        """Deletes the runs."""
        common.discard(*self.runs, *self.digests)
        self.runs, self.digests = [], []


def part(table: DataFrame, kind: int) -> DataFrame:
    """The rows of a kind, which have a folder of their own that can be discarded."""
    rows = table.where(F.col("kind") == kind)
    rows.scratch_path = f"{table.scratch_path}/kind={kind}"
    return rows


def narrow(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def buckets_for(spark: SparkSession, n_bytes: int) -> int:
    return max(common.shuffle_partitions(spark), -(-n_bytes // BUCKET_BYTES))


def repeated_windows(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The repeats of a whole table, one row for each text that has any.

    The table is cut into batches of about as many rows each, lower ids first; an index is filled with one after the other, and all are verified at once.
    """
    spark, known = docs.sparkSession, docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_bytes, edges = known.agg(F.sum(F.octet_length("text").cast("long")), F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 10_000)).first()
    index = Index(spark, buckets_for(spark, n_bytes or 0))
    edges, wants = sorted(set(edges or ())), []
    for k in range(len(edges) + 1):
        batch = known
        if k:
            batch = batch.where(F.col("doc_id") > edges[k - 1])
        if k < len(edges):
            batch = batch.where(F.col("doc_id") <= edges[k])
        wants.append(index.fill(batch))
    index.close()
    found = index.verify(known, functools.reduce(DataFrame.unionByName, wants))
    common.discard(*wants)
    return found


def same_windows(raw: np.ndarray, words: list[bytes], starts: np.ndarray) -> np.ndarray:
    """The starts of all windows of a text that have the words of one of the given windows: found by hash, compared by their bytes."""
    first, h = (found := common.Words(raw, np.array([0, len(raw)]), _WORD)).windows(found.hashes(), WIDTH)
    near = first[np.isin(h, h[starts])]
    if len(near) == len(starts):
        return starts
    text = b" ".join(words)
    edge = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)))
    window = lambda i: text[edge[i] : edge[i + WIDTH] - 1]
    wanted = {window(i) for i in starts.tolist()}
    return np.array([i for i in near.tolist() if window(i) in wanted], dtype=np.int64)


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_text: bool = False) -> DataFrame:
    """One row for each document: id, n_words, n_removed, kept_sha256; the kept words joined by one space too with keep_text."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    found = repeated_windows(narrow)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * keep_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, "text"):
            data, offsets = common.utf8(piece.column("text"))
            n_words, n_removed, kept = [], [], []
            for r, repeated in enumerate(piece.column("starts").to_pylist()):
                raw = data[offsets[r] : offsets[r + 1]]
                words = raw.tobytes().split()
                n_words.append(len(words))
                if repeated:
                    gone = common.covered(same_windows(raw, words, np.frombuffer(repeated, dtype=np.int32).astype(np.int64)), WIDTH, len(words))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            columns = [piece.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), *[pa.array([k.decode() for k in kept], pa.string())] * keep_text]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(narrow.dtypes)["doc_id"]
    both = narrow.withColumn("text_key", F.xxhash64("text")).join(found, ["doc_id", "text_key"], "left").select("doc_id", "text", "starts")
    return both.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text).withColumnRenamed("doc_id", id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_substring_dedup: every document of the table without what smaller ids have."""
    return deduplicate(common.read(spark, sf_dir, "documents"))
