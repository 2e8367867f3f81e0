"""Byte-level BPE by overlapping chunks.

A text is cut into chunks that overlap, and each chunk is pre-tokenised on its own.  Neighbours are
stitched at the first boundary that both put at one place: the pattern never looks behind, so from
there on the later chunk's pieces are those of the whole text.  Where an overlap has no such place (a run
longer than the overlap), the chunk is matched again from its last sure boundary.  The pieces are
encoded by merging the lowest rank first, and decoded by joining raw bytes.

Chunks of a text longer than ``SPREAD`` characters are rows of their own, which are dealt over all tasks, matched and encoded there in parallel,
and meet again by text to be stitched; equal long texts are encoded once.  In a shorter text, chunks follow one another in one task.

Defined results: a null text is empty; an empty text has no ids, and the digests are those of empty
strings; special tokens are ordinary text; repeated rows are encoded alike; texts of any length are
encoded whole; an empty table has no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import common

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters of a chunk, and how many of them the next chunk starts with.
CHUNK, OVERLAP = 16_384, 512
#: Texts with more characters are encoded as rows of so many characters.
SPREAD = 65_536
#: Pieces whose encodings a worker keeps; the table is emptied when full.
KEPT_PIECES = 150_000


def vocabulary(name: str = VOCABULARY) -> str:
    """Where a rank file of the installed public vocabularies is."""
    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder for a rank file.  The path is a parameter; the file is read where the work is done."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.ranks = load_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.find = regex.compile(pattern)
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.chunk, self.overlap = chunk, overlap
        self.known: dict[str, tuple[int, str, bytes, bytes]] = {}

    # -- pieces ---------------------------------------------------------------------------

    def pretokenise(self, text: str) -> list[str]:
        """The pieces of the whole text, from overlapping chunks."""
        find, chunk, step = self.find.findall, self.chunk, self.chunk - self.overlap
        if len(text) <= chunk:
            return find(text)
        starts = range(0, max(1, len(text) - self.overlap), step)
        out: list[str] = []
        ours, i, at, stop = find(text[:chunk]), 0, 0, chunk
        for start in starts[1:]:
            theirs = find(text[start : start + chunk])
            boundaries, place = {}, start
            for k, piece in enumerate(theirs):
                boundaries[place] = k
                place += len(piece)
            # the chunk's last piece may go on beyond its end, so it never counts
            while at not in boundaries and at + len(ours[i]) < stop:
                out.append(ours[i])
                at += len(ours[i])
                i += 1
            stop = start + chunk
            if at in boundaries:
                ours, i = theirs, boundaries[at]
            else:
                ours, i = find(text[at:stop]), 0
        return out + ours[i:]

    # -- merges ---------------------------------------------------------------------------

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece.  merge_bytes() tells what they are; the library does the same faster on usual pieces (one alone is split no further)."""
        return self.library.encode_ordinary(piece) if len(piece) <= 400 else self.merge_bytes(piece.encode())

    def merge_bytes(self, raw: bytes) -> list[int]:
        """Neighbours with the lowest rank are joined, the leftmost first, until none is in the vocabulary; with a heap and links."""
        ranks, n = self.ranks, len(raw)
        end, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (rank := ranks.get(raw[i : end[j]])) is not None:
                heapq.heappush(heap, (rank, i, end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = right[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            end[i], right[i], alive[j] = stop, right[j], False
            if right[i] < n:
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = right[i]
        return out

    def encoded(self, piece: str) -> tuple[int, str, bytes, bytes]:
        """Number of ids of a piece, the ids in decimal, the bytes they decode to, and the ids as 32-bit numbers."""
        ids = self.merge(piece)
        out = (len(ids), " ".join(map(str, ids)), self.decode(ids), np.array(ids, dtype="<i4").tobytes())
        if len(self.known) >= KEPT_PIECES:
            self.known.clear()
        if len(piece) <= 64:
            self.known[piece] = out
        return out

    def blocks(self, text: str) -> Iterator[list[tuple[int, str, bytes, bytes]]]:
        """The encoded pieces of a text, a bounded number at a time."""
        known, made = self.known, self.encoded
        pieces = self.pretokenise(text)
        for at in range(0, len(pieces), 65_536):
            yield [known.get(p) or made(p) for p in pieces[at : at + 65_536]]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(d[3] for done in self.blocks(text) for d in done), dtype="<i4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def digest(self, text: str, with_ids: bool = False) -> tuple[int, str, str, bytes]:
        """Number of ids, digest of the ids in decimal, digest of the decoded bytes, and the ids if asked for."""
        ids, raw, count, numbers = hashlib.sha256(), hashlib.sha256(), 0, []
        for done in self.blocks(text):
            ids.update(((" " if count else "") + " ".join([d[1] for d in done])).encode())
            raw.update(b"".join([d[2] for d in done]))
            count += sum([d[0] for d in done])
            if with_ids:
                numbers += [d[3] for d in done]
        return count, ids.hexdigest(), raw.hexdigest(), b"".join(numbers)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


class Chunk(NamedTuple):
    """A chunk of a text: where it starts, its characters, where its pieces start (the end comes last), how many ids precede each, and all ids."""

    start: int
    text: str
    places: np.ndarray
    before: np.ndarray
    ids: np.ndarray

    @staticmethod
    def of(tool: Codec, start: int, text: str) -> Chunk:
        pieces = tool.find.findall(text)
        done = [tool.known.get(p) or tool.encoded(p) for p in pieces]
        sums = lambda sizes: np.concatenate(([0], np.cumsum(np.fromiter(sizes, dtype=np.int64, count=len(pieces)))))
        return Chunk(start, text, start + sums(map(len, pieces)), sums(d[0] for d in done), np.frombuffer(b"".join(d[3] for d in done), dtype="<i4"))

    def ids_between(self, a: int, b: int) -> np.ndarray:
        i, j = np.searchsorted(self.places, [a, b])
        return self.ids[self.before[i] : self.before[j]]


def stitched(tool: Codec, chunks: list[Chunk]) -> Iterator[np.ndarray]:
    """The ids of a whole text from its chunks in order."""
    ours, at = chunks[0], 0
    for theirs in chunks[1:]:
        # the chunk's last piece may go on beyond its end, so only starts of pieces are sure
        both = np.intersect1d(ours.places[:-1], theirs.places[:-1], assume_unique=True)
        both = both[both >= at]
        if len(both):
            yield ours.ids_between(at, both[0])
            ours, at = theirs, int(both[0])
        else:
            last = int(ours.places[-2]) if len(ours.places) > 2 and ours.places[-2] >= at else at
            yield ours.ids_between(at, last)
            overlap = ours.start + len(ours.text) - theirs.start
            ours, at = Chunk.of(tool, last, ours.text[last - ours.start :] + theirs.text[overlap:]), last
    yield ours.ids_between(at, int(ours.places[-1]))


def spread(longs: DataFrame, path: str, with_ids: bool, size: int, overlap: int = OVERLAP) -> DataFrame:
    """digests() of long texts, chunk by chunk in parallel."""
    keyed = longs.withColumn("key", F.sha2("text", 256))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for n, start in enumerate(range(0, max(1, len(text) - overlap), size - overlap)):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([n], pa.int32()), pa.array([start], pa.int64()), pa.array([text[start : start + size]])], names=["key", "n", "start", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for piece in common.pieces(batches, "text"):
            made = [Chunk.of(tool, *x) for x in zip(piece.column("start").to_pylist(), piece.column("text").to_pylist(), strict=True)]
            arrays = [pa.array([getattr(c, name).tobytes() for c in made], pa.binary()) for name in ("places", "before", "ids")]
            yield pa.RecordBatch.from_arrays([*piece.columns, *arrays], names=[*piece.schema.names, "places", "before", "ids"])

    def stitch(table: pa.Table) -> pa.Table:
        tool, numbers = codec(path), []
        chunks = [Chunk(r["start"], r["text"], *(np.frombuffer(r[c], dtype=np.int64) for c in ("places", "before")), np.frombuffer(r["ids"], dtype="<i4")) for r in table.sort_by("n").to_pylist()]
        ids, raw, count = hashlib.sha256(), hashlib.sha256(), 0
        for part in stitched(tool, chunks):
            for at in range(0, len(part), 65_536):
                some = part[at : at + 65_536].tolist()
                ids.update(((" " if count else "") + " ".join(map(str, some))).encode())
                raw.update(tool.decode(some))
                count += len(some)
            if with_ids:
                numbers.append(part)
        columns = {"key": [table.column("key")[0].as_py()], "n_tokens": [count], "ids_sha256": [ids.hexdigest()], "decoded_sha256": [raw.hexdigest()]}
        if with_ids:
            columns["ids"] = pa.array([np.concatenate(numbers)], pa.list_(pa.int32()))
        return pa.table(columns)

    chunks = keyed.select("key", "text").dropDuplicates(["key"]).mapInArrow(cut, "key string, n int, start long, text string").repartition("key", "n")
    encoded = chunks.mapInArrow(encode, "key string, n int, start long, text string, places binary, before binary, ids binary")
    done = encoded.groupBy("key").applyInArrow(stitch, "key string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return keyed.select("doc_id", "key").join(done, "key").drop("key")


def digests(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False, size: int = SPREAD) -> DataFrame:
    """One row for each document: id, number of ids, digest of the ids, digest of the decoded bytes; ``ids`` too with with_ids."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for piece in common.pieces(batches, "text"):
            n, ids, raw, numbers = zip(*(tool.digest(t or "", with_ids) for t in piece.column("text").to_pylist()), strict=True)
            columns = [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(raw)]
            if with_ids:
                values = pa.array(np.frombuffer(b"".join(numbers), dtype="<i4"), pa.int32())
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), values))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(narrow.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    is_long = F.coalesce(F.length("text") > size, F.lit(False))
    short = narrow.where(~is_long).mapInArrow(run, schema)
    return short.unionByName(spread(narrow.where(is_long), path, with_ids, size)).withColumnRenamed("doc_id", id_column)


def decode(encoded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """One row for each row of ids: id and ``raw``, the bytes.  Null ids decode to no bytes."""
    narrow = encoded.select(F.col(id_column).alias("doc_id"), F.col(ids_column).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            raw = [tool.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "raw"])

    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.mapInArrow(run, f"doc_id {kind}, raw binary").withColumnRenamed("doc_id", id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_bpe: every document of the table encoded and decoded."""
    return digests(common.read(spark, sf_dir, "documents"), vocabulary())
