"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint's 64 bits are cut into three segments.  Of two fingerprints at most four bits apart,
one segment differs by one bit at most; with that bit as a wildcard the segments are equal.  So each
fingerprint is filed under its 64 one-wildcard segments, files are joined on equality, and what meets is verified by counting bits.

Identical fingerprints are one node.  A file emits a spanning forest of its links, never its pairs:
small files are compared at all distances in the sorted order, large ones in blocks.  A key with more than ``HUGE`` fingerprints is not
compared where it is: they are filed once more by one-wildcard segments of the bits beside the key's, which loses no link, and these files are
dealt over all tasks anew, up to ``FILINGS`` times.  Files are dealt by a hash of the key, as packed arrays.  Components come from contraction (``components``).

Defined results: texts without words (null, empty, blank) have fingerprint 0 and link like any other; repeated rows are links
of distance 0; a row without an id gets its component's smallest id; an empty table has no rows; texts of any length are read whole.
Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from stratalog.llm import common, components

SHINGLE, SEED, BITS = 4, 42, 64
DISTANCE = 4
#: Entries that one file group holds, and sizes from which files are compared in blocks or filed again.
ENTRIES, LARGE, HUGE = 1 << 20, 64, 1 << 14
#: How often a key is filed again.  After that, equal keys agree in all but some 13 bits and a wildcard for each filing, so that
#: distinct fingerprints with one key are fewer than 2^18, and are compared where they are.
FILINGS = 4
_ONE = np.uint64(1)


# -- fingerprints -----------------------------------------------------------------------------


def fingerprint(raw: bytes) -> int:
    """The fingerprint of one text's UTF-8 bytes."""
    text = b" ".join(raw.lower().split())
    if not text:
        return 0
    blanks = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
    n = max(1, len(blanks) + 2 - SHINGLE)
    starts = np.concatenate(([0], blanks + 1))[:n].tolist()
    ends = np.append(blanks, len(text))[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a:b], SEED) for a, b in zip(starts, ends, strict=True)], dtype=">u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, more: str = "") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), and one more column that is passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, "text"):
            data, offsets = common.utf8(piece.column("text"))
            fps = np.array([fingerprint(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(fps.view(np.int64)), *[piece.column(c) for c in passed]], names=["doc_id", "fp", *passed])

    passed = [more.split()[0]] if more else []
    return docs.select("doc_id", "text", *passed).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long" + f", {more}" * bool(more))


# -- files ------------------------------------------------------------------------------------


def segments(width: int) -> list[tuple[int, int]]:
    """First bit and length of the three segments of a number of so many bits."""
    third = width // 3
    return [(0, width - 2 * third), (width - 2 * third, third), (width - third, third)]


def rest(fps: np.ndarray, path: str) -> tuple[np.ndarray, int]:
    """The bits that are left when the segments named by a path's digits are taken out one after the other, and how many they are."""
    width = BITS
    for digit in path:
        first, size = segments(width)[int(digit)]
        fps = fps & np.uint64((1 << first) - 1) | (fps >> np.uint64(first + size)) << np.uint64(first)
        width -= size
    return fps, width


def without_bit(x: np.ndarray, first: int, size: int, bit: int) -> np.ndarray:
    """A segment without one of its bits."""
    segment, j = x >> np.uint64(first) & np.uint64((1 << size) - 1), np.uint64(bit - first)
    return segment >> (j + _ONE) << j | segment & ((_ONE << j) - _ONE)


def signature(fps: np.ndarray, variant: int) -> np.ndarray:
    """The segment that holds a bit, without the bit, and the bit's number."""
    first, size = next(s for s in segments(BITS) if s[0] <= variant < s[0] + s[1])
    return without_bit(fps, first, size, variant) << np.uint64(6) | np.uint64(variant)


def signatures(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of all fingerprints, and the fingerprints they belong to."""
    return np.concatenate([signature(fps, v) for v in range(BITS)]), np.tile(fps, BITS)


def refiled(key: int, path: str, fps: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    """Paths and 64-bit keys of fingerprints that share a key, by one-wildcard segments of the bits beside it: two that are near agree in one."""
    left, width = rest(fps, path)
    for s, (first, size) in enumerate(segments(width)):
        for bit in range(first, first + size):
            salt = common.mixed(np.array([key], dtype=np.uint64) + np.uint64(bit + 1))[0]
            yield f"{path}{s}", common.mixed(without_bit(left, first, size, bit) ^ salt)


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= DISTANCE


def forest(keys: np.ndarray, fps: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """A spanning forest of the links between distinct fingerprints with equal keys; and the huge keys with theirs, that are to be filed again, unless it is the last filing."""
    nodes, place = np.unique(fps, return_inverse=True)
    order = np.lexsort((place, keys))
    keys, place = keys[order], place[order]
    new = np.concatenate([np.ones(min(1, len(keys)), dtype=bool), (keys[1:] != keys[:-1]) | (place[1:] != place[:-1])])
    keys, place = keys[new], place[new]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    joined, out, huge = components.Union(len(nodes)), [], []

    def link(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if joined.join(x, y):
                out.append((x, y))

    small = np.repeat(sizes <= LARGE, sizes)
    left = np.repeat(sizes, sizes) - (np.arange(len(keys)) - np.repeat(starts, sizes))
    for d in range(1, int(min(LARGE, sizes.max(initial=1)))):
        i = np.flatnonzero(small & (left > d))
        a, b = place[i], place[i + d]
        good = near(nodes[a], nodes[b])
        link(a[good], b[good])
    for start, size in zip(starts[sizes > LARGE], sizes[sizes > LARGE], strict=True):
        members = place[start : start + size]
        if size > HUGE and not last:
            huge.append((int(keys[start]), nodes[members]))
        else:
            compare_all(nodes, members, link)
    a, b = (np.array(x, dtype=np.int64) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))
    return nodes[a], nodes[b], huge


def compare_all(nodes: np.ndarray, members: np.ndarray, link: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Compares all members with all, one against all later ones at a time: memory follows their number, not its square."""
    fps = nodes[members]
    for i in range(len(members)):
        hits = members[i + 1 :][near(fps[i + 1 :], fps[i])]
        if len(hits):
            link(np.full(len(hits), members[i]), hits)


#: What a file group returns: edges (a, b as arrays), and huge keys with blocks of their fingerprints.
_FILED = "kind int, a binary, b binary, path string, key long, fps binary"
_EDGES, _HUGE = 0, 1


def filed(edges: list[tuple[np.ndarray, np.ndarray]], huge: list[tuple[str, int, np.ndarray]]) -> pa.Table:
    """Edges, and huge keys in rows of a bounded number of fingerprints, which go to many tasks."""
    blocks = [(path, key, fps[at : at + HUGE]) for path, key, fps in huge for at in range(0, len(fps), HUGE)]
    n, m = len(edges), len(blocks)
    return pa.table(
        {
            "kind": pa.array([_EDGES] * n + [_HUGE] * m, pa.int32()),
            "a": pa.array([a.tobytes() for a, _ in edges] + [None] * m, pa.binary()),
            "b": pa.array([b.tobytes() for _, b in edges] + [None] * m, pa.binary()),
            "path": pa.array([None] * n + [path for path, _, _ in blocks], pa.string()),
            "key": pa.array([None] * n + [key - (1 << 64) if key >> 63 else key for _, key, _ in blocks], pa.int64()),
            "fps": pa.array([None] * n + [fps.tobytes() for _, _, fps in blocks], pa.binary()),
        }
    )


def array_of(column: pa.ChunkedArray, dtype: object = np.uint64) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype=dtype)


def links(nodes: DataFrame, count: int) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (a, b) that span the links between the fingerprints of nodes (fp), and the tables that they are read from."""
    least = common.shuffle_partitions(nodes.sparkSession)
    files = max(least, -(-count * BITS // ENTRIES))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fps), 1 << 14):
                keys, owners = signatures(fps[at : at + (1 << 14)])
                where = (common.mixed(keys) % np.uint64(files)).astype(np.int32)
                order = np.argsort(where, kind="stable")
                keys, owners, where = keys[order], owners[order], where[order]
                cuts = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
                ends = np.append(cuts[1:], len(where))
                variants = (keys & np.uint64(63)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(where[cuts]), pa.array([variants[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()), pa.array([owners[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())], names=["file", "variants", "fps"])

    def join(table: pa.Table) -> pa.Table:
        fps, variants = array_of(table.column("fps")), array_of(table.column("variants"), np.uint8)
        keys = np.empty(len(fps), dtype=np.uint64)
        for v in range(BITS):
            mine = np.flatnonzero(variants == v)
            keys[mine] = signature(fps[mine], v)
        a, b, huge = forest(keys, fps)
        which = {v: str(s) for s, (first, size) in enumerate(segments(BITS)) for v in range(first, first + size)}
        return filed([(a, b)] if len(a) else [], [(which[key & 63], key, members) for key, members in huge])

    found = common.written(nodes.select("fp").mapInArrow(file, "file int, variants binary, fps binary").groupBy("file").applyInArrow(join, _FILED), "files", by="kind")
    tables, edges = [found], [found.where(F.col("kind") == _EDGES)]
    for filing in range(1, FILINGS + 1):
        again = found.where(F.col("kind") == _HUGE)
        entries = again.agg(F.coalesce(F.sum(F.length("fps")), F.lit(0))).first()[0] // 8 * BITS
        if not entries:
            break
        found = common.written(file_again(again, max(least, -(-entries // ENTRIES)), filing == FILINGS), "files", by="kind")
        tables.append(found)
        edges.append(found.where(F.col("kind") == _EDGES))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(array_of(batch.column(c), np.int64)) for c in "ab"], names=["a", "b"])

    return functools.reduce(DataFrame.union, edges).select("a", "b").mapInArrow(opened, "a long, b long"), tables


def file_again(huge: DataFrame, files: int, last: bool) -> DataFrame:
    """Edges between the fingerprints of huge keys, and the keys that are still huge."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fps = np.frombuffer(row["fps"], dtype=np.uint64)
                for path, keys in refiled(row["key"] % (1 << 64), row["path"], fps):
                    where = (keys % np.uint64(files)).astype(np.int32)
                    order = np.argsort(where, kind="stable")
                    cuts = np.flatnonzero(np.concatenate(([True], where[order][1:] != where[order][:-1])))
                    parts = list(zip(cuts, np.append(cuts[1:], len(where)), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(where[order][cuts]), pa.array([path] * len(parts)), *[pa.array([x[order][a:b].tobytes() for a, b in parts], pa.binary()) for x in (keys, fps)]], names=["file", "path", "keys", "fps"])

    def join(table: pa.Table) -> pa.Table:
        edges, more = [], []
        for path in table.column("path").unique().to_pylist():
            mine = table.filter(pc.equal(table.column("path"), path))
            a, b, still = forest(array_of(mine.column("keys")), array_of(mine.column("fps")), last)
            edges += [(a, b)] * bool(len(a))
            more += [(path, key, members) for key, members in still]
        return filed(edges, more)

    return huge.select("path", "key", "fps").mapInArrow(file, "file int, path string, keys binary, fps binary").groupBy("file").applyInArrow(join, _FILED)


def rooted(found: DataFrame, least: Column) -> tuple[DataFrame, DataFrame]:
    """The nodes (fp, least, root) of a table with fp, and the least of each root; least is an aggregate."""
    nodes = common.written(found.groupBy("fp").agg(least.alias("least")), "nodes")
    edges, tables = links(nodes, nodes.count())
    trees = components.roots(edges)
    with_roots = common.written(nodes.join(trees.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    common.discard(nodes, trees, *tables)
    return with_roots, with_roots.groupBy("root").agg(F.min("least").alias("least"))


def components_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: id, fingerprint (16 hex digits) and component_id."""
    found = common.written(fingerprints(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))), "fingerprints")
    nodes, least = rooted(found, F.min("doc_id"))
    members = common.written(nodes.select("fp", "root").join(least, "root").select("fp", F.col("least").alias("component_id")), "members")
    common.discard(nodes)
    return found.join(members, "fp").select(F.col("doc_id").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest id; of rows with this id, the one with the smallest hash of all its columns, and of equal rows any.

    Rows without an id stay only where nobody in their component has one.
    """
    row = common.free_name(docs.columns, "__row")
    columns = [hashable(f) for f in docs.schema.fields]
    # 128 bits that tell rows apart; a hash leaves nulls out, so where they are is hashed too
    key = F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), *columns, *[c.isNull() for c in columns])), 16, "0") for k in (0, 1)])
    keyed = docs.withColumn(row, key)
    found = common.written(fingerprints(keyed.select("doc_id", "text", F.col(row).alias("row")), "row string"), "fingerprints")
    nodes, least = rooted(found, F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")))
    kept = common.written(least.select(F.col("least.row").alias(row)), "kept")
    common.discard(found, nodes)
    return keyed.join(kept, row, "left_semi").dropDuplicates([row]).select(*common.quoted(docs.columns))


def hashable(field: StructField) -> Column:
    """A column as it can be hashed: maps as sorted entries in JSON."""
    column = common.quoted([field.name])[0]
    return F.to_json(column) if "map<" in field.dataType.simpleString() or "variant" in field.dataType.simpleString() else column


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_simhash: fingerprint and component of every document of the table."""
    return components_of(common.read(spark, sf_dir, "documents"))
