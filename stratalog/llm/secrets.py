"""Secret scan: all rules as one minimal automaton, one pass over the bytes of every text.

Three base kinds (assign, access, hex) and further ones that only add spans.  A match is leftmost,
longest and does not overlap the kind's previous one; base matches that are too short are dropped
after they have taken their text.  Positions are code points, ends exclusive.

Defined results: null and empty texts have no spans; repeated rows are scanned alike; texts of any
length are scanned whole; an empty table has no rows; other columns are not read, so clashing names do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from stratalog.llm import automaton, common

_KEYWORDS = "|".join(map(automaton.any_case, ("password", "passwd", "secret", "token", "api_?key")))
#: The three base kinds, in the order that breaks ties.
BASE = {
    "assign": f"({_KEYWORDS})[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{16,}",
}
MORE = {
    "forge_token": "gh[pousr]_[A-Za-z0-9]+",
    "chat_token": "xox[abprs]-[A-Za-z0-9-]+",
    "private_key": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "web_token": "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+",
}
#: Shortest matches kept, in bytes; of assign, the shortest value.  A count inside a pattern costs states, so only hex, whose short runs are everywhere, has one.
LEAST = {"access": 18, "forge_token": 24, "chat_token": 15, "web_token": 40}
LEAST_VALUE = 12
_VALUE = re.compile(rb"""[A-Za-z_]+["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


class Scanner:
    def __init__(self, rules: dict[str, str] | None = None) -> None:
        self.rules = rules or BASE | MORE
        self.machine = automaton.compile_rules(self.rules)
        self.rank = {name: k for k, name in enumerate(self.rules)}

    def spans(self, raw: bytes) -> list[Span]:
        """Spans of one text by start, then kind as listed."""
        found = []
        for k, start, end in self.machine.scan(raw):
            kind = self.machine.names[k]
            if end - start < LEAST.get(kind, 1) or kind == "assign" and len(_VALUE.fullmatch(raw[start:end])[1]) < LEAST_VALUE:
                continue
            found.append((start, self.rank[kind], end, kind))
        if not found:
            return []
        points = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80, out=points[1:])
        return [Span(kind, int(points[start]), int(points[end])) for start, _, end, kind in sorted(found)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def _texts(piece: pa.RecordBatch) -> Iterator[bytes]:
    data, offsets = common.utf8(piece.column("text"))
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield data[a:b].tobytes()


_COUNTS = ("n_assign", "n_access", "n_hex")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """One row for each document: id, counts of the base kinds, digest of the base spans, and all spans as text."""
    shared = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, "text"):
            spans = [shared.value.spans(raw) for raw in _texts(piece)]
            base = [[s for s in x if s.kind in BASE] for x in spans]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    *[pa.array([sum(s.kind == kind for s in x) for x in base], pa.int64()) for kind in BASE],
                    pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in base]),
                    pa.array([joined(x) for x in spans], pa.string()),
                ],
                names=["doc_id", *_COUNTS, "base_sha256", "spans"],
            )

    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, base_sha256 string, spans string").withColumnRenamed("doc_id", id_column)


def redact(docs: DataFrame, drop: bool = False) -> DataFrame:
    """docs with every span replaced by ``<kind>``, and n_chars, if it is there, the new length; with drop, without the rows that have spans."""
    shared = docs.sparkSession.sparkContext.broadcast(Scanner())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for piece in common.pieces(batches, "text"):
            at = piece.schema.names.index("text") if at is None else at
            found = [shared.value.spans(raw) for raw in _texts(piece)]
            texts = [cut(t, spans) if spans else t for t, spans in zip(piece.column("text").to_pylist(), found, strict=True)]
            columns = [*piece.columns]
            columns[at] = pa.array(texts, piece.schema.field("text").type)
            if "n_chars" in piece.schema.names:
                k = piece.schema.names.index("n_chars")
                columns[k] = pa.array([len(t) if x else n for t, x, n in zip(texts, found, columns[k].to_pylist(), strict=True)], columns[k].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([bool(x) for x in found], pa.bool_())], names=[*piece.schema.names, mark])

    plain = common.undotted(docs)
    mark = common.free_name(plain.columns, "__found")
    out = plain.mapInArrow(run, StructType([*plain.schema.fields]).add(mark, BooleanType()))
    return (out.where(~F.col(mark)) if drop else out).select(plain.columns).toDF(*docs.columns)


def cut(text: str, spans: list[Span]) -> str:
    """Spans that overlap are replaced as one, under the kind that starts first."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_secrets: the spans of every document of the table."""
    return scan(common.read(spark, sf_dir, "documents"))
