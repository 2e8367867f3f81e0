"""Toxicity from confirmed toxic examples and unlabelled text: non-negative positive-unlabelled learning, in NumPy.

A text's features are its distinct words (ASCII lower-cased) and their beginnings of several
lengths, and which of them occur often.  Candidates are those far more frequent in the positives than in unlabelled text; a linear
model over them is trained on the risk

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

with the logistic loss: the unlabelled text stands for both classes, the positives' share is taken
out, and where that term falls below zero its gradient is turned round.  The prior is the share of toxic among the
rows that may be learned from.

Learning uses bounded numbers of positives (``POSITIVES``) and unlabelled texts (``UNLABELLED``) of any length, and bounded bytes
of their features (``SAMPLE_BYTES``), chosen by a hash of the id, one text an id, never from the held-out quarter.  Features are made where the
texts are, and both bounds hold before anything reaches the driver.

Defined results: null and empty texts have no features and get the score of none; without a positive to learn from, all
scores are 0; repeated rows score alike; a document with several labels is toxic if any is; an empty table has no rows; texts of any
length are scored whole; only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import common

POSITIVES, UNLABELLED, SAMPLE_BYTES = 3000, 6000, 48 << 20
#: Bytes of the word beginnings that are features, features kept, and the share of a candidate's texts that must be positive by the prior.
PREFIXES, FEATURES, LEAST_PURITY = (4, 5, 6), 4096, 0.6
#: How often a word or beginning occurs in a text to be a second feature of it.
OFTEN = 3
THRESHOLD = 0.3
_WORD = common.byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


def tokens(column: pa.Array, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash (lowest bit 0) of each word and each beginning; with marks, only those whose upper 20 bits are marked."""
    data, offsets = common.utf8(column)
    words = common.Words(common.lower_table()[data], offsets, _WORD)
    of, sizes = words.row_of_words(), words.ends - words.starts
    rows, hashes = [], []
    for n in (0, *PREFIXES):
        some = np.flatnonzero(sizes > n)
        h = words.hashes() if not n else words.some_hashes(some, words.starts[some] + n, seed=3 + n)
        row = of[some]
        if marks is not None:
            near = marks[h >> np.uint64(44)]
            h, row = h[near], row[near]
        rows.append(row)
        hashes.append(h & ~np.uint64(1))
    return np.concatenate(rows), np.concatenate(hashes)


def features(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of each feature: a hash that occurs in the row, and with the lowest bit set one that occurs OFTEN times."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(rows)), dtype=bool), (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])]))
    often = first[np.diff(np.append(first, len(rows))) >= OFTEN]
    return np.concatenate([rows[first], rows[often]]), np.concatenate([hashes[first], hashes[often] | np.uint64(1)])


class Model(NamedTuple):
    """keys: sorted features; a score is the logistic of bias + the weights of the features a text has."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, column: pa.Array) -> np.ndarray:
        if not self.prior:
            return np.zeros(len(column))
        total = np.full(len(column), self.bias)
        if len(self.keys):
            marks = np.zeros(1 << 20, dtype=bool)
            marks[self.keys >> np.uint64(44)] = True
            rows, found = features(*tokens(column, marks))
            place = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            same = self.keys[place] == found
            total += np.bincount(rows[same], self.weights[place[same]], minlength=len(column))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.05, decay: float = 5e-4) -> Model:
    """Chooses the features and trains their weights."""
    if not positive or not unlabelled or not prior:
        return Model(np.empty(0, np.uint64), np.empty(0), 0.0, 0.0)
    keys, seen = np.unique(np.concatenate(positive), return_counts=True)
    other = np.zeros(len(keys))
    for h in unlabelled:
        place = np.searchsorted(keys, h)
        place = place[(place < len(keys)) & (keys[np.minimum(place, len(keys) - 1)] == h)]
        other[place] += 1
    # how unlikely so many positives are at the rate of unlabelled text (the exponent of a Poisson tail), against the number of candidates
    usual = len(positive) * (other + 0.5) / (len(unlabelled) + 1)
    lift = seen / usual
    surprise = seen * np.log(lift) - seen + usual
    good = np.flatnonzero((lift * prior >= LEAST_PURITY) & (surprise >= np.log(len(keys)) + 1))
    good = np.sort(good[np.lexsort((good, -surprise[good]))][:FEATURES])
    keys = keys[good]
    p, u = matrix(positive, keys), matrix(unlabelled, keys)
    weights, bias = np.zeros(len(keys)), -1.0
    mean, square = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)

    def sums(rows: tuple, value: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(rows[1], value[rows[0]], minlength=len(keys)), [value.sum()]]) / len(value)

    for step in range(1, steps + 1):
        zp = np.bincount(p[0], weights[p[1]], minlength=len(positive)) + bias
        zu = np.bincount(u[0], weights[u[1]], minlength=len(unlabelled)) + bias
        _, negative_part = risk(zp, zu, prior)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        towards_negative = sums(u, su) - prior * sums(p, sp)
        g = prior * sums(p, sp - 1) + towards_negative if negative_part >= 0 else -towards_negative
        g[:-1] += decay * weights
        mean += 0.1 * (g - mean)
        square += 0.01 * (g * g - square)
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    return Model(keys, weights, float(bias), prior)


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the risk from the margins of positive and unlabelled texts: of positives, and of negatives, which the estimator keeps from falling below zero."""
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def matrix(texts: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the features that texts have."""
    rows, columns = [], []
    for r, h in enumerate(texts):
        place = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
        place = place[keys[place] == h] if len(keys) else np.empty(0, np.int64)
        rows.append(np.full(len(place), r))
        columns.append(place)
    return np.concatenate(rows), np.concatenate(columns)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, room: int = SAMPLE_BYTES) -> Model:
    """Learns from docs (doc_id, text) and labels (doc_id, toxic)."""
    may = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~common.held_out(F.col("doc_id"))).select("doc_id", "toxic")
    prior = may.agg(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0))).first()[0] or 0.0
    if not prior:
        return fit([], [], 0.0)
    kind = docs.schema["doc_id"].dataType
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~common.held_out(F.col("doc_id"))).select("doc_id", "text", F.xxhash64("text").alias("key"))
    # of ids bounded numbers, and of an id's texts that with the smallest hash: what is broadcast below has positives + unlabelled short rows at most
    known = common.sampled(may.where("toxic = 1").select(F.col("doc_id").cast(kind).alias("doc_id")).distinct(), "doc_id", positives)
    marked = rows.join(F.broadcast(known), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("key").alias("key"))
    share = min(1.0, 1.3 * unlabelled / max(1, rows.agg(F.approx_count_distinct("doc_id")).first()[0]))
    others = rows.where(common.hash_rank("doc_id") < share).groupBy("doc_id").agg(F.min("key").alias("key")).orderBy(common.hash_rank("doc_id"), "doc_id").limit(unlabelled)
    chosen = marked.withColumn("positive", F.lit(True)).unionByName(others.withColumn("positive", F.lit(False)))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, "text"):
            of, keys = features(*tokens(piece.column("text")))
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(piece.num_rows + 1))
            made = [keys[order[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("positive"), pa.array(made, pa.binary())], names=["doc_id", "positive", "keys"])

    found = rows.join(F.broadcast(chosen), ["doc_id", "key"]).select("doc_id", "positive", "text").mapInArrow(featured, f"doc_id {kind.simpleString()}, positive boolean, keys binary")
    found = common.written(found.dropDuplicates(["doc_id", "positive"]).withColumn("rank", common.hash_rank("doc_id")), "features")
    texts: dict[bool, list[np.ndarray]] = {}
    for positive in (True, False):
        some = common.within(found.where(F.col("positive") == positive), F.length("keys"), room, "rank", "doc_id").orderBy("rank", "doc_id").select("keys")
        texts[positive] = [np.frombuffer(r["keys"], dtype=np.uint64) for r in some.toLocalIterator()]
    common.discard(found)
    return fit(texts[True], texts[False], prior)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(id_column).alias("doc_id"), common.held_out(F.col(id_column)).alias("held_out"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, "text"):
            s = shared.value.scores(piece.column("text"))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("doc_id", id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3_toxicity: the score of every document of the table."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, common.read(spark, sf_dir, "labels")))
