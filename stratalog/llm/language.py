"""Language identification by a convolutional network over bytes, in NumPy.

A text is cut into windows of a fixed number of bytes, all of it.  Each window's bytes, as classes
(letters in lower case, bytes beyond ASCII as they are), go through filters of several widths; the
maximum of each filter over the window, cut off at zero, goes to a softmax.  A text's probabilities are the
means over its windows.  A filter over one-hot bytes is a sum of table rows, so that inference adds rows of tables for
byte pairs, and the gradient of a maximum touches one position only.

Learning: text and non-null lang of a bounded number of documents per language (``PER_LANGUAGE``, fewer where more than
``LEARN_DOCS`` would come together, one at least), chosen by a hash of the id outside the held-out quarter, one text a document.
Every value of lang that has a text with a letter is learned; the bounds hold before anything reaches the driver.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and where nothing
could be learned; equal texts are judged alike; ties between languages go to the first in sorted order; texts of any length are judged
whole, window by window in bounded memory; an empty table has no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructType

from stratalog.llm import common

UNDECIDED = "und"
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Documents learned from per language and together, and windows of each.
PER_LANGUAGE, LEARN_DOCS, WINDOWS_PER_TEXT = 600, 60_000, 8
#: Below this score the pipeline rejects a text.
LEAST_SCORE = 0.3
_SOME = 2048


def byte_classes() -> np.ndarray:
    """Class of each byte: 0 pads, then control and space, digits, other ASCII, 26 letters, and one for each byte from 0x80 on."""
    table = np.full(256, 3, dtype=np.uint8)
    table[:33] = 1
    table[48:58] = 2
    table[65:91] = table[97:123] = np.arange(4, 30)
    table[128:] = np.arange(30, 158)
    return table


CLASSES = 158
_TABLE = byte_classes()


def has_letter(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)


def windowed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of each row, padded with class 0 at the end, and the n + 1 offsets into them."""
    sizes = np.diff(offsets)
    count = np.maximum(1, -(-sizes // WINDOW))
    of = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(of[-1] * WINDOW, dtype=np.uint8)
    out[np.arange(len(data)) + np.repeat(of[:-1] * WINDOW - offsets[:-1], sizes)] = _TABLE[data]
    return out.reshape(-1, WINDOW), of


class Network:
    """filters[w]: (w, classes, filters), biases[w]: (filters,), out: (all filters + 1, languages)."""

    def __init__(self, languages: list[str], seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = {w: rng.normal(0, 0.1, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.biases = {w: np.zeros(FILTERS, dtype=np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS) + 1, len(languages))).astype(np.float32)
        self.pairs: dict[tuple[int, int], np.ndarray] = {}

    # -- learning -------------------------------------------------------------------------

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = 500, batch: int = 96, rate: float = 0.01, seed: int = 8) -> Network:
        """Adam on the cross-entropy; each language is drawn equally often, and beyond eight, each takes more steps."""
        steps += steps // 16 * max(0, len(self.languages) - 8)
        rng = np.random.default_rng(seed)
        by_language = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        parts = [*self.filters.values(), *self.biases.values(), self.out]
        mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
        for step in range(1, steps + 1):
            y = rng.integers(0, len(self.languages), batch)
            x = windows[[by_language[k][rng.integers(0, len(by_language[k]))] for k in y]]
            for p, g, m, s in zip(parts, self.gradients(x, y), mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        self.pairs = {}
        return self

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, pooled, where = len(x), [], {}
        for w in WIDTHS:
            z = sum(self.filters[w][k][x[:, k : WINDOW - w + 1 + k]] for k in range(w))
            where[w] = z.argmax(axis=1)
            pooled.append(np.take_along_axis(z, where[w][:, None], axis=1)[:, 0] + self.biases[w])
        hidden = np.concatenate([*pooled, np.ones((n, 1), dtype=np.float32)], axis=1)
        active = np.maximum(hidden, 0)
        error = softmax(active @ self.out)
        error[np.arange(n), y] -= 1
        error /= n
        back = (error @ self.out.T) * (hidden > 0)
        filters, biases = [], []
        for i, w in enumerate(WIDTHS):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]
            d = np.zeros_like(self.filters[w])
            for k in range(w):
                np.add.at(d[k], (np.take_along_axis(x, where[w] + k, axis=1), np.arange(FILTERS)[None]), g)
            filters.append(d + 1e-5 * self.filters[w])
            biases.append(g.sum(axis=0))
        return [*filters, *biases, active.T @ error]

    # -- use ------------------------------------------------------------------------------

    def pair_table(self, w: int, k: int) -> np.ndarray:
        """What two bytes at places k and k + 1 of a filter of width w add up to, for each pair of classes."""
        if (w, k) not in self.pairs:
            f = self.filters[w]
            self.pairs[w, k] = (f[k][:, None] + f[k + 1][None]).reshape(-1, FILTERS)
        return self.pairs[w, k]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax for each window."""
        out = []
        for at in range(0, len(windows), _SOME):
            x = windows[at : at + _SOME].astype(np.int32)
            pair = x[:, :-1] * CLASSES + x[:, 1:]
            pooled = []
            for w in WIDTHS:
                n = WINDOW - w + 1
                z = self.pair_table(w, 0).take(pair[:, :n], axis=0)
                for k in range(2, w - 1, 2):
                    z += self.pair_table(w, k).take(pair[:, k : k + n], axis=0)
                if w % 2:
                    z += self.filters[w][w - 1].take(x[:, w - 1 : w - 1 + n], axis=0)
                pooled.append(z.max(axis=1) + self.biases[w])
            hidden = np.concatenate([*pooled, np.ones((len(x), 1), dtype=np.float32)], axis=1)
            out.append(softmax(np.maximum(hidden, 0) @ self.out))
        return np.concatenate(out)

    def judge(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        names = np.array([*self.languages, UNDECIDED], dtype=object)
        best, score = np.full(len(column), len(self.languages)), np.zeros(len(column))
        if self.languages and len(column):
            windows, of = windowed(*common.utf8(column))
            means = np.add.reduceat(self.probabilities(windows).astype(np.float64), of[:-1], axis=0) / np.diff(of)[:, None]
            letters = has_letter(column)
            best[letters] = means.argmax(axis=1)[letters]
            score[letters] = np.clip(means.max(axis=1)[letters], 0, 1)
        return names[best].tolist(), score


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, together: int = LEARN_DOCS) -> Network:
    """Learns from docs (doc_id, text, lang), held-out rows left out."""
    usable = F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\pL") & ~common.held_out(F.col("doc_id"))
    known = docs.where(usable).select("lang", "text", common.hash_rank("doc_id", "lang").alias("rank"), F.xxhash64("text").alias("key"))
    # one row a language: as small as the labels' own set of values
    counts = common.written(known.groupBy("lang").agg(F.approx_count_distinct("rank").alias("n")), "counts")
    languages = [r["lang"] for r in counts.select("lang").orderBy("lang").collect()]
    if not languages:
        return Network([])
    per = max(1, min(per_language, together // len(languages)))
    shares = counts.select("lang", F.least(F.lit(1.0), 1.5 * per / F.col("n") + 3.0 / F.sqrt("n")).alias("share"))
    some = known.join(F.broadcast(shares), "lang").where(F.col("rank") < F.col("share")).groupBy("lang", "rank").agg(F.min("key").alias("key"))
    # per rows a language are broadcast, one for each document
    first = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("rank"))).where(F.col("place") <= per).drop("place")
    chosen = known.join(F.broadcast(first), ["lang", "rank", "key"]).select("lang", "rank", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, "text"):
            windows, of = windowed(*common.utf8(piece.column("text")))
            made = [windows[np.unique(np.linspace(a, b - 1, WINDOWS_PER_TEXT).astype(int))].tobytes() for a, b in zip(of[:-1], of[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("lang"), piece.column("rank"), pa.array(made, pa.binary())], names=["lang", "rank", "windows"])

    # repeated rows once: at most per rows a language are left
    rows = chosen.mapInArrow(cut, "lang string, rank double, windows binary").dropDuplicates(["lang", "rank"]).orderBy("lang", "rank").collect()
    common.discard(counts)
    place = {lang: k for k, lang in enumerate(languages)}
    windows = np.frombuffer(b"".join(r["windows"] for r in rows), dtype=np.uint8).reshape(-1, WINDOW)
    labels = np.repeat([place[r["lang"]] for r in rows], [len(r["windows"]) // WINDOW for r in rows])
    return Network(languages).fit(windows, labels)


def predict(docs: DataFrame, network: Network, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: id, held_out, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    narrow = docs.select(F.col(id_column).alias("doc_id"), common.held_out(F.col(id_column)).alias("held_out"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, "text"):
            names, score = shared.value.judge(piece.column("text"))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("doc_id", id_column)


def keep_known(docs: DataFrame, network: Network, least: float = LEAST_SCORE) -> DataFrame:
    """docs without the texts whose language is undecided or scored below the least, all columns as they were.  Where nothing could be learned, texts with a letter stay."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.pieces(batches, "text"):
            if shared.value.languages:
                names, score = shared.value.judge(piece.column("text"))
                known = (np.array(names, dtype=object) != UNDECIDED) & (score >= least)
            else:
                known = has_letter(piece.column("text"))
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(known)], names=[*piece.schema.names, mark])

    plain = common.undotted(docs)
    mark = common.free_name(plain.columns, "__known")
    out = plain.mapInArrow(run, StructType([*plain.schema.fields]).add(mark, BooleanType()))
    return out.where(F.col(mark)).select(plain.columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6_language: the language of every document of the table."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, train(docs))
