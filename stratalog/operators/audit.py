"""Analytics of payloads at table level: histograms, divergence, segments, recommendations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions import payload

LEAST_SEGMENT, MOST_SEGMENT, COMPRESSIBLE = 1 << 10, 1 << 20, 7.5


def byte_counts(table: DataFrame, by: str, column: str = "payload") -> DataFrame:
    """by, byte, n over all payloads of a group: counted in Arrow batches, then summed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for key, rows in batch.groupby(by, dropna=False)[column]:
                counts = sum((payload.byte_counts(b) for b in rows if b is not None), np.zeros(256, dtype=np.int64))
                made.append(pd.DataFrame({by: key, "byte": np.flatnonzero(counts), "n": counts[counts > 0]}))
            if made:
                yield pd.concat(made)

    kind = dict(table.dtypes)[by]
    return table.select(by, column).mapInPandas(run, f"`{by}` {kind}, byte int, n long").groupBy(by, "byte").agg(F.sum("n").alias("n"))


def entropies(counts: DataFrame, by: str) -> DataFrame:
    """Bits a byte of each group of (by, byte, n)."""
    totals = counts.groupBy(by).agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return counts.join(totals, by).groupBy(by).agg(F.greatest(F.lit(0.0), -F.sum(p * F.log2(p))).alias("entropy"))


def divergence(counts: DataFrame, by: str, a: object, b: object) -> DataFrame:
    """Half the absolute differences between the byte shares of two groups: 0 if alike, 1 if disjoint."""
    shares = counts.where(F.col(by).isin(a, b)).join(counts.groupBy(by).agg(F.sum("n").alias("total")), by)
    p = F.col("n") / F.col("total")
    signed = shares.groupBy("byte").agg(F.sum(F.when(F.col(by) == a, p).otherwise(-p)).alias("d"))
    return signed.agg((F.sum(F.abs("d")) / 2).alias("divergence"))


def segments(table: DataFrame, key: str, column: str = "payload", size: int = 65_536) -> DataFrame:
    """key, segment, offset, length, entropy and is_compressible of every piece of every payload."""
    size = min(MOST_SEGMENT, max(LEAST_SEGMENT, size))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, at, len(b[at : at + size]), payload.entropy_of(payload.byte_counts(b[at : at + size]))) for k, b in zip(batch[key], batch[column], strict=True) if b is not None for i, at in enumerate(range(0, len(b), size))]
            yield pd.DataFrame(rows, columns=[key, "segment", "offset", "length", "entropy"])

    kind = dict(table.dtypes)[key]
    return table.select(key, column).mapInPandas(run, f"`{key}` {kind}, segment int, offset long, length int, entropy double").withColumn("is_compressible", F.col("entropy") < COMPRESSIBLE)


def segment_summary(pieces: DataFrame, key: str) -> DataFrame:
    return pieces.groupBy(key).agg(F.count("*").alias("n_segments"), F.count_if("is_compressible").cast("long").alias("n_compressible"), F.avg("entropy").alias("mean_entropy"))


def text_segments(table: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Segments of a text column in characters, in expressions only."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    cut = table.where(F.length(text) > 0).select(key, text, F.posexplode(starts).alias("segment", "offset"))
    piece: Column = F.substring(F.col(text), F.col("offset") + 1, F.lit(size))
    return cut.select(key, "segment", F.col("offset").cast("long").alias("offset"), F.length(piece).alias("length"), payload.text_entropy(piece).alias("entropy"))


def recommendations(table: DataFrame, key: str, kind: Column, column: str = "payload") -> DataFrame:
    """key, entropy, trial ratio and the recommended codec of every payload."""
    probed = table.select(key, payload.entropy(F.substring(F.col(column), 1, 1 << 20)).alias("entropy"), payload.trial_ratio()(F.col(column)).alias("ratio"), kind.alias("kind"))
    return probed.withColumn("r", payload.recommendation(F.col("entropy"), F.col("ratio"), F.col("kind"))).select(key, "entropy", "ratio", "r.*")
