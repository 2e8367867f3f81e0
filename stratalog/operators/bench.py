"""Statistics of measurements: Pareto fronts, tiers, hulls, interpolation, A/B tests and regression audits."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.functions import paths, payload

EPSILON = 1e-7
MOST_CRITICAL, LEAST_WARNING, LEAST_GAIN = -10.0, -3.0, 3.0


# -- fronts -----------------------------------------------------------------------------------


def pareto(points: DataFrame, *by: str, slices: int = 64) -> DataFrame:
    """points (x, y) with is_optimal: no point of the same group is as good in both and better in one.  Larger is better.

    A window a group.  Without groups, x is cut into slices of like size, each with a window of its own, which also
    has to beat the best of the slices above: a row a slice is broadcast.
    """
    order = [F.desc("x"), F.desc("y")]
    if by:
        best = F.max("y").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        return points.withColumn("is_optimal", best.isNull() | (F.col("y") > best + EPSILON))
    edges = sorted(set(points.approxQuantile("x", [k / slices for k in range(1, slices)], 0.001)))
    part = sum((F.when(F.col("x") > e, 1).otherwise(0) for e in edges), F.lit(0))
    sliced = points.withColumn("__slice", part)
    tops = sliced.groupBy("__slice").agg(F.max("y").alias("top"))
    above = tops.select("__slice", F.max("top").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("__slice")).rowsBetween(Window.unboundedPreceding, -1)).alias("__above"))
    inside = F.max("y").over(Window.partitionBy("__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    best = F.greatest(inside, F.col("__above"))
    return sliced.join(F.broadcast(above), "__slice").withColumn("is_optimal", best.isNull() | (F.col("y") > best + EPSILON)).select(*points.columns, "is_optimal")


def tiers_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tier of each point, from 1: by falling x, the first tier whose best y so far the point beats by more than epsilon.

    Best ys fall from tier to tier, so the tier is found by bisection.  Of equal points, the earlier in the arrays gets the earlier tier.
    """
    out = np.zeros(len(x), dtype=np.int64)
    tops: list[float] = []  # negated, rising
    for i in np.lexsort((-y, -x)):
        k = bisect.bisect_right(tops, -(y[i] - EPSILON))
        # tiers before k have a top that is not beaten
        while k > 0 and y[i] > -tops[k - 1] + EPSILON:
            k -= 1
        if k == len(tops):
            tops.append(-y[i])
        else:
            tops[k] = -y[i]
        out[i] = k + 1
    return out


def hull_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points are corners of the upper hull; all of two or fewer."""
    on = np.zeros(len(x), dtype=bool)
    if len(x) <= 2:
        return ~on
    kept: list[int] = []
    for i in np.lexsort((y, x)):
        while len(kept) >= 2:
            a, b = kept[-2], kept[-1]
            if (x[b] - x[a]) * (y[i] - y[a]) - (y[b] - y[a]) * (x[i] - x[a]) < -EPSILON:
                break
            kept.pop()
        kept.append(i)
    on[kept] = True
    return on


def tiers(points: DataFrame, by: str) -> DataFrame:
    """points (by, codec, x, y) with tier, is_optimal and on_hull (corners among the optimal ones).

    Of points at the same place, the codec that sorts first has the earlier tier, in whatever order they arrive.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("codec", kind="stable")
        x, y = group["x"].to_numpy(float), group["y"].to_numpy(float)
        tier = tiers_of(x, y)
        first = tier == 1
        on = np.zeros(len(x), dtype=bool)
        on[first] = hull_of(x[first], y[first])
        return group.assign(tier=tier, is_optimal=first, on_hull=on)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.groupBy(by).applyInPandas(run, f"{schema}, tier long, is_optimal boolean, on_hull boolean")


def monotone(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation (Fritsch and Carlson): secant means as slopes, zero at turns, held inside a circle of radius 3; ends are held."""
    x, keep = np.unique(x, return_index=True)
    y = y[keep]
    if len(x) < 2:
        return np.full(len(at), y[0] if len(y) else np.nan)
    h, secant = np.diff(x), np.diff(y) / np.diff(x)
    slope = np.concatenate(([secant[0]], (secant[:-1] + secant[1:]) / 2, [secant[-1]]))
    slope[1:-1][secant[:-1] * secant[1:] <= 0] = 0
    flat = secant == 0
    slope[:-1][flat] = slope[1:][flat] = 0
    for k in np.flatnonzero(~flat):
        a, b = slope[k] / secant[k], slope[k + 1] / secant[k]
        size = np.hypot(a, b)
        if size > 3:
            slope[k], slope[k + 1] = 3 / size * a * secant[k], 3 / size * b * secant[k]
    at = np.clip(at, x[0], x[-1])
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(h) - 1)
    t = (at - x[k]) / h[k]
    return (1 + 2 * t) * (1 - t) ** 2 * y[k] + t * (1 - t) ** 2 * h[k] * slope[k] + t**2 * (3 - 2 * t) * y[k + 1] + t**2 * (t - 1) * h[k] * slope[k + 1]


def interpolated(points: DataFrame, by: str, steps: int = 33) -> DataFrame:
    """by, x, y at evenly spaced places between each group's ends."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x, y = group["x"].to_numpy(float), group["y"].to_numpy(float)
        order = np.lexsort((y, x))
        at = np.linspace(x.min(), x.max(), steps)
        return pd.DataFrame({by: group[by].iloc[0], "x": at, "y": monotone(x[order], y[order], at)})

    return points.select(by, "x", "y").groupBy(by).applyInPandas(run, f"`{by}` {dict(points.dtypes)[by]}, x double, y double")


# -- tests ------------------------------------------------------------------------------------


def samples(values: DataFrame, metric: str, value: str, *where: object) -> DataFrame:
    return values.groupBy(metric).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count(value).alias("n"))


def welch(a: DataFrame, b: DataFrame, metric: str, value: str, threshold_pct: float = 3.0, with_p: bool = True) -> DataFrame:
    """For metrics of both sides: means, change in per cent, Welch's t, its degrees of freedom, p and a verdict.

    The verdict needs p below 0.05 and a change of more than max(1, threshold) per cent.  Sums are aggregated before the join.
    """
    left = samples(a, metric, value).select(metric, *[F.col(c).alias(f"{c}_a") for c in ("mean", "sd", "n")])
    right = samples(b, metric, value).select(metric, *[F.col(c).alias(f"{c}_b") for c in ("mean", "sd", "n")])
    va, vb = F.col("sd_a") ** 2 / F.col("n_a"), F.col("sd_b") ** 2 / F.col("n_b")
    few = (F.col("n_a") < 2) | (F.col("n_b") < 2)
    still = F.sqrt(va + vb) < 1e-12
    t = F.when(few | still, 0.0).otherwise((F.col("mean_b") - F.col("mean_a")) / F.sqrt(va + vb))
    df = F.when(few, 1.0).when(still, F.col("n_a") + F.col("n_b") - 2.0).otherwise((va + vb) ** 2 / (va**2 / (F.col("n_a") - 1) + vb**2 / (F.col("n_b") - 1)))
    out = left.join(right, metric).withColumns({"t": t, "df": df, "delta_pct": F.coalesce(F.try_divide((F.col("mean_b") - F.col("mean_a")) * 100, F.col("mean_a")), F.lit(0.0))})
    if not with_p:
        return out
    p = F.when(few | still, 1.0).otherwise(payload.t_pvalue("t", "df"))
    least = max(1.0, threshold_pct)
    verdict = F.when((F.col("p") >= 0.05) | (F.abs("delta_pct") <= least), "no change").when(F.col("delta_pct") > 0, "increase").otherwise("decrease")
    return out.withColumn("p", p).withColumn("verdict", verdict)


def audit(latest: DataFrame, baseline: DataFrame, keys: tuple[str, ...], measures: tuple[str, ...]) -> DataFrame:
    """A row for each key and measure of latest: before, after, change in per cent and verdict; NO_BASELINE where nothing is known."""
    old = baseline.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(m).alias(f"__{m}") for m in measures])
    same = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}")) if same is None else same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"__{m}").cast("double").alias("before"), F.col(m).cast("double").alias("after")) for m in measures]))
    rows = latest.join(old, same, "left").select(*keys, each.alias("r")).select(*keys, "r.*")
    change = F.when(F.col("before") > 0, (F.col("after") - F.col("before")) / F.col("before") * 100)
    verdict = F.when(change.isNull(), "NO_BASELINE").when(change > LEAST_GAIN, "GAIN").when(change < MOST_CRITICAL, "CRITICAL").when(change < LEAST_WARNING, "WARNING").otherwise("FLAT")
    return rows.withColumns({"change_pct": change, "verdict": verdict})


def audit_summary(audited: DataFrame) -> DataFrame:
    return audited.groupBy("verdict").agg(F.count("*").alias("n"))


def exit_code(audited: DataFrame) -> int:
    """2 with a critical row, 1 with a warning, else 0."""
    worst = audited.agg(F.max(F.when(F.col("verdict") == "CRITICAL", 2).when(F.col("verdict") == "WARNING", 1).otherwise(0))).first()[0]
    return worst or 0


# -- matrices ---------------------------------------------------------------------------------


def matrix_summary(points: DataFrame) -> DataFrame:
    """Peaks, largest savings, optimal points and whether the matrix is complete (50 points or more, one optimal)."""
    optimal = F.count_if("is_optimal")
    return points.agg(
        F.count("*").alias("n_points"),
        F.max("compress_mbs").alias("peak_compress_mbs"),
        F.max("decompress_mbs").alias("peak_decompress_mbs"),
        F.max(paths.savings(F.col("original"), F.col("compressed"))).alias("max_savings_pct"),
        optimal.cast("long").alias("n_optimal"),
        ((F.count("*") >= 50) & (optimal > 0)).alias("passed"),
    )


def throughput(rows: DataFrame, cycles: str | None = None, instructions: str | None = None) -> DataFrame:
    """MB/s of (bytes, seconds), and cycles a byte and instructions a cycle where counters are given."""
    out = rows.withColumn("mb_s", F.try_divide(F.col("bytes") / 1e6, F.col("seconds")))
    if cycles:
        out = out.withColumn("cycles_per_byte", F.try_divide(F.col(cycles).cast("double"), F.col("bytes")))
    return out.withColumn("ipc", F.try_divide(F.col(instructions).cast("double"), F.col(cycles))) if cycles and instructions else out
