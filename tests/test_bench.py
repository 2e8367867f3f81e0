import random

import numpy as np
import pytest

from stratalog.operators import bench


def points(spark, rows):
    return spark.createDataFrame([("s", str(k), float(x), float(y)) for k, (x, y) in enumerate(rows)], "suite string, codec string, x double, y double")


def optimal(frame):
    return [r.codec for r in bench.pareto(frame, "suite").where("is_optimal").orderBy("codec").collect()]


def test_fronts(spark):
    a = points(spark, [(100, 50), (200, 60), (50, 80), (30, 40)])
    assert optimal(a) == ["1", "2"]
    b = points(spark, [(10, 90), (50, 45), (100, 10)])
    rows = {r.codec: r for r in bench.tiers(b, "suite").collect()}
    assert all(r.is_optimal for r in rows.values())
    assert [rows[k].on_hull for k in "012"] == [True, False, True]


def dominated_depth(x, y):
    """Tier by peeling: points no other beats are tier 1, and so on; no equal coordinates."""
    tier, left = np.zeros(len(x), dtype=int), set(range(len(x)))
    k = 1
    while left:
        front = [i for i in left if not any(x[j] >= x[i] and y[j] >= y[i] and j != i for j in left)]
        for i in front:
            tier[i] = k
        left -= set(front)
        k += 1
    return tier


def test_tiers_are_peeled_fronts():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 60, 200):
        x, y = rng.permutation(n) + rng.random(n) / 2, rng.permutation(n) + rng.random(n) / 2
        assert bench.tiers_of(x, y).tolist() == dominated_depth(x, y).tolist()
    assert sorted(bench.tiers_of(np.array([1.0, 1.0]), np.array([2.0, 2.0])).tolist()) == [1, 2]


def test_tiers_of_equal_points_follow_the_codec(spark):
    """Whatever the order of the rows: by code points, so that "10" comes before "9"."""
    names = ["9", "10", "b", "B", "é", "\U0001f600", "\uffee"]
    for order in (names, names[::-1]):
        rows = spark.createDataFrame([("s", k, 1.0, 2.0) for k in order], "suite string, codec string, x double, y double").coalesce(1)
        found = {r.codec: (r.tier, r.is_optimal, r.on_hull) for r in bench.tiers(rows, "suite").collect()}
        assert found == {k: (n, n == 1, n == 1) for n, k in enumerate(sorted(names, key=str.encode), 1)}


def test_hull_lies_above_all_points():
    rng = np.random.default_rng(3)
    x, y = rng.random(80), rng.random(80)
    on = np.flatnonzero(bench.hull_of(x, y))
    corners = on[np.argsort(x[on])]
    assert (np.interp(x, x[corners], y[corners]) >= y - 1e-6).all()
    assert bench.hull_of(np.array([1.0, 2.0]), np.array([1.0, 2.0])).all()


def test_interpolation_is_monotone_and_exact():
    rng = random.Random(4)
    for _ in range(50):
        x = np.cumsum([rng.random() + 0.01 for _ in range(8)])
        y = np.cumsum([rng.choice([0, rng.random()]) for _ in range(8)])
        at = np.linspace(x[0] - 1, x[-1] + 1, 400)
        v = bench.monotone(x, y, at)
        assert (np.diff(v) >= -1e-9).all() and np.allclose(bench.monotone(x, y, x), y)
        assert v[0] == y[0] and v[-1] == y[-1]
    assert bench.monotone(np.array([1.0, 1.0]), np.array([3.0, 3.0]), np.array([0.0])).tolist() == [3.0]


def test_welch(spark):
    a = spark.createDataFrame([("m", v) for v in (10.0, 11.0, 9.0, 10.0)] + [("one", 1.0), ("flat", 2.0), ("flat", 2.0), ("only_a", 1.0)], "metric string, v double")
    b = spark.createDataFrame([("m", v) for v in (14.0, 15.0, 13.0, 14.0)] + [("one", 5.0), ("flat", 2.0), ("flat", 2.0)], "metric string, v double")
    rows = {r.metric: r for r in bench.welch(a, b, "metric", "v").collect()}
    assert set(rows) == {"m", "one", "flat"}
    assert rows["m"].t == pytest.approx(6.928203, abs=1e-5) and rows["m"].df == pytest.approx(6) and rows["m"].verdict == "increase"
    assert rows["m"].p == pytest.approx(0.000448, abs=1e-5)
    assert (rows["one"].t, rows["one"].p, rows["flat"].df, rows["flat"].verdict) == (0, 1, 2, "no change")


def test_audit(spark):
    keys = "format string, level int"
    old = spark.createDataFrame([("zip", 1, 100.0, 100.0), (None, 2, 100.0, 0.0)], keys + ", c double, e double")
    new = spark.createDataFrame([("zip", 1, 85.0, 104.0), (None, 2, 95.0, 50.0), ("tar", 3, 1.0, 1.0)], old.schema)
    out = bench.audit(new, old, ("format", "level"), ("c", "e"))
    got = {(r.format, r.measure): r.verdict for r in out.collect()}
    assert got == {("zip", "c"): "CRITICAL", ("zip", "e"): "GAIN", (None, "c"): "WARNING", (None, "e"): "NO_BASELINE", ("tar", "c"): "NO_BASELINE", ("tar", "e"): "NO_BASELINE"}
    assert bench.exit_code(out) == 2 and bench.exit_code(out.where("verdict = 'GAIN'")) == 0
    assert {r.verdict: r.n for r in bench.audit_summary(out).collect()}["NO_BASELINE"] == 3


def test_rates(spark):
    r = bench.throughput(spark.createDataFrame([(2_000_000, 2.0, 4_000_000, 8_000_000), (1, 0.0, 0, 0)], "bytes long, seconds double, c long, i long"), "c", "i").collect()
    assert (r[0].mb_s, r[0].cycles_per_byte, r[0].ipc) == (1.0, 2.0, 2.0) and r[1].mb_s is None


def test_fronts_without_groups_are_cut_into_slices(spark):
    rng = random.Random(8)
    rows = [(k, float(rng.randint(0, 300)), float(rng.randint(0, 300))) for k in range(900)]
    found = {r.k: r.is_optimal for r in bench.pareto(spark.createDataFrame(rows, "k int, x double, y double"), slices=9).collect()}
    best = {}
    for k, x, y in sorted(rows, key=lambda r: (-r[1], -r[2])):
        best[k] = all(y > b + 1e-7 for _, b in best.values()), y
    assert {k for k, v in found.items() if v} and sum(found.values()) == sum(v for v, _ in best.values())
    points = {k: (x, y) for k, x, y in rows}
    assert {points[k] for k, v in found.items() if v} == {points[k] for k, (v, _) in best.items() if v}
