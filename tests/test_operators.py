"""Closed-form cases and invariants of the operators on tiny tables."""

import datetime as dt
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgrid.functions import physics, stats, text
from skillgrid.operators import campaign, graph, pairing, quality, raster, regrid, spatial, strata, temporal
from skillgrid.operators.columns import interpolate_one


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_pair_stats(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 3.0), (1, 8.0, 4.0), (1, None, 5.0), (2, 5.0, 5.0), (2, 5.0, 6.0)], "k int, m double, o double")
    rows = {r.k: r for r in stats.pair_stats(df, ["k"], "m", "o").collect()}
    r = rows[1]
    m, o = np.array([1.0, 3.0, 8.0]), np.array([2.0, 3.0, 4.0])
    assert r.pair_count == 3 and r.bias == pytest.approx((m - o).mean()) and r.rmse == pytest.approx(math.sqrt(((m - o) ** 2).mean()))
    assert r.rmse**2 == pytest.approx(r.bias**2 + r.centered_rmse**2)
    assert r["corr"] == pytest.approx(np.corrcoef(m, o)[0, 1])
    assert rows[2]["corr"] is None  # a constant series has none


def test_pair_stats_of_nothing(spark):
    r = stats.pair_stats(spark.createDataFrame([(1, None, 2.0)], "k int, m double, o double"), ["k"], "m", "o").first()
    assert r.pair_count == 0 and r.rmse is None


def test_circular_error_wraps(spark):
    r = one(spark, a=stats.circular_error(F.lit(350.0), F.lit(10.0)), b=stats.circular_error(F.lit(10.0), F.lit(350.0)), c=stats.circular_error(F.lit(0.0), F.lit(180.0)))
    assert (r.a, r.b, r.c) == (-20.0, 20.0, -180.0)


@pytest.mark.parametrize("delta,base,want", [(-0.1, 1.0, "neutral"), (-0.100001, 1.0, "improvement"), (0.11, 1.0, "degradation"), (0.11, 4.0, "neutral"), (0.0, 0.0, "neutral")])
def test_material_change(spark, delta, base, want):
    assert one(spark, x=stats.material_change(F.lit(delta), F.lit(base))).x == want


@pytest.mark.parametrize("v,s,want", [("improvement", "improvement", "strong"), ("improvement", "neutral", "qualified"), ("neutral", "neutral", "neutral"), ("improvement", "degradation", "mixed"), ("degradation", "improvement", "mixed"), ("degradation", "neutral", "degraded"), ("degradation", "degradation", "degraded")])
def test_joint_class(spark, v, s, want):
    assert one(spark, x=stats.joint_class(F.lit(v), F.lit(s))).x == want


def test_exclusion_priority(spark):
    rows = [(None, None, None), (1.0, None, None), (1.0, None, 2.0), (1.0, 2.0, None), (1.0, 2.0, 3.0), (5.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "obs double, candidate double, baseline double")
    got = [r[0] for r in df.select(pairing.exclusion_reason(F.col("obs"), F.col("candidate"), F.col("baseline"), F.col("obs") < 2.5)).collect()]
    assert got == ["observation_missing", "both_models_missing", "candidate_missing", "baseline_missing", "calm", None]


def test_triplets_in_neither_model_are_not_counted(spark):
    t = lambda rows: spark.createDataFrame(rows, "k int, value double")
    out = pairing.common_triplets(t([(1, 1.0), (2, 1.0)]), t([(1, 2.0), (3, 1.0)]), t([(1, 3.0)]), ["k"])
    assert sorted((r.k, r.reason) for r in out.collect()) == [(1, None), (3, "observation_missing")]
    a = pairing.accounting(out.withColumn("g", F.lit(1)), ["g"]).first()
    assert a.candidates == a.accepted + a.excluded


def test_class_bounds(spark):
    df = spark.createDataFrame([(499.9,), (500.0,), (3000.0,)], "z double")
    assert [r[0] for r in df.select(strata.elevation_class(F.col("z"))).collect()] == ["<500", "500-1000", ">=3000"]
    assert [one(spark, x=strata.terrain_class(F.lit(v))).x for v in (-150.0, 150.0, 150.1)] == ["neutral", "neutral", "ridge"]


def test_ending_hour(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 1, 0),), (dt.datetime(2024, 1, 1, 1, 10),), (dt.datetime(2024, 1, 1, 2, 0),)], "ts timestamp")
    assert [r[0].hour for r in df.select(temporal.ending_hour(F.col("ts"))).collect()] == [1, 2, 2]


def test_asof_takes_the_last_and_keeps_the_early(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    left = spark.createDataFrame([(1, t(0)), (1, t(5)), (1, t(9))], "k int, ts timestamp")
    right = spark.createDataFrame([(1, t(1), 10.0), (1, t(5), 20.0)], "k int, ts timestamp, v double")
    assert [r.v for r in temporal.asof(left, right, ["k"], "ts", "ts", "v").orderBy("ts").collect()] == [None, 20.0, 20.0]


def test_coverage_both_ways(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    have = spark.createDataFrame([(1, t(0)), (1, t(2)), (1, t(9))], "k int, ts timestamp")
    bounds = spark.createDataFrame([(1, t(0), t(3))], "k int, begin timestamp, end timestamp")
    got = sorted((r.ts.hour, r.problem) for r in pairing.coverage(have, ["k"], "ts", "1 hour", bounds).collect())
    assert got == [(1, "missing"), (3, "missing"), (9, "unexpected")]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000), (7, None)]
    out = graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.component for r in out if r.node <= 200} == {0} and {r.component for r in out if 1000 <= r.node < 1400} == {1000}
    assert len(out) == 201 + 400


def test_box_mean_at_the_edge(spark):
    g = spark.createDataFrame([(y, x, float(y * 3 + x)) for y in range(3) for x in range(3)], "y int, x int, v double")
    got = {(r.y, r.x): r.v for r in raster.box_mean(g, "v", 1).collect()}
    assert got[0, 0] == pytest.approx(np.mean([0, 1, 3, 4])) and got[1, 1] == pytest.approx(4.0)


def test_filters_keep_a_constant(spark):
    g = spark.createDataFrame([(y, x, 7.0, (x + y) % 4 != 0) for y in range(6) for x in range(6)], "y int, x int, v double, land boolean")
    assert {r.v for r in raster.shapiro(g, "v", "land", 4, 1.0).collect()} == {7.0}


def test_gradient_of_a_parabola(spark):
    g = spark.createDataFrame([(0, x, float(x * x)) for x in range(6)], "y int, x int, v double")
    got = [r[1] for r in g.select("x", raster.gradient(g, "v", "x", 1.0)).orderBy("x").collect()]
    assert got == pytest.approx([2.0 * x for x in range(6)])


def test_labels_in_scan_order(spark):
    cells = [(0, 0), (0, 1), (0, 3), (1, 3), (2, 0)]
    g = spark.createDataFrame([(y, x, (y, x) in cells) for y in range(3) for x in range(4)], "y int, x int, m boolean")
    assert {(r.y, r.x): r.label for r in raster.label_components(g, F.col("m")).collect()} == {(0, 0): 1, (0, 1): 1, (0, 3): 2, (1, 3): 2, (2, 0): 3}


def test_kernel_weights_sum_to_one():
    rng = np.random.default_rng(0)
    donors = regrid._unit(46 + 0.01 * rng.random((20, 9)), 7 + 0.01 * rng.random((20, 9)))
    w, _ = regrid.kernel_weights(regrid._unit(np.full(20, 46.005), np.full(20, 7.005)), donors, 1e-4)
    assert w.sum(axis=1) == pytest.approx(np.ones(20))


def test_nearest_tie_goes_to_the_first(spark):
    cells = spark.createDataFrame([(0, 0, 46.0, 7.0), (0, 1, 46.0, 7.001953125)], "y int, x int, lat double, lon double")
    site = spark.createDataFrame([(1, 46.0, 7.0009765625)], "site int, lat double, lon double")
    r = spatial.nearest_cell(site, cells, ["site"]).first()
    assert (r.y, r.x) == (0, 0)


def test_profile_interpolation():
    z, v = np.array([100.0, 200.0]), np.array([10.0, 20.0])
    assert interpolate_one(z, v, np.array([150.0, 50.0]), 1.0, True).tolist() == [15.0, 10.0]  # held in the source's range
    assert np.isnan(interpolate_one(z, v, np.array([201.0]), 1.0, True)[0])


def test_bits_tell_zeros_apart(spark):
    a = spark.createDataFrame([("v", 1, 0.0), ("v", 2, float("nan"))], "var string, k int, value double")
    b = spark.createDataFrame([("v", 1, -0.0), ("v", 2, float("nan"))], "var string, k int, value double")
    assert quality.exact_compare(a, b, ["k"]).first().bits_different == 1


def test_rules_count_null_as_violation(spark):
    df = spark.createDataFrame([(1.0,), (None,), (-1.0,)], "v double")
    assert quality.check(df, {"positive": F.col("v") > 0}).first().violations == 2


def test_parsing(spark):
    r = one(spark, a=text.finite(F.lit("inf")), b=text.finite(F.lit("1e3")), c=text.finite(F.lit("x")), d=text.step_hours(F.lit("90m")), e=text.step_hours(F.lit("2d")), f=text.normalized_units(F.lit("W m**-2")))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (None, 1000.0, None, None, 48, "wm-2")


def test_rotation_round_trip(spark):
    s, c = F.lit(math.sin(0.3)), F.lit(math.cos(0.3))
    g = physics.earth_to_grid(F.lit(3.0), F.lit(-2.0), s, c)
    e = physics.grid_to_earth(*g, s, c)
    r = one(spark, u=e[0], v=e[1])
    assert (r.u, r.v) == pytest.approx((3.0, -2.0))


def test_leave_one_out(spark):
    rows = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 3.0), ("c", "m", 10.0)], "season string, metric string, delta double")
    got = {r.omitted: r.median for r in campaign.leave_one_out(rows, "season", "delta", ["metric"]).collect()}
    assert got == {"a": 6.5, "b": 5.5, "c": 2.0}


def test_without_the_other_package(tmp_path):
    """The entry module imports and registers its own queries when the optional package isn't there."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "skillgrid", tmp_path / "skillgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(root / "tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    alone = {**os.environ, "PYTHONPATH": os.pathsep.join([str(tmp_path), *filter(None, [os.environ.get("PYTHONPATH")])])}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=alone, timeout=120).returncode == 0
    # its own queries run there, and its tests are all there and can be collected
    few = [sys.executable, "-m", "pytest", "tests/test_oracles.py", "-q", "-p", "no:cacheprovider", "-k", "compare_row or box_mean_2d or column_total"]
    ran = subprocess.run(few, cwd=tmp_path, env=alone, timeout=600, capture_output=True, text=True)
    assert ran.returncode == 0, ran.stdout
    listed = subprocess.run([sys.executable, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider"], cwd=tmp_path, env=alone, timeout=120, capture_output=True, text=True)
    assert listed.returncode == 0, listed.stdout
