"""Closed forms: numbers worked out by hand from published rules, not from this library's SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgrid.functions import physics
from skillgrid.operators import graph, raster, regrid, spatial


@pytest.mark.parametrize(
    "sand, silt, clay, want",
    [(92, 5, 3, 1), (80, 15, 5, 2), (65, 25, 10, 3), (45, 49, 6, 3), (20, 65, 15, 4), (30, 60, 10, 4), (10, 85, 5, 5), (40, 40, 20, 6), (60, 15, 25, 7), (10, 55, 35, 8), (30, 37, 33, 9), (55, 5, 40, 10), (5, 50, 45, 11), (20, 30, 50, 12), (90, 0, 10, 6)],
)
def test_soil_texture(spark, sand, silt, clay, want):
    row = spark.range(1).select(physics.soil_texture(F.lit(float(sand)), F.lit(float(silt)), F.lit(float(clay))).alias("k")).first()
    assert row.k == want


def plane(spark, ny=12, nx=9):
    """A cell table on a plane of heights."""
    return spark.range(ny * nx).selectExpr("cast(id div %d as int) y" % nx, "cast(id %% %d as int) x" % nx).selectExpr("y", "x", "46 + 0.01D*y lat", "7 + 0.02D*x lon", "2D*y + 3D*x height", "(y + x) % 5 != 0 land", "cast(y*100 + x as long) donor")


def test_land_cells_within_a_bound(spark):
    """Water at the site's own cell: the next land cell is taken if it lies within the bound, and else the row is a violation."""
    cells = spark.createDataFrame([(0, x, 46.0, 7 + 0.01 * x, x >= 2) for x in range(5)], "y int, x int, lat double, lon double, land boolean")
    sites = spark.createDataFrame([(1, 46.0, 7.001), (2, 46.0, 7.031)], "site int, lat double, lon double")
    step = 111.32 * np.cos(np.radians(46.0)) * 0.01
    near = {r.site: r for r in spatial.nearest_land_cell(sites, cells, ["site"], 2.5 * step).collect()}
    assert (near[1].x0, near[1].x, near[1].override) == (0, 2, True) and near[1].displacement == pytest.approx(2 * step) and near[1].km == pytest.approx(1.9 * step)
    assert (near[2].x0, near[2].x, near[2].override, near[2].displacement) == (3, 3, False, 0.0)
    far = {r.site: r for r in spatial.nearest_land_cell(sites, cells, ["site"], 1.5 * step).collect()}
    assert far[1].x is None and far[1].x0 == 0 and far[2].x == 3


def test_bilinear_is_exact_on_a_plane(spark):
    sites = spark.createDataFrame([(1, 46.033, 7.055), (2, 46.0, 7.0), (3, 46.11, 7.16), (4, 45.99, 7.0), (5, 46.05, 7.17)], "site int, lat double, lon double")
    got = {r.site: (r.height, r.outside) for r in spatial.bilinear(sites, plane(spark), "height", "site", 0.05).collect()}
    for k, want in {1: 2 * 3.3 + 3 * 2.75, 2: 0.0, 3: 2 * 11 + 3 * 8}.items():
        assert got[k][0] == pytest.approx(want) and not got[k][1]
    assert got[4] == (None, True) and got[5] == (None, True)


def test_box_median(spark):
    g = plane(spark).collect()
    height = {(r.y, r.x): r.height for r in g}
    for r in raster.box_median(plane(spark), "height", 2).collect():
        assert r["median"] == pytest.approx(np.median([v for (y, x), v in height.items() if abs(y - r.y) <= 2 and abs(x - r.x) <= 2]))


def test_components_are_numbered_in_order(spark):
    df = spark.createDataFrame([(7 * k % 1009,) for k in range(1, 500)], "component long")
    got = sorted((r.component, r.label) for r in raster.numbered(df).collect())
    assert [label for _, label in got] == list(range(1, 500))


def test_unfinished_components_are_an_error(spark):
    chain = spark.range(300).selectExpr("id src", "id + 1 dst")
    assert graph.connected_components(chain).where("component != 0").count() == 0
    with pytest.raises(RuntimeError):
        graph.connected_components(chain, most_rounds=1)


# ---- regridding ----------------------------------------------------------------------------------


def test_kernel_weights(spark):
    """Weights sum to 1; at a donor they pick it; the scale at 13 km is a twentieth of a radian."""
    assert regrid.kernel_scale(13.0) == 0.05 and regrid.kernel_scale(6.5, 2.0) == 0.05
    rng = np.random.default_rng(1)
    d = regrid._unit(46 + rng.random((5, 10)), 7 + rng.random((5, 10)))
    w, took = regrid.kernel_weights(d[:, 3], d, 0.002)
    assert np.allclose(w.sum(axis=1), 1) and np.allclose(w[:, 3], 1, atol=1e-6) and set(took) <= set(regrid.NUGGETS)
    same = np.repeat(d[:1, :1], 10, axis=1)
    w, took = regrid.kernel_weights(d[:1, 0], same, 0.002)  # ten donors in one place need the ladder
    assert took[0] > 0 and np.allclose(w, 0.1)


def test_targets_without_sound_weights(spark):
    donors = plane(spark).select("donor", "lat", "lon")
    far = spark.createDataFrame([(1, 46.05, 7.05), (2, 47.5, 9.0)], "target long, lat double, lon double")
    w = regrid.rbf_weights(far, donors, 10, regrid.kernel_scale(1.5), 1.1, strict=False)
    assert {r.target: r.n for r in w.groupBy("target").agg(F.count("weight").alias("n")).collect()} == {1: 10, 2: 0}
    with pytest.raises(Exception, match="sound weights"):
        regrid.rbf_weights(far, donors, 10, regrid.kernel_scale(1.5), 1.1).count()


# ---- columns and time ----------------------------------------------------------------------------


def test_quiet_top():
    from skillgrid.operators.columns import quiet_top

    assert quiet_top(5) == [1.0, 1.0, 0.66, 0.33, 0.0] and quiet_top(2) == [0.33, 0.0]


def test_hourly_vectors(spark):
    """Two winds at a right angle: the mean vector has the mean direction and the mean speed; opposite ones have none."""
    from skillgrid.operators import temporal

    rows = [(1, "2024-01-01 00:00:00", 4.0, 4.0, 0.0), (1, "2024-01-01 01:00:00", 2.0, 0.0, 2.0), (1, "2024-01-01 03:00:00", 2.0, 2.0, 0.0), (2, "2024-01-01 00:00:00", 3.0, 3.0, 0.0), (2, "2024-01-01 01:00:00", 3.0, -3.0, 0.0)]
    df = spark.createDataFrame(rows, "k int, t string, s double, u double, v double").withColumn("t", F.col("t").cast("timestamp"))
    got = {(r.k, r.t.hour): (r.hourly_speed, r.hourly_u, r.hourly_v) for r in temporal.trapezoid_wind(df, ["k"], "t", "s", "u", "v").collect()}
    assert got[1, 0] == got[1, 3] == (None, None, None) and got[2, 1] == (3.0, 0.0, 0.0)
    assert got[1, 1][0] == 3.0 and np.hypot(*got[1, 1][1:]) == pytest.approx(3.0) and got[1, 1][1] == pytest.approx(2 * got[1, 1][2])


def test_six_samples_an_hour(spark):
    from skillgrid.operators import temporal

    rows = [(1, f"2024-01-01 00:{m:02d}:00", 2.0, 270.0) for m in (10, 20, 30, 40, 50)] + [(1, "2024-01-01 01:00:00", 8.0, 270.0), (1, "2024-01-01 01:10:00", 9.0, 90.0)]
    df = spark.createDataFrame(rows, "k int, t string, s double, d double").withColumn("t", F.col("t").cast("timestamp"))
    got = {r.hour.hour: r for r in temporal.ending_hour_wind(df, ["k"], "t", "s", "d").collect()}
    assert got[1].samples == 6 and got[1].speed == 3.0 and got[1].u == pytest.approx(3.0) and got[1].v == pytest.approx(0.0)
    assert got[2].samples == 1 and got[2].speed is None and got[2].u is None


def test_epochs(spark):
    from skillgrid.operators import temporal

    asked = spark.createDataFrame([(1, 1, 5), (2, 1, 15), (3, 2, 5)], "id int, k int, t int")
    epochs = spark.createDataFrame([(1, 10, 1.5), (1, 12, 2.5)], "k int, e int, v double")
    got = {r.id: (r.v, r.valid_from, r.extrapolated) for r in temporal.asof(asked, epochs, ["k"], "t", "e", "v", back=True).collect()}
    assert got == {1: (1.5, 10, True), 2: (2.5, 12, False), 3: (None, None, False)}
    assert {r.id: r.v for r in temporal.asof(asked, epochs, ["k"], "t", "e", "v").collect()} == {1: None, 2: 2.5, 3: None}


def test_soil_by_class(spark):
    r = spark.range(1).select(*[physics.soil_moisture_index(F.lit(m), 2, F.lit(c)).alias(n) for n, m, c in (("wilting", 0.06 * 1000 * 0.11, 5), ("full", 0.06 * 1000 * 0.34, 5), ("dry", 0.0, 5), ("ice", 9.0, 1))], physics.relative_saturation(F.lit(0.06 * 1000 * 0.2275), 2, F.lit(5)).alias("half")).first()
    assert (r.wilting, r.full, r.dry, r.ice, r.half) == (pytest.approx(0), pytest.approx(1), 0, None, pytest.approx(0.5))


def test_angles_and_covers(spark):
    with pytest.raises(Exception, match="unknown unit"):
        spark.range(1).select(physics.to_degrees(F.lit(1.0), F.lit("gon"))).collect()
    df = spark.createDataFrame([(0.5, 50.0), (1.0, 30.0)], "a double, b double")
    assert [r.x for r in physics.as_percent(df, "a", "x").collect()] == [50.0, 100.0]
    assert [r.x for r in physics.as_percent(df, "b", "x").collect()] == [50.0, 30.0]
    assert [r.x for r in physics.as_fraction(df, "b", "x").collect()] == [0.5, 0.3]


def test_aliases(spark):
    from skillgrid.functions import text

    df = spark.createDataFrame([("", "b"), ("a", "c"), (None, None)], "one string, two string")
    assert [r.x for r in text.aliased(df, "x", ["no", "one", "two"]).collect()] == ["b", "a", None]
    with pytest.raises(ValueError):
        text.aliased(df, "x", ["no"])
