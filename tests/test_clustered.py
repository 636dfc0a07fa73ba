"""Clustered products: what is read is what was written, from the files that hold it and no others; records that don't fit are refused."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from skillgrid.sources import clustered

NAN = float("nan")


@pytest.fixture(scope="module")
def product(spark, tmp_path_factory):
    """Four times of 40 x 60 cells in tiles of 20: 6 tiles a time, 24 files."""
    cells = spark.range(4 * 40 * 60).select(F.timestamp_seconds(F.lit(1704067200) + 3600 * (F.col("id") % 4)).alias("valid"), (F.col("id") / 240).cast("int").alias("y"), (F.col("id") / 4 % 60).cast("int").alias("x"), (F.col("id") * 1.0).alias("v"))
    cells = cells.withColumn("w", F.when(F.col("y") == 3, NAN).when(F.col("x") == 5, -9999.0).otherwise(F.col("v") / 2))
    path = f"{tmp_path_factory.mktemp('clustered')}/p"
    clustered.write(cells, path, 20, {"w": -9999.0})
    return path, cells


def test_what_is_read_is_what_was_written(spark, product):
    path, cells = product
    got = clustered.read(spark, path, "v", "w").select("valid", "y", "x", "v", "w")
    want = cells.withColumn("w", F.when(F.isnan("w") | (F.col("w") == -9999.0), None).otherwise(F.col("w"))).select("valid", "y", "x", "v", "w")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    assert clustered.files_of(got) == 24


def test_a_slice_opens_its_time_only(spark, product):
    path, cells = product
    got = clustered.slice_2d(spark, path, "w", "2024-01-01 02:00:00")
    assert clustered.files_of(got) == 6 and got.count() == 2400
    assert got.where("y = 3 or x = 5").agg(F.count("w")).first()[0] == 0 and got.where("w is null").count() == 60 + 40 - 1
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "struct<y:int,x:int,w:double>" in scan  # no other field
    with pytest.raises(ValueError, match="no times"):
        clustered.slice_2d(spark, path, "w", "2024-01-01 09:00:00")
    with pytest.raises(ValueError, match="no fields"):
        clustered.slice_2d(spark, path, "u", "2024-01-01 02:00:00")
    with pytest.raises(ValueError, match="levels"):
        clustered.slice_2d(spark, path, "w", "2024-01-01 02:00:00", 1)


def test_points_open_their_tiles_only(spark, product):
    path, cells = product
    points = spark.createDataFrame([("a", 0, 0), ("b", 1, 1), ("c", 39, 59), ("far", 500, 2), ("a2", 0, 0)], "site string, y int, x int")
    got = clustered.at_points(spark, path, points, "v", side=20)
    assert clustered.files_of(got) == 8  # two tiles of four times; the far one has none
    want = {(r.site, r.valid, r.v) for r in points.join(cells, ["y", "x"]).collect()}
    assert {(r.site, r.valid, r.v) for r in got.collect()} == want and len(want) == 16
    one = clustered.at_points(spark, path, points, "v", at=["2024-01-01 01:00:00"], side=20)
    assert clustered.files_of(one) == 2 and one.count() == 4
    assert clustered.at_points(spark, path, points.where("false"), "v", side=20).count() == 0


def test_a_cell_twice_is_refused(spark, product, tmp_path):
    with pytest.raises(PySparkException, match="twice"):
        clustered.write(product[1].unionAll(product[1].limit(1)), f"{tmp_path}/p")
    assert list(tmp_path.rglob("*.parquet")) == []


def test_axes_by_name(spark):
    rows = [
        ("tyx", ["time", "y", "x"], [2, 2, 3], [float(n) for n in range(12)]), ("xty", ["x", "time", "y"], [3, 2, 2], [float(n) for n in range(12)]), ("yx", ["y", "x"], [1, 2], [5.0, NAN]), ("level", ["time", "level", "y"], [1, 1, 2], [-1.0, 2.0]),
        ("deep", ["level", "y"], [2, 1], [1.0, 2.0]), ("short", ["y", "x"], [2, 2], [1.0]), ("twice", ["y", "y"], [1, 1], [1.0]), ("ragged", ["y"], [1, 1], [1.0]), ("none", None, None, None),
    ]
    out = clustered.unpack(spark.createDataFrame(rows, "name string, dims array<string>, shape array<int>, values array<double>"), fill=-1.0).collect()
    of = lambda n: {(r.time, r.y, r.x): r.value for r in out if r.name == n}
    assert of("tyx") == {(t, y, x): t * 6.0 + y * 3 + x for t in range(2) for y in range(2) for x in range(3)}
    assert of("xty") == {(t, y, x): x * 4.0 + t * 2 + y for t in range(2) for y in range(2) for x in range(3)}
    assert of("yx") == {(0, 0, 0): 5.0, (0, 0, 1): None} and of("level") == {(0, 0, 0): None, (0, 1, 0): 2.0}
    assert {r.name: r.violation for r in out if r.violation} == {"deep": "other_axis", "short": "length", "twice": "axis_twice", "ragged": "shape", "none": "shape"}


def parts(spark):
    at = dt.datetime(2024, 1, 1, 6)
    cells = [(y, x) for y in range(2) for x in range(3)]
    static = [(y, x, 46.0 + y, 7.0 + x, x == 0) for y, x in cells]
    levels = [(y, x, k, 100.0 * k, 100.0 * k + 50) for y, x in cells for k in range(2)]
    state = [(at, y, x, k, 46.0 + y, 7.0 + x, 100.0 * k, 100.0 * k + 50, 280.0 - k) for y, x in cells for k in range(2)]
    sst = [(at, y, x, NAN if x == 0 else 285.0) for y, x in cells]
    said = [(at, "static_sha256", "d"), (at, "w_vertical_coordinate", "static_HFL"), (at, "w_wind_basis", "grid_relative")]
    return dict(state=state, static=static, static_levels=levels, sst=sst, said=said)


SCHEMAS = dict(state="valid timestamp, y int, x int, k int, lat double, lon double, HHL double, HFL double, T double", static="y int, x int, lat double, lon double, land boolean", static_levels="y int, x int, k int, HHL double, HFL double", sst="valid timestamp, y int, x int, SST double", said="valid timestamp, key string, value string")


def edit(row, at, value):
    return lambda rows: [r if n != row else (*r[:at], value, *r[at + 1 :]) for n, r in enumerate(rows)]


@pytest.mark.parametrize(
    "part, change, violations",
    [
        ("state", lambda r: r, []),
        ("state", edit(0, 4, 46.0 + 1e-12), ["grid"]),
        ("state", edit(3, 6, 101.0), ["geometry"]),
        ("state", edit(3, 8, NAN), ["not_finite"]),
        ("state", edit(3, 8, None), ["not_finite"]),
        ("state", lambda r: r[1:], ["cells"]),
        ("state", lambda r: r[1:] + r[1:2], ["cell_twice"]),
        ("state", edit(0, 1, 9), ["geometry", "grid"]),
        ("static", edit(4, 2, 0.0), ["grid"]),
        ("sst", lambda r: r[1:], ["sst_cells"]),
        ("sst", lambda r: [], ["no_sst"]),
        ("sst", edit(1, 3, 100.0), ["sst_range"]),
        ("sst", edit(1, 3, NAN), ["sst_range"]),
        ("said", edit(0, 2, "e"), ["static_identity"]),
        ("said", edit(1, 2, "model"), ["w_vertical_coordinate"]),
        ("said", lambda r: r[:2], ["w_wind_basis"]),
    ],
)
def test_records(spark, tmp_path, part, change, violations):
    p = parts(spark)
    p[part] = change(p[part])
    frames = {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in p.items()}
    assert clustered.record_report(**frames, static_digest="d").first().violations == violations
    if violations:
        with pytest.raises(ValueError, match=violations[0]):
            clustered.write_records(**frames, static_digest="d", path=f"{tmp_path}/r")
        assert list(tmp_path.iterdir()) == []
    else:
        clustered.write_records(**frames, static_digest="d", path=f"{tmp_path}/r", side=2)
        got = clustered.read(spark, f"{tmp_path}/r", "T", "SST")
        assert got.count() == 12 and {(r.x, r.SST) for r in got.collect()} == {(0, None), (1, 285.0), (2, 285.0)}


def test_a_sea_surface_without_a_state(spark):
    frames = {n: spark.createDataFrame(rows, SCHEMAS[n]) for n, rows in parts(spark).items()}
    later = frames["sst"].unionAll(frames["sst"].withColumn("valid", F.lit("2024-01-02").cast("timestamp")))
    got = clustered.record_report(**frames | {"sst": later}, static_digest="d").orderBy("valid").collect()
    assert [r.violations for r in got] == [[], ["no_state"]] and got[1].cells == 0
