"""References at stations, inventories, lists, maxima and the gate of an embedding, by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skillgrid.functions import physics as P
from skillgrid.operators import campaign, raster
from skillgrid.sources import lists, references


def test_station_reference(spark):
    sites = spark.createDataFrame([(1, 46.0, 7.0), (2, 47.0, 7.0)], "station long, lat double, lon double")
    cells = spark.createDataFrame([(0, 0, 46.001, 7.0, 500.0), (0, 1, 46.0, 7.01, 600.0)], "y int, x int, lat double, lon double, terrain double")
    current = spark.createDataFrame([(h, 0, x, 280.0 + h, 275.0, 9e4, 1.0, 2.0, 0.0) for h in (0, 1, 3) for x in (0, 1)], "time int, y int, x int, t double, td double, p double, u double, v double, snow double")
    total = spark.createDataFrame([(0, 0, 0, 5.0), (1, 0, 0, 7.5), (2, 0, 0, 7.0), (3, 0, 0, 9.0), *[(h, 0, 1, 0.0) for h in range(4)]], "time int, y int, x int, total double")
    got = {(r.station, r.time): r for r in references.station_reference(sites, cells, current, total, spark.range(4).select(F.col("id").cast("int").alias("time"))).collect()}
    assert len(got) == 8 and all(got[2, h].violation == "too_far" for h in range(4))
    assert [(got[1, h].precipitation, got[1, h].violation) for h in range(4)] == [(0.0, None), (2.5, None), (0.0, "missing"), (2.0, None)]
    e = 611.2 * 2.718281828459045 ** (17.67 * (275 - 273.15) / (275 - 273.15 + 243.5))
    assert got[1, 0].q == pytest.approx(0.622 * e / (9e4 - 0.378 * e)) and got[1, 0].terrain == 500.0
    falling = total.where("time != 2").withColumn("total", F.when(F.col("time") == 3, 1.0).otherwise(F.col("total")))
    got = references.station_reference(sites, cells, current, falling, current.select("time").distinct()).where("station = 1 and time = 3").first()
    assert (got.precipitation, got.violation) == (0.0, "decreasing")


def test_inventory(spark):
    at = dt.datetime(2024, 1, 1)
    good = dict(name="T", param=1, level=1, units="K", level_type="hybrid", step_type="instant", reference=at, valid=at + dt.timedelta(hours=2), step=2, grid="g")
    changes = [{}, {"level": 2}, {"level": 2, "units": "C"}, {"level": 9, "step_type": "accum"}, {"name": "X"}, {"level": 3, "valid": at}, {"level": 4, "step": 3}, {"level": 5, "grid": None}, {"level": 6, "level_type": "surface"}, {"level": 7, "reference": at - dt.timedelta(hours=1), "step": 3}, {"name": "P", "param": 2, "level": 0, "units": "Pa"}]
    messages = spark.createDataFrame([tuple((good | c).values()) for c in changes], "name string, param int, level int, units string, level_type string, step_type string, reference timestamp, valid timestamp, step int, grid string")
    spec = spark.createDataFrame([("T", 1, "K", "hybrid", 8), ("P", 2, "pa", "hybrid", 1)], "name string, param int, units string, level_type string, levels int")
    found = [r.violation for r in references.message_violations(messages, spec, "2024-01-01 02:00:00").orderBy("name", "level", "units").collect()]
    assert sorted(map(str, found)) == sorted(["None", "None", "None", "units", "step_type", "unexpected", "valid_time", "step", "grid", "level_type", "mixed"])
    state = {(r.name, r.level): (r.state, r.violations) for r in references.inventory(messages, spec, "2024-01-01 02:00:00").collect()}
    assert state["T", 1] == ("one", 0) and state["T", 2] == ("duplicate", 1) and state["T", 8] == ("missing", 0) and state["T", 9] == ("extra", 1) and state["X", 1] == ("extra", 1) and state["P", 0] == ("one", 0)


def test_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text('# no comment in a list of paths\n\n  "b/c"\n\'a\'\n"z",\n')
    (tmp_path / "k.txt").write_text("# note\nk2\n\nk1\nk2\n")
    assert [(r.place, r.entry) for r in lists.ordered_list(spark, f"{tmp_path}/a.txt").orderBy("place").collect()] == [(0, "# no comment in a list of paths"), (1, "b/c"), (2, "a"), (3, "z")]
    assert {r.key for r in lists.key_list(spark, f"{tmp_path}/k.txt", 2).collect()} == {"k1", "k2"}
    with pytest.raises(ValueError):
        lists.key_list(spark, f"{tmp_path}/k.txt", 3)


def test_maxima_need_their_levels(spark):
    rows = spark.createDataFrame([(0, 0, 1, 10, 3.0, 4.0), (0, 1, 0, 10, 0.0, 5.0), (0, 1, 0, 50, 61.0, 0.0)], "y int, x int, t int, height int, u double, v double")
    got = {r.height: tuple(r)[1:] for r in campaign.wind_maxima(rows, 60.0).collect()}
    assert got == {10: (5.0, 0, 1, 0, True), 50: (61.0, 0, 1, 1, False)}  # of equal ones the earlier
    for wrong in (rows.where("height = 10"), rows.withColumn("height", F.col("height") + 1)):
        with pytest.raises(ValueError):
            campaign.wind_maxima(wrong, 60.0)


def test_embedding_behind_its_gate(spark):
    outer = spark.range(100).selectExpr("cast(id div 10 as int) y", "cast(id % 10 as int) x", "cast(id as double) v")
    inner = outer.where("y between 3 and 6 and x between 2 and 7").withColumn("v", F.col("v") + F.when((F.col("y") == 4) & (F.col("x") == 4), 50.0).otherwise(0.5))
    gap = raster.edge_gap(outer, inner, "v").first()
    assert (gap.cells, gap.largest, gap.p99) == (16, 0.5, 0.5)  # what lies inside doesn't count
    out = {(r.y, r.x): (r.v, r.inside) for r in raster.embedded(outer, inner, "v", 0.5).collect()}
    assert out[4, 4] == (94.0, True) and out[0, 0] == (0.0, False) and len(out) == 100
    for o, most in ((outer, 0.4), (outer.where("not (y = 3 and x = 3)"), 9.0)):
        with pytest.raises(ValueError):
            raster.embedded(o, inner, "v", most)


def test_units_and_slopes(spark):
    r = spark.range(1).select(P.from_observed(F.lit(10.0), "celsius").alias("k"), P.from_observed(F.lit(900.0), "hectopascal").alias("pa"), P.from_observed(F.lit(25.0), "centimetre").alias("m"), *[c.alias(n) for n, c in zip(("slope", "aspect"), P.slope_of(F.lit(0.0), F.lit(2.0), F.lit(2.0)))], P.horizon_zenith(F.lit(-0.3)).alias("z")).first()
    assert (r.k, r.pa, r.m, r.z) == (283.15, 90000.0, 0.25, 90.0) and r.slope == pytest.approx(0.7853981634) and r.aspect == pytest.approx(0.0)
    with pytest.raises(ValueError):
        P.from_observed(F.lit(1.0), "furlong")


def test_names_of_two_fields_are_refused(spark):
    from skillgrid.sources import fields

    table = spark.createDataFrame([("a", "invariant", "cell", ["b"], None), ("c", "epoch", "cell", None, "m")], "field string, lifetime string, support string, aliases array<string>, units string")
    assert {(r.name, r.field) for r in fields.registry(table).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    with pytest.raises(ValueError, match="two fields"):
        fields.registry(table.union(table.where("field = 'c'")))


@pytest.mark.parametrize("name, column", [("product_partition", "field"), ("lifetime_contract", "field")])
def test_queries_take_the_whole_registry(spark, name, column):
    """All 69 fields of the registry are split and judged, under all their names."""
    from skillgrid.plans import bindings
    from skillgrid.plans.registry import QUERIES, load

    load()
    rows = QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    fields = {f for f, *_ in bindings.FIELDS}
    assert len(fields) == 69 and {r[column] for r in rows if r[column]} == fields
    if name == "lifetime_contract":
        assert {r.name for r in rows} == {n for f, _, _, names, _ in bindings.FIELDS for n in (f, *names)} | {"no_such_field"}
