"""Digests merge, tell one cell, and guard what is assembled and reloaded."""

import pytest
from pyspark.sql import functions as F

from skillgrid.operators import digest, regrid


@pytest.fixture
def cells(spark):
    return spark.range(900).select((F.col("id") / 30).cast("int").alias("y"), (F.col("id") % 30).cast("int").alias("x"), (F.col("id") * 1.5).alias("v"), F.when(F.col("id") % 7 > 0, "a").alias("k"))


def test_digests_do_not_depend_on_order_or_tiles(cells):
    one = digest.fingerprint(cells, ["y", "x", "v", "k"])
    assert one == digest.fingerprint(cells.repartition(7, "x").orderBy(F.desc("v")), ["y", "x", "v", "k"])
    assert one == digest.whole(digest.tile_digests(cells, ["v", "k"], 8)) == digest.whole(digest.tile_digests(cells, ["v", "k"], 30))
    others = [cells.where("v > 0"), cells.unionAll(cells.limit(1)), cells.withColumn("v", F.when(F.col("y") == 4, F.col("v") + 1e-12 * F.col("v")).otherwise(F.col("v"))), cells.withColumn("k", F.coalesce("k", F.lit("")))]
    assert len({one, *[digest.fingerprint(o, ["y", "x", "v", "k"]) for o in others]}) == 5
    assert digest.fingerprint(cells.where("false"), ["v"]) == "0:0:0"
    # two rows that change places aren't the same table
    swapped = cells.withColumn("v", F.when(F.col("v") == 3.0, 4.5).when(F.col("v") == 4.5, 3.0).otherwise(F.col("v")))
    assert digest.fingerprint(swapped, ["y", "x", "v"]) != digest.fingerprint(cells, ["y", "x", "v"])


def test_one_cell_names_its_tile(cells):
    after = cells.withColumn("v", F.when((F.col("y") == 9) & (F.col("x") == 17), -1.0).otherwise(F.col("v")))
    assert [tuple(r) for r in digest.changed_tiles(digest.tile_digests(cells, ["v"], 8), digest.tile_digests(after, ["v"], 8)).collect()] == [(1, 2, "changed")]


def test_assembly_refuses(cells):
    parts = {"a": cells.select("y", "x", "v"), "b": cells.where("x > 0").select("y", "x", "k")}
    recorded = {n: digest.fingerprint(p, p.columns) for n, p in parts.items()}
    out = digest.assemble(parts, recorded, "a")
    assert out.columns == ["y", "x", "v", "k", "missing"] and out.count() == 900
    assert {tuple(r.missing) for r in out.where("x = 0").collect()} == {("b",)} and out.where("x > 0 and size(missing) > 0").count() == 0
    with pytest.raises(ValueError, match="recorded"):
        digest.assemble(parts | {"b": parts["b"].where("y > 0")}, recorded, "a")
    with pytest.raises(ValueError, match="recorded"):
        digest.assemble(parts, {"a": recorded["a"]}, "a")
    twice = parts | {"c": cells.select("y", "x", "v")}
    with pytest.raises(ValueError, match="two parts"):
        digest.assemble(twice, recorded | {"c": digest.fingerprint(twice["c"], ["y", "x", "v"])}, "a")


def test_epochs_and_months(spark):
    e = spark.createDataFrame([("2020-01-01", 0, 0, 1), ("2022-01-01", 0, 0, 2)], "valid_from string, y int, x int, value int")
    assert digest.at_time(e, "use", "2021-12-31").first().use == 1 and digest.at_time(e, "use", "2022-01-01").first().use == 2
    assert digest.at_time(e, "use", "2019-01-01", back=True).first().use == 1
    with pytest.raises(ValueError):
        digest.at_time(e, "use", "2019-01-01")
    m = spark.createDataFrame([(k, 0, 0, float(k)) for k in range(1, 12)], "month int, y int, x int, value double")
    assert digest.months_of(m, "v").first().v == [*map(float, range(1, 12)), None]


def test_weights_that_were_changed_on_disk(spark, tmp_path):
    weights = spark.createDataFrame([(1, 1, 10, 0.5, 0.0), (1, 2, 11, 0.5, 1e-8)], "target long, rank int, donor long, weight double, nugget double")
    source, targets = spark.createDataFrame([(10, 46.0, 7.0), (11, 46.0, 7.1)], "donor long, lat double, lon double"), spark.createDataFrame([(1, 46.0, 7.05)], "target long, lat double, lon double")
    path = f"{tmp_path}/w"
    regrid.save_weights(weights, path, source, targets, "kernel", 0.05)
    assert sorted(map(tuple, regrid.load_weights(spark, path, source, targets).collect())) == sorted(map(tuple, weights.collect()))
    about = spark.read.parquet(f"{path}/about").first()
    assert (about.method, about.scale, about.nugget) == ("kernel", 0.05, 1e-8)
    weights.limit(1).write.mode("append").parquet(f"{path}/weights")
    with pytest.raises(ValueError, match="weights"):
        regrid.load_weights(spark, path, source, targets)


def test_epochs_are_appended_whole_or_not(spark):
    rows = lambda at, n, value: [(f, at, 0, x, value) for f in ("albedo", "use") for x in range(n)]
    table = lambda r: spark.createDataFrame(r, "field string, valid_from int, y int, x int, value double")
    old = table(rows(1, 3, 0.5))
    assert digest.append_epochs(old, table(rows(2, 3, 1.0) + rows(3, 3, 0.0)), ["albedo"]).count() == 18
    for new, what in ((rows(1, 3, 0.5), "not_later"), (rows(2, 2, 0.5), "incomplete"), (rows(2, 3, 0.5) + [("albedo", 2, 0, 0, 0.5)], "incomplete"), (rows(2, 3, 1.5), "fraction"), (rows(2, 3, float("nan")), "fraction"), (rows(2, 3, 0.5)[:3], "fields")):
        with pytest.raises(ValueError, match=what):
            digest.append_epochs(old, table(new), ["albedo"])
