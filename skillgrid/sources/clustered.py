"""Fields over time on a raster, laid out so that a slice or a list of points opens only the files that hold it.

A product has a folder for each valid time and, below it, one for each square tile of ``side`` cells; a tile of a time is one file, in order of its cells. Times and tiles are partition columns, so a reader
that names them lists no other folder, and a file's columns are read one by one. What a tile holds is bounded by its side and the number of levels, whatever the size of the raster or the length of the series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillgrid.operators.contracts import ON_LEVEL
from skillgrid.session import shuffled

#: Cells of a tile's side.
SIDE = 256
#: Tiles up to which the tiles of points are named to the reader; points in more of them are joined with all.
NAMED_TILES = 10_000
PARTS = ("valid", "tile_y", "tile_x")


def tile_of(side: int) -> dict[str, Column]:
    return {f"tile_{c}": F.floor(F.col(c) / side).cast("int") for c in ("y", "x")}


def masked(value: Column, fill: float | None = None) -> Column:
    """A value, or null where it is the fill value, not a number, or null already."""
    gone = F.isnan(value) if fill is None else F.isnan(value) | (value == F.lit(fill))
    return F.when(~gone, value)


def write(cells: DataFrame, path: str, side: int = SIDE, fills: dict[str, float] | None = None) -> None:
    """Write cells (valid, y, x, fields) as a product; with a column ``k`` a cell has levels. Values that equal their field's fill become null, and so do NaN.

    One shuffle brings a tile of a time to one task, which also sees whether a cell of a level is there twice; that is an error, and no file is committed.
    """
    keys = [c for c in ("valid", "y", "x", "k") if c in cells.columns]
    numbers = {c for c, t in cells.dtypes if t in ("double", "float") and c not in keys}
    fields = [masked(F.col(c), (fills or {}).get(c)).alias(c) if c in numbers else F.col(c) for c in cells.columns if c not in keys]
    # partition values are written as text: a time as one, so that it comes back to the microsecond
    rows = cells.select(*keys, *fields).withColumns(tile_of(side)).withColumn("valid", F.date_format("valid", "yyyy-MM-dd'T'HH-mm-ss.SSSSSS"))
    spread = rows.repartition(*PARTS)
    before, cell = Window.partitionBy(*PARTS).orderBy(*keys[1:]), F.struct(*keys[1:])
    twice = F.coalesce(F.lag(cell).over(before) == cell, F.lit(False))
    spread = spread.withColumn("_twice", twice).withColumn("y", F.when(F.col("_twice"), F.raise_error(F.concat(F.lit("a cell is there twice: "), F.to_json(F.struct("valid", *keys[1:])))).cast("int")).otherwise(F.col("y"))).drop("_twice")
    spread.write.mode("overwrite").partitionBy(*PARTS).option("parquet.block.size", str(64 << 20)).parquet(path)


def _stamp(at: str) -> Column:
    return F.date_format(F.lit(at).cast("timestamp"), "yyyy-MM-dd'T'HH-mm-ss.SSSSSS")


def read(spark: SparkSession, path: str, *fields: str, at: list[str] | None = None) -> DataFrame:
    """(valid, tile_y, tile_x, y, x, k if there are levels, fields) of all times or of those of ``at``. A field that isn't there is an error, and so is a time that isn't."""
    rows = spark.read.option("basePath", path).parquet(path).withColumns({t: F.col(t).cast("int") for t in PARTS[1:]})
    lacking = sorted(set(fields) - set(rows.columns))
    if lacking:
        raise ValueError(f"no fields {lacking} in {path}")
    if at is not None:
        stamps = [rows.sparkSession.range(1).select(_stamp(t)).first()[0] for t in at]
        rows = rows.where(F.col("valid").cast("string").isin(stamps))
        held = {r[0] for r in rows.select(F.col("valid").cast("string")).distinct().collect()}  # as many as were asked for at most
        if set(stamps) - held:
            raise ValueError(f"no times {sorted(set(stamps) - held)} in {path}")
    valid = F.to_timestamp(F.col("valid").cast("string"), "yyyy-MM-dd'T'HH-mm-ss.SSSSSS")
    levels = ["k"] if "k" in rows.columns else []
    return rows.select(valid.alias("valid"), "tile_y", "tile_x", "y", "x", *levels, *fields)


def slice_2d(spark: SparkSession, path: str, field: str, at: str, level: int | None = None) -> DataFrame:
    """(y, x, field): one field at one time; of a field with levels one level must be named, and of one without none may be."""
    rows = read(spark, path, field, at=[at])
    if ("k" in rows.columns) != (level is not None):
        raise ValueError(f"{field} {'has' if level is None else 'has no'} levels")
    return (rows if level is None else rows.where(F.col("k") == level)).select("y", "x", field)


def at_points(spark: SparkSession, path: str, points: DataFrame, *fields: str, at: list[str] | None = None, side: int = SIDE) -> DataFrame:
    """(point's columns, valid, k if there are levels, fields) at points (y, x, ...), for all times or those of ``at``. A point outside the raster has no rows; ``side`` is that of the product.

    The tiles of the points are named to the reader, which opens no others; the cells of those are joined by tile and cell.
    """
    where = points.withColumns(tile_of(side))
    tiles = where.select("tile_y", "tile_x").distinct().limit(NAMED_TILES + 1).collect()
    rows = read(spark, path, *fields, at=at)
    if len(tiles) <= NAMED_TILES:
        by_row: dict[int, list[int]] = {}
        for t in tiles:
            by_row.setdefault(t.tile_y, []).append(t.tile_x)
        alike: dict[tuple, list[int]] = {}  # rows of tiles whose points lie in the same columns share a test
        for y, xs in by_row.items():
            alike.setdefault(tuple(sorted(xs)), []).append(y)
        rows = rows.where(any_of([F.col("tile_y").isin(ys) & F.col("tile_x").isin(list(xs)) for xs, ys in alike.items()]))
    return where.join(shuffled(rows), ["tile_y", "tile_x", "y", "x"]).drop("tile_y", "tile_x")


def any_of(tests: list[Column]) -> Column:
    """Whether one of the tests holds, as a tree that is as deep as the logarithm of their number; false if there are none."""
    if len(tests) < 2:
        return tests[0] if tests else F.lit(False)
    return any_of(tests[: len(tests) // 2]) | any_of(tests[len(tests) // 2 :])


def files_of(df: DataFrame) -> int:
    """Files that the scans of a plan would open, by the partitions that its filters leave."""
    plan, count = df._jdf.queryExecution().executedPlan(), 0
    leaves = plan.collectLeaves()
    for n in range(leaves.size()):
        leaf = leaves.apply(n)
        if leaf.nodeName().startswith("AdaptiveSparkPlan"):
            inner = leaf.initialPlan().collectLeaves()
            count += sum(_opened(inner.apply(k)) for k in range(inner.size()))
        else:
            count += _opened(leaf)
    return count


def _opened(leaf) -> int:
    if "Scan parquet" not in leaf.nodeName():
        return 0
    found = leaf.relation().location().listFiles(leaf.partitionFilters(), leaf.dataFilters())
    return sum(found.apply(n).files().size() for n in range(found.size()))


def unpack(arrays: DataFrame, axes: tuple[str, ...] = ("time", "y", "x"), fill: float | None = None) -> DataFrame:
    """(other columns, axes, value, violation) from arrays as files hold them: (dims array<string>, shape array<int>, values array<double>), values in row-major order of ``dims``.

    Axes are found by their names, wherever they stand; one that an array lacks is 0, and one that isn't asked for is squeezed out if its length is 1. An array of other axes, of a shape that isn't its length, or of an
    axis twice keeps one row with a violation. Masked values are null.
    """
    known = F.array(*map(F.lit, axes))
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, n: a * n)
    other = F.exists(F.arrays_zip("dims", "shape"), lambda d: ~F.array_contains(known, d["dims"]) & (d["shape"] > 1))
    wrong = (
        F.when(F.size("dims") != F.size("shape"), "shape")
        .when(F.size(F.array_distinct("dims")) < F.size("dims"), "axis_twice")
        .when(other, "other_axis")
        .when(size != F.size("values"), "length")
    )
    keep = [c for c in arrays.columns if c not in ("dims", "shape", "values")]
    rows = arrays.withColumn("violation", F.when(F.coalesce(F.size("dims"), F.lit(-1)) < 0, "shape").otherwise(wrong))
    rows = rows.select(*keep, "dims", "shape", "violation", F.posexplode_outer(F.when(F.col("violation").isNull(), F.col("values"))).alias("_n", "_v"))

    def place(axis: str) -> Column:
        at = F.array_position("dims", axis).cast("int")
        stride = F.aggregate(F.slice("shape", at + 1, F.size("shape")), F.lit(1).cast("long"), lambda a, n: a * n)
        return F.when(F.col("_n").isNull(), None).when(at == 0, 0).otherwise(F.floor(F.col("_n") / stride) % F.try_element_at("shape", F.greatest(at, F.lit(1)))).cast("int")

    return rows.select(*keep, *[place(a).alias(a) for a in axes], masked(F.col("_v"), fill).alias("value"), "violation")


#: What a state must say of itself before it becomes a record, each with the value that it must have; fixed values.
SAID = {"w_vertical_coordinate": "static_HFL", "w_wind_basis": "grid_relative"}


def record_report(state: DataFrame, static: DataFrame, static_levels: DataFrame, sst: DataFrame, said: DataFrame, static_digest: str) -> DataFrame:
    """(valid, cells, violations) of every time of ``state`` or ``sst``: why it can't become a record, in order of their names; none if it can.

    state: (valid, y, x, k, lat, lon, HHL, HFL, fields); static: (y, x, lat, lon, land); static_levels: (y, x, k, HHL, HFL); sst: (valid, y, x, SST); said: (valid, key, value), what each state says of itself.
    Grids and geometry are compared cell by cell, without a tolerance. Counts are summed before they are shuffled.
    """
    at = ["y", "x", "k"]
    # by the cell alone, with the level as a test, so that tables that come dealt by their cells stay where they are
    levels = static_levels.select(*at, F.col("HHL").alias("_h"), F.col("HFL").alias("_f"))
    geometry = levels.join(shuffled(static.select("y", "x", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))), ["y", "x"]).withColumnsRenamed({c: f"_{c}" for c in at})
    fields = [c for c in state.columns if c not in ("valid", "lat", "lon", *at)]
    finite = F.lit(True)
    for c in fields:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    off = lambda ok, name: F.count_if(~ok).alias(name)
    s = state.join(shuffled(geometry), F.expr(ON_LEVEL), "left").groupBy("valid").agg(
        F.count("*").alias("cells"), off(finite, "finite"), off(same("lat", "_lat") & same("lon", "_lon"), "grid"), off(same("HHL", "_h") & same("HFL", "_f"), "geometry"),
    )
    copies = state.groupBy("valid", *at).count().groupBy("valid").agg(F.count_if(F.col("count") > 1).alias("copies"))
    t = sst.join(shuffled(static.select("y", "x", "land")), ["y", "x"], "left").groupBy("valid").agg(
        F.count("*").alias("sst_cells"), F.count_if(~F.coalesce(F.col("land") | (~F.isnan("SST") & F.col("SST").between(180, 350)), F.lit(False))).alias("sst_bad"),
    )
    claims = said.groupBy("valid").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_said"))  # a few for each time
    whole = static_levels.agg(F.count("*").alias("_levels")).crossJoin(static.agg(F.count("*").alias("_grid")))  # one row
    j = s.join(copies, "valid", "left").join(t, "valid", "full").join(claims, "valid", "left").crossJoin(F.broadcast(whole))
    says = lambda key, value: F.coalesce(F.try_element_at("_said", F.lit(key)) == F.lit(value), F.lit(False))
    fails = {
        "cell_twice": F.col("copies") > 0, "cells": F.col("cells") != F.col("_levels"), "geometry": F.col("geometry") > 0, "grid": F.col("grid") > 0, "no_sst": F.col("sst_cells").isNull(), "no_state": F.col("cells").isNull(), "not_finite": F.col("finite") > 0,
        "sst_cells": F.col("sst_cells") != F.col("_grid"), "sst_range": F.col("sst_bad") > 0, "static_identity": F.col("cells").isNotNull() & ~says("static_sha256", static_digest), **{k: F.col("cells").isNotNull() & ~says(k, v) for k, v in SAID.items()},
    }
    named = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in fails.items()]), lambda v: v.isNotNull())
    return j.select("valid", F.coalesce("cells", F.lit(0)).alias("cells"), F.array_sort(named).alias("violations"))


def write_records(state: DataFrame, static: DataFrame, static_levels: DataFrame, sst: DataFrame, said: DataFrame, static_digest: str, path: str, side: int = SIDE) -> None:
    """Write every time of ``state`` with its sea surface, on water only, as a product; a time that can't become a record is an error that names it, and nothing is written."""
    wrong = record_report(state, static, static_levels, sst, said, static_digest).where("size(violations) > 0").orderBy("valid").limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.valid}: {', '.join(r.violations)}" for r in wrong))
    water = sst.join(shuffled(static.select("y", "x", "land")), ["y", "x"]).select("valid", "y", "x", F.when(~F.col("land"), F.col("SST")).alias("SST"))
    write(state.join(shuffled(water), ["valid", "y", "x"], "left"), path, side)
