"""Static layers from pixels: mosaics of overlapping tiles, means and shares over cells of another grid, and gaps filled from the nearest cell that has a value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.functions.physics import soil_texture
from skillgrid.operators.nearest import nearest
from skillgrid.operators.surface import layer_mean

#: Bounds of the source's and the target's soil layers in centimetres, and the category of water.
SOURCE_CM, TARGET_CM, WATER = (0.0, 5.0, 15.0, 30.0, 60.0, 100.0, 200.0), ((0.0, 10.0), (10.0, 30.0), (30.0, 70.0), (70.0, 150.0)), 16


def mosaic(tiles: DataFrame, *values: str) -> DataFrame:
    """(y, x, values) of pixels (tile, y, x, values): each value is that of the first tile, in order of ``tile``, that has one there."""
    first = lambda v: F.min_by(F.when(F.col(v).isNotNull(), F.col(v)), F.when(F.col(v).isNotNull(), F.col("tile")))
    return tiles.groupBy("y", "x").agg(*[first(v).alias(v) for v in values])


def over_cells(pixels: DataFrame, size: float, cell: float, offset: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """``pixels`` (y, x, ...) of width ``size`` with every cell (cell_y, cell_x) of width ``cell`` that they overlap and the shared ``area``. Pixel 0 begins at ``offset``, cell 0 at 0.

    A pixel meets (size / cell + 1)^2 cells or so; cells are found by arithmetic, nothing is joined.
    """
    for axis, begin in (("y", offset[0]), ("x", offset[1])):
        lo = F.col(axis) * size + begin
        hi = lo + size
        pixels = pixels.withColumns({"_lo": lo, "_hi": hi}).withColumn(f"cell_{axis}", F.explode(F.sequence(F.floor(F.col("_lo") / cell).cast("int"), F.ceil(F.col("_hi") / cell).cast("int") - 1)))
        pixels = pixels.withColumn(f"_{axis}", F.least(F.col("_hi"), (F.col(f"cell_{axis}") + 1) * cell) - F.greatest(F.col("_lo"), F.col(f"cell_{axis}") * cell))
    return pixels.withColumn("area", F.col("_y") * F.col("_x")).where("area > 0").drop("_lo", "_hi", "_y", "_x")


def zonal_mean(overlaps: DataFrame, *values: str) -> DataFrame:
    """(cell_y, cell_x, values): means weighted by area over the pixels that have a value; null where none has one."""
    mean = lambda v: F.try_divide(F.sum(F.col(v) * F.col("area")), F.sum(F.when(F.col(v).isNotNull(), F.col("area"))))
    return overlaps.groupBy("cell_y", "cell_x").agg(*[mean(v).alias(v) for v in values])


def zonal_shares(overlaps: DataFrame, category: str) -> DataFrame:
    """(cell_y, cell_x, category, share): the part of each cell's covered area that a category has."""
    g = overlaps.where(F.col(category).isNotNull()).groupBy("cell_y", "cell_x", category).agg(F.sum("area").alias("area"))
    total = g.groupBy("cell_y", "cell_x").agg(F.sum("area").alias("total"))
    return g.join(total, ["cell_y", "cell_x"]).select("cell_y", "cell_x", category, (F.col("area") / F.col("total")).alias("share"))


def dominant(shares: DataFrame, category: str) -> DataFrame:
    """(cell_y, cell_x, category, share, land): the category with the largest share, the smaller of equal ones; land is what isn't water."""
    best = shares.groupBy("cell_y", "cell_x").agg(F.max_by(F.struct(category, "share"), F.struct(F.round("share", 9), -F.col(category))).alias("b"))
    return best.select("cell_y", "cell_x", "b.*").withColumn("land", F.col(category) != WATER)


def filled(cells: DataFrame, *values: str) -> DataFrame:
    """``cells`` (cell_y, cell_x, ...) where rows with a null among ``values`` have all of them from the nearest cell that has all, the first of equals, and ``gap_cells``, its distance (0: their own).

    Only cells with gaps are looked for; if no cell is whole they keep their nulls.
    """
    whole = F.lit(True)
    for v in values:
        whole = whole & F.col(v).isNotNull()
    sound = cells.where(whole)
    lost = cells.where(~whole).drop(*values)
    there = sound.select(F.col("cell_y").alias("from_y"), F.col("cell_x").alias("from_x"), *values)

    def first(pairs: DataFrame) -> DataFrame:
        dy, dx = F.col("cell_y") - F.col("from_y"), F.col("cell_x") - F.col("from_x")
        square = dy * dy + dx * dx
        best = F.min_by(F.struct(*values, F.sqrt(square).alias("gap_cells")), F.struct(square, "from_y", "from_x"))
        return pairs.groupBy(*lost.columns).agg(best.alias("_b")).select(*lost.columns, "_b.*")

    at = lambda y, x: [F.col(y), F.col(x)]
    found = nearest(lost, there, 1, at("cell_y", "cell_x"), at("from_y", "from_x"), first)
    return sound.withColumn("gap_cells", F.lit(0.0)).unionByName(found)


def soil_layers(overlaps: DataFrame, sand: str, silt: str, clay: str, depths: int = len(SOURCE_CM) - 1) -> DataFrame:
    """(cell_y, cell_x, texture0 to texture3, gap_cells): texture classes of the target's layers from pixels with columns ``sand0``, ``sand1`` ... of the source's depths.

    Shares are averaged over a cell, then over the depths that a layer overlaps; cells without any are filled from the nearest before they are classified.
    """
    names = [f"{p}{k}" for p in (sand, silt, clay) for k in range(depths)]
    means = zonal_mean(overlaps, *names)
    layer = lambda p, a, b: layer_mean([F.col(f"{p}{k}") for k in range(depths)], SOURCE_CM, a, b)
    mixed = means.select("cell_y", "cell_x", *[layer(p, a, b).alias(f"{p}_{k}") for p in (sand, silt, clay) for k, (a, b) in enumerate(TARGET_CM)])
    whole = filled(mixed, *[c for c in mixed.columns if c not in ("cell_y", "cell_x")])
    texture = lambda k: soil_texture(*[F.col(f"{p}_{k}") for p in (sand, silt, clay)])
    return whole.select("cell_y", "cell_x", *[texture(k).alias(f"texture{k}") for k in range(len(TARGET_CM))], "gap_cells")
