"""Raster neighbourhoods as windows along rows and columns of a cell table (y, x, ...)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillgrid.functions.physics import edge_taper
from skillgrid.operators.graph import connected_components
from skillgrid.operators.order import ranked
from skillgrid.operators.tiles import Tile, box_medians, over_tiles
from skillgrid.session import materialize


def along(axis: str):
    """Windows of one row (axis x) or one column (axis y), which are as many as the raster has, so no task holds the raster."""
    return Window.partitionBy("y" if axis == "x" else "x").orderBy(axis)


def box_mean(cells: DataFrame, value: str, half: int, passes: int = 1) -> DataFrame:
    """Mean over a square of half-width ``half`` cut at the edges; sums and counts are separable."""
    for _ in range(passes):
        for axis in ("x", "y"):
            w = along(axis).rangeBetween(-half, half)
            first = axis == "x"
            total = F.sum(value if first else "_s").over(w)
            count = (F.count(value) if first else F.sum("_n")).over(w)
            cells = cells.withColumns({"_s": total, "_n": count})
        cells = cells.withColumn(value, F.col("_s") / F.col("_n")).drop("_s", "_n")
        if passes > 1:
            cells = materialize(cells, "box-mean")
    return cells


def box_median(cells: DataFrame, value: str, half: int, name: str = "median", side: int = 128) -> DataFrame:
    """``cells`` with the median over a square of half-width ``half`` cut at the edges, null where it holds no value. By tiles that have the box around them, so that no task holds a row or
    a column of the raster."""

    def run(tile: Tile, table: pa.Table) -> dict[str, pa.Array]:
        values = table[value].to_numpy().astype(np.float64)
        return {name: pa.array(tile.rows(box_medians(tile.dense(values), half)), from_pandas=True)}

    return over_tiles(cells, half, run, f"`{name}` double", max(side, half))


def smooth_121(cells: DataFrame, value: str, active: str) -> DataFrame:
    """1-2-1 filter normalised over active neighbours, along x and then y."""
    for axis in ("x", "y"):
        w = along(axis)
        weight = lambda c, k: F.when(F.coalesce(c, F.lit(False)), F.lit(float(k))).otherwise(0.0)
        near = [(F.lag(value).over(w), F.lag(active).over(w), F.lag(axis).over(w) == F.col(axis) - 1, 1), (F.col(value), F.col(active), F.lit(True), 2), (F.lead(value).over(w), F.lead(active).over(w), F.lead(axis).over(w) == F.col(axis) + 1, 1)]
        weights = [weight(a & next_, k) for _, a, next_, k in near]
        total = weights[0] + weights[1] + weights[2]
        mean = sum((F.coalesce(v, F.lit(0.0)) * g for (v, _, _, _), g in list(zip(near, weights))[1:]), F.coalesce(near[0][0], F.lit(0.0)) * weights[0])
        cells = cells.withColumn(value, F.when(F.col(active) & (total > 0), mean / total).otherwise(F.col(value)))
    return cells


def shapiro(cells: DataFrame, value: str, active: str, order: int = 4, strength: float = 1.0, passes: int = 1) -> DataFrame:
    """value - strength * (1 - S)^(order / 2) value on active cells; S is the 1-2-1 filter."""
    for _ in range(passes):
        cells = cells.withColumn("_d", F.col(value))
        for _ in range(order // 2):
            cells = smooth_121(cells.withColumn("_f", F.col("_d")), "_f", active).withColumn("_d", F.col("_d") - F.col("_f")).drop("_f")
        cells = cells.withColumn(value, F.when(F.col(active), F.col(value) - strength * F.col("_d")).otherwise(F.col(value))).drop("_d")
        if passes > 1:
            cells = materialize(cells, "shapiro")
    return cells


def edge_distance(cells: DataFrame) -> DataFrame:
    """``cells`` with how many cells each is from the raster's edge, by the raster's own bounds."""
    e = cells.agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    return cells.crossJoin(F.broadcast(e)).withColumn("cells", F.least(F.col("x") - F.col("_x0"), F.col("_x1") - F.col("x"), F.col("y") - F.col("_y0"), F.col("_y1") - F.col("y"))).drop("_x0", "_x1", "_y0", "_y1")


def embedded(outer: DataFrame, inner: DataFrame, value: str, most: float) -> DataFrame:
    """(y, x, value, inside) of the cells of ``outer`` with those of ``inner`` in their place, bit by bit, where the two agree at the inner raster's edge; an error if they differ there by more than ``most``."""
    gap = edge_gap(outer, inner, value).first()
    if gap.cells and not (gap.largest is not None and gap.largest <= most):
        raise ValueError(f"the rasters differ by {gap.largest} at the edge, the limit is {most}")
    j = outer.select("y", "x", F.col(value).alias("_o")).join(inner.select("y", "x", F.col(value).alias("_i"), F.lit(True).alias("inside")), ["y", "x"], "left")
    return j.select("y", "x", F.when(F.col("inside"), F.col("_i")).otherwise(F.col("_o")).alias(value), F.coalesce("inside", F.lit(False)).alias("inside"))


def edge_gap(outer: DataFrame, inner: DataFrame, value: str) -> DataFrame:
    """One row: cells on the edge of ``inner``, and the largest difference, the 99th percentile and the mean of the two rasters there; largest is null where ``outer`` lacks one of them."""
    edge = edge_distance(inner).where("cells = 0").select("y", "x", F.col(value).alias("_i"))
    j = edge.join(outer.select("y", "x", F.col(value).alias("_o")), ["y", "x"], "left").withColumn("_d", F.abs(F.col("_o") - F.col("_i")))
    return j.agg(F.count("*").alias("cells"), F.when(F.count("_d") == F.count("*"), F.max("_d")).alias("largest"), F.percentile("_d", 0.99).alias("p99"), F.avg("_d").alias("mean"))


def reblend(cells: DataFrame, value: str, outer: Column, width: float) -> DataFrame:
    """``value`` blended into ``outer`` over ``width`` cells from the edges (x0, x1, y0, y1), which are columns."""
    w = edge_taper(F.least(F.col("x") - F.col("x0"), F.col("x1") - F.col("x"), F.col("y") - F.col("y0"), F.col("y1") - F.col("y")), width, "cosine")
    return cells.withColumn(value, (1 - w) * outer + w * F.col(value))


def second_order(value: str, w, step: float) -> Column:
    """Second-order difference along a window: centred inside, one-sided over two steps at the ends."""
    v, b, f, b2, f2 = F.col(value), F.lag(value).over(w), F.lead(value).over(w), F.lag(value, 2).over(w), F.lead(value, 2).over(w)
    return F.when(b.isNull() & f2.isNotNull(), (-3 * v + 4 * f - f2) / (2 * step)).when(f.isNull() & b2.isNotNull(), (3 * v - 4 * b + b2) / (2 * step)).when(b.isNull(), (f - v) / step).when(f.isNull(), (v - b) / step).otherwise((f - b) / (2 * step))


def gradient(cells: DataFrame, value: str, axis: str, step: float) -> Column:
    """Second-order difference along a row or a column."""
    return second_order(value, along(axis), step)


def faces(cells: DataFrame, value: str, axis: str) -> tuple[Column, Column]:
    """Values at a cell's two faces along an axis: midway to the neighbours, and the cell's own at the raster's edge. Their mean brings a face field back to cells."""
    w, v = along(axis), F.col(value)
    return F.coalesce((v + F.lag(value).over(w)) / 2, v), F.coalesce((v + F.lead(value).over(w)) / 2, v)


def rotation(cells: DataFrame, dx_m: float, smooth_m: float = 1000.0, half: int = 4) -> DataFrame:
    """(y, x, sin_a, cos_a) of the grid against the parallels: from the change of lat and lon over two cells either way, fewer at the edges, smoothed over ``smooth_m``."""
    w = along("x")
    at = lambda c, f: F.coalesce(f(c, 2).over(w), f(c, 1).over(w), F.col(c))
    dlat, dlon = at("lat", F.lead) - at("lat", F.lag), (at("lon", F.lead) - at("lon", F.lag)) * F.cos(F.radians("lat"))
    r = cells.select("y", "x", dlat.alias("_a"), dlon.alias("_o"))
    n = F.sqrt(F.col("_a") * F.col("_a") + F.col("_o") * F.col("_o"))
    r = r.select("y", "x", F.try_divide(-F.col("_a"), n).alias("sin_a"), F.abs(F.try_divide(F.col("_o"), n)).alias("cos_a"))
    passes = int(smooth_m / dx_m)
    return r if not passes else box_mean(box_mean(r, "sin_a", half, passes), "cos_a", half, passes)


def neighbour_pairs(cells: DataFrame, keep: list[str]) -> DataFrame:
    """Pairs of cells that touch along a row or a column: (y, x, axis, keep..., next_keep...)."""
    out = None
    for axis in ("x", "y"):
        w = along(axis)
        p = cells.select("y", "x", F.lit(axis).alias("axis"), *keep, *[F.lead(k).over(w).alias(f"next_{k}") for k in keep], (F.lead(axis).over(w) == F.col(axis) + 1).alias("_t")).where("_t").drop("_t")
        out = p if out is None else out.unionByName(p)
    return out


def label_components(cells: DataFrame, mask: Column) -> DataFrame:
    """(y, x, label) of masked cells; labels number the 4-connected groups in order of their first cell."""
    width = F.broadcast(cells.agg((F.max("x").cast("long") + 1).alias("_width")))  # one row
    on = cells.where(mask).select("y", "x").crossJoin(width).select("y", "x", (F.col("y").cast("long") * F.col("_width") + F.col("x")).alias("node"))
    edges = neighbour_pairs(on, ["node"]).select(F.col("node").alias("src"), F.col("next_node").alias("dst"))
    found = connected_components(edges)
    named = on.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return named.join(numbered(named.select("component").distinct()), "component").select("y", "x", "label")


def numbered(components: DataFrame) -> DataFrame:
    """(component, label) with labels from 1 in order of component."""
    return ranked(components, "component", name="label").select("component", F.col("label").cast("int").alias("label"))
