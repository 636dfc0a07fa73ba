"""Places in an order of all rows, and quantiles from them, without one task that holds them all."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillgrid.session import drop, materialize


def ranked(df: DataFrame, *columns: str, name: str = "place") -> DataFrame:
    """``df`` with the place of every row, from 1, in order of ``columns``: places within ranges, and how many rows lie in the ranges before."""
    ranged = materialize(df.repartitionByRange(*columns).withColumn("_range", F.spark_partition_id()), "ranges")
    before = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each task
    before = before.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*columns))
    return ranged.withColumn("_i", within).join(F.broadcast(before), "_range").withColumn(name, F.col("_i") + F.col("_before")).drop("_range", "_i", "_before")


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of a column, between two values in proportion; nulls don't count. Only the values next to them reach the driver."""
    rows = df.where(F.col(value).isNotNull()).select(value)
    placed = materialize(ranked(rows, value), "places")
    n = placed.count()
    if not n:
        return [None] * len(shares)
    at = [q * (n - 1) + 1 for q in shares]
    wanted = sorted({int(f(p)) for p in at for f in (math.floor, math.ceil)})
    found = {r[0]: r[1] for r in placed.where(F.col("place").isin(wanted)).select("place", value).collect()}
    drop(placed)
    return [found[math.floor(p)] + (p - math.floor(p)) * (found[math.ceil(p)] - found[math.floor(p)]) for p in at]
