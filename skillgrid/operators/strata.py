"""Classes of stations and cells; an element may be in several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def season(valid: Column) -> Column:
    m = F.month(valid)
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").otherwise("SON")


SEASON_ORDER = "CASE season WHEN 'DJF' THEN 0 WHEN 'MAM' THEN 1 WHEN 'JJA' THEN 2 ELSE 3 END"


def elevation_class(z: Column) -> Column:
    return F.when(z < 500, "<500").when(z < 1000, "500-1000").when(z < 1500, "1000-1500").when(z < 2000, "1500-2000").when(z < 3000, "2000-3000").otherwise(">=3000")


def terrain_class(relative: Column) -> Column:
    """150 m either way is still neutral."""
    return F.when(relative < -150, "valley").when(relative > 150, "ridge").otherwise("neutral")


def memberships(z: Column, relative: Column, edge_m: Column, width_m: float) -> Column:
    """Names of all classes that a site is in."""
    tests = {
        "all": F.lit(True),
        "interior": edge_m >= width_m,
        "boundary": edge_m < width_m,
        "lt_500": z < 500,
        "500_1000": (z >= 500) & (z < 1000),
        "1000_1500": (z >= 1000) & (z < 1500),
        "1500_2000": (z >= 1500) & (z < 2000),
        "ge_2000": z >= 2000,
        "2000_3000": (z >= 2000) & (z < 3000),
        "ge_3000": z >= 3000,
        "valley": relative < -150,
        "neutral": F.abs(relative) <= 150,
        "ridge": relative > 150,
    }
    return F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in tests.items()]))


def explode_membership(df: DataFrame, classes: Column, name: str = "stratum") -> DataFrame:
    """A row for each class that a row is in."""
    return df.withColumn(name, F.explode(classes))
