"""Spatial joins without a theta join: within a bound by bins, candidates sharing one or lying in one next to it; the nearest, however far, by a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillgrid.functions.physics import KM_PER_LAT, KM_PER_LON, arc_km
from skillgrid.operators.nearest import nearest
from skillgrid.session import fresh, shuffled


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, at_lat: Column) -> Column:
    dy, dx = (lat1 - lat2) * KM_PER_LAT, (lon1 - lon2) * KM_PER_LON * F.cos(F.radians(at_lat))
    return F.sqrt(dy * dy + dx * dx)


def _bin(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def candidates(sites: DataFrame, cells: DataFrame, size: float, rings: int = 1, site_at: tuple = ("lat", "lon"), cell_at: tuple = ("lat", "lon")) -> DataFrame:
    """Every pair of a site and a cell within ``rings`` bins of ``size`` degrees, by an equi-join on bins."""
    around = F.sequence(F.lit(-rings), F.lit(rings))
    s = sites.withColumn("_by", F.explode(F.transform(around, lambda i: _bin(F.col(site_at[0]), size) + i))).withColumn("_bx", F.explode(F.transform(around, lambda i: _bin(F.col(site_at[1]), size) + i)))
    c = cells.withColumns({"_by": _bin(F.col(cell_at[0]), size), "_bx": _bin(F.col(cell_at[1]), size)}).withColumnsRenamed({cell_at[0]: "cell_lat", cell_at[1]: "cell_lon"})
    return s.join(c, ["_by", "_bx"]).drop("_by", "_bx")


def nearest_cell(sites: DataFrame, cells: DataFrame, keys: list[str], at_lat: Column | None = None) -> DataFrame:
    """(keys, y, x, km) of the cell next to each site, however far; ties go to the first (y, x). Distances are planar at ``at_lat``, the site's own latitude if not given.

    A site without coordinates, or any where there are no cells, keeps its row with nulls: a violation.
    """
    at = fresh("at_lat", [*sites.columns, "y", "x", "cell_lat", "cell_lon", "km"])
    sites = sites.withColumn(at, F.col("lat") if at_lat is None else at_lat)

    def first(pairs: DataFrame) -> DataFrame:
        pairs = pairs.withColumn("km", planar_km(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon"), F.col(at)))
        return pairs.groupBy(*keys).agg(F.min_by(F.struct("y", "x", "km"), F.struct("km", "y", "x")).alias("b")).select(*keys, "b.*")

    points = cells.select("y", "x", F.col("lat").alias("cell_lat"), F.col("lon").alias("cell_lon"))
    return nearest(sites.select(*keys, "lat", "lon", at), points, 1, [F.col("lat"), F.col("lon")], [F.col("cell_lat"), F.col("cell_lon")], first, [F.lit(KM_PER_LAT), KM_PER_LON * F.cos(F.radians(at))])


def nearest_land_cell(sites: DataFrame, cells: DataFrame, keys: list[str], bound_km: float) -> DataFrame:
    """(keys, y0, x0, km0, y, x, km, displacement, override): the cell next to a site, and of the land cells that are no further than ``bound_km`` from that cell the
    one next to the site. Distances are planar at the mean latitude of the cells. A site without such a cell keeps its row, with nulls: a violation.
    """
    mean = cells.agg(F.avg("lat").alias("mean_lat"))
    at = F.col("mean_lat")
    sites, cells = sites.crossJoin(F.broadcast(mean)), cells.select("y", "x", "lat", "lon", "land")
    first = nearest_cell(sites, cells, keys, at).select(*keys, F.col("y").alias("y0"), F.col("x").alias("x0"), F.col("km").alias("km0"))
    origin = first.join(cells.select(F.col("y").alias("y0"), F.col("x").alias("x0"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0")), ["y0", "x0"]).join(sites, keys)
    # bins as wide as the bound even where a degree of longitude is half as long
    near = candidates(origin, cells.where("land"), 2 * bound_km / KM_PER_LAT, 1, ("lat0", "lon0"))
    moved = planar_km(F.col("cell_lat"), F.col("cell_lon"), F.col("lat0"), F.col("lon0"), at)
    near = near.withColumn("displacement", moved).where(F.col("displacement") <= bound_km + max(1e-9, 1e-6 * bound_km))
    near = near.withColumn("km", planar_km(F.col("cell_lat"), F.col("cell_lon"), F.col("lat"), F.col("lon"), at))
    best = near.groupBy(*keys).agg(F.min_by(F.struct("y", "x", "km", "displacement"), F.struct("km", "y", "x")).alias("b")).select(*keys, "b.*")
    return first.join(best, keys, "left").withColumn("override", (F.col("y") != F.col("y0")) | (F.col("x") != F.col("x0")))


def within_domain(sites: DataFrame, cells: DataFrame, keys: list[str], most_km: float) -> DataFrame:
    """(keys, y, x, km, kept) of every site; ``kept`` where its cell is no further than ``most_km``. That none is kept is an error."""
    out = nearest_cell(sites, cells, keys).withColumn("kept", F.col("km") <= most_km)
    if out.where("kept").isEmpty():
        raise ValueError("no site within the domain")
    return out


def on_sphere(lat: Column, lon: Column) -> list[Column]:
    """A place as a point of the unit sphere; straight distances grow with those along the surface."""
    lat, lon = F.radians(lat), F.radians(lon)
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]


def k_nearest(targets: DataFrame, donors: DataFrame, k: int) -> DataFrame:
    """(target, rank, donor, km, lat, lon, cell_lat, cell_lon): the k nearest donors on the sphere, ties by donor, for every target; all of them if they are fewer.
    ``targets`` and ``donors`` have (target | donor, lat, lon).

    A target without coordinates, or any where there are no donors, keeps one row with nulls: a violation.
    """

    def first(pairs: DataFrame) -> DataFrame:
        pairs = pairs.withColumn("km", arc_km(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon")))
        w = Window.partitionBy("target").orderBy(F.round("km", 9), "donor")
        return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("target", "rank", "donor", "km", "lat", "lon", "cell_lat", "cell_lon")

    points = donors.select("donor", F.col("lat").alias("cell_lat"), F.col("lon").alias("cell_lon"))
    return nearest(targets.select("target", "lat", "lon"), points, k, on_sphere(F.col("lat"), F.col("lon")), on_sphere(F.col("cell_lat"), F.col("cell_lon")), first)


def footprint(sites: DataFrame, cells: DataFrame, radius_km: float, dx_km: float) -> DataFrame:
    """Cells around a site's cell (site, y0, x0): a table of offsets, then an equi-join on (y, x)."""
    n = int(radius_km / dx_km) + 1
    steps = F.sequence(F.lit(-n), F.lit(n))
    off = sites.withColumn("oy", F.explode(steps)).withColumn("ox", F.explode(steps)).where(F.sqrt(F.col("oy") * F.col("oy") + F.col("ox") * F.col("ox")) * dx_km <= radius_km)
    off = off.withColumns({"y": F.col("y0") + F.col("oy"), "x": F.col("x0") + F.col("ox")})
    return off.join(shuffled(cells), ["y", "x"], "left")


def brackets(axis: DataFrame, value: str) -> DataFrame:
    """(lo, hi, i, last) intervals of an ascending axis, which is one row of a raster long."""
    w = Window.orderBy(value)
    out = axis.select(F.col(value).alias("lo"), F.lead(value).over(w).alias("hi"), (F.row_number().over(w) - 1).alias("i")).where("hi is not null")
    return out.withColumn("last", F.lead("i").over(Window.orderBy("i")).isNull())


def in_bracket(rows: DataFrame, axis: DataFrame, value: str, size: float, index: str, fraction: str) -> DataFrame:
    """``rows`` with the interval of ``axis`` that ``value`` lies in and how far into it; nulls outside. The last interval holds its end.

    Intervals are joined by the bins of ``size`` that they touch, so no rows are compared with the whole axis.
    """
    b = brackets(axis, value).withColumn("_b", F.explode(F.sequence(_bin(F.col("lo"), size), _bin(F.col("hi"), size))))
    at = rows.withColumn("_b", _bin(F.col(value), size))
    inside = (at["_b"] == b["_b"]) & (at[value] >= b["lo"]) & ((at[value] < b["hi"]) | (b["last"] & (at[value] == b["hi"])))
    out = at.join(b, inside, "left")
    return out.select(*[at[c] for c in rows.columns], F.col("i").alias(index), ((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias(fraction))


def bilinear(sites: DataFrame, cells: DataFrame, value: str, key: str, size: float = 0.01) -> DataFrame:
    """(key, value, outside) from the four cells around a site on ascending axes; a site outside them keeps its row with a null value."""
    w = in_bracket(in_bracket(sites, cells.select("lat").distinct(), "lat", size, "y0", "fy"), cells.select("lon").distinct(), "lon", size, "x0", "fx")
    corner = lambda j, i: F.struct((F.col("y0") + j).alias("y"), (F.col("x0") + i).alias("x"), ((F.col("fy") if j else 1 - F.col("fy")) * (F.col("fx") if i else 1 - F.col("fx"))).alias("w"))
    c = w.select(key, F.explode(F.array(*[corner(j, i) for j in (0, 1) for i in (0, 1)])).alias("c")).select(key, "c.*")
    g = c.join(cells.select("y", "x", F.col(value).alias("_v")), ["y", "x"], "left").groupBy(key).agg(F.sum(F.col("w") * F.col("_v")).alias("_s"), F.count("_v").alias("_n"))
    return g.select(key, F.when(F.col("_n") == 4, F.col("_s")).alias(value), (F.col("_n") < 4).alias("outside"))
