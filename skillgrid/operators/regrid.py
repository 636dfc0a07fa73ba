"""Kernel regridding: weights are a sparse table (target, rank, donor, weight), applied by joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillgrid.operators.digest import fingerprint
from skillgrid.operators.order import quantiles
from skillgrid.operators.spatial import k_nearest

#: Condition limit of a kernel system, largest sum of absolute weights, ladder of nuggets, kernel scale in radians at a spacing of 13 km, spacings within which a donor must lie.
CONDITION, MOST_WEIGHT, NUGGETS = 1e10, 10.0, (0.0, 1e-14, 1e-12, 1e-10, 1e-8, 1e-7, 1e-6)
SCALE, SCALE_KM, MOST_SPACINGS = 0.05, 13.0, 3.0


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=-1)


def kernel_scale(spacing_km: float, factor: float = 1.0) -> float:
    """Scale of the kernel, in radians, for donors of a spacing."""
    return SCALE * spacing_km / SCALE_KM * factor


def solve_conditioned(matrix: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of n systems (n, k, k) for their right sides (n, k, m) with the least nugget on the diagonal that makes each well-conditioned, and that nugget; NaN where none does."""
    out, took, todo = np.full(right.shape, np.nan), np.full(len(matrix), np.nan), np.arange(len(matrix))
    for nugget in NUGGETS:
        m = matrix[todo] + nugget * np.eye(matrix.shape[1])
        fine = np.linalg.cond(m) <= CONDITION
        out[todo[fine]] = np.linalg.solve(m[fine], right[todo[fine]])
        took[todo[fine]] = nugget
        todo = todo[~fine]
        if not len(todo):
            break
    return out, took


def kernel_weights(points: np.ndarray, donors: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of k donors for n targets that sum to 1, and the nugget that each system took; all systems of a batch at once. points: (n, 3), donors: (n, k, 3).

    A system that stays ill-conditioned with the largest nugget, or whose weights add up to nothing, has weights of NaN.
    """
    arc = lambda a, b: 2 * np.arcsin(np.clip(np.linalg.norm(a - b, axis=-1) / 2, 0, 1))
    matrix = np.exp(-((arc(donors[:, :, None], donors[:, None]) / scale) ** 2))
    right = np.exp(-((arc(points[:, None], donors) / scale) ** 2))
    out, took = solve_conditioned(matrix, right[..., None])
    out = out[..., 0]
    total = out.sum(axis=1, keepdims=True)
    return out / np.where(np.abs(total) > 1e-14, total, np.nan), took


def _stencils(targets: DataFrame, donors: DataFrame, k: int, *more: str) -> DataFrame:
    """One row a target: its k nearest donors as arrays in order of rank, with their columns ``more``, and the distance of the nearest."""
    near = k_nearest(targets, donors, k)
    if more:
        near = near.join(donors.select("donor", *more), "donor", "left")
    rows = near.groupBy("target").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.min("km").alias("km"), F.array_sort(F.collect_list(F.struct("rank", "donor", "cell_lat", "cell_lon", *more))).alias("d"))
    return rows.select("target", "lat", "lon", "km", *[F.col(f"d.{c}").alias(c) for c in ("donor", "cell_lat", "cell_lon", *more)])


def _of_full_stencils(rows: DataFrame, k: int, names: list[str], solve, spacing_km: float | None, strict: bool) -> DataFrame:
    """(target, rank, donor, names..., nugget) from ``solve(lat, lon, donor columns...)``, which gives an (n, k) array for each name and the nuggets.

    A target without k donors, without one within three spacings, or with weights that aren't sound is an error; with ``strict`` off it keeps its rows, with null weights.
    """
    reach = float("inf") if spacing_km is None else MOST_SPACINGS * spacing_km

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n = np.diff(b.column(4).offsets.to_numpy())
            km = b.column(3).to_numpy(zero_copy_only=False)
            fine = (n == k) & (km <= reach)
            full = b.filter(pa.array(n == k))
            grids = [full.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, k) for c in range(4, b.num_columns)]
            found = [np.full((b.num_rows, k), np.nan) for _ in names]
            took = np.full(b.num_rows, np.nan)
            if full.num_rows:
                solved, nuggets = solve(full.column(1).to_numpy(), full.column(2).to_numpy(), *grids[1:])
                for out, one in zip(found, solved):
                    out[n == k] = one
                took[n == k] = nuggets
            for out in found:
                fine &= np.isfinite(out).all(axis=1)
            if strict and not fine.all():
                raise ValueError(f"{int((~fine).sum())} targets without sound weights, of them {b.column(0)[int(np.flatnonzero(~fine)[0])]}")
            rank = np.concatenate([np.arange(1, m + 1, dtype=np.int32) for m in n])
            place = (np.repeat(np.arange(b.num_rows), n), rank - 1)
            flat = [np.where(fine[:, None], out, np.nan)[place[0], np.minimum(place[1], k - 1)] for out in found]
            cols = [b.column(0).take(pa.array(place[0])), pa.array(rank), b.column(4).flatten(), *(pa.array(x, from_pandas=True) for x in flat), pa.array(took[place[0]], from_pandas=True)]
            yield pa.RecordBatch.from_arrays(cols, ["target", "rank", "donor", *names, "nugget"])

    return rows.mapInArrow(run, f"target long, rank int, donor long, {', '.join(f'{n} double' for n in names)}, nugget double")


def rbf_weights(targets: DataFrame, donors: DataFrame, k: int, scale: float, spacing_km: float | None = None, strict: bool = True) -> DataFrame:
    """(target, rank, donor, weight, nugget): Gaussian kernel weights of the k nearest donors, summing to 1.

    Weights whose sizes add up to more than the limit aren't sound, nor is a system that stays ill-conditioned.
    """

    def solve(lat, lon, cell_lat, cell_lon):
        w, took = kernel_weights(_unit(lat, lon), _unit(cell_lat, cell_lon), scale)
        w[~(np.abs(w).sum(axis=1) <= MOST_WEIGHT)] = np.nan
        return [w], took

    return _of_full_stencils(_stencils(targets, donors, k), k, ["weight"], solve, spacing_km, strict)


def tangents(lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors to the east and the north at places on the sphere."""
    a, b = np.radians(lat), np.radians(lon)
    east = np.stack([-np.sin(b), np.cos(b), np.zeros_like(b)], axis=-1)
    return east, np.stack([-np.sin(a) * np.cos(b), -np.sin(a) * np.sin(b), np.cos(a)], axis=-1)


def vector_kernel_weights(points: np.ndarray, east: np.ndarray, north: np.ndarray, donors: np.ndarray, normals: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of winds along k normals for the east and the north wind of n targets, and the nugget of each system.

    The kernel of two donors is that of their distance times the inner product of their normals; the right sides are the kernels to the target times the normals'
    projections on its east and north. Each solution is divided by its sum over those projections, so that a uniform wind comes back. points, east, north: (n, 3); donors, normals: (n, k, 3).
    """
    arc = lambda a, b: 2 * np.arcsin(np.clip(np.linalg.norm(a - b, axis=-1) / 2, 0, 1))
    alike = np.einsum("nid,njd->nij", normals, normals)
    matrix = alike * np.exp(-((arc(donors[:, :, None], donors[:, None]) / scale) ** 2))
    near = np.exp(-((arc(points[:, None], donors) / scale) ** 2))
    onto = np.stack([np.einsum("nkd,nd->nk", normals, t) for t in (east, north)], axis=-1)
    out, took = solve_conditioned(matrix, near[..., None] * onto)
    total = (out * onto).sum(axis=1, keepdims=True)
    out = out / np.where(np.abs(total) > 1e-14, total, np.nan)
    return out[..., 0], out[..., 1], took


def vector_weights(targets: DataFrame, edges: DataFrame, k: int, scale: float, spacing_km: float | None = None, strict: bool = True) -> DataFrame:
    """(target, rank, donor, east, north, nugget): weights of the winds along the k nearest edges' normals. edges: (donor, lat, lon, ne, nn), the normal's parts to the east and north; of any length but 0.

    An edge without a normal leaves its targets without sound weights.
    """

    def solve(lat, lon, cell_lat, cell_lon, ne, nn):
        by_east, by_north = tangents(cell_lat, cell_lon)
        normal = ne[..., None] * by_east + nn[..., None] * by_north
        length = np.linalg.norm(normal, axis=-1, keepdims=True)
        normal = normal / np.where(length > 1e-12, length, np.nan)
        sound = np.isfinite(normal).all(axis=(1, 2))
        east, north = tangents(lat, lon)
        w_east, w_north, took = vector_kernel_weights(_unit(lat, lon), east, north, _unit(cell_lat, cell_lon), np.where(sound[:, None, None], normal, 0.0), scale)
        w_east[~sound], w_north[~sound] = np.nan, np.nan
        return [w_east, w_north], took

    return _of_full_stencils(_stencils(targets, edges, k, "ne", "nn"), k, ["east", "north"], solve, spacing_km, strict)


def wind_from_normals(weights: DataFrame, edges: DataFrame, value: str = "vn") -> DataFrame:
    """(target, u, v) from winds along edge normals (donor, vn) by ``vector_weights``; null where the weights are, or a wind is missing."""
    j = weights.join(edges.select("donor", value), "donor", "left")
    whole = F.count_if(F.col("east").isNull() | F.col(value).isNull()) == 0
    part = lambda w: F.when(whole, F.sum(F.col(w) * F.col(value)))
    return j.groupBy("target").agg(part("east").alias("u"), part("north").alias("v"))


def apply_weights(weights: DataFrame, source: DataFrame, value: str, clip: bool = True) -> DataFrame:
    """(target, value): weighted sums over donors, clipped to the donors' range."""
    j = weights.join(source.select("donor", value), "donor")
    total = F.sum(F.col("weight") * F.col(value))
    g = j.groupBy("target").agg(total.alias("v"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    return g.select("target", (F.least(F.greatest("v", "lo"), F.col("hi")) if clip else F.col("v")).alias(value))


def spacing_km(cells: DataFrame) -> DataFrame:
    """One row: the median distance to the nearest other point. cells: (donor, lat, lon)."""
    near = k_nearest(cells.withColumnRenamed("donor", "target"), cells, 2).where("rank = 2")
    return cells.sparkSession.createDataFrame([(quantiles(near, "km", [0.5])[0],)], "spacing_km double")


def tie_rank(df: DataFrame, key: str, order: list) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def save_weights(weights: DataFrame, path: str, source: DataFrame, targets: DataFrame, method: str, scale: float) -> None:
    """Write weights (target, rank, donor, ...) with what they belong to: digests of both grids and of themselves, method, scale and largest nugget."""
    spark, columns = weights.sparkSession, weights.columns
    weights.write.parquet(f"{path}/weights")
    back = spark.read.parquet(f"{path}/weights")
    nugget = back.agg(F.max("nugget")).first()[0] if "nugget" in columns else None
    told = (fingerprint(source, ["donor", "lat", "lon"]), fingerprint(targets, ["target", "lat", "lon"]), fingerprint(back, columns), method, scale, nugget)
    spark.createDataFrame([told], "source string, target string, weights string, method string, scale double, nugget double").coalesce(1).write.parquet(f"{path}/about")


def load_weights(spark: SparkSession, path: str, source: DataFrame, targets: DataFrame, method: str | None = None) -> DataFrame:
    """Weights that ``save_weights`` wrote. That they belong to another grid, to another method, or aren't what was written is an error."""
    about, weights = spark.read.parquet(f"{path}/about").first(), spark.read.parquet(f"{path}/weights")
    checks = {"source grid": (about.source, fingerprint(source, ["donor", "lat", "lon"])), "target grid": (about.target, fingerprint(targets, ["target", "lat", "lon"])), "weights": (about.weights, fingerprint(weights, weights.columns)), "method": (about.method, method or about.method)}
    for what, (told, found) in checks.items():
        if told != found:
            raise ValueError(f"the {what} is not the one that was written: {told}, {found}")
    return weights
