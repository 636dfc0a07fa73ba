"""Error statistics as aggregate expressions: sums that merge, and a projection of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_sums(model: Column, obs: Column) -> list[Column]:
    """Eight mergeable sums over rows in which both values are there."""
    both = model.isNotNull() & obs.isNotNull()
    m, o = F.when(both, model), F.when(both, obs)
    parts = {"n": F.count(m), "sm": F.sum(m), "so": F.sum(o), "smm": F.sum(m * m), "soo": F.sum(o * o), "smo": F.sum(m * o), "sdd": F.sum((m - o) * (m - o)), "sabs": F.sum(F.abs(m - o))}
    return [v.alias(k) for k, v in parts.items()]


def pair_result() -> list[Column]:
    """Statistics from ``pair_sums``: population moments, variances held at 0, correlation null for a constant series."""
    n = F.nullif(F.col("n"), F.lit(0)).cast("double")
    mm, mo = F.col("sm") / n, F.col("so") / n
    bias, rmse = mm - mo, F.sqrt(F.col("sdd") / n)
    vm, vo = F.greatest(F.col("smm") / n - mm * mm, F.lit(0.0)), F.greatest(F.col("soo") / n - mo * mo, F.lit(0.0))
    spread = F.sqrt(vm * vo)
    return [
        F.col("n").alias("pair_count"),
        mm.alias("model_mean"),
        mo.alias("obs_mean"),
        bias.alias("bias"),
        (F.col("sabs") / n).alias("mae"),
        rmse.alias("rmse"),
        F.sqrt(F.greatest(rmse * rmse - bias * bias, F.lit(0.0))).alias("centered_rmse"),
        F.sqrt(vm).alias("model_sd"),
        F.sqrt(vo).alias("obs_sd"),
        F.when(spread > 0, (F.col("smo") / n - mm * mo) / spread).alias("corr"),
    ]


STATS = ("model_mean", "obs_mean", "bias", "mae", "rmse", "centered_rmse", "model_sd", "obs_sd", "corr")


def pair_stats(df: DataFrame, keys: list[str], model: str, obs: str) -> DataFrame:
    """Error statistics of ``model`` against ``obs`` for every group."""
    sums = df.groupBy(*keys).agg(*pair_sums(F.col(model), F.col(obs)))
    return sums.select(*keys, *pair_result())


def circular_error(model: Column, obs: Column) -> Column:
    """Degrees from obs to model, in [-180, 180)."""
    return F.pmod(model - obs + 180.0, F.lit(360.0)) - 180.0


def circular_stats(df: DataFrame, keys: list[str], model: str, obs: str) -> DataFrame:
    """Count, circular bias, mean absolute and root-mean-square error of directions in degrees."""
    e = circular_error(F.col(model), F.col(obs))
    sums = df.where(F.col(model).isNotNull() & F.col(obs).isNotNull()).groupBy(*keys).agg(F.count(e).alias("pair_count"), F.sum(F.sin(F.radians(e))).alias("s"), F.sum(F.cos(F.radians(e))).alias("c"), F.avg(F.abs(e)).alias("mean_abs"), F.sqrt(F.avg(e * e)).alias("rms"))
    return sums.select(*keys, "pair_count", F.degrees(F.atan2("s", "c")).alias("bias"), "mean_abs", "rms")


def vector_rmse(du: Column, dv: Column) -> Column:
    return F.sqrt(F.avg(du * du + dv * dv))


def distribution(value: Column | str, quantiles: tuple = (0.5, 0.9, 0.99)) -> list[Column]:
    """Count, maximum and exact linear quantiles; nulls where there is nothing."""
    value = F.col(value) if isinstance(value, str) else value
    at = F.percentile(value, F.array(*map(F.lit, quantiles)))
    return [F.count(value).alias("n"), F.max(value).alias("max"), *[at[i].alias(f"p{round(q * 100):02d}") for i, q in enumerate(quantiles)]]


def material_change(delta: Column, baseline: Column, slack: float = 1e-12) -> Column:
    """Improvement or degradation beyond max(0.10, 5 % of the baseline); the boundary is neutral."""
    limit = F.greatest(F.lit(0.10), 0.05 * baseline)
    return F.when(delta < -limit - slack, "improvement").when(delta > limit + slack, "degradation").otherwise("neutral")


def joint_class(vector: Column, speed: Column) -> Column:
    """Class of an event from its vector and speed changes."""
    good, bad = F.lit("improvement"), F.lit("degradation")
    return (
        F.when((vector == good) & (speed == good), "strong")
        .when(((vector == bad) & (speed == good)) | ((vector == good) & (speed == bad)), "mixed")
        .when((vector == bad) | (speed == bad), "degraded")
        .when((vector == good) | (speed == good), "qualified")
        .otherwise("neutral")
    )


def normalized_difference(candidate: Column, baseline: Column) -> Column:
    """(c - b) / (c + b), 0 where the sum is 0."""
    return F.coalesce(F.try_divide(candidate - baseline, candidate + baseline), F.lit(0.0))


def slope(y: str, x: str) -> Column:
    """Ordinary least squares slope from sums."""
    n, sx, sy = F.count(y).cast("double"), F.sum(x), F.sum(y)
    return F.try_divide(n * F.sum(F.col(x) * F.col(y)) - sx * sy, n * F.sum(F.col(x) * F.col(x)) - sx * sx)
