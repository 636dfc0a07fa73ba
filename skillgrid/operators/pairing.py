"""Pairing of observations with two forecasts, and what keeps coverage and keys honest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclusion_reason(obs: Column, candidate: Column, baseline: Column, calm: Column | None = None) -> Column:
    """The first reason that holds, in this order; null for an accepted triplet."""
    reason = F.when(obs.isNull(), "observation_missing").when(candidate.isNull() & baseline.isNull(), "both_models_missing").when(candidate.isNull(), "candidate_missing").when(baseline.isNull(), "baseline_missing")
    return reason.when(calm, "calm") if calm is not None else reason


def common_triplets(obs: DataFrame, candidate: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Full-outer pairing of three (keys, value) tables with a reason; keys in neither model are not counted."""
    o = obs.select(*keys, F.col("value").alias("obs"))
    c = candidate.select(*keys, F.col("value").alias("candidate"), F.lit(True).alias("in_candidate"))
    b = baseline.select(*keys, F.col("value").alias("baseline"), F.lit(True).alias("in_baseline"))
    rows = o.join(c, keys, "full").join(b, keys, "full").where("in_candidate or in_baseline").drop("in_candidate", "in_baseline")
    return rows.withColumn("reason", exclusion_reason(F.col("obs"), F.col("candidate"), F.col("baseline")))


def accounting(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates, accepted, excluded and a column for each reason."""
    reasons = ("observation_missing", "both_models_missing", "candidate_missing", "baseline_missing", "calm")
    return rows.groupBy(*keys).agg(F.count("*").alias("candidates"), F.count_if(F.col("reason").isNull()).alias("accepted"), F.count("reason").alias("excluded"), *[F.count_if(F.col("reason") == r).alias(r) for r in reasons])


def coverage(actual: DataFrame, keys: list[str], time: str, step: str, bounds: DataFrame) -> DataFrame:
    """Times of a regular grid that are missing, and actual times that it doesn't have. bounds: keys, begin, end."""
    grid = bounds.select(*keys, F.explode(F.sequence("begin", "end", F.expr(f"interval {step}"))).alias(time))
    have = actual.select(*keys, time).distinct()
    missing = grid.join(have, [*keys, time], "left_anti").withColumn("problem", F.lit("missing"))
    extra = have.join(grid, [*keys, time], "left_anti").withColumn("problem", F.lit("unexpected"))
    return missing.unionByName(extra)


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys, the one that is last in ``order``; ``replaced`` says that there were others."""
    w = Window.partitionBy(*keys)
    return df.withColumn("_r", F.row_number().over(w.orderBy(F.desc(order)))).withColumn("replaced", F.count("*").over(w) > 1).where("_r = 1").drop("_r")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def full_cohort(df: DataFrame, key: str, grain: str, expected: int) -> DataFrame:
    """Keys that have every one of ``expected`` grains."""
    return df.groupBy(key).agg(F.count_distinct(grain).alias("g")).where(F.col("g") == expected).select(key)


def bracketed_sum(hourly: DataFrame, keys: list[str], time: str, value: str, hours: int) -> DataFrame:
    """Sum over (t - hours, t]; null unless every hour is there."""
    w = Window.partitionBy(*keys).orderBy(F.unix_seconds(F.col(time).cast("timestamp"))).rangeBetween(-3600 * hours + 1, 0)
    return hourly.withColumn("total", F.when(F.count(value).over(w) == hours, F.sum(value).over(w)))
