"""Data-quality contracts as rule tables, and comparison of products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def range_rules(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """(var, cells, below, above, nonfinite, ok) of long cells (var, value) against rules (var, lo, hi)."""
    v = F.col("value")
    bad = v.isNull() | F.isnan(v)
    j = cells.join(F.broadcast(rules), "var")
    g = j.groupBy("var").agg(F.count("*").alias("cells"), F.count_if(~bad & (v < F.col("lo"))).alias("below"), F.count_if(~bad & (v > F.col("hi"))).alias("above"), F.count_if(bad).alias("nonfinite"))
    return g.withColumn("ok", (F.col("below") + F.col("above") + F.col("nonfinite")) == 0)


def check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations, ok): one pass over the rows for all rules; a null test is a violation."""
    g = df.agg(*[F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return g.select(F.explode(pairs).alias("r")).select("r.*").withColumn("ok", F.col("violations") == 0)


@F.pandas_udf(LongType())
def bits(value: pd.Series) -> pd.Series:
    """The bit pattern of a double; Spark's own equality holds 0.0 and -0.0, and all NaN, to be equal."""
    return pd.Series(value.to_numpy(np.float64, na_value=np.nan).view(np.int64))


def numeric_compare(reference: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Differences of (var, keys..., value) by variable."""
    r = reference.select("var", *keys, F.col("value").alias("r"), F.lit(True).alias("in_r"))
    c = candidate.select("var", *keys, F.col("value").alias("c"), F.lit(True).alias("in_c"))
    j = r.join(c, ["var", *keys], "full")
    d = F.abs(F.col("c") - F.col("r"))
    e = F.col("c") - F.col("r")
    rms = lambda x: F.sqrt(F.avg(x * x))
    g = j.groupBy("var").agg(
        F.count_if(F.col("in_c").isNull()).alias("missing"),
        F.count_if(F.col("in_r").isNull()).alias("extra"),
        F.count_if(d > 0).alias("different"),
        F.count_if(F.col("r").isNull() != F.col("c").isNull()).alias("mask_different"),
        F.max(d).alias("max_abs"),
        F.max(d / F.greatest(F.abs("r"), F.lit(1e-30))).alias("max_rel"),
        rms(e).alias("rms"),
        rms(F.col("r")).alias("reference_rms"),
        F.min("r").alias("reference_min"),
        F.max("r").alias("reference_max"),
        F.count_if(F.col("c").cast("float") != F.col("r").cast("float")).alias("different_as_float"),
    )
    return g.withColumn("normalized_rms", F.try_divide("rms", "reference_rms"))


def exact_compare(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Bitwise and mask differences by variable."""
    j = left.select("var", *keys, bits("value").alias("lb"), F.col("value").alias("lv")).join(right.select("var", *keys, bits("value").alias("rb"), F.col("value").alias("rv")), ["var", *keys], "full")
    mask = F.col("lv").isNull() != F.col("rv").isNull()
    return j.groupBy("var").agg(F.count("*").alias("cells"), F.count_if(mask).alias("mask_different"), F.count_if(~mask & F.col("lv").isNotNull() & (F.col("lb") != F.col("rb"))).alias("bits_different"), F.max(F.abs(F.col("lv") - F.col("rv"))).alias("max_abs"))


def closure(df: DataFrame, key: str, fraction: str, tolerance: float = 1e-6) -> DataFrame:
    """Keys whose fractions leave [0, 1] or don't sum to 1."""
    g = df.groupBy(key).agg(F.sum(fraction).alias("total"), F.min(fraction).alias("lo"), F.max(fraction).alias("hi"))
    return g.withColumn("ok", (F.abs(F.col("total") - 1) <= tolerance) & (F.col("lo") >= 0) & (F.col("hi") <= 1))
