"""Time semantics: ending hours, trapezoids, as-of and cyclic months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillgrid.functions.physics import wind_uv


def ending_hour(ts: Column) -> Column:
    """The hour that a sample of (hour - 1h, hour] belongs to."""
    return F.date_trunc("hour", ts.cast("timestamp") - F.expr("interval 1 microsecond")) + F.expr("interval 1 hour")


def trapezoid(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Mean of the previous hour's end and this one's; null where the previous hour is missing."""
    w = Window.partitionBy(*keys).orderBy(time)
    gap = F.unix_seconds(F.col(time).cast("timestamp")) - F.unix_seconds(F.lag(time).over(w).cast("timestamp"))
    return df.withColumn("hourly", F.when(gap == 3600, (F.col(value) + F.lag(value).over(w)) / 2))


def trapezoid_wind(df: DataFrame, keys: list[str], time: str, speed: str, u: str, v: str) -> DataFrame:
    """Hourly speed, u and v: the mean of the previous hour's end and this one's; the mean vector is brought to the mean speed, and is 0 where it is no vector. Nulls where the previous hour is missing."""
    w = Window.partitionBy(*keys).orderBy(time)
    follows = F.unix_seconds(F.col(time).cast("timestamp")) - F.unix_seconds(F.lag(time).over(w).cast("timestamp")) == 3600
    half = lambda c: F.when(follows, (F.col(c) + F.lag(c).over(w)) / 2)
    return rescaled(df.select("*", half(speed).alias("hourly_speed"), half(u).alias("_u"), half(v).alias("_v")), "hourly_speed", "_u", "_v", "hourly_u", "hourly_v").drop("_u", "_v")


def rescaled(df: DataFrame, speed: str, u: str, v: str, u_name: str, v_name: str) -> DataFrame:
    """A mean vector in its own direction with the length ``speed``; 0 where the mean vector is 0."""
    length = F.sqrt(F.col(u) * F.col(u) + F.col(v) * F.col(v))
    factor = F.when(length > 0, F.col(speed) / length).when(length == 0, 0.0)
    return df.withColumns({u_name: F.col(u) * factor, v_name: F.col(v) * factor})


def ending_hour_wind(df: DataFrame, keys: list[str], time: str, speed: str, direction: str, samples: int = 6) -> DataFrame:
    """(keys, hour, samples, speed, u, v) from the means of the ten-minute samples in (hour - 1h, hour]; nulls unless all ``samples`` are there.

    Several values within one sample's ten minutes are averaged first.
    """
    u, v = wind_uv(F.col(speed), F.col(direction))
    slot = F.timestamp_seconds(F.ceil(F.unix_micros(F.col(time).cast("timestamp")) / 600000000) * 600)
    tens = df.groupBy(*keys, slot.alias("_slot")).agg(F.avg(speed).alias("_s"), F.avg(u).alias("_u"), F.avg(v).alias("_v"))
    g = tens.groupBy(*keys, ending_hour(F.col("_slot")).alias("hour")).agg(F.count("*").alias("samples"), *[F.avg(c).alias(c) for c in ("_s", "_u", "_v")])
    full = F.col("samples") == samples
    g = g.select(*keys, "hour", "samples", F.when(full, F.col("_s")).alias("speed"), "_u", "_v")
    return rescaled(g, "speed", "_u", "_v", "u", "v").drop("_u", "_v")


def cumulative_difference(df: DataFrame, keys: list[str], time: str, value: str, tolerance: float = 0.01) -> DataFrame:
    """Increase since the previous time, at least 0; the first is 0; ``violation`` where it falls by more than ``tolerance``."""
    d = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(time))
    return df.withColumn("increase", F.coalesce(F.greatest(d, F.lit(0.0)), F.lit(0.0))).withColumn("violation", F.coalesce(d < -tolerance, F.lit(False)))


def lead_hour(valid: Column, start: Column) -> Column:
    """Whole hours since the start; null if not whole or negative."""
    s = F.unix_seconds(valid.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))
    return F.when((s >= 0) & (s % 3600 == 0), F.floor(s / 3600))


#: Stretches of time that a series is cut into.
STRETCHES = 64


def around(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str, stretches: int = STRETCHES) -> DataFrame:
    """``left`` with ``_before`` and ``_after``: structs (t, v) of the last row of ``right`` at or before its time and of the first after it, and ``_first``, the series' first; null where there is none.

    Time is cut into ``stretches`` with about as many rows each, and windows run within one key and stretch, so one long series goes to many tasks. What a stretch
    needs of those before and after it, the last and the first row there, comes from a scan over stretches, of which a key has ``stretches`` at most, and is put in as two rows of its own.
    """
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    kind = f"struct<t:{right.schema[right_time].dataType.simpleString()},v:{right.schema[value].dataType.simpleString()}>"
    times = left.select(at(left_time).alias("t")).unionAll(right.select(at(right_time).alias("t")))
    cuts = sorted(set(times.agg(F.percentile_approx("t", [k / stretches for k in range(1, stretches)], 1000)).first()[0] or []))
    stretch = lambda c: F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= c)) if cuts else F.lit(0)
    a = left.withColumns({"_t": at(left_time), "_s": F.lit(1)}).withColumn("_k", F.when(F.col("_t").isNotNull(), stretch(F.col("_t"))))
    b = right.select(*keys, at(right_time).alias("_t"), F.lit(0).alias("_s"), F.struct(F.col(right_time).alias("t"), F.col(value).alias("v")).alias("_x")).where("_t is not null").withColumn("_k", stretch(F.col("_t")))
    ends = b.groupBy(*keys, "_k").agg(F.min_by("_x", "_t").alias("_lo"), F.max_by("_x", "_t").alias("_hi"))
    asked = a.select(*keys, "_k").distinct().withColumns({"_lo": F.lit(None).cast(kind), "_hi": F.lit(None).cast(kind)})
    places = ends.unionByName(asked).groupBy(*keys, "_k").agg(F.first("_lo", ignorenulls=True).alias("_lo"), F.first("_hi", ignorenulls=True).alias("_hi"))
    w = Window.partitionBy(*keys).orderBy("_k")
    ever = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = places.select(*keys, "_k", F.last("_hi", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_p"), F.first("_lo", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("_n"), F.first("_lo", ignorenulls=True).over(ever).alias("_w"))
    ends_of_time = F.array(F.struct(F.lit(-(1 << 63)).alias("_t"), F.col("_p").alias("_x"), F.col("_w").alias("_w")), F.struct(F.lit((1 << 63) - 1).alias("_t"), F.col("_n").alias("_x"), F.lit(None).cast(kind).alias("_w")))
    carried = carried.select(*keys, "_k", F.explode(ends_of_time).alias("_e")).select(*keys, "_k", "_e.*", F.lit(0).alias("_s"))
    both = a.unionByName(b, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    part = Window.partitionBy(*keys, "_k").orderBy("_t", "_s")
    out = both.withColumns({"_before": F.last("_x", ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, 0)), "_after": F.first("_x", ignorenulls=True).over(part.rowsBetween(1, Window.unboundedFollowing)), "_first": F.first("_w", ignorenulls=True).over(part.rowsBetween(Window.unboundedPreceding, 0))})
    return out.where("_s = 1").select(*left.columns, "_before", "_after", "_first")


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str, back: bool = False) -> DataFrame:
    """The last ``value`` with right_time <= left_time, without a range join: see ``around``.

    Before the first there is none, or, with ``back``, the first one's; ``extrapolated`` says so. Without any there is null.
    """
    found = around(left, right, keys, left_time, right_time, value)
    x = F.coalesce("_before", "_first") if back else F.col("_before")
    out = found.withColumn("_x", x).withColumns({value: F.col("_x.v"), "valid_from": F.col("_x.t")})
    return out.withColumn("extrapolated", F.coalesce(F.col("valid_from") > F.col(left_time), F.lit(False))).drop("_x", "_before", "_after", "_first")


def bracket_interpolate(left: DataFrame, series: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Linear interpolation of ``series`` at the times of ``left``; null outside. The series' rows next to each time come from ``around``."""
    found = around(left, series, keys, time, time, value)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    (t0, v0), (t1, v1) = ((F.col(f"{side}.t"), F.col(f"{side}.v")) for side in ("_before", "_after"))
    part = (seconds(F.col(time)) - seconds(t0)) / (seconds(t1) - seconds(t0))
    out = F.when(t0 == F.col(time), v0).otherwise(v0 + part * (v1 - v0))
    return found.withColumn("interpolated", out).drop("_before", "_after", "_first")


def month_anchor(valid: Column) -> Column:
    """The last 15th at or before a time; months wrap over the year."""
    this = F.make_date(F.year(valid), F.month(valid), F.lit(15))
    return F.when(F.to_date(valid) >= this, this).otherwise(F.add_months(this, -1))


def month_part(valid: Column) -> Column:
    """How far a time is from its month anchor to the next, from 0 to 1."""
    a = month_anchor(valid)
    days = F.datediff(F.add_months(a, 1), a)
    return (F.unix_seconds(valid.cast("timestamp")) - F.unix_seconds(a.cast("timestamp"))) / (86400.0 * days)
