"""As-of and brackets: plain loops, stretches of any number, and one series that holds nearly all rows."""

import bisect
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgrid.operators import temporal

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def tables(spark):
    rng = np.random.default_rng(6)
    at = lambda s: DAY + dt.timedelta(seconds=int(s))
    series = sorted({(k, int(rng.integers(0, 90_000)) if k < 3 else 500) for k in range(5) for _ in range(40) if k != 4})
    asked = [(i, int(rng.integers(0, 5)), int(rng.integers(-1000, 95_000))) for i in range(300)] + [(900, 0, series[3][1]), (901, 3, 500), (902, 3, 499)]
    right = spark.createDataFrame([(k, at(s), float(s * 2 + k)) for k, s in series], "k int, t timestamp, v double")
    left = spark.createDataFrame([(i, k, at(s)) for i, k, s in asked] + [(999, 1, None)], "i int, k int, t timestamp")
    return left, right, asked, {k: [s for q, s in series if q == k] for k in range(5)}


@pytest.mark.parametrize("stretches", [2, 7, 64])
def test_rows_around(tables, stretches):
    left, right, asked, series = tables
    got = {r.i: r for r in temporal.around(left, right, ["k"], "t", "t", "v", stretches).collect()}
    second = lambda x: x and round((x.t - DAY).total_seconds())
    assert len(got) == len(asked) + 1 and got[999]._before is None
    for i, k, s in asked:
        n = bisect.bisect_right(series[k], s)
        want = (series[k][n - 1] if n else None, series[k][n] if n < len(series[k]) else None, series[k][0] if series[k] else None)
        assert (second(got[i]._before), second(got[i]._after), second(got[i]._first)) == want


def test_asof_and_brackets(tables):
    left, right, asked, series = tables
    epoch = {r.i: r for r in temporal.asof(left, right.withColumnRenamed("t", "u"), ["k"], "t", "u", "v", back=True).collect()}
    line = {r.i: r.interpolated for r in temporal.bracket_interpolate(left, right, ["k"], "t", "v").collect()}
    for i, k, s in asked:
        n = bisect.bisect_right(series[k], s)
        if not series[k]:
            assert epoch[i].v is None and line[i] is None
            continue
        assert epoch[i].v == series[k][max(n - 1, 0)] * 2 + k and epoch[i].extrapolated == (n == 0)
        inside = series[k][0] <= s <= series[k][-1]
        assert line[i] == (pytest.approx(2 * s + k) if inside else None)


def test_one_long_series_goes_to_many_tasks(spark):
    """Nine rows of ten are of one key: no window's group holds more than a twentieth of all rows."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id")).alias("k"), (F.lit(DAY) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id") * F.col("id") / 1000)).alias("t"), F.col("id").cast("double").alias("v"))
    left = rows.select("k", (F.col("t") + F.expr("interval 1 second")).alias("t"))
    found = temporal.around(left, rows, ["k"], "t", "t", "v")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    micros = lambda c: F.unix_micros(F.col(c))
    cuts = rows.agg(F.percentile_approx(micros("t"), [k / temporal.STRETCHES for k in range(1, temporal.STRETCHES)], 1000)).first()[0]
    sizes = rows.groupBy("k", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= micros("t")))).count().agg(F.max("count")).first()[0]
    assert sizes < 0.05 * 40_000
    assert found.where("_before is null").count() == 0
