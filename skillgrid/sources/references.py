"""Reference values at stations from native cells, and inventories of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.functions.physics import q_from_dewpoint
from skillgrid.operators.spatial import nearest_cell
from skillgrid.operators.temporal import cumulative_difference

#: Kilometres within which a station's cell must lie, and by how much (kg/m2) an accumulated sum may fall.
MOST_KM, SLACK = 2.0, 0.01


def station_reference(sites: DataFrame, cells: DataFrame, current: DataFrame, accumulated: DataFrame, times: DataFrame, most_km: float = MOST_KM) -> DataFrame:
    """(station, time, y, x, km, terrain, t, p, q, u, v, snow, precipitation, violation) of every station at every expected time, from the native cell next to it.

    sites: (station, lat, lon); cells: (y, x, lat, lon, terrain); current: (time, y, x, t, td, p, u, v, snow); accumulated: (time, y, x, total); times: (time), the expected ones. Humidity comes from the dew
    point, precipitation is the increase of the accumulated sum since the time before, 0 at the first. ``violation``: too_far, missing (a time without one of its fields) or decreasing. Fields are
    joined for the stations' cells only.
    """
    at = nearest_cell(sites, cells, ["station"]).join(cells.select("y", "x", "terrain"), ["y", "x"], "left")
    expected = at.crossJoin(F.broadcast(times.select("time").distinct()))  # the hours of a period
    rows = expected.join(current, ["time", "y", "x"], "left").join(accumulated, ["time", "y", "x"], "left")
    rows = cumulative_difference(rows, ["station"], "time", "total", SLACK)
    lacks = F.greatest(*[F.col(c).isNull() for c in ("t", "td", "p", "u", "v", "snow", "total")])
    wrong = F.when(F.col("km").isNull() | (F.col("km") > most_km), "too_far").when(lacks, "missing").when(F.col("violation"), "decreasing")
    return rows.select("station", "time", "y", "x", "km", "terrain", "t", "p", q_from_dewpoint(F.col("td"), F.col("p")).alias("q"), "u", "v", "snow", F.when(F.col("total").isNotNull(), F.col("increase")).alias("precipitation"), wrong.alias("violation"))


def message_violations(messages: DataFrame, spec: DataFrame, valid: str) -> DataFrame:
    """``messages`` with the first thing that is wrong with each, null if nothing is: unexpected, units, level_type, step_type, valid_time, step, grid, or mixed (another reference time, step or grid than most
    messages of the inventory have).

    messages: (name, param, level, units, level_type, step_type, reference, valid, step, grid); spec: (name, param, units, level_type, levels), small.
    """
    known = spec.select("name", "param", F.col("units").alias("_units"), F.col("level_type").alias("_type"), "levels")
    common = messages.groupBy("reference", "step", "grid").count().agg(F.max_by(F.struct("reference", "step", "grid"), F.struct("count", F.struct("reference", "step", "grid"))).alias("_common"))  # one row
    j = messages.join(F.broadcast(known), ["name", "param"], "left").crossJoin(F.broadcast(common))
    plain = lambda c: F.regexp_replace(F.lower(c), r"[\^\s*/]", "")
    hours = (F.unix_seconds(F.col("valid").cast("timestamp")) - F.unix_seconds(F.col("reference").cast("timestamp"))) / 3600
    tests = {
        "unexpected": F.col("levels").isNull(), "units": ~plain(F.col("units")).eqNullSafe(plain(F.col("_units"))), "level_type": ~F.col("level_type").eqNullSafe(F.col("_type")), "step_type": ~F.lower("step_type").eqNullSafe(F.lit("instant")),
        "valid_time": ~F.col("valid").cast("timestamp").eqNullSafe(F.lit(valid).cast("timestamp")), "step": ~hours.eqNullSafe(F.col("step").cast("double")), "grid": F.coalesce(F.col("grid"), F.lit("")) == "",
        "mixed": ~F.struct("reference", "step", "grid").eqNullSafe(F.col("_common")),
    }
    return j.withColumn("violation", F.coalesce(*[F.when(t, n) for n, t in tests.items()])).drop("_units", "_type", "levels", "_common")


def inventory(messages: DataFrame, spec: DataFrame, valid: str) -> DataFrame:
    """(name, level, messages, state, violations) of every level that is expected or there: one, missing, duplicate or extra; single-level fields have level 0. ``violations``: of its messages, how many have one."""
    wanted = spec.select("name", F.explode(F.when(F.col("levels") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.col("levels")))).alias("level"), F.lit(True).alias("wanted"))
    checked = message_violations(messages, spec, valid).join(F.broadcast(spec.select("name", F.col("levels").alias("_n"))), "name", "left")
    found = checked.groupBy("name", F.when(F.col("_n") == 1, 0).otherwise(F.col("level")).cast("int").alias("level")).agg(F.count("*").alias("messages"), F.count("violation").alias("violations"))
    j = wanted.join(found, ["name", "level"], "full")
    state = F.when(F.col("wanted").isNull(), "extra").when(F.col("messages").isNull(), "missing").when(F.col("messages") > 1, "duplicate").otherwise("one")
    return j.select("name", "level", F.coalesce("messages", F.lit(0)).alias("messages"), state.alias("state"), F.coalesce("violations", F.lit(0)).alias("violations"))
