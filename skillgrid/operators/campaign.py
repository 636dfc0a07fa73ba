"""Campaign post-processing: station-season rows, network scores, cohorts and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillgrid.functions import stats
from skillgrid.operators.strata import elevation_class, terrain_class
from skillgrid.session import shuffled

TIE = 1e-12


def station_rows(triplets: DataFrame, keys: list[str]) -> DataFrame:
    """Both sources' statistics side by side from one aggregation, with delta and outcome."""
    both = triplets.select(*keys, F.explode(F.array(F.struct(F.lit("c").alias("source"), F.col("candidate").alias("m"), "obs"), F.struct(F.lit("b").alias("source"), F.col("baseline").alias("m"), "obs"))).alias("x")).select(*keys, "x.*")
    s = stats.pair_stats(both, [*keys, "source"], "m", "obs")
    wide = s.groupBy(*keys).agg(
        *[F.max(F.when(F.col("source") == k, F.col("pair_count"))).alias(f"{n}_count") for k, n in (("c", "candidate"), ("b", "baseline"))],
        *[F.max(F.when(F.col("source") == k, F.col(v))).alias(f"{n}_{v}") for k, n in (("c", "candidate"), ("b", "baseline")) for v in stats.STATS],
    )
    delta = F.col("candidate_rmse") - F.col("baseline_rmse")
    wide = wide.withColumns({"pair_count": F.col("candidate_count"), "delta": delta, "outcome": F.when(delta < -TIE, "improved").when(delta > TIE, "degraded").otherwise("tied")})
    usable = (F.col("pair_count") >= 20) & (F.col("candidate_obs_sd") > 0) & (F.abs(F.col("candidate_obs_sd") - F.col("baseline_obs_sd")) < 1e-9)
    return wide.withColumns({"sd_ratio": F.when(usable, F.try_divide("candidate_model_sd", "candidate_obs_sd")), "correlation": F.when(usable, F.col("candidate_corr"))})


def exclusions(rows: DataFrame, least: int = 20) -> DataFrame:
    """Reason for leaving a station row out, null if it counts."""
    return rows.withColumn("reason", F.when(F.col("candidate_count") != F.col("baseline_count"), "unequal_counts").when(F.col("pair_count") < least, "too_few_pairs"))


def diagnosis(rows: DataFrame, sites: DataFrame, key: str, worst: int, ridge: float = 150.0, high: float = 2000.0) -> DataFrame:
    """(key, reasons, excluded) of sites (key, z, rel) on a ridge, high up, or among the ``worst`` by delta of rows (key, delta, reason). Rows with a reason to be left out aren't ranked; their reason stays beside the site's."""
    top = rows.where("reason is null").orderBy(F.desc("delta"), key).limit(worst).select(key, F.lit(True).alias("worst"))  # a few rows
    left_out = rows.where("reason is not null").select(key, F.col("reason").alias("excluded"))
    why = F.array_compact(F.array(F.when(F.col("rel") > ridge, "ridge"), F.when(F.col("z") >= high, "high"), F.when(F.col("worst"), "worst")))
    return sites.join(F.broadcast(top), key, "left").join(left_out, key, "left").select(key, F.concat_ws(",", why).alias("reasons"), "excluded").where("reasons != ''")


def equal_station_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Network scores of a group: each station equally, and pooled by pairs."""
    c, b, n = F.col("candidate_rmse"), F.col("baseline_rmse"), F.col("pair_count")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("stations"),
        F.sum(n).alias("pairs"),
        F.avg(c).alias("candidate_mean_rmse"),
        F.avg(b).alias("baseline_mean_rmse"),
        F.sqrt(F.avg(c * c)).alias("candidate_equal_rmse"),
        F.sqrt(F.avg(b * b)).alias("baseline_equal_rmse"),
        F.sqrt(F.sum(n * c * c) / F.sum(n)).alias("candidate_pooled_rmse"),
        F.sqrt(F.sum(n * b * b) / F.sum(n)).alias("baseline_pooled_rmse"),
        F.median("delta").alias("median_delta"),
        F.count_if(F.col("outcome") == "improved").alias("improved"),
        F.count_if(F.col("outcome") == "degraded").alias("degraded"),
        F.count_if(F.col("outcome") == "tied").alias("tied"),
        F.when(F.count("sd_ratio") >= 10, F.percentile("sd_ratio", F.array(F.lit(0.25), F.lit(0.75)))).alias("q"),
    ).withColumns({"sd_ratio_q1": F.col("q")[0], "sd_ratio_q3": F.col("q")[1]}).drop("q")


def cohort(rows: DataFrame, sets: int, pairs: int) -> DataFrame:
    """Stations that have ``pairs`` pairs or more in every one of ``sets`` (season, metric) sets."""
    return rows.groupBy("station").agg(F.count_if(F.col("pair_count") >= pairs).alias("n")).where(F.col("n") == sets).select("station")


def worst(rows: DataFrame, keys: list[str], top: int, order: str = "delta") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order), "station")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def subsets(rows: DataFrame, four_season: DataFrame, fixed: DataFrame) -> DataFrame:
    """A row for each of the subsets national, four_season and fixed that a station row belongs to."""
    marked = rows.join(four_season.select("station", "metric", F.lit(True).alias("_four")), ["station", "metric"], "left").join(fixed.select("station", F.lit(True).alias("_fixed")), "station", "left")
    names = F.array_compact(F.array(F.lit("national"), F.when(F.col("_four"), "four_season"), F.when(F.col("_fixed"), "fixed")))
    return marked.withColumn("subset", F.explode(names)).drop("_four", "_fixed")


def leave_one_out(rows: DataFrame, group: str, value: str, keys: list[str], most: int = 100) -> DataFrame:
    """Median of ``value`` without each group in turn: every row is copied to the other groups, of which there may be ``most``."""
    groups = rows.select(group).distinct().agg(F.collect_list(group).alias("_groups"), F.count("*").alias("_n"))  # one row
    few = groups.select(F.when(F.col("_n") <= most, F.col("_groups")).otherwise(F.raise_error(F.lit(f"over {most} groups")).cast(f"array<{rows.schema[group].dataType.simpleString()}>")).alias("_groups"))
    others = F.filter("_groups", lambda g: g != F.col(group))
    return rows.crossJoin(F.broadcast(few)).withColumn("omitted", F.explode(others)).groupBy("omitted", *keys).agg(F.median(value).alias("median"))


def decision(summaries: DataFrame) -> DataFrame:
    """One row for the campaign from event rows (season, metric, class)."""
    wide = summaries.groupBy("season").agg(F.max(F.when(F.col("metric") == "vector", F.col("class"))).alias("vector"), F.max(F.when(F.col("metric") == "speed", F.col("class"))).alias("speed"))
    wide = wide.withColumn("event_class", stats.joint_class(F.col("vector"), F.col("speed")))
    good, bad = F.col("event_class").isin("strong", "qualified"), F.col("event_class").isin("degraded", "mixed")
    counts = wide.agg(F.count("*").alias("events"), F.count_if(good).alias("good"), F.count_if(bad).alias("bad"))
    return counts.withColumn("campaign_class", F.when((F.col("good") >= 3) & (F.col("bad") == 0), "improved").when(F.col("bad") >= 2, "degraded").otherwise("inconclusive"))


def with_bands(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Station rows with elevation and terrain class of their site (station, z, rel)."""
    s = sites.select("station", elevation_class(F.col("z")).alias("elevation_class"), terrain_class(F.col("rel")).alias("terrain_class"), "z", "rel")
    return rows.join(s, "station")


def sensitivity(rows: DataFrame, keys: list[str], base: str, other: str, baseline: str) -> DataFrame:
    """Equal-station RMSE of a run and of another of the same stations, their difference and its class, medians and counts of stations, and the class against the baseline."""
    equal = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    change = F.col(other) - F.col(base)
    g = rows.groupBy(*keys).agg(F.count("*").alias("stations"), equal(base).alias("base"), equal(other).alias("sensitivity"), equal(baseline).alias("_b"), F.median(change).alias("median_delta"), F.count_if(change < 0).alias("improved"), F.count_if(change > 0).alias("degraded"))
    delta = F.col("sensitivity") - F.col("base")
    return g.select(*keys, "stations", "base", "sensitivity", delta.alias("delta"), stats.material_change(delta, F.col("base"), 0.0).alias("class"), stats.material_change(F.col("sensitivity") - F.col("_b"), F.col("_b"), 0.0).alias("class_to_baseline"), "median_delta", "improved", "degraded")


def three_way(rows: DataFrame, keys: list[str], names: tuple[str, str, str]) -> DataFrame:
    """Differences of equal-station RMSE between each pair of three sources (columns ``<name>_rmse``), their classes and the medians over stations."""
    pairs = [(names[0], names[1]), (names[1], names[2]), (names[0], names[2])]
    col = lambda n: F.col(f"{n}_rmse")
    g = rows.groupBy(*keys).agg(*[F.sqrt(F.avg(col(n) * col(n))).alias(f"_{n}") for n in names], *[F.median(col(a) - col(b)).alias(f"median_{a}_{b}") for a, b in pairs])
    delta = lambda a, b: F.col(f"_{a}") - F.col(f"_{b}")
    return g.select(*keys, *[delta(a, b).alias(f"{a}_vs_{b}") for a, b in pairs], *[stats.material_change(delta(a, b), F.col(f"_{b}"), 0.0).alias(f"{a}_{b}_class") for a, b in pairs], *[f"median_{a}_{b}" for a, b in pairs])


def footprint_errors(rows: DataFrame, site: str) -> tuple[DataFrame, DataFrame]:
    """Errors of a site's cells over time, and how they spread at each time, from rows (site, t, y, x, u, v, obs_u, obs_v, nearest).

    The first table has a row a site: vector RMSE of the nearest cell, of the mean vector of all cells, and median, tenth and ninetieth percentile of the RMSE of
    single cells that are there at every time of the site, with the best of them. The second has a row for each site and time: count, mean, median, p90 and largest error.
    """
    e2 = lambda u, v: (F.col(u) - F.col("obs_u")) * (F.col(u) - F.col("obs_u")) + (F.col(v) - F.col("obs_v")) * (F.col(v) - F.col("obs_v"))
    # one shuffle, by site: all that follows is within sites
    r = rows.withColumn("_e2", e2("u", "v")).repartition(site)
    own = F.when(F.col("nearest"), F.col("_e2"))
    at = r.groupBy(site, "t").agg(F.avg("u").alias("u"), F.avg("v").alias("v"), F.first("obs_u").alias("obs_u"), F.first("obs_v").alias("obs_v"), F.count("*").alias("cells"), F.avg(F.sqrt("_e2")).alias("mean"), F.percentile(F.sqrt("_e2"), F.array(F.lit(0.5), F.lit(0.9))).alias("q"), F.max(F.sqrt("_e2")).alias("largest"), F.sum(own).alias("_s"), F.count(own).alias("_n"))
    whole = at.groupBy(site).agg(F.sqrt(F.avg(e2("u", "v"))).alias("mean_vector_rmse"), F.count("*").alias("times"), F.sqrt(F.try_divide(F.sum("_s"), F.sum("_n"))).alias("nearest_rmse"))
    cell = r.groupBy(site, "y", "x").agg(F.sqrt(F.avg("_e2")).alias("rmse"), F.count("*").alias("n")).join(shuffled(whole.select(site, "times")), site).where("n - times = 0")  # as an equality of two columns it would be a key to shuffle by
    fixed = cell.groupBy(site).agg(F.count("*").alias("cells"), F.percentile("rmse", F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9))).alias("q"), F.min_by(F.struct("y", "x", "rmse"), F.struct("rmse", "y", "x")).alias("best"))
    out = whole.join(shuffled(fixed), site, "left")
    sites = out.select(site, "times", "nearest_rmse", "mean_vector_rmse", "cells", F.col("q")[0].alias("median"), F.col("q")[1].alias("p10"), F.col("q")[2].alias("p90"), F.col("best.y").alias("best_y"), F.col("best.x").alias("best_x"), F.col("best.rmse").alias("best_rmse"))
    return sites, at.select(site, "t", "cells", "mean", F.col("q")[0].alias("median"), F.col("q")[1].alias("p90"), "largest")


def wind_maxima(cells: DataFrame, most: float, levels: tuple = (10, 50)) -> DataFrame:
    """(height, strongest, y, x, over, bounded): of winds (y, x, t, height, u, v) the strongest at each height, its first cell by time, row and column, and how many are over ``most``.

    Other heights than ``levels``, or one of them missing, are an error.
    """
    found = sorted(r[0] for r in cells.select("height").distinct().collect())  # as many as there are levels
    if found != sorted(levels):
        raise ValueError(f"winds at heights {found}, not {sorted(levels)}")
    speed = F.hypot("u", "v")
    first = F.max_by(F.struct("y", "x"), F.struct(F.round(speed, 9), -F.col("t"), -F.col("y"), -F.col("x")))
    return cells.groupBy("height").agg(F.max(speed).alias("strongest"), first.alias("_c"), F.count_if(speed > most).alias("over")).select("height", "strongest", "_c.y", "_c.x", "over", (F.col("strongest") <= most).alias("bounded"))
