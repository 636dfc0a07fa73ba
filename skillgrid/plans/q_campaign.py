"""Queries of the campaign family."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skillgrid.functions import stats
from skillgrid.operators import campaign, pairing, strata
from skillgrid.plans import bindings as B
from skillgrid.plans.q_stats import PAIR_SQL, STRATA_SQL, site_strata
from skillgrid.plans.registry import query, r6, rounded, sql6
from skillgrid.session import materialize

#: Station-season rows in SQL.
ROWS = f"""{B.TRIPLETS}, rows_ AS (SELECT station, season, metric, 'c' AS source, candidate AS m, obs AS o FROM accepted UNION ALL SELECT station, season, metric, 'b', baseline, obs FROM accepted),
{PAIR_SQL.format(k="station, season, metric, source")},
sr AS (SELECT c.station, c.season, c.metric, c.pair_count, c.rmse AS candidate_rmse, b.rmse AS baseline_rmse, c.mae AS candidate_mae, b.mae AS baseline_mae, c.centered_rmse AS candidate_centered_rmse, b.centered_rmse AS baseline_centered_rmse, c.bias AS candidate_bias, b.bias AS baseline_bias, c.rmse-b.rmse AS delta,
 CASE WHEN c.rmse-b.rmse < -1e-12 THEN 'improved' WHEN c.rmse-b.rmse > 1e-12 THEN 'degraded' ELSE 'tied' END AS outcome,
 CASE WHEN c.pair_count>=20 AND c.obs_sd>0 THEN c.model_sd/c.obs_sd END AS sd_ratio, CASE WHEN c.pair_count>=20 AND c.obs_sd>0 THEN c.corr END AS correlation
 FROM st c JOIN st b USING (station, season, metric) WHERE c.source='c' AND b.source='b')"""
KEYS = ["station", "season", "metric"]


def station_rows(spark, d):
    return campaign.station_rows(B.accepted(spark, d), KEYS)


def written_rows(spark, d):
    """The same as a table, for queries that read them more than once."""
    return materialize(station_rows(spark, d), "station-rows")


@query("compare_row", f"WITH {ROWS} SELECT station, season, metric, pair_count, {sql6('candidate_rmse', 'baseline_rmse', 'candidate_mae', 'baseline_mae', 'candidate_centered_rmse', 'baseline_centered_rmse', 'candidate_bias', 'baseline_bias', 'delta', 'sd_ratio', 'correlation')}, outcome FROM sr")
def compare_row(spark, d):
    cols = "station season metric pair_count candidate_rmse baseline_rmse candidate_mae baseline_mae candidate_centered_rmse baseline_centered_rmse candidate_bias baseline_bias delta sd_ratio correlation outcome".split()
    return rounded(station_rows(spark, d).select(*cols))


SUMMARY = "count(*) AS stations, sum(pair_count)::BIGINT AS pairs, avg(candidate_rmse) AS candidate_mean_rmse, avg(baseline_rmse) AS baseline_mean_rmse, sqrt(avg(candidate_rmse*candidate_rmse)) AS candidate_equal_rmse, sqrt(avg(baseline_rmse*baseline_rmse)) AS baseline_equal_rmse, sqrt(sum(pair_count*candidate_rmse*candidate_rmse)/sum(pair_count)) AS candidate_pooled_rmse, sqrt(sum(pair_count*baseline_rmse*baseline_rmse)/sum(pair_count)) AS baseline_pooled_rmse, median(delta) AS median_delta, count(*) FILTER (outcome='improved') AS improved, count(*) FILTER (outcome='degraded') AS degraded, count(*) FILTER (outcome='tied') AS tied, CASE WHEN count(sd_ratio)>=10 THEN quantile_cont(sd_ratio,0.25) END AS sd_ratio_q1, CASE WHEN count(sd_ratio)>=10 THEN quantile_cont(sd_ratio,0.75) END AS sd_ratio_q3"
S6 = "stations, pairs, " + sql6("candidate_mean_rmse", "baseline_mean_rmse", "candidate_equal_rmse", "baseline_equal_rmse", "candidate_pooled_rmse", "baseline_pooled_rmse", "median_delta") + ", improved, degraded, tied, " + sql6("sd_ratio_q1", "sd_ratio_q3")


@query("equal_station_summary", f"WITH {ROWS}, {STRATA_SQL}, g AS (SELECT season, stratum, metric, {SUMMARY} FROM sr JOIN strata_ USING (station) GROUP BY ALL) SELECT season, stratum, metric, {S6} FROM g")
def equal_station_summary(spark, d):
    rows = station_rows(spark, d).join(site_strata(spark, d).select("station", "stratum"), "station")
    return rounded(campaign.equal_station_summary(rows, ["season", "stratum", "metric"]))


FOUR = "four AS (SELECT metric, station FROM sr GROUP BY 1,2 HAVING count(DISTINCT season)=4), fixed_ AS (SELECT station FROM sr GROUP BY 1 HAVING count(*) FILTER (pair_count>=20)=8)"


@query("multi_subset_union", f"WITH {ROWS}, {FOUR}, u AS (SELECT 'national' AS subset, * FROM sr UNION ALL SELECT 'four_season', * FROM sr WHERE (metric, station) IN (SELECT metric, station FROM four) UNION ALL SELECT 'fixed', * FROM sr WHERE station IN (SELECT station FROM fixed_)) SELECT subset, season, metric, count(*) AS stations, {sql6('e')} FROM (SELECT subset, season, metric, station, sqrt(avg(candidate_rmse*candidate_rmse) OVER (PARTITION BY subset, season, metric)) AS e FROM u) GROUP BY subset, season, metric, e")
def multi_subset_union(spark, d):
    rows = written_rows(spark, d)
    four = rows.groupBy("metric", "station").agg(F.count_distinct("season").alias("s")).where("s = 4").drop("s")
    sub = campaign.subsets(rows, four, campaign.cohort(rows, 8, 20))
    return rounded(sub.groupBy("subset", "season", "metric").agg(F.count("*").alias("stations"), F.sqrt(F.avg(F.col("candidate_rmse") ** 2)).alias("e")))


@query("lead_table", f"WITH {B.TRIPLETS} SELECT season, lead, lead-1 AS relative_lead, metric, count(*) AS pairs, round(sqrt(avg((candidate-obs)*(candidate-obs))),6)+0.0 AS candidate_rmse, round(sqrt(avg((baseline-obs)*(baseline-obs))),6)+0.0 AS baseline_rmse FROM accepted GROUP BY ALL")
def lead_table(spark, d):
    e = lambda m: F.sqrt(F.avg((F.col(m) - F.col("obs")) * (F.col(m) - F.col("obs"))))
    t = B.accepted(spark, d).groupBy("season", "lead", "metric").agg(F.count("*").alias("pairs"), e("candidate").alias("candidate_rmse"), e("baseline").alias("baseline_rmse"))
    return rounded(t.withColumn("relative_lead", F.col("lead") - 1))


@query("count_reconcile", f"WITH {B.TRIPLETS}, a AS (SELECT metric, count(*) AS candidates, count(*) FILTER (obs IS NOT NULL AND candidate IS NOT NULL AND baseline IS NOT NULL) AS accepted FROM triplets GROUP BY metric), s AS (SELECT metric, sum(n)::BIGINT AS station_total FROM (SELECT metric, station, count(*) AS n FROM accepted GROUP BY 1,2) GROUP BY 1) SELECT a.metric, candidates, accepted, station_total, accepted = station_total AS agrees FROM a JOIN s USING (metric)")
def count_reconcile(spark, d):
    t = B.triplets(spark, d).withColumn("reason", pairing.exclusion_reason(F.col("obs"), F.col("candidate"), F.col("baseline")))
    a = pairing.accounting(t, ["metric"]).select("metric", "candidates", "accepted")
    s = t.where("reason is null").groupBy("metric", "station").count().groupBy("metric").agg(F.sum("count").alias("station_total"))
    return a.join(s, "metric").withColumn("agrees", F.col("accepted") == F.col("station_total"))


@query("shortwave_diag", f"WITH {B.TRIPLETS} SELECT season, count(*) AS pairs, round(avg(candidate-obs),6)+0.0 AS bias, round(sqrt(avg((candidate-obs)*(candidate-obs))),6)+0.0 AS rmse, count(*) FILTER (candidate < 0) AS negative FROM accepted WHERE metric='speed' AND obs > 20 GROUP BY season")
def shortwave_diag(spark, d):
    e = F.col("candidate") - F.col("obs")
    return rounded(B.accepted(spark, d).where("metric = 'speed' and obs > 20").groupBy("season").agg(F.count("*").alias("pairs"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count_if(F.col("candidate") < 0).alias("negative")))


def _mc(delta: str, base: str) -> str:
    return f"CASE WHEN {delta} < -greatest(0.10, 0.05*{base})-1e-12 THEN 'improvement' WHEN {delta} > greatest(0.10, 0.05*{base})+1e-12 THEN 'degradation' ELSE 'neutral' END"


@query("material_change", f"WITH {ROWS} SELECT station, season, metric, {_mc('delta', 'baseline_rmse')} AS class FROM sr")
def material_change(spark, d):
    return station_rows(spark, d).select(*KEYS, stats.material_change(F.col("delta"), F.col("baseline_rmse")).alias("class"))


JOINT = "CASE WHEN vector='improvement' AND speed='improvement' THEN 'strong' WHEN (vector='degradation' AND speed='improvement') OR (vector='improvement' AND speed='degradation') THEN 'mixed' WHEN vector='degradation' OR speed='degradation' THEN 'degraded' WHEN vector='improvement' OR speed='improvement' THEN 'qualified' ELSE 'neutral' END"
EVENTS_SQL = f"ev AS (SELECT season, metric, {_mc('sqrt(avg(candidate_rmse*candidate_rmse))-sqrt(avg(baseline_rmse*baseline_rmse))', 'sqrt(avg(baseline_rmse*baseline_rmse))')} AS class FROM sr WHERE station IN (SELECT station FROM fixed_) GROUP BY 1,2), jo AS (SELECT season, max(class) FILTER (metric='vector') AS vector, max(class) FILTER (metric='speed') AS speed FROM ev GROUP BY 1), jc AS (SELECT *, {JOINT} AS event_class FROM jo)"


def event_rows(spark, d, rows=None):
    rows = written_rows(spark, d) if rows is None else rows
    fixed = rows.join(campaign.cohort(rows, 8, 20), "station", "left_semi")
    s = campaign.equal_station_summary(fixed, ["season", "metric"])
    return s.withColumn("class", stats.material_change(F.col("candidate_equal_rmse") - F.col("baseline_equal_rmse"), F.col("baseline_equal_rmse")))


@query("joint_event_class", f"WITH {ROWS}, {FOUR}, {EVENTS_SQL} SELECT season, vector, speed, event_class FROM jc")
def joint_event_class(spark, d):
    wide = event_rows(spark, d).groupBy("season").agg(F.max(F.when(F.col("metric") == "vector", F.col("class"))).alias("vector"), F.max(F.when(F.col("metric") == "speed", F.col("class"))).alias("speed"))
    return wide.withColumn("event_class", stats.joint_class(F.col("vector"), F.col("speed")))


@query("decision_readout", f"WITH {ROWS}, {FOUR}, {EVENTS_SQL}, n AS (SELECT count(*) AS events, count(*) FILTER (event_class IN ('strong','qualified')) AS good, count(*) FILTER (event_class IN ('degraded','mixed')) AS bad FROM jc) SELECT *, CASE WHEN good>=3 AND bad=0 THEN 'improved' WHEN bad>=2 THEN 'degraded' ELSE 'inconclusive' END AS campaign_class, (SELECT count(*) FROM fixed_) AS cohort FROM n")
def decision_readout(spark, d):
    rows = written_rows(spark, d)
    size = campaign.cohort(rows, 8, 20).agg(F.count("*").alias("cohort"))
    return campaign.decision(event_rows(spark, d, rows)).crossJoin(F.broadcast(size))


@query("leave_one_out", f"WITH {ROWS}, s AS (SELECT DISTINCT season AS omitted FROM sr) SELECT omitted, metric, round(median(delta),6)+0.0 AS median, median(delta) <= 1e-12 AS nondegrading FROM sr JOIN s ON season <> omitted GROUP BY 1,2")
def leave_one_out(spark, d):
    out = campaign.leave_one_out(station_rows(spark, d), "season", "delta", ["metric"])
    return out.select("omitted", "metric", r6("median").alias("median"), (F.col("median") <= 1e-12).alias("nondegrading"))


@query("safeguard_strata", f"WITH {ROWS}, {STRATA_SQL}, sg AS (SELECT station, stratum AS guard FROM strata_ WHERE stratum IN ('ridge','valley') UNION ALL SELECT station, 'high' FROM site_ WHERE z >= 1500), g AS (SELECT guard, season, count(*) AS stations, {_mc('sqrt(avg(candidate_rmse*candidate_rmse))-sqrt(avg(baseline_rmse*baseline_rmse))', 'sqrt(avg(baseline_rmse*baseline_rmse))')} AS class FROM sr JOIN sg USING (station) WHERE metric='vector' GROUP BY 1,2) SELECT guard, count(*) AS seasons, count(*) FILTER (class='degradation') AS degradations, count(*) FILTER (class='degradation') >= 2 AS fails FROM g WHERE stations >= 10 GROUP BY guard")
def safeguard_strata(spark, d):
    sites = site_strata(spark, d)
    guards = sites.where("stratum in ('ridge', 'valley')").select("station", F.col("stratum").alias("guard")).unionByName(sites.where("stratum = 'all' and z >= 1500").select("station", F.lit("high").alias("guard")))
    g = campaign.equal_station_summary(station_rows(spark, d).where("metric = 'vector'").join(guards, "station"), ["guard", "season"]).where("stations >= 10")
    g = g.withColumn("class", stats.material_change(F.col("candidate_equal_rmse") - F.col("baseline_equal_rmse"), F.col("baseline_equal_rmse")))
    bad = F.count_if(F.col("class") == "degradation")
    return g.groupBy("guard").agg(F.count("*").alias("seasons"), bad.alias("degradations"), (bad >= 2).alias("fails"))


FOUR_STRATA = "('all', 'valley', 'ridge', 'ge_2000')"
_MC0 = lambda delta, base: _mc(delta, base).replace("-1e-12", "").replace("+1e-12", "")


@query("sensitivity_compare", f"WITH {ROWS}, {STRATA_SQL}, x AS (SELECT sr.*, stratum, candidate_mae*(1+0.05*((station % 5)-2)) + candidate_rmse - candidate_mae AS sens FROM sr JOIN strata_ USING (station) WHERE stratum IN {FOUR_STRATA}), g AS (SELECT season, stratum, metric, count(*) AS stations, sqrt(avg(candidate_rmse*candidate_rmse)) AS base, sqrt(avg(sens*sens)) AS sensitivity, sqrt(avg(baseline_rmse*baseline_rmse)) AS baseline, median(sens-candidate_rmse) AS median_delta, count(*) FILTER (sens < candidate_rmse) AS improved, count(*) FILTER (sens > candidate_rmse) AS degraded FROM x GROUP BY 1,2,3) SELECT season, stratum, metric, stations, {sql6('base', 'sensitivity', 'median_delta')}, round(sensitivity-base,6)+0.0 AS delta, {_MC0('sensitivity-base', 'base')} AS class, {_MC0('sensitivity-baseline', 'baseline')} AS class_to_baseline, improved, degraded FROM g")
def sensitivity_compare(spark, d):
    """A second run of the same stations against the first, by stratum, and against the baseline."""
    x = station_rows(spark, d).withColumn("sens", F.col("candidate_mae") * (1 + 0.05 * ((F.col("station") % 5) - 2)) + F.col("candidate_rmse") - F.col("candidate_mae"))
    x = x.join(site_strata(spark, d).where(f"stratum in {FOUR_STRATA}").select("station", "stratum"), "station")
    return rounded(campaign.sensitivity(x, ["season", "stratum", "metric"], "candidate_rmse", "sens", "baseline_rmse"))


@query("control_compare", f"WITH {ROWS}, x AS (SELECT *, (candidate_rmse+baseline_rmse)/2 AS control_rmse FROM sr), g AS (SELECT season, metric, sqrt(avg(candidate_rmse*candidate_rmse)) AS c, sqrt(avg(control_rmse*control_rmse)) AS k, sqrt(avg(baseline_rmse*baseline_rmse)) AS b, median(candidate_rmse-control_rmse) AS mck, median(control_rmse-baseline_rmse) AS mkb, median(candidate_rmse-baseline_rmse) AS mcb FROM x GROUP BY 1,2) SELECT season, metric, round(c-k,6)+0.0 AS candidate_vs_control, round(k-b,6)+0.0 AS control_vs_baseline, round(c-b,6)+0.0 AS candidate_vs_baseline, {_MC0('c-k', 'k')} AS candidate_control_class, {_MC0('k-b', 'b')} AS control_baseline_class, {_MC0('c-b', 'b')} AS candidate_baseline_class, round(mck,6)+0.0 AS median_candidate_control, round(mkb,6)+0.0 AS median_control_baseline, round(mcb,6)+0.0 AS median_candidate_baseline FROM g")
def control_compare(spark, d):
    """Candidate, control and baseline of the same stations: three differences, their classes and their medians."""
    x = station_rows(spark, d).withColumn("control_rmse", (F.col("candidate_rmse") + F.col("baseline_rmse")) / 2)
    return rounded(campaign.three_way(x, ["season", "metric"], ("candidate", "control", "baseline")))


HALVES = "hv AS (SELECT user_id % 2 AS station, date_trunc('hour', ts) AS hour, avg(value) AS s, avg(-value*sin(radians(((event_id*37) % 360)::DOUBLE))) AS u, avg(-value*cos(radians(((event_id*37) % 360)::DOUBLE))) AS v FROM events GROUP BY 1,2)"
_H = lambda c: f"CASE WHEN date_diff('second', lag(hour) OVER w, hour)=3600 THEN ({c}+lag({c}) OVER w)/2 END"


@query("control_eval", f"WITH {HALVES}, t AS (SELECT *, {_H('s')} AS hs, {_H('u')} AS hu, {_H('v')} AS hv_ FROM hv WINDOW w AS (PARTITION BY station ORDER BY hour)), r AS (SELECT station, date_trunc('day', hour) AS day, s, u, v, hs, hu*CASE WHEN sqrt(hu*hu+hv_*hv_)>0 THEN hs/sqrt(hu*hu+hv_*hv_) ELSE 0 END AS ru, hv_*CASE WHEN sqrt(hu*hu+hv_*hv_)>0 THEN hs/sqrt(hu*hu+hv_*hv_) ELSE 0 END AS rv FROM t), dd AS (SELECT station, day, count(hs) AS n, avg(hs-s) AS bias, sqrt(avg((hs-s)*(hs-s))) AS rmse, sqrt(avg((ru-u)*(ru-u)+(rv-v)*(rv-v))) AS vector_rmse FROM r GROUP BY 1,2) SELECT station, day, n, CASE WHEN n=24 THEN round(bias,6)+0.0 END AS bias, CASE WHEN n=24 THEN round(rmse,6)+0.0 END AS rmse, CASE WHEN n=24 THEN round(vector_rmse,6)+0.0 END AS vector_rmse FROM dd")
def control_eval(spark, d):
    """Days of hourly winds by trapezoids against the hours' ends; only days with all 24 hours are scored."""
    from skillgrid.functions.physics import wind_uv
    from skillgrid.operators.temporal import trapezoid_wind

    e = B.table(spark, d, "events")
    u, v = wind_uv(F.col("value"), ((F.col("event_id") * 37) % 360).cast("double"))
    ends = e.groupBy((F.col("user_id") % 2).alias("station"), F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("s"), F.avg(u).alias("u"), F.avg(v).alias("v"))
    h = trapezoid_wind(ends, ["station"], "hour", "s", "u", "v")
    es, eu, ev = (F.col(f"hourly_{a}") - F.col(b) for a, b in (("speed", "s"), ("u", "u"), ("v", "v")))
    g = h.groupBy("station", F.date_trunc("day", "hour").cast("timestamp_ntz").alias("day")).agg(F.count("hourly_speed").alias("n"), F.avg(es).alias("bias"), F.sqrt(F.avg(es * es)).alias("rmse"), F.sqrt(F.avg(eu * eu + ev * ev)).alias("vector_rmse"))
    whole = F.col("n") == 24
    return rounded(g.select("station", "day", "n", *[F.when(whole, F.col(c)).alias(c) for c in ("bias", "rmse", "vector_rmse")]))


@query("strata_wind_summary", f"WITH {ROWS}, {STRATA_SQL} SELECT stratum, sum(pair_count)::BIGINT AS pairs, round(sqrt(avg(candidate_rmse*candidate_rmse)),6)+0.0 AS equal_rmse, round(avg(candidate_rmse),6)+0.0 AS mean_rmse, round(avg(rel),6)+0.0 AS mean_relative FROM sr JOIN strata_ USING (station) JOIN site_ USING (station) WHERE stratum IN ('valley','neutral','ridge','ge_2000') AND metric='vector' GROUP BY stratum")
def strata_wind_summary(spark, d):
    s = site_strata(spark, d).where("stratum in ('valley', 'neutral', 'ridge', 'ge_2000')")
    r = station_rows(spark, d).where("metric = 'vector'").join(s, "station")
    return rounded(r.groupBy("stratum").agg(F.sum("pair_count").alias("pairs"), F.sqrt(F.avg(F.col("candidate_rmse") ** 2)).alias("equal_rmse"), F.avg("candidate_rmse").alias("mean_rmse"), F.avg("rel").alias("mean_relative")))


@query("normalized_diff", f"WITH {ROWS} SELECT station, season, metric, round(CASE WHEN candidate_rmse+baseline_rmse=0 THEN 0 ELSE (candidate_rmse-baseline_rmse)/(candidate_rmse+baseline_rmse) END,6)+0.0 AS skill FROM sr")
def normalized_diff(spark, d):
    return station_rows(spark, d).select(*KEYS, r6(stats.normalized_difference(F.col("candidate_rmse"), F.col("baseline_rmse"))).alias("skill"))


LEADS = "lt AS (SELECT season, metric, lead, sqrt(avg((candidate-obs)*(candidate-obs))) AS rmse FROM accepted GROUP BY 1,2,3)"


@query("lead_trend", f"WITH {B.TRIPLETS}, {LEADS}, r AS (SELECT *, row_number() OVER (PARTITION BY season, metric ORDER BY lead) AS i, count(*) OVER (PARTITION BY season, metric) AS n FROM lt) SELECT season, metric, round((count(*)*sum(lead*rmse)-sum(lead)*sum(rmse))/(count(*)*sum(lead*lead)-sum(lead)*sum(lead)),6)+0.0 AS slope, round(avg(rmse) FILTER (i > n - n//3) - avg(rmse) FILTER (i <= n//3),6)+0.0 AS late_minus_early FROM r GROUP BY 1,2")
def lead_trend(spark, d):
    e = F.col("candidate") - F.col("obs")
    lt = B.accepted(spark, d).groupBy("season", "metric", "lead").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    w = Window.partitionBy("season", "metric")
    r = lt.withColumns({"i": F.row_number().over(w.orderBy("lead")), "k": F.floor(F.count("*").over(w) / 3), "n": F.count("*").over(w)})
    late, early = F.avg(F.when(F.col("i") > F.col("n") - F.col("k"), F.col("rmse"))), F.avg(F.when(F.col("i") <= F.col("k"), F.col("rmse")))
    return rounded(r.groupBy("season", "metric").agg(stats.slope("rmse", "lead").alias("slope"), (late - early).alias("late_minus_early")))


@query("pivot_scorecard", f"WITH {ROWS}, g AS (SELECT season, metric, sqrt(avg(candidate_rmse*candidate_rmse)) AS c, sqrt(avg(baseline_rmse*baseline_rmse)) AS b, min(pair_count) AS n0, max(pair_count) AS n1 FROM sr GROUP BY 1,2) SELECT season, round(max((c-b)/(c+b)) FILTER (metric='vector'),6)+0.0 AS vector, round(max((c-b)/(c+b)) FILTER (metric='speed'),6)+0.0 AS speed, min(n0) AS min_pairs, max(n1) AS max_pairs FROM g GROUP BY season")
def pivot_scorecard(spark, d):
    rows = station_rows(spark, d)
    e = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    g = rows.groupBy("season", "metric").agg(stats.normalized_difference(e("candidate_rmse"), e("baseline_rmse")).alias("s"))
    wide = g.groupBy("season").pivot("metric", ["vector", "speed"]).agg(F.first("s"))
    n = rows.groupBy("season").agg(F.min("pair_count").alias("min_pairs"), F.max("pair_count").alias("max_pairs"))
    return rounded(wide.join(n, "season"))


@query("min_pairs", f"WITH {ROWS} SELECT CASE WHEN pair_count < 60 THEN 'too_few_pairs:'||season||':'||metric ELSE 'accepted' END AS verdict, count(*) AS rows_ FROM sr GROUP BY 1")
def min_pairs(spark, d):
    r = campaign.exclusions(station_rows(spark, d), 60)
    return r.groupBy(F.coalesce(F.concat_ws(":", F.when(F.col("reason").isNotNull(), F.col("reason")), F.when(F.col("reason").isNotNull(), F.col("season")), F.when(F.col("reason").isNotNull(), F.col("metric"))), F.lit("")).alias("v")).agg(F.count("*").alias("rows_")).select(F.when(F.col("v") == "", "accepted").otherwise(F.col("v")).alias("verdict"), "rows_")


@query("diag_selection", f"WITH {ROWS}, a AS (SELECT station, candidate_rmse-baseline_rmse AS diff, station % 7 = 3 AS unequal FROM sr WHERE metric='vector' AND season='DJF'), k AS (SELECT *, row_number() OVER (ORDER BY diff DESC, station) AS place FROM a WHERE NOT unequal), s AS (SELECT s_suppkey AS station, abs(s_acctbal/3) AS z, s_acctbal/20-250 AS rel FROM supplier) SELECT s.station, concat_ws(',', CASE WHEN rel>150 THEN 'ridge' END, CASE WHEN z>=2000 THEN 'high' END, CASE WHEN place<=5 THEN 'worst' END) AS reasons, CASE WHEN a.unequal THEN 'unequal_counts' END AS excluded FROM s LEFT JOIN k USING (station) LEFT JOIN a ON a.station = s.station WHERE rel>150 OR z>=2000 OR place<=5")
def diag_selection(spark, d):
    """Sites for a diagnosis with all their reasons; a site whose two pair counts differ isn't ranked, and is marked. Every seventh site's candidate lost a pair here."""
    a = station_rows(spark, d).where("metric = 'vector' and season = 'DJF'")
    lost = F.when(F.col("station") % 7 == 3, 1).otherwise(0)
    marked = campaign.exclusions(a.withColumns({"candidate_count": F.col("pair_count") - lost, "baseline_count": F.col("pair_count")}), least=0)
    return campaign.diagnosis(marked, site_strata(spark, d).select("station", "z", "rel").distinct(), "station", 5)


@query("rank_worst", f"WITH {ROWS}, k AS (SELECT season, metric, station, delta, row_number() OVER (PARTITION BY season, metric ORDER BY delta DESC, station) AS place FROM sr) SELECT season, metric, station, {sql6('delta')}, place FROM k WHERE place <= 5")
def rank_worst(spark, d):
    return rounded(campaign.worst(station_rows(spark, d), ["season", "metric"], 5).select("season", "metric", "station", "delta", "place"))


@query("season_order", f"WITH {ROWS} SELECT row_number() OVER (ORDER BY {strata.SEASON_ORDER}, metric) AS place, season, metric, n FROM (SELECT season, metric, count(*) AS n FROM sr GROUP BY 1,2)")
def season_order(spark, d):
    g = station_rows(spark, d).groupBy("season", "metric").agg(F.count("*").alias("n"))
    ordered = g.orderBy(F.expr(strata.SEASON_ORDER), "metric")
    return ordered.select(F.row_number().over(Window.orderBy(F.expr(strata.SEASON_ORDER), "metric")).alias("place"), "season", "metric", "n")


@query("sql_report_views", f"WITH {ROWS} SELECT season, metric, count(*) AS stations, round(avg(delta),6)+0.0 AS mean_delta FROM sr GROUP BY season, metric ORDER BY {strata.SEASON_ORDER}, metric")
def sql_report_views(spark, d):
    return spark.sql(f"SELECT season, metric, count(*) AS stations, round(avg(delta), 6) + 0D AS mean_delta FROM {{rows}} GROUP BY season, metric ORDER BY {strata.SEASON_ORDER}, metric", rows=station_rows(spark, d))


@query("top_abs_change", f"WITH {ROWS} SELECT station, season, round(abs(delta),6)+0.0 AS change FROM sr WHERE metric='speed' ORDER BY abs(delta) DESC, station, season LIMIT 20")
def top_abs_change(spark, d):
    r = station_rows(spark, d).where("metric = 'speed'").withColumn("change", F.abs("delta"))
    return rounded(r.orderBy(F.desc("change"), "station", "season").limit(20).select("station", "season", "change"))


@query("nlargest_station", f"WITH {ROWS} SELECT station, round(avg((candidate_rmse-baseline_rmse)/(candidate_rmse+baseline_rmse)),6)+0.0 AS skill FROM sr GROUP BY station ORDER BY avg((candidate_rmse-baseline_rmse)/(candidate_rmse+baseline_rmse)) DESC, station LIMIT 12")
def nlargest_station(spark, d):
    g = station_rows(spark, d).groupBy("station").agg(F.avg(stats.normalized_difference(F.col("candidate_rmse"), F.col("baseline_rmse"))).alias("skill"))
    return rounded(g.orderBy(F.desc("skill"), "station").limit(12))


@query("four_season_intersection", f"WITH {ROWS} SELECT metric, count(*) FILTER (s=4) AS in_all, count(*) AS in_any FROM (SELECT metric, station, count(DISTINCT season) AS s FROM sr GROUP BY 1,2) GROUP BY metric")
def four_season_intersection(spark, d):
    g = station_rows(spark, d).groupBy("metric", "station").agg(F.count_distinct("season").alias("s"))
    return g.groupBy("metric").agg(F.count_if(F.col("s") == 4).alias("in_all"), F.count("*").alias("in_any"))


@query("key_set_diff", f"WITH {B.TRIPLETS}, a AS (SELECT DISTINCT station, valid FROM triplets WHERE candidate IS NOT NULL), b AS (SELECT DISTINCT station, valid FROM triplets WHERE obs IS NOT NULL) SELECT 'only_candidate' AS side, count(*) AS keys FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only_observation', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def key_set_diff(spark, d):
    t = B.triplets(spark, d)
    a, b = (t.where(F.col(c).isNotNull()).select("station", "valid").distinct() for c in ("candidate", "obs"))
    one = lambda x, name: x.agg(F.count("*").alias("keys")).select(F.lit(name).alias("side"), "keys")
    return one(a.subtract(b), "only_candidate").unionByName(one(b.subtract(a), "only_observation"))


@query("cohort_intersection", f"WITH {ROWS}, k AS (SELECT season, metric, count(*) FILTER (pair_count>=60) AS eligible, count(*) FILTER (pair_count<60) AS excluded FROM sr GROUP BY 1,2), c AS (SELECT count(*) AS cohort FROM (SELECT station FROM sr GROUP BY 1 HAVING count(*) FILTER (pair_count>=60)=8)) SELECT k.*, cohort FROM k, c")
def cohort_intersection(spark, d):
    rows = station_rows(spark, d)
    k = rows.groupBy("season", "metric").agg(F.count_if(F.col("pair_count") >= 60).alias("eligible"), F.count_if(F.col("pair_count") < 60).alias("excluded"))
    return k.join(F.broadcast(campaign.cohort(rows, 8, 60).agg(F.count("*").alias("cohort"))))


@query("day_union", f"WITH {B.CATALOG} SELECT segment, record, valid FROM catalog WHERE valid < TIMESTAMP '1996-01-01' UNION ALL SELECT segment, record, valid FROM catalog WHERE valid >= TIMESTAMP '2000-01-01'")
def day_union(spark, d):
    c = B.catalog(spark, d).select("segment", "record", "valid")
    return c.where("valid < timestamp_ntz'1996-01-01'").unionByName(c.where("valid >= timestamp_ntz'2000-01-01'").select("record", "valid", "segment"))


@query("distinct_times", "SELECT DISTINCT o_orderdate AS valid FROM orders UNION SELECT DISTINCT l_shipdate FROM lineitem")
def distinct_times(spark, d):
    return B.table(spark, d, "orders").select(F.col("o_orderdate").alias("valid")).union(B.table(spark, d, "lineitem").select("l_shipdate")).distinct()


@query("cohort_semi", f"WITH {ROWS}, {FOUR} SELECT station, count(*) AS rows_ FROM sr WHERE station IN (SELECT station FROM fixed_) GROUP BY station")
def cohort_semi(spark, d):
    rows = station_rows(spark, d)
    return rows.join(campaign.cohort(rows, 8, 20), "station", "left_semi").groupBy("station").agg(F.count("*").alias("rows_"))


@query("report_parity", f"WITH {ROWS}, other AS (SELECT station, season, metric, baseline_rmse + CASE WHEN station=7 THEN 1e-6 ELSE 0 END AS b FROM sr) SELECT metric, count(*) AS rows_, round(max(abs(baseline_rmse-b)),6)+0.0 AS max_difference, max(abs(baseline_rmse-b)) <= 1e-12 AS parity FROM sr JOIN other USING (station, season, metric) GROUP BY metric")
def report_parity(spark, d):
    rows = station_rows(spark, d).select(*KEYS, "baseline_rmse")
    other = rows.select(*KEYS, (F.col("baseline_rmse") + F.when(F.col("station") == 7, 1e-6).otherwise(0.0)).alias("b"))
    off = F.max(F.abs(F.col("baseline_rmse") - F.col("b")))
    return rounded(rows.join(other, KEYS).groupBy("metric").agg(F.count("*").alias("rows_"), off.alias("max_difference"), (off <= 1e-12).alias("parity")))


@query("nest_rows", f"WITH {ROWS} SELECT station, string_agg(season||':'||metric||':'||pair_count, ',' ORDER BY season, metric) AS nested FROM sr GROUP BY station")
def nest_rows(spark, d):
    n = station_rows(spark, d).groupBy("station").agg(F.array_sort(F.collect_list(F.struct("season", "metric", "pair_count"))).alias("l"))
    return n.select("station", F.concat_ws(",", F.transform("l", lambda x: F.concat_ws(":", x["season"], x["metric"], x["pair_count"].cast("string")))).alias("nested"))
