"""Queries of the statistics and stratification family."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skillgrid.functions import stats
from skillgrid.operators import pairing, strata
from skillgrid.plans import bindings as B
from skillgrid.plans.registry import query, r6, rounded, sql6

#: SQL of the statistics over rows named ``rows`` with columns m and o, grouped by {k}.
PAIR_SQL = """sums AS (SELECT {k}, count(*) AS n, sum(m) AS sm, sum(o) AS so, sum(m*m) AS smm, sum(o*o) AS soo, sum(m*o) AS smo, sum((m-o)*(m-o)) AS sdd, sum(abs(m-o)) AS sabs FROM rows_ WHERE m IS NOT NULL AND o IS NOT NULL GROUP BY {k}),
st AS (SELECT {k}, n AS pair_count, sm/n AS model_mean, so/n AS obs_mean, sm/n-so/n AS bias, sabs/n AS mae, sqrt(sdd/n) AS rmse, sqrt(greatest(sdd/n-(sm/n-so/n)*(sm/n-so/n),0)) AS centered_rmse, sqrt(greatest(smm/n-(sm/n)*(sm/n),0)) AS model_sd, sqrt(greatest(soo/n-(so/n)*(so/n),0)) AS obs_sd, CASE WHEN sqrt(greatest(smm/n-(sm/n)*(sm/n),0)*greatest(soo/n-(so/n)*(so/n),0)) > 0 THEN (smo/n-(sm/n)*(so/n))/sqrt(greatest(smm/n-(sm/n)*(sm/n),0)*greatest(soo/n-(so/n)*(so/n),0)) END AS corr FROM sums)"""
STAT6 = sql6(*stats.STATS)


def _stats_sql(prelude: str, rows: str, keys: str) -> str:
    return f"WITH {prelude}, rows_ AS ({rows}), {PAIR_SQL.format(k=keys)} SELECT {keys}, pair_count, {STAT6} FROM st"


@query("pair_stats", _stats_sql(B.TRIPLETS, "SELECT station, season, metric, candidate AS m, obs AS o FROM accepted", "station, season, metric"))
def pair_stats(spark, d):
    return rounded(stats.pair_stats(B.accepted(spark, d), ["station", "season", "metric"], "candidate", "obs"))


@query("grid_pair_stats", f"WITH {B.GRID}, rows_ AS (SELECT class, height*1.01 AS m, CASE WHEN size <> 13 THEN height END AS o, land FROM grid), {PAIR_SQL.format(k='class').replace('WHERE m IS', 'WHERE land AND m IS')}, bad AS (SELECT class, count(*) FILTER (land AND o IS NULL) AS nonfinite FROM rows_ GROUP BY class) SELECT st.class, pair_count, {STAT6}, nonfinite FROM st JOIN bad USING (class)")
def grid_pair_stats(spark, d):
    g = B.grid(spark, d).withColumns({"m": F.col("height") * 1.01, "o": F.when(F.col("size") != 13, F.col("height"))})
    bad = g.groupBy("class").agg(F.count_if(F.col("land") & F.col("o").isNull()).alias("nonfinite"))
    return rounded(stats.pair_stats(g.where("land"), ["class"], "m", "o").join(bad, "class"))


CIRC_SQL = "WITH {p}, e AS (SELECT station, (((direction+speed*3-(direction*1.1)+180) - floor((direction+speed*3-(direction*1.1)+180)/360)*360)) - 180 AS e FROM wind) SELECT station, count(*) AS pair_count, round(degrees(atan2(sum(sin(radians(e))), sum(cos(radians(e))))),6)+0.0 AS bias, round(avg(abs(e)),6)+0.0 AS mean_abs, round(sqrt(avg(e*e)),6)+0.0 AS rms FROM e GROUP BY station"


@query("circular_stats", CIRC_SQL.format(p=B.WIND))
def circular_stats(spark, d):
    w = B.wind(spark, d).withColumns({"m": F.col("direction") + F.col("speed") * 3, "o": F.col("direction") * 1.1})
    return rounded(stats.circular_stats(w, ["station"], "m", "o"))


UV = "uv AS (SELECT station, kind, ts, speed, direction, -speed*sin(radians(direction)) AS u, -speed*cos(radians(direction)) AS v FROM wind)"


@query("vector_rmse", f"WITH {B.WIND}, {UV} SELECT station, round(sqrt(avg((u*1.1-u)*(u*1.1-u)+(v+0.5-v)*(v+0.5-v))),6)+0.0 AS vector_rmse FROM uv GROUP BY station")
def vector_rmse(spark, d):
    from skillgrid.functions.physics import wind_uv

    u, v = wind_uv(F.col("speed"), F.col("direction"))
    w = B.wind(spark, d).withColumns({"u": u, "v": v})
    return rounded(w.groupBy("station").agg(stats.vector_rmse(F.col("u") * 1.1 - F.col("u"), F.col("v") + 0.5 - F.col("v")).alias("vector_rmse")))


MULTI_ROWS = "SELECT t.*, s.stratum FROM (SELECT *, candidate AS m, obs AS o FROM accepted) t JOIN strata_ s USING (station)"
STRATA_SQL = """site_ AS (SELECT s_suppkey AS station, abs(s_acctbal/3) AS z, s_acctbal/20 - 250 AS rel, (s_suppkey % 40)*100.0 AS edge FROM supplier),
strata_ AS (SELECT station, unnest(list_filter([CASE WHEN TRUE THEN 'all' END, CASE WHEN edge>=1000 THEN 'interior' END, CASE WHEN edge<1000 THEN 'boundary' END, CASE WHEN z<500 THEN 'lt_500' END, CASE WHEN z>=500 AND z<1000 THEN '500_1000' END, CASE WHEN z>=1000 AND z<1500 THEN '1000_1500' END, CASE WHEN z>=1500 AND z<2000 THEN '1500_2000' END, CASE WHEN z>=2000 THEN 'ge_2000' END, CASE WHEN z>=2000 AND z<3000 THEN '2000_3000' END, CASE WHEN z>=3000 THEN 'ge_3000' END, CASE WHEN rel<-150 THEN 'valley' END, CASE WHEN abs(rel)<=150 THEN 'neutral' END, CASE WHEN rel>150 THEN 'ridge' END], lambda x: x IS NOT NULL)) AS stratum FROM site_)"""


def site_strata(spark, d):
    """(station, z, rel, stratum): a row for each class of a site."""
    s = B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("station"), F.abs(F.col("s_acctbal") / 3).alias("z"), (F.col("s_acctbal") / 20 - 250).alias("rel"), ((F.col("s_suppkey") % 40) * 100.0).alias("edge"))
    return strata.explode_membership(s, strata.memberships(F.col("z"), F.col("rel"), F.col("edge"), 1000.0))


@query("strata", f"WITH {STRATA_SQL} SELECT station, stratum FROM strata_")
def strata_query(spark, d):
    return site_strata(spark, d).select("station", "stratum")


def _sets(sets: list[str]) -> str:
    keys = ("stratum", "season", "lead", "station")
    one = "SELECT {g} AS grain, " + "{c}" + ", metric, count(*) AS n, sum(m) AS sm, sum(o) AS so, sum((m-o)*(m-o)) AS sdd FROM rows_ {w} GROUP BY {k}"
    out = []
    for s in sets:
        names = s.split("+")
        cast = {"stratum": "VARCHAR", "season": "VARCHAR", "lead": "INT", "station": "BIGINT"}
        cols = ", ".join(k if k in names else f"NULL::{cast[k]} AS {k}" for k in keys)
        out.append(one.format(g=f"'{s}'", c=cols, k=", ".join([*names, "metric"]), w="" if s != "station" else "WHERE stratum='all'"))
    return " UNION ALL ".join(out)


GRAINS = ["stratum", "stratum+season", "stratum+lead", "station"]


@query("multi_grain", f"WITH {B.TRIPLETS}, {STRATA_SQL}, rows_ AS ({MULTI_ROWS}), g AS ({_sets(GRAINS)}) SELECT grain, stratum, season, lead, station, metric, n AS pair_count, round(sm/n-so/n,6)+0.0 AS bias, round(sqrt(sdd/n),6)+0.0 AS rmse FROM g")
def multi_grain(spark, d):
    """All grains from one pass: partial sums by the finest keys first, then grouping sets over those."""
    sums = stats.pair_sums(F.col("candidate"), F.col("obs"))
    fine = B.accepted(spark, d).groupBy("station", "season", "lead", "metric").agg(*sums)
    rows = fine.join(site_strata(spark, d).select("station", "stratum"), "station")
    again = ", ".join(f"sum({c}) AS {c}" for c in ("n", "sm", "so", "sdd"))
    sets = spark.sql(f"SELECT stratum, season, lead, station, metric, grouping(season) AS gs, grouping(lead) AS gl, grouping(station) AS gt, {again} FROM {{rows}} GROUP BY GROUPING SETS ((stratum, metric), (stratum, season, metric), (stratum, lead, metric), (stratum, station, metric))", rows=rows)
    sets = sets.where("station is null or stratum = 'all'")
    grain = F.when(F.col("gt") == 0, "station").when(F.col("gl") == 0, "stratum+lead").when(F.col("gs") == 0, "stratum+season").otherwise("stratum")
    return sets.select(grain.alias("grain"), F.when(F.col("station").isNull(), F.col("stratum")).alias("stratum"), "season", "lead", "station", "metric", F.col("n").alias("pair_count"), r6(F.col("sm") / F.col("n") - F.col("so") / F.col("n")).alias("bias"), r6(F.sqrt(F.col("sdd") / F.col("n"))).alias("rmse"))


REASON_SQL = "CASE WHEN obs IS NULL THEN 'observation_missing' WHEN candidate IS NULL AND baseline IS NULL THEN 'both_models_missing' WHEN candidate IS NULL THEN 'candidate_missing' WHEN baseline IS NULL THEN 'baseline_missing' {calm}END"
THREE_SQL = """daily AS (SELECT event_type AS kind, user_id % 25 AS station, date_trunc('day', ts) AS day, avg(value) AS value FROM events GROUP BY 1,2,3),
three AS (SELECT station, day, o.value AS obs, c.value AS candidate, b.value AS baseline, (c.station IS NOT NULL OR b.station IS NOT NULL) AS counted FROM (SELECT * FROM daily WHERE kind='view') o FULL JOIN (SELECT * FROM daily WHERE kind='click') c USING (station, day) FULL JOIN (SELECT * FROM daily WHERE kind='purchase') b USING (station, day))"""


def three_sources(spark, d):
    daily = B.wind(spark, d).groupBy("kind", "station", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.avg("speed").alias("value"))
    one = lambda k: daily.where(F.col("kind") == k).drop("kind")
    return pairing.common_triplets(one("view"), one("click"), one("purchase"), ["station", "day"])


@query("common_triplet", f"WITH {THREE_SQL.replace('(c.station IS NOT NULL OR b.station IS NOT NULL) AS counted', '(c.value IS NOT NULL OR b.value IS NOT NULL) AS counted')} SELECT station, day, {sql6('obs', 'candidate', 'baseline')}, {REASON_SQL.format(calm='')} AS reason FROM three WHERE counted")
def common_triplet(spark, d):
    return rounded(three_sources(spark, d))


ACC_COLS = "count(*) AS candidates, count(*) FILTER (reason IS NULL) AS accepted, count(reason) AS excluded, count(*) FILTER (reason='observation_missing') AS observation_missing, count(*) FILTER (reason='both_models_missing') AS both_models_missing, count(*) FILTER (reason='candidate_missing') AS candidate_missing, count(*) FILTER (reason='baseline_missing') AS baseline_missing, count(*) FILTER (reason='calm') AS calm"


@query("triplet_accounting", f"WITH {B.TRIPLETS}, r AS (SELECT metric, {REASON_SQL.format(calm=chr(32) + 'WHEN obs < 2.5 THEN ' + chr(39) + 'calm' + chr(39) + ' ')} AS reason FROM triplets) SELECT metric, {ACC_COLS} FROM r GROUP BY metric")
def triplet_accounting(spark, d):
    t = B.triplets(spark, d)
    return pairing.accounting(t.withColumn("reason", pairing.exclusion_reason(F.col("obs"), F.col("candidate"), F.col("baseline"), F.col("obs") < 2.5)), ["metric"])


@query("calm_mask", f"WITH {B.WIND} SELECT station, count(*) FILTER (speed >= 2.5) AS scored, count(*) FILTER (speed < 2.5) AS calm FROM wind GROUP BY station")
def calm_mask(spark, d):
    return B.wind(spark, d).groupBy("station").agg(F.count_if(F.col("speed") >= 2.5).alias("scored"), F.count_if(F.col("speed") < 2.5).alias("calm"))


CLIM_SQL = f"""WITH {B.WIND}, {UV}, k AS (SELECT station, {B.SEASON_SQL.format('ts')} AS season, date_trunc('hour', ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS hour, avg(speed) AS s, avg(u) AS u, avg(v) AS v, max(speed) AS mx FROM uv GROUP BY 1,2,3),
f AS (SELECT *, hour = min(hour) OVER (PARTITION BY station) AS cold, u*0.9+0.4 AS mu, v*0.9-0.2 AS mv FROM k), m AS (SELECT *, sqrt(mu*mu+mv*mv) AS ms, sqrt(u*u+v*v) AS os, degrees(atan2(mu,mv)-atan2(u,v)) AS turn FROM f),
g AS (SELECT 'all' AS grain, 'all' AS part, * FROM m UNION ALL SELECT 'season', season, * FROM m UNION ALL SELECT 'site', station::VARCHAR, * FROM m)
SELECT grain, part, count(*) FILTER (NOT cold) AS hours, count(*) FILTER (cold) AS cold_start, round(avg(s) FILTER (NOT cold),6)+0.0 AS mean_speed, round(avg(ms-os) FILTER (NOT cold),6)+0.0 AS speed_bias, round(sqrt(avg((ms-os)*(ms-os)) FILTER (NOT cold)),6)+0.0 AS speed_rmse, round(avg(mu-u) FILTER (NOT cold),6)+0.0 AS u_bias, round(avg(mv-v) FILTER (NOT cold),6)+0.0 AS v_bias, round(sqrt(avg((mu-u)*(mu-u)+(mv-v)*(mv-v)) FILTER (NOT cold)),6)+0.0 AS vector_rmse, round(degrees(atan2(sum(sin(radians(turn))) FILTER (NOT cold), sum(cos(radians(turn))) FILTER (NOT cold))),6)+0.0 AS direction_bias,
 round(avg(mx) FILTER (NOT cold),6)+0.0 AS max_mean, round(min(mx) FILTER (NOT cold),6)+0.0 AS max_min, round(max(mx) FILTER (NOT cold),6)+0.0 AS max_max, count(*) FILTER (NOT cold AND mx + 1e-6 >= s) AS max_at_least_mean FROM g GROUP BY 1,2"""


@query("wind_clim_stats", CLIM_SQL)
def wind_clim_stats(spark, d):
    """Speed, components, direction and maxima of hours, over all, by season and by site; a station's first hour has no full interval and is only counted."""
    from pyspark.sql import Window

    from skillgrid.functions.physics import wind_uv
    from skillgrid.operators.temporal import ending_hour

    u, v = wind_uv(F.col("speed"), F.col("direction"))
    w = B.wind(spark, d).withColumns({"u": u, "v": v, "season": strata.season(F.col("ts")), "hour": ending_hour(F.col("ts"))})
    k = w.groupBy("station", "season", "hour").agg(F.avg("speed").alias("s"), F.avg("u").alias("u"), F.avg("v").alias("v"), F.max("speed").alias("mx"))
    k = k.withColumns({"cold": F.col("hour") == F.min("hour").over(Window.partitionBy("station")), "mu": F.col("u") * 0.9 + 0.4, "mv": F.col("v") * 0.9 - 0.2})
    length = lambda a, b: F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b))
    k = k.withColumns({"e": length("mu", "mv") - length("u", "v"), "turn": F.atan2("mu", "mv") - F.atan2("u", "v")})
    grains = F.array(*[F.struct(F.lit(g).alias("grain"), p.alias("part")) for g, p in (("all", F.lit("all")), ("season", F.col("season")), ("site", F.col("station").cast("string")))])
    g = k.withColumn("g", F.explode(grains)).withColumn("warm", ~F.col("cold"))
    warm = lambda c: F.when(F.col("warm"), c)
    du, dv = F.col("mu") - F.col("u"), F.col("mv") - F.col("v")
    out = g.groupBy("g.grain", "g.part").agg(
        F.count_if("warm").alias("hours"), F.count_if("cold").alias("cold_start"), F.avg(warm(F.col("s"))).alias("mean_speed"), F.avg(warm(F.col("e"))).alias("speed_bias"), F.sqrt(F.avg(warm(F.col("e") * F.col("e")))).alias("speed_rmse"),
        F.avg(warm(du)).alias("u_bias"), F.avg(warm(dv)).alias("v_bias"), F.sqrt(F.avg(warm(du * du + dv * dv))).alias("vector_rmse"), F.degrees(F.atan2(F.sum(warm(F.sin("turn"))), F.sum(warm(F.cos("turn"))))).alias("direction_bias"),
        F.avg(warm(F.col("mx"))).alias("max_mean"), F.min(warm(F.col("mx"))).alias("max_min"), F.max(warm(F.col("mx"))).alias("max_max"), F.count_if(F.col("warm") & (F.col("mx") + 1e-6 >= F.col("s"))).alias("max_at_least_mean"),
    )
    return rounded(out)


@query("distribution", f"WITH {B.GRID} SELECT class, count(height) AS n, max(height) AS max, round(quantile_cont(height,0.5),6)+0.0 AS p50, round(quantile_cont(height,0.9),6)+0.0 AS p90, round(quantile_cont(height,0.99),6)+0.0 AS p99 FROM grid GROUP BY class")
def distribution(spark, d):
    return rounded(B.grid(spark, d).groupBy("class").agg(*stats.distribution("height")))


@query("finite_parse", "SELECT e AS event_id, v AS value FROM (SELECT event_id AS e, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN NULL WHEN event_id % 7 = 2 THEN NULL ELSE round(value,6)+0.0 END AS v FROM events)")
def finite_parse(spark, d):
    from skillgrid.functions.text import finite

    e = B.table(spark, d, "events")
    k = F.col("event_id") % 7
    text = F.when(k == 0, "nan").when(k == 1, "-inf").when(k == 2, "n/a").otherwise(F.col("value").cast("string"))
    return e.select("event_id", r6(finite(text)).alias("value"))


TENS = "tens AS (SELECT user_id % 2 AS station, make_timestamp((ceil(epoch_us(ts)/600000000.0)*600000000)::BIGINT) AS slot FROM events GROUP BY 1, 2), hh AS (SELECT station, date_trunc('hour', slot - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS hour, count(*) AS samples FROM tens GROUP BY 1, 2)"


@query("eval_window", f"WITH {TENS}, w AS (SELECT station, unnest(generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-20', INTERVAL 1 HOUR)) AS hour FROM (SELECT DISTINCT station FROM hh)) SELECT w.station, w.hour, date_diff('hour', TIMESTAMP '2024-01-02', w.hour) AS lead, coalesce(samples, 0) AS samples, coalesce(samples, 0) = 6 AS complete FROM w LEFT JOIN hh ON hh.station=w.station AND hh.hour=w.hour")
def eval_window(spark, d):
    """Every hour of an inclusive window with its lead; one that lacks any of its six samples isn't complete."""
    from skillgrid.operators.temporal import ending_hour_wind, lead_hour

    e = B.table(spark, d, "events").select((F.col("user_id") % 2).alias("station"), "ts", F.col("value").alias("s"), F.lit(0.0).alias("d"))
    have = ending_hour_wind(e, ["station"], "ts", "s", "d").select("station", "hour", "samples")
    hours = F.expr("sequence(timestamp'2024-01-05', timestamp'2024-01-20', interval 1 hour)")
    w = e.select("station").distinct().withColumn("hour", F.explode(hours)).join(have, ["station", "hour"], "left")
    n = F.coalesce("samples", F.lit(0).cast("long"))
    return w.select("station", F.col("hour").cast("timestamp_ntz").alias("hour"), lead_hour(F.col("hour"), F.lit("2024-01-02").cast("timestamp")).alias("lead"), n.alias("samples"), (n == 6).alias("complete"))


BAND = "CASE WHEN z<500 THEN '<500' WHEN z<1000 THEN '500-1000' WHEN z<1500 THEN '1000-1500' WHEN z<2000 THEN '1500-2000' WHEN z<3000 THEN '2000-3000' ELSE '>=3000' END"
TBAND = "CASE WHEN rel < -150 THEN 'valley' WHEN rel > 150 THEN 'ridge' ELSE 'neutral' END"


@query("elev_band", f"SELECT {BAND} AS band, count(*) AS n FROM (SELECT abs(s_acctbal/3) AS z FROM supplier) GROUP BY 1")
def elev_band(spark, d):
    return B.table(spark, d, "supplier").groupBy(strata.elevation_class(F.abs(F.col("s_acctbal") / 3)).alias("band")).agg(F.count("*").alias("n"))


@query("terrain_band", f"SELECT {TBAND} AS band, count(*) AS n FROM (SELECT s_acctbal/20-250 AS rel FROM supplier UNION ALL SELECT 150.0 UNION ALL SELECT -150.0) GROUP BY 1")
def terrain_band(spark, d):
    rel = B.table(spark, d, "supplier").select((F.col("s_acctbal") / 20 - 250).alias("rel")).union(spark.createDataFrame([(150.0,), (-150.0,)], "rel double"))
    return rel.groupBy(strata.terrain_class(F.col("rel")).alias("band")).agg(F.count("*").alias("n"))


@query("season", f"SELECT {B.SEASON_SQL.format('o_orderdate')} AS season, count(*) AS n FROM orders GROUP BY 1")
def season(spark, d):
    return B.table(spark, d, "orders").groupBy(strata.season(F.col("o_orderdate")).alias("season")).agg(F.count("*").alias("n"))


@query("metric_prune", f"WITH {B.TRIPLETS}, r AS (SELECT station, metric, sqrt(avg((candidate-obs)*(candidate-obs))) AS c, sqrt(avg((baseline-obs)*(baseline-obs))) AS b FROM accepted GROUP BY 1,2) SELECT station, metric, {sql6('c', 'b')} FROM r WHERE c IS NOT NULL AND b IS NOT NULL AND metric IN ('vector','pressure')")
def metric_prune(spark, d):
    e = lambda m: F.sqrt(F.avg((F.col(m) - F.col("obs")) ** 2))
    r = B.accepted(spark, d).groupBy("station", "metric").agg(e("candidate").alias("c"), e("baseline").alias("b")).where("c is not null and b is not null")
    asked = spark.createDataFrame([("vector",), ("pressure",)], "metric string")
    return rounded(r.join(F.broadcast(asked), "metric", "left_semi").select("station", "metric", "c", "b"))


@query("domain_site_filter", f"WITH {B.GRID}, {B.SITES}, t AS (SELECT site, lat + CASE WHEN site % 10 = 0 THEN 0.3 ELSE 0 END AS lat, lon FROM sites), p AS (SELECT site, min(sqrt(((t.lat-g.lat)*110.57)*((t.lat-g.lat)*110.57)+((t.lon-g.lon)*111.32*cos(radians(t.lat)))*((t.lon-g.lon)*111.32*cos(radians(t.lat))))) AS km FROM t, grid g GROUP BY 1) SELECT site, round(km,6)+0.0 AS km, km <= greatest(1.0, 3*0.2) AS kept FROM p")
def domain_site_filter(spark, d):
    """Sites within a kilometre, or three cells, of the grid, and those that are not; no site at all within it is an error."""
    from skillgrid.operators import spatial

    s = B.sites(spark, d).select("site", (F.col("lat") + F.when(F.col("site") % 10 == 0, 0.3).otherwise(0.0)).alias("lat"), "lon")
    return rounded(spatial.within_domain(s, B.grid(spark, d), ["site"], max(1.0, 3 * 0.2)).select("site", "km", "kept"))


@query("daylight_filter", "WITH w AS (SELECT user_id % 25 AS station, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events) SELECT station, count(*) AS pairs, round(avg(value),6)+0.0 AS mean FROM w WHERE value > 5 AND prev IS NOT NULL GROUP BY station")
def daylight_filter(spark, d):
    prev = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts"))
    w = B.table(spark, d, "events").select((F.col("user_id") % 25).alias("station"), "value", prev.alias("prev"))
    return rounded(w.where("value > 5 and prev is not null").groupBy("station").agg(F.count("*").alias("pairs"), F.avg("value").alias("mean")))


@query("guard_trim", f"WITH {B.GRID}, e AS (SELECT max(y)+1 AS ny, max(x)+1 AS nx FROM grid) SELECT y, x, height FROM grid, e WHERE y BETWEEN 3 AND ny-4 AND x BETWEEN 3 AND nx-4")
def guard_trim(spark, d):
    g = B.grid(spark, d)
    e = g.agg((F.max("y") + 1).alias("ny"), (F.max("x") + 1).alias("nx"))
    return g.join(F.broadcast(e), (g.y.between(3, e.ny - 4)) & (g.x.between(3, e.nx - 4))).select("y", "x", "height")


@query("surface_masks", f"WITH {B.GRID}, e AS (SELECT max(y) AS my, max(x) AS mx FROM grid) SELECT mask, count(*) AS cells FROM (SELECT unnest(list_filter(['all', CASE WHEN least(x, mx-x, y, my-y) >= 5 THEN 'interior' END, CASE WHEN (height-900)*30<500 THEN '<500' ELSE '>=500' END], lambda k: k IS NOT NULL)) AS mask FROM grid, e WHERE land) GROUP BY mask")
def surface_masks(spark, d):
    g = B.grid(spark, d)
    e = g.agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    edge = F.least(F.col("x"), F.col("mx") - F.col("x"), F.col("y"), F.col("my") - F.col("y"))
    masks = F.array_compact(F.array(F.lit("all"), F.when(edge >= 5, "interior"), F.when((F.col("height") - 900) * 30 < 500, "<500").otherwise(">=500")))
    return g.where("land").join(F.broadcast(e)).select(F.explode(masks).alias("mask")).groupBy("mask").agg(F.count("*").alias("cells"))


@query("turnover_filter", "SELECT DISTINCT l_linenumber*5 AS lead, (l_linenumber*5-1)//12 AS segment, (l_linenumber*5-1) % 12 + 1 AS position FROM lineitem WHERE (l_linenumber*5-1) % 12 + 1 IN (1,6,12,5,10,8)")
def turnover_filter(spark, d):
    lead = F.col("l_linenumber") * 5
    position = (lead - 1) % 12 + 1
    return B.table(spark, d, "lineitem").where(position.isin(1, 6, 12, 5, 10, 8)).select(lead.alias("lead"), F.floor((lead - 1) / 12).cast("int").alias("segment"), position.alias("position")).distinct()


@query("land_eligibility", f"WITH {B.GRID} SELECT class, count(*) FILTER (land AND size < 40 AND size % 2 = 0) AS vegetated, count(*) FILTER (land AND size < 40 AND size % 2 = 1) AS bare, count(*) FILTER (land AND size < 40) >= 40 AS enough FROM grid GROUP BY class")
def land_eligibility(spark, d):
    ok, veg = F.col("land") & (F.col("size") < 40), F.col("size") % 2 == 0
    return B.grid(spark, d).groupBy("class").agg(F.count_if(ok & veg).alias("vegetated"), F.count_if(ok & ~veg).alias("bare"), (F.count_if(ok) >= 40).alias("enough"))


@query("udaf_pair", f"WITH {B.TRIPLETS} SELECT metric, count(*) AS pair_count, round(avg(candidate)-avg(obs),6)+0.0 AS bias FROM accepted GROUP BY metric")
def udaf_pair(spark, d):
    """The accumulator as plain aggregate expressions, merged from partial sums."""
    partial = B.accepted(spark, d).groupBy("metric", "station").agg(*stats.pair_sums(F.col("candidate"), F.col("obs")))
    merged = partial.groupBy("metric").agg(*[F.sum(c).alias(c) for c in ("n", "sm", "so", "smm", "soo", "smo", "sdd", "sabs")])
    return rounded(merged.select("metric", *stats.pair_result()).select("metric", "pair_count", "bias"))
