"""Queries of the temporal family: joins, windows and catalogs over time."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skillgrid.operators import pairing, temporal
from skillgrid.plans import bindings as B
from skillgrid.plans.registry import query, r6, rounded, sql6

NTZ = "timestamp_ntz"


def endpoints(spark, d):
    return B.endpoints(spark, d).withColumn("hour", F.col("hour").cast(NTZ))


VECTORS = "ev AS (SELECT station, date_trunc('hour', ts) AS hour, avg(speed) AS s, avg(-speed*sin(radians(direction))) AS u, avg(-speed*cos(radians(direction))) AS v FROM wind GROUP BY 1, 2)"


def vectors(spark, d):
    from skillgrid.functions.physics import wind_uv

    u, v = wind_uv(F.col("speed"), F.col("direction"))
    return B.wind(spark, d).groupBy("station", F.date_trunc("hour", "ts").cast(NTZ).alias("hour")).agg(F.avg("speed").alias("s"), F.avg(u).alias("u"), F.avg(v).alias("v"))


_MEAN = lambda c: f"CASE WHEN date_diff('second', lag(hour) OVER w, hour)=3600 THEN ({c}+lag({c}) OVER w)/2 END"


@query("trapezoid_hour", f"WITH {B.WIND}, {VECTORS}, t AS (SELECT station, hour, {_MEAN('s')} AS hs, {_MEAN('u')} AS hu, {_MEAN('v')} AS hv FROM ev WINDOW w AS (PARTITION BY station ORDER BY hour)) SELECT station, hour, round(hs,6)+0.0 AS hourly_speed, round(hu*CASE WHEN sqrt(hu*hu+hv*hv)>0 THEN hs/sqrt(hu*hu+hv*hv) ELSE 0 END,6)+0.0 AS hourly_u, round(hv*CASE WHEN sqrt(hu*hu+hv*hv)>0 THEN hs/sqrt(hu*hu+hv*hv) ELSE 0 END,6)+0.0 AS hourly_v FROM t")
def trapezoid_hour(spark, d):
    out = temporal.trapezoid_wind(vectors(spark, d), ["station"], "hour", "s", "u", "v")
    return rounded(out.select("station", "hour", "hourly_speed", "hourly_u", "hourly_v"))


@query("cumulative_diff", f"WITH {B.ENDPOINTS}, c AS (SELECT station, hour, sum(value) OVER (PARTITION BY station ORDER BY hour) - CASE WHEN station=3 THEN value*1.5 ELSE 0 END AS total FROM endpoints) SELECT station, hour, round(coalesce(greatest(total-lag(total) OVER w,0),0),6)+0.0 AS increase, coalesce(total-lag(total) OVER w < -0.01, FALSE) AS violation FROM c WINDOW w AS (PARTITION BY station ORDER BY hour)")
def cumulative_diff(spark, d):
    w = Window.partitionBy("station").orderBy("hour")
    c = endpoints(spark, d).select("station", "hour", (F.sum("value").over(w) - F.when(F.col("station") == 3, F.col("value") * 1.5).otherwise(0.0)).alias("total"))
    return rounded(temporal.cumulative_difference(c, ["station"], "hour", "total").drop("total"))


@query("ending_hour_mean", "WITH w AS (SELECT user_id % 2 AS station, make_timestamp((ceil(epoch_us(ts)/600000000.0)*600000000)::BIGINT) AS slot, value AS speed, radians(((event_id*37) % 360)::DOUBLE) AS a FROM events), t AS (SELECT station, slot, avg(speed) AS s, avg(-speed*sin(a)) AS u, avg(-speed*cos(a)) AS v FROM w GROUP BY 1,2), h AS (SELECT station, date_trunc('hour', slot - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS hour, count(*) AS samples, avg(s) AS s, avg(u) AS u, avg(v) AS v FROM t GROUP BY 1,2), f AS (SELECT *, CASE WHEN sqrt(u*u+v*v)>0 THEN s/sqrt(u*u+v*v) ELSE 0 END AS k FROM h) SELECT station, hour, samples, round(CASE WHEN samples=6 THEN s END,6)+0.0 AS speed, round(CASE WHEN samples=6 THEN u*k END,6)+0.0 AS u, round(CASE WHEN samples=6 THEN v*k END,6)+0.0 AS v FROM f")
def ending_hour_mean(spark, d):
    """Hours of six ten-minute samples; incomplete ones keep their count and have no mean."""
    w = B.wind(spark, d).join(B.table(spark, d, "events").select("event_id", (F.col("user_id") % 2).alias("half")), "event_id").drop("station").withColumnRenamed("half", "station")
    out = temporal.ending_hour_wind(w, ["station"], "ts", "speed", "direction")
    return rounded(out.withColumn("hour", F.col("hour").cast(NTZ)))


@query("lead_hour", "SELECT event_id, CASE WHEN epoch(ts)::BIGINT >= 0 AND date_diff('second', TIMESTAMP '2024-01-10', date_trunc('minute', ts)) >= 0 AND date_diff('second', TIMESTAMP '2024-01-10', date_trunc('minute', ts)) % 3600 = 0 THEN date_diff('second', TIMESTAMP '2024-01-10', date_trunc('minute', ts))//3600 END AS lead FROM events")
def lead_hour(spark, d):
    return B.table(spark, d, "events").select("event_id", temporal.lead_hour(F.date_trunc("minute", "ts"), F.lit("2024-01-10").cast("timestamp")).alias("lead"))


@query("asof_epoch", "WITH e AS (SELECT user_id, ts, value FROM events WHERE event_type='purchase'), f AS (SELECT user_id, min(ts) AS ts, arg_min(value, ts) AS value FROM e GROUP BY 1), c AS (SELECT event_id, user_id, ts FROM events WHERE event_type='click') SELECT event_id, c.user_id, round(coalesce(e.value, f.value),6)+0.0 AS value, coalesce(e.ts, f.ts) AS valid_from, e.ts IS NULL AND f.ts IS NOT NULL AS extrapolated, f.ts IS NULL AS violation FROM c ASOF LEFT JOIN e ON c.user_id=e.user_id AND c.ts >= e.ts LEFT JOIN f ON c.user_id=f.user_id")
def asof_epoch(spark, d):
    """The epoch in force; before the first, that one, marked; a series without any is a violation."""
    e = B.table(spark, d, "events")
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    out = temporal.asof(clicks, e.where("event_type = 'purchase'").select("user_id", "ts", "value"), ["user_id"], "ts", "ts", "value", back=True)
    return out.select("event_id", "user_id", r6("value").alias("value"), "valid_from", "extrapolated", F.col("valid_from").isNull().alias("violation"))


SERIES = "s AS (SELECT o_custkey AS k, o_orderdate AS t0, avg(sqrt(o_totalprice)) AS v0 FROM orders GROUP BY 1,2), b AS (SELECT k, t0, v0, lead(t0) OVER w AS t1, lead(v0) OVER w AS v1 FROM s WINDOW w AS (PARTITION BY k ORDER BY t0))"


@query("bracket_interp", f"WITH {SERIES}, q AS (SELECT o_orderkey AS record, o_custkey AS k, o_orderdate + INTERVAL 3 DAY AS t FROM orders) SELECT record, q.k AS segment, round(CASE WHEN t1 IS NULL THEN CASE WHEN t=t0 THEN v0 END ELSE v0+(v1-v0)*date_diff('second',t0,t)/date_diff('second',t0,t1)::DOUBLE END,6)+0.0 AS interpolated FROM q LEFT JOIN b ON q.k=b.k AND t>=t0 AND (t<t1 OR (t1 IS NULL AND t=t0))")
def bracket_interp(spark, d):
    o = B.table(spark, d, "orders")
    series = o.groupBy(F.col("o_custkey").alias("segment"), F.col("o_orderdate").alias("t")).agg(F.avg(F.sqrt("o_totalprice")).alias("v"))
    asked = o.select(F.col("o_orderkey").alias("record"), F.col("o_custkey").alias("segment"), (F.col("o_orderdate") + F.expr("interval 3 days")).alias("t"))
    return rounded(temporal.bracket_interpolate(asked, series, ["segment"], "t", "v").drop("t"))


ANCHOR = "CASE WHEN day(o_orderdate)>=15 THEN make_date(year(o_orderdate),month(o_orderdate),15) ELSE (make_date(year(o_orderdate),month(o_orderdate),15) - INTERVAL 1 MONTH)::DATE END"


@query("cyclic_month", f"WITH m AS (SELECT o_orderkey AS record, o_orderdate AS t, {ANCHOR} AS a FROM orders) SELECT record, month(a) AS month0, month(a + INTERVAL 1 MONTH) AS month1, round(date_diff('second', a::TIMESTAMP, t)/(86400.0*date_diff('day', a, (a + INTERVAL 1 MONTH)::DATE)),6)+0.0 AS part FROM m")
def cyclic_month(spark, d):
    t = F.col("o_orderdate")
    a = temporal.month_anchor(t)
    return B.table(spark, d, "orders").select(F.col("o_orderkey").alias("record"), F.month(a).alias("month0"), F.month(F.add_months(a, 1)).alias("month1"), r6(temporal.month_part(t)).alias("part"))


@query("coverage_anti", f"WITH {B.ENDPOINTS}, b AS (SELECT station, TIMESTAMP '2024-01-02' AS begin_, TIMESTAMP '2024-01-04' AS end_ FROM (SELECT DISTINCT station FROM endpoints)), g AS (SELECT station, unnest(generate_series(begin_, end_, INTERVAL 1 HOUR)) AS hour FROM b), a AS (SELECT station, hour FROM endpoints WHERE hour BETWEEN TIMESTAMP '2024-01-01 12:00:00' AND TIMESTAMP '2024-01-04') SELECT station, hour, 'missing' AS problem FROM g WHERE (station,hour) NOT IN (SELECT station,hour FROM a) UNION ALL SELECT station, hour, 'unexpected' FROM a WHERE (station,hour) NOT IN (SELECT station,hour FROM g)")
def coverage_anti(spark, d):
    a = endpoints(spark, d).where("hour between timestamp_ntz'2024-01-01 12:00:00' and timestamp_ntz'2024-01-04'")
    bounds = endpoints(spark, d).select("station").distinct().select("station", F.expr("timestamp_ntz'2024-01-02'").alias("begin"), F.expr("timestamp_ntz'2024-01-04'").alias("end"))
    return pairing.coverage(a, ["station"], "hour", "1 hour", bounds)


@query("overlap_policy", f"WITH {B.CATALOG}, r AS (SELECT valid, segment, record, count(*) OVER (PARTITION BY valid, segment) > 1 AS replaced, row_number() OVER (PARTITION BY valid, segment ORDER BY record DESC) AS n FROM catalog) SELECT valid, segment, record, replaced FROM r WHERE n=1")
def overlap_policy(spark, d):
    return pairing.keep_last(B.catalog(spark, d).select("valid", "segment", "record"), ["valid", "segment"], "record")


@query("overlap_duplicates", f"WITH {B.CATALOG} SELECT valid, segment, count(*) AS copies FROM catalog GROUP BY 1,2 HAVING count(*)>1")
def overlap_duplicates(spark, d):
    return pairing.duplicates(B.catalog(spark, d), ["valid", "segment"])


MERGE = "dd AS (SELECT station, hour, value, hour::DATE AS file_day FROM endpoints UNION ALL SELECT station, hour, value, (hour - INTERVAL 1 DAY)::DATE FROM endpoints WHERE hour = date_trunc('day', hour))"


@query("midnight_merge", f"WITH {B.ENDPOINTS}, {MERGE}, r AS (SELECT *, row_number() OVER (PARTITION BY station, hour ORDER BY file_day) AS n, max(value) OVER (PARTITION BY station, hour) = min(value) OVER (PARTITION BY station, hour) AS agrees FROM dd) SELECT station, hour, {sql6('value')}, file_day, agrees FROM r WHERE n=1")
def midnight_merge(spark, d):
    e = endpoints(spark, d)
    days = e.withColumn("file_day", F.to_date("hour")).unionByName(e.where("hour = date_trunc('day', hour)").withColumn("file_day", F.date_sub(F.to_date("hour"), 1)))
    w = Window.partitionBy("station", "hour")
    r = days.withColumns({"n": F.row_number().over(w.orderBy("file_day")), "agrees": F.max("value").over(w) == F.min("value").over(w)})
    return rounded(r.where("n = 1").drop("n"))


@query("midnight_checks", f"WITH {B.ENDPOINTS}, {MERGE}, n AS (SELECT file_day, station, count(*) AS hours FROM dd GROUP BY 1,2), f AS (SELECT file_day, count(*) AS stations, count(*) FILTER (hours=25) AS whole FROM n GROUP BY 1) SELECT file_day, stations, whole, whole = stations AS complete, coalesce(date_diff('day', lag(file_day) OVER w, file_day) = 1, TRUE) AS follows, coalesce(stations = lag(stations) OVER w, TRUE) AS same_stations FROM f WINDOW w AS (ORDER BY file_day)")
def midnight_checks(spark, d):
    """What each daily file must have before it is merged: 25 endpoints of every station, the day after the last file's, and as many stations."""
    e = endpoints(spark, d)
    days = e.withColumn("file_day", F.to_date("hour")).unionByName(e.where("hour = date_trunc('day', hour)").withColumn("file_day", F.date_sub(F.to_date("hour"), 1)))
    n = days.groupBy("file_day", "station").agg(F.count("*").alias("hours"))
    f = n.groupBy("file_day").agg(F.count("*").alias("stations"), F.count_if(F.col("hours") == 25).alias("whole"))
    w = Window.orderBy("file_day")  # a row a file
    yes = F.lit(True)
    return f.select("file_day", "stations", "whole", (F.col("whole") == F.col("stations")).alias("complete"), F.coalesce(F.datediff("file_day", F.lag("file_day").over(w)) == 1, yes).alias("follows"), F.coalesce(F.col("stations") == F.lag("stations").over(w), yes).alias("same_stations"))


@query("time_bracketed_sum", f"WITH {B.ENDPOINTS} SELECT station, hour, round(CASE WHEN count(*) OVER w = 3 THEN sum(value) OVER w END,6)+0.0 AS total FROM endpoints WINDOW w AS (PARTITION BY station ORDER BY hour RANGE BETWEEN INTERVAL 10799 SECOND PRECEDING AND CURRENT ROW)")
def time_bracketed_sum(spark, d):
    return rounded(pairing.bracketed_sum(endpoints(spark, d), ["station"], "hour", "value", 3).drop("value"))


@query("segment_inputs", f"WITH {B.CATALOG}, s AS (SELECT unnest(range((SELECT min(year(valid)) FROM catalog), (SELECT max(year(valid)) FROM catalog)+1)) AS segment_index), b AS (SELECT segment_index, make_timestamp(segment_index,1,1,0,0,0) AS begin_, make_timestamp(segment_index+1,1,1,0,0,0) AS end_ FROM s) SELECT segment_index::INT AS segment_index, count(*) AS records, min(valid) AS first, max(valid) AS last FROM b JOIN catalog ON valid BETWEEN begin_ AND end_ GROUP BY 1")
def segment_inputs(spark, d):
    """Records of each yearly segment, both ends included: what lies on a boundary goes to both sides, so there is no range join."""
    year, least = F.year("valid"), B.catalog(spark, d).agg(F.min(F.year("valid")).alias("least"))
    on_edge = F.date_trunc("year", F.col("valid").cast("timestamp")) == F.col("valid").cast("timestamp")
    c = B.catalog(spark, d).crossJoin(F.broadcast(least)).withColumn("segment_index", F.explode(F.when(on_edge & (year > F.col("least")), F.array(year - 1, year)).otherwise(F.array(year))))
    return c.groupBy("segment_index").agg(F.count("*").alias("records"), F.min("valid").alias("first"), F.max("valid").alias("last"))


@query("monotonic_check", f"WITH {B.PROFILE}, dd AS (SELECT column_id, value - lag(value) OVER w AS dv, z - lag(z) OVER w AS dz FROM profile WINDOW w AS (PARTITION BY column_id ORDER BY level)) SELECT column_id, coalesce(min(dz)>0, TRUE) AS z_increasing, coalesce(min(dv)>0, TRUE) AS value_increasing, coalesce(max(dv)<0, TRUE) AS value_decreasing FROM dd GROUP BY 1")
def monotonic_check(spark, d):
    w = Window.partitionBy("column_id").orderBy("level")
    p = B.profile(spark, d).select("column_id", (F.col("value") - F.lag("value").over(w)).alias("dv"), (F.col("z") - F.lag("z").over(w)).alias("dz"))
    ok = lambda c: F.coalesce(c, F.lit(True))
    return p.groupBy("column_id").agg(ok(F.min("dz") > 0).alias("z_increasing"), ok(F.min("dv") > 0).alias("value_increasing"), ok(F.max("dv") < 0).alias("value_decreasing"))


@query("cadence_check", f"WITH {B.ENDPOINTS}, g AS (SELECT *, date_diff('second', lag(hour) OVER w, hour) AS gap, row_number() OVER w AS i, count(*) OVER (PARTITION BY station) AS n FROM endpoints WINDOW w AS (PARTITION BY station ORDER BY hour)) SELECT station, count(*) FILTER (gap <> 3600) AS irregular, max(gap)::BIGINT AS longest, bool_and(value IS NOT NULL) FILTER (i=n) AS last_finite FROM g GROUP BY 1")
def cadence_check(spark, d):
    w = Window.partitionBy("station")
    ts = F.unix_seconds(F.col("hour").cast("timestamp"))
    g = endpoints(spark, d).withColumns({"gap": ts - F.lag(ts).over(w.orderBy("hour")), "i": F.row_number().over(w.orderBy("hour")), "n": F.count("*").over(w)})
    return g.groupBy("station").agg(F.count_if(F.col("gap") != 3600).alias("irregular"), F.max("gap").alias("longest"), F.bool_and(F.when(F.col("i") == F.col("n"), F.col("value").isNotNull())).alias("last_finite"))


@query("layer_cumsum", f"WITH {B.PROFILE} SELECT column_id, level, round(sum(value) OVER (PARTITION BY column_id ORDER BY level),6)+0.0 AS interface FROM profile")
def layer_cumsum(spark, d):
    w = Window.partitionBy("column_id").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(B.profile(spark, d).select("column_id", "level", F.sum("value").over(w).alias("interface")))


@query("contiguous_prefix", f"WITH {B.CATALOG}, f AS (SELECT segment, min(record) FILTER (NOT complete) AS frontier FROM catalog GROUP BY 1) SELECT segment, frontier, count(*) FILTER (complete AND record > frontier) AS complete_after FROM catalog JOIN f USING (segment) GROUP BY 1,2")
def contiguous_prefix(spark, d):
    c = B.catalog(spark, d).withColumn("frontier", F.min(F.when(~F.col("complete"), F.col("record"))).over(Window.partitionBy("segment")))
    return c.groupBy("segment", "frontier").agg(F.count_if(F.col("complete") & (F.col("record") > F.col("frontier"))).alias("complete_after"))


@query("segment_position", "SELECT DISTINCT l_linenumber AS lead, (l_linenumber-1)//3 AS segment, (l_linenumber-1)%3+1 AS position, (l_linenumber-1)//3 > 0 AS restarted FROM lineitem")
def segment_position(spark, d):
    i = F.col("l_linenumber") - 1
    return B.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("lead"), F.floor(i / 3).cast("int").alias("segment"), (i % 3 + 1).alias("position"), (F.floor(i / 3) > 0).alias("restarted")).distinct()


@query("adjacent_link", f"WITH {B.CATALOG}, g AS (SELECT segment, record, valid, valid + (record % 40) * INTERVAL 1 DAY AS until, priority FROM catalog), l AS (SELECT segment, record, until, priority, lead(record) OVER w AS next, lead(valid) OVER w AS begins, lead(priority) OVER w AS np FROM g WINDOW w AS (PARTITION BY segment ORDER BY valid, record)) SELECT segment, record, next, begins = until AS meets, date_diff('day', until, begins)::INT AS gap_days, sha256(until::DATE||priority) = sha256(begins::DATE||np) AS same_state, begins = until AND priority = np AS linked FROM l WHERE next IS NOT NULL")
def adjacent_link(spark, d):
    """Each segment must begin where the one before ends, in the state that it ended in."""
    w = Window.partitionBy("segment").orderBy("valid", "record")
    g = B.catalog(spark, d).withColumn("until", F.expr("valid + make_interval(0, 0, 0, cast(record % 40 as int))"))
    l = g.withColumns({"next": F.lead("record").over(w), "begins": F.lead("valid").over(w), "np": F.lead("priority").over(w)}).where("next is not null")
    state = lambda t, p: F.sha2(F.concat(F.date_format(t, "yyyy-MM-dd"), F.col(p)), 256)
    meets = F.col("begins") == F.col("until")
    return l.select("segment", "record", "next", meets.alias("meets"), F.datediff("begins", "until").alias("gap_days"), (state("until", "priority") == state("begins", "np")).alias("same_state"), (meets & (F.col("priority") == F.col("np"))).alias("linked"))


@query("interval_extrema", f"WITH {B.CATALOG}, g AS (SELECT segment, date_diff('day', lag(valid) OVER (PARTITION BY segment ORDER BY valid, record), valid) AS gap FROM catalog) SELECT segment, min(gap)::INT AS shortest, max(gap)::INT AS longest, coalesce(min(gap)>0, TRUE) AS increasing FROM g GROUP BY 1")
def interval_extrema(spark, d):
    gap = F.datediff("valid", F.lag("valid").over(Window.partitionBy("segment").orderBy("valid", "record")))
    return B.catalog(spark, d).select("segment", gap.alias("gap")).groupBy("segment").agg(F.min("gap").alias("shortest"), F.max("gap").alias("longest"), F.coalesce(F.min("gap") > 0, F.lit(True)).alias("increasing"))


@query("round_robin", f"WITH {B.CATALOG}, s AS (SELECT segment % 4 AS season, valid, row_number() OVER (PARTITION BY segment % 4 ORDER BY valid) AS pos FROM (SELECT DISTINCT segment % 4 AS segment, valid FROM catalog)) SELECT season, valid, pos::INT AS pos FROM s")
def round_robin(spark, d):
    s = B.catalog(spark, d).select((F.col("segment") % 4).alias("season"), "valid").dropDuplicates()
    out = s.withColumn("pos", F.row_number().over(Window.partitionBy("season").orderBy("valid")))
    return out.orderBy("pos", "season")


@query("time_slices", "WITH b AS (SELECT n_nationkey AS k, TIMESTAMP '2024-01-01' + n_nationkey*INTERVAL 1 HOUR AS s, TIMESTAMP '2024-01-03' AS e FROM nation), g AS (SELECT k, unnest(generate_series(s, e - INTERVAL 1 SECOND, INTERVAL 12 HOUR)) AS begin_, e FROM b) SELECT k, begin_ AS slice_begin, least(begin_ + INTERVAL 12 HOUR, e) AS slice_end FROM g")
def time_slices(spark, d):
    b = B.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.expr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,n_nationkey)").alias("s"), F.expr("timestamp_ntz'2024-01-03'").alias("e"))
    g = b.select("k", "e", F.explode(F.expr("sequence(s, e - interval 1 second, interval 12 hours)")).alias("slice_begin"))
    return g.select("k", "slice_begin", F.least(F.col("slice_begin") + F.expr("interval 12 hours"), F.col("e")).alias("slice_end"))


@query("archive_inventory", "WITH n AS (SELECT o_orderdate::DATE AS day, o_orderstatus='P' AS field FROM orders), k AS (SELECT DISTINCT day FROM n WHERE field), b AS (SELECT min(day) AS a, max(day) AS z FROM k), g AS (SELECT unnest(generate_series(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM b) SELECT year(g.day)::INT AS year, count(k.day) AS available, count(*) AS expected, count(*) - count(k.day) AS missing, (SELECT count(*) FROM n WHERE NOT field) AS ignored, (SELECT count(*) FROM k) = (SELECT count(*) FROM g) AS passes FROM g LEFT JOIN k ON g.day=k.day GROUP BY 1")
def archive_inventory(spark, d):
    """A listing of daily keys among other entries, which are counted and ignored."""
    name = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.when(F.col("o_orderstatus") == "P", ":0000:field").otherwise(".log"))
    names = B.table(spark, d, "orders").select(name.alias("name"))
    days = names.select(F.try_to_timestamp(F.regexp_extract("name", r"^(\d{8}):0000:", 1), F.lit("yyyyMMdd")).cast("date").alias("day"))
    k = days.where("day is not null").distinct()
    other = days.agg(F.count_if(F.col("day").isNull()).alias("ignored"))
    g = k.agg(F.min("day").alias("a"), F.max("day").alias("z")).select(F.explode(F.expr("sequence(a, z, interval 1 day)")).alias("day"))
    years = g.join(k.withColumn("have", F.lit(1)), "day", "left").groupBy(F.year("day").alias("year")).agg(F.count("have").alias("available"), F.count("*").alias("expected"), (F.count("*") - F.count("have")).alias("missing"))
    gaps = F.sum("missing").over(Window.partitionBy(F.lit(1)))  # a row a year
    return years.crossJoin(F.broadcast(other)).withColumn("passes", gaps == 0)


@query("archive_rollup", "WITH y AS (SELECT year(o_orderdate)::INT AS year, count(*) AS records, count(DISTINCT o_orderdate) AS days, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1) SELECT *, date_diff('day', make_date(year,1,1), make_date(year+1,1,1))::INT AS expected, (date_diff('day', make_date(year,1,1), make_date(year+1,1,1)) - days)::BIGINT AS missing FROM y")
def archive_rollup(spark, d):
    y = B.table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("records"), F.count_distinct("o_orderdate").alias("days"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    expected = F.datediff(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)), F.make_date("year", F.lit(1), F.lit(1)))
    return y.withColumn("expected", expected).withColumn("missing", F.col("expected") - F.col("days"))


@query("ready_pairs", f"WITH {B.CATALOG} SELECT segment, valid, bool_or(priority='1-URGENT') AS forcing, bool_or(priority='2-HIGH') AS boundary, bool_or(priority='1-URGENT') AND bool_or(priority='2-HIGH') AS ready FROM catalog WHERE priority IN ('1-URGENT','2-HIGH') GROUP BY 1,2")
def ready_pairs(spark, d):
    c = B.catalog(spark, d).where("priority in ('1-URGENT', '2-HIGH')")
    f, b = F.bool_or(F.col("priority") == "1-URGENT"), F.bool_or(F.col("priority") == "2-HIGH")
    return c.groupBy("segment", "valid").agg(f.alias("forcing"), b.alias("boundary"), (f & b).alias("ready"))


@query("retention_plan", f"WITH {B.CATALOG}, f AS (SELECT segment, coalesce(min(record) FILTER (NOT complete), 9999999999) AS frontier, max(record) AS newest FROM catalog GROUP BY 1) SELECT segment, count(*) AS removable, round(sum(bytes),2)+0.0 AS freed FROM catalog JOIN f USING (segment) WHERE record < frontier AND record <> newest AND priority <> '5-LOW' GROUP BY 1")
def retention_plan(spark, d):
    c = B.catalog(spark, d)
    f = c.groupBy("segment").agg(F.coalesce(F.min(F.when(~F.col("complete"), F.col("record"))), F.lit(9999999999)).alias("frontier"), F.max("record").alias("newest"))
    live = c.where("priority = '5-LOW'").select("record").distinct()
    out = c.join(f, "segment").where("record < frontier and record != newest").join(live, "record", "left_anti")
    return out.groupBy("segment").agg(F.count("*").alias("removable"), (F.round(F.sum("bytes"), 2) + F.lit(0.0)).alias("freed"))
