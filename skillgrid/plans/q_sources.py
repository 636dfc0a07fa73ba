"""Queries of the sources: files are derived from the tables, written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from skillgrid.operators import digest as digests
from skillgrid.operators import quality
from skillgrid.plans import bindings as B
from skillgrid.plans.q_campaign import ROWS, station_rows
from skillgrid.plans.registry import query, r6, rounded, sql6
from skillgrid.sources import clustered, fields, lists, products, references, station_files
from skillgrid.session import shared_path, shuffled

#: What the station file holds: some speeds are negative, some directions impossible, one site moves and one lies outside the range.
SITE = "'S'||(user_id%25)"
SPEED = "CASE WHEN event_id%11<>0 THEN CASE WHEN event_id%89=0 THEN -value ELSE value END END"
TURN = "CASE WHEN event_id%97=0 THEN 400.0 ELSE ((event_id*37)%360)::DOUBLE END"
STATION = f"sf AS (SELECT {SITE} AS meas_site, event_id, date_trunc('second', ts) AS valid, {SPEED} AS s, {TURN} AS a, event_id%6 AS qs, (event_id+2)%6 AS qa, CASE WHEN user_id%25=7 THEN 95.0 ELSE 46.0+(user_id%25)*0.05 + CASE WHEN user_id%25=3 AND event_id%2=0 THEN 0.01 ELSE 0 END END AS latitude FROM events)"


def station_csv(spark, d) -> str:
    """Events as station files: two parameters with their pi, mi, dq and uc; every file begins with the header."""
    e = B.table(spark, d, "events")
    n = F.col("user_id") % 25
    site = F.concat(F.lit("S"), n.cast("string"))
    latitude = F.when(n == 7, 95.0).otherwise(46.0 + n * 0.05 + F.when((n == 3) & (F.col("event_id") % 2 == 0), 0.01).otherwise(0.0))
    speed = F.when(F.col("event_id") % 89 == 0, -F.col("value")).otherwise(F.col("value"))
    turn = F.when(F.col("event_id") % 97 == 0, 400.0).otherwise(((F.col("event_id") * 37) % 360).cast("double"))
    cols = [site, F.date_format("ts", "yyyyMMddHHmmss"), F.round(latitude, 4).cast("string"), F.lit("7.5"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 11 == 0, "").otherwise(speed.cast("string")), F.lit("0"), F.lit("0"), (F.col("event_id") % 6).cast("string"), F.lit("1"), turn.cast("string"), F.lit("0"), F.lit("0"), ((F.col("event_id") + 2) % 6).cast("string"), F.lit("1")]
    path = shared_path(spark, "station-file")
    station_files.write_lines(e.select(F.concat_ws(";", *cols).alias("line")), "meas_site;termin;latitude;longitude;nr;fkl010h0;pi;mi;dq;uc;dkl010h0;pi;mi;dq;uc", path)
    return path


@query("obs_scan", f"WITH {STATION} SELECT meas_site, count(s) FILTER (qs>=4) AS accepted, count(s) FILTER (qs<4) AS rejected, round(sum(s) FILTER (qs>=4),6)+0.0 AS total FROM sf GROUP BY 1")
def obs_scan(spark, d):
    long = station_files.read_long(spark, station_csv(spark, d)).where("parameter = 'fkl010h0'")
    good = station_files.accepted(long).groupBy("meas_site").agg(F.count("*").alias("accepted"), F.sum("value").alias("total"))
    return rounded(good.join(station_files.rejected(long, ["meas_site"]), "meas_site").select("meas_site", "accepted", "rejected", "total"))


@query("wind_obs_scan", f"WITH {STATION} SELECT meas_site, 'fkl010h0' AS parameter, count(s) AS finite FROM sf GROUP BY 1 UNION ALL SELECT meas_site, 'dkl010h0', count(a) FROM sf GROUP BY 1")
def wind_obs_scan(spark, d):
    return station_files.read_long(spark, station_csv(spark, d)).groupBy("meas_site", "parameter").agg(F.count("value").alias("finite"))


def _pairs(spark, d):
    long = station_files.accepted(station_files.read_long(spark, station_csv(spark, d)))
    return long.groupBy("meas_site", "valid", "nr").agg(F.max(F.when(F.col("parameter") == "fkl010h0", F.col("value"))).alias("s"), F.max(F.when(F.col("parameter") == "dkl010h0", F.col("value"))).alias("a")).where("s is not null and a is not null")


@query("wind_vec_scan", f"WITH {STATION}, p AS (SELECT *, count(*) OVER (PARTITION BY meas_site, valid) AS n FROM sf WHERE s IS NOT NULL AND qs>=4 AND qa>=4), v AS (SELECT *, CASE WHEN s<0 THEN 'speed' WHEN a<0 OR a>360 THEN 'direction' WHEN n>1 THEN 'duplicate' END AS violation FROM p) SELECT meas_site, event_id::BIGINT AS nr, CASE WHEN violation IS NULL THEN round(-s*sin(radians(a)),6)+0.0 END AS u, CASE WHEN violation IS NULL THEN round(-s*cos(radians(a)),6)+0.0 END AS v, violation FROM v")
def wind_vec_scan(spark, d):
    """Vectors of the strict reader; what it would stop at keeps its row with the reason and no vector."""
    out = station_files.vectors(_pairs(spark, d), ["meas_site", "valid"], "s", "a")
    return rounded(out.select("meas_site", F.col("nr").cast("long").alias("nr"), "u", "v", "violation"))


@query("wind_vec_scan_ctl", f"WITH {STATION} SELECT meas_site, count(*) FILTER (s IS NOT NULL AND least(qs,qa)>=4) AS used, count(*) FILTER (NOT (s IS NOT NULL AND least(qs,qa)>=4)) AS rejected FROM sf GROUP BY 1")
def wind_vec_scan_ctl(spark, d):
    long = station_files.read_long(spark, station_csv(spark, d))
    both = long.groupBy("meas_site", "nr").agg(F.count("value").alias("n"), F.min("dq").alias("q"))
    ok = (F.col("n") == 2) & (F.col("q") >= 4)
    return both.groupBy("meas_site").agg(F.count_if(ok).alias("used"), F.count_if(~ok).alias("rejected"))


@query("station_dim", f"WITH {STATION} SELECT meas_site, min(round(latitude,4))::DOUBLE AS latitude, 7.5::DOUBLE AS longitude, count(DISTINCT round(latitude,4)) > 1 AS conflict, NOT (min(latitude) BETWEEN -90 AND 90 AND max(latitude) BETWEEN -90 AND 90) AS out_of_range FROM sf GROUP BY 1")
def station_dim(spark, d):
    """One row a site, and whether its place changes or isn't one."""
    long = station_files.read_long(spark, station_csv(spark, d)).withColumns({"latitude": F.col("latitude").try_cast("double"), "longitude": F.col("longitude").try_cast("double")})
    return station_files.stations(long, "meas_site", "latitude", "longitude").orderBy("meas_site")


@query("ref_scan", f"WITH {B.ENDPOINTS} SELECT station, hour AS valid, {sql6('value')}, CASE WHEN extract(hour FROM hour)=5 THEN 2 ELSE 1 END::BIGINT AS copies, extract(hour FROM hour)=5 AS violation FROM endpoints")
def ref_scan(spark, d):
    """A reference file read back; a time that a station has twice is a violation."""
    path = shared_path(spark, "reference-csv")
    rows = B.endpoints(spark, d).select("station", F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("valid"), "value")
    products.write_csv(rows.unionByName(rows.where("substring(valid, 12, 2) = '05'")), path)
    back = spark.read.schema("station long, valid string, value double").option("header", True).csv(path)
    once = back.groupBy("station", "valid").agg(F.min("value").alias("value"), F.count("*").alias("copies"))
    return rounded(once.select("station", F.to_timestamp("valid").cast("timestamp_ntz").alias("valid"), "value", "copies", (F.col("copies") > 1).alias("violation")))


KM_SITE = "sqrt(((s.lat-g.lat)*110.57)*((s.lat-g.lat)*110.57)+((s.lon-g.lon)*111.32*cos(radians(s.lat)))*((s.lon-g.lon)*111.32*cos(radians(s.lat))))"


@query("station_reference_export", f"WITH {B.GRID}, {B.SITES}, p AS (SELECT site AS station, g.*, {KM_SITE} AS km, row_number() OVER (PARTITION BY site ORDER BY {KM_SITE}, g.y, g.x) AS n FROM sites s, grid g), h AS (SELECT p.*, hour, CASE WHEN size = 7 AND hour = 2 THEN NULL ELSE 280+size*0.1+hour END::DOUBLE AS t, (90000-size*10.0)::DOUBLE AS ps, CASE WHEN size = 11 AND hour = 2 THEN 0.0 ELSE size*0.5*hour END::DOUBLE AS total FROM p, (SELECT unnest(range(3)) AS hour) hh WHERE n = 1), e AS (SELECT *, 611.2*exp(17.67*(t-5-273.15)/((t-5-273.15)+243.5)) AS vp, total - lag(total) OVER (PARTITION BY station ORDER BY hour) AS rain FROM h) SELECT station, hour::INT AS hour, y, x, round(km,6)+0.0 AS km, round(height,6)+0.0 AS terrain, round(t,6)+0.0 AS t, round(ps,6)+0.0 AS p, round(0.622*vp/(ps-(1-0.622)*vp),6)+0.0 AS q, round((size*0.1)::DOUBLE,6)+0.0 AS u, round((2.0-hour)::DOUBLE,6)+0.0 AS v, round((size*0.01)::DOUBLE,6)+0.0 AS snow, round(greatest(coalesce(rain, 0), 0),6)+0.0 AS precipitation, CASE WHEN km > 0.3 THEN 'too_far' WHEN t IS NULL THEN 'missing' WHEN rain < -0.01 THEN 'decreasing' END AS violation FROM e")
def station_reference_export(spark, d):
    """Three hours at every station from the native cell next to it, written as CSV and read back: humidity from the dew point, precipitation between hours; stations too far off, a missing field and a falling sum are marked."""
    g, size, hour = B.grid(spark, d), F.col("size"), F.col("hour")
    hours = g.select("y", "x", "size", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("hour"))
    t = F.when(~((size == 7) & (hour == 2)), 280 + size * 0.1 + hour)
    current = hours.select(hour.alias("time"), "y", "x", t.alias("t"), (t - 5).alias("td"), (90000 - size * 10.0).alias("p"), (size * 0.1).alias("u"), (2.0 - hour).alias("v"), (size * 0.01).alias("snow"))
    total = hours.select(hour.alias("time"), "y", "x", F.when((size == 11) & (hour == 2), 0.0).otherwise(size * 0.5 * hour).alias("total"))
    sites = B.sites(spark, d).select(F.col("site").alias("station"), "lat", "lon")
    rows = references.station_reference(sites, g.select("y", "x", "lat", "lon", F.col("height").alias("terrain")), current, total, current.select("time").distinct(), 0.3)
    path = shared_path(spark, "station-reference")
    products.write_csv(rows.withColumnRenamed("time", "hour"), path)
    names = "station long, hour int, y int, x int, km double, terrain double, t double, p double, q double, u double, v double, snow double, precipitation double, violation string"
    return rounded(spark.read.schema(names).option("header", True).csv(path))


@query("time_decode", "SELECT event_id, CASE WHEN microsecond(ts) % 1000000 <= 500000 THEN date_trunc('second', ts) ELSE ts END AS valid, microsecond(ts) % 1000000 > 500000 AS violation, date_trunc('second', ts) AS surface_valid FROM events")
def time_decode(spark, d):
    """Times snapped by half a second, for which more is a violation in a campaign, and by a second."""
    from skillgrid.functions.text import snapped

    e = B.table(spark, d, "events")
    off = F.unix_micros(F.col("ts").cast("timestamp")) % 1000000
    return e.select("event_id", snapped(F.col("ts"), 0.5).cast("timestamp_ntz").alias("valid"), (off > 500000).alias("violation"), snapped(F.col("ts"), 1.0).cast("timestamp_ntz").alias("surface_valid"))


@query("report_scan", f"WITH {ROWS} SELECT station, season, metric, CASE WHEN station%7<>0 THEN pair_count END AS pair_count, CASE WHEN station%7<>0 THEN round(candidate_rmse,6)+0.0 END AS candidate_rmse, CASE WHEN station%7=0 THEN 'issues' END AS rejected FROM sr")
def report_scan(spark, d):
    """Nested reports read back; those that name issues or lack a required field are rejected with the reason."""
    path = shared_path(spark, "report-json")
    entry = F.map_from_entries(F.collect_list(F.struct("metric", F.struct("pair_count", F.col("candidate_rmse").alias("rmse")))))
    reports = station_rows(spark, d).groupBy("station", "season").agg(entry.alias("metrics")).withColumn("issues", F.when(F.col("station") % 7 == 0, F.array(F.lit("late"))).otherwise(F.array().cast("array<string>")))
    products.write_json(reports, path)
    back = spark.read.schema("station long, season string, metrics map<string, struct<pair_count: long, rmse: double>>, issues array<string>").json(path)
    rejected = F.when(F.col("station").isNull() | F.col("season").isNull() | F.col("metrics").isNull(), "incomplete").when(F.size("issues") > 0, "issues")
    rows = back.withColumn("rejected", rejected).select("station", "season", "rejected", F.explode("metrics").alias("metric", "s"))
    fine = lambda c: F.when(F.col("rejected").isNull(), c)
    return rounded(rows.select("station", "season", "metric", fine(F.col("s.pair_count")).alias("pair_count"), fine(F.col("s.rmse")).alias("candidate_rmse"), "rejected"))


@query("file_catalog", "SELECT o_custkey AS path, count(*) AS times, min(o_orderdate) AS first, max(o_orderdate) AS last, count(*) - count(DISTINCT o_orderdate) AS duplicates FROM orders GROUP BY 1")
def file_catalog(spark, d):
    return B.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("times"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), (F.count("*") - F.count_distinct("o_orderdate")).alias("duplicates"))


@query("list_scan", "SELECT (row_number() OVER (ORDER BY c_mktsegment DESC) - 1)::INT AS place, c_mktsegment AS entry, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS keys FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def list_scan(spark, d):
    """A list of quoted entries with blank lines between them, in its own order; the same as keys, with comments, counted."""
    names = B.table(spark, d, "customer").groupBy().agg(F.sort_array(F.collect_set("c_mktsegment"), asc=False).alias("k"))  # five segments
    path, keys = shared_path(spark, "path-list"), shared_path(spark, "key-list")
    line = lambda pad: F.transform("k", lambda x: F.concat(F.lit('  "'), x, F.lit(pad)))
    names.select(F.array_join(line('"\n\n'), "\n").alias("value")).write.text(path)
    names.select(F.concat(F.lit("# note\n"), F.array_join(line('"'), "\n")).alias("value")).write.text(keys)
    n = names.select(F.size("k")).first()[0]
    return lists.ordered_list(spark, path).select("place", "entry", F.lit(lists.key_list(spark, keys, n).count()).alias("keys"))


#: A message for each event: five fields of which one has a single level, some with other units, kinds, times, steps or grids than they should have.
MESSAGES = "m AS (SELECT event_type AS name, CASE WHEN event_id % 97 = 5 THEN 9 ELSE 1 END AS param, (event_id % 7)::INT AS level, CASE WHEN event_id % 31 = 2 THEN 'K' ELSE 'm s-1' END AS units, CASE WHEN event_id % 37 = 3 THEN 'surface' ELSE 'hybrid' END AS level_type, CASE WHEN event_id % 41 = 4 THEN 'accum' ELSE 'instant' END AS step_type, TIMESTAMP '2024-01-01' - INTERVAL 6 HOUR * (event_id % 43 = 1)::INT AS reference, TIMESTAMP '2024-01-01 03:00:00' + INTERVAL 1 HOUR * (event_id % 47 = 6)::INT AS valid, CASE WHEN event_id % 53 = 7 THEN 4 WHEN event_id % 43 = 1 THEN 9 WHEN event_id % 47 = 6 THEN 4 ELSE 3 END AS step, CASE WHEN event_id % 59 = 8 THEN '' WHEN event_id % 61 = 9 THEN 'other' ELSE 'grid' END AS grid FROM events WHERE event_type <> 'click' OR event_id % 7 <> 2)"
SPEC = [("view", 1, "m/s-1", "hybrid", 5), ("click", 1, "m s-1", "hybrid", 6), ("purchase", 1, "m*s-1", "hybrid", 6), ("error", 1, "m s-1", "hybrid", 1), ("refund", 1, "K", "hybrid", 2)]
SPEC_SQL = "spec(name, param, levels) AS (VALUES " + ", ".join(f"('{n}', {p}, {k})" for n, p, _, _, k in SPEC) + ")"
WRONG = "CASE WHEN levels IS NULL THEN 'unexpected' WHEN units = 'K' THEN 'units' WHEN level_type = 'surface' THEN 'level_type' WHEN step_type = 'accum' THEN 'step_type' WHEN valid <> TIMESTAMP '2024-01-01 03:00:00' THEN 'valid_time' WHEN date_diff('hour', reference, valid) <> step THEN 'step' WHEN grid = '' THEN 'grid' WHEN reference <> TIMESTAMP '2024-01-01' OR grid = 'other' THEN 'mixed' END"


def messages(spark, d):
    e = B.table(spark, d, "events").where("event_type <> 'click' or event_id % 7 <> 2")
    n = lambda k, at, yes, no: F.when(F.col("event_id") % k == at, yes).otherwise(no)
    hour = lambda text, h: F.lit(text).cast("timestamp") + F.make_dt_interval(F.lit(0), h)
    step = F.when(F.col("event_id") % 53 == 7, 4).otherwise(n(43, 1, 9, n(47, 6, 4, 3)))
    return e.select(F.col("event_type").alias("name"), n(97, 5, 9, 1).alias("param"), (F.col("event_id") % 7).cast("int").alias("level"), n(31, 2, "K", "m s-1").alias("units"), n(37, 3, "surface", "hybrid").alias("level_type"), n(41, 4, "accum", "instant").alias("step_type"), hour("2024-01-01", n(43, 1, -6, 0)).alias("reference"), hour("2024-01-01 03:00:00", n(47, 6, 1, 0)).alias("valid"), step.alias("step"), n(59, 8, "", n(61, 9, "other", "grid")).alias("grid"))


def message_spec(spark):
    return spark.createDataFrame(SPEC, "name string, param int, units string, level_type string, levels int")


@query("inventory_messages", f"WITH {MESSAGES}, {SPEC_SQL}, w AS (SELECT name, unnest(CASE WHEN levels = 1 THEN [0] ELSE range(1, levels+1) END)::INT AS level FROM spec), c AS (SELECT m.name, CASE WHEN any_n.levels = 1 THEN 0 ELSE level END AS level, {WRONG.replace('levels IS', 'm.levels IS')} AS violation FROM (SELECT m.*, spec.levels FROM m LEFT JOIN spec USING (name, param)) m LEFT JOIN spec any_n ON any_n.name = m.name), f AS (SELECT name, level, count(*) AS messages, count(violation) AS violations FROM c GROUP BY 1,2) SELECT name, level::INT AS level, coalesce(messages, 0) AS messages, CASE WHEN w.name IS NULL THEN 'extra' WHEN messages IS NULL THEN 'missing' WHEN messages > 1 THEN 'duplicate' ELSE 'one' END AS state, coalesce(violations, 0) AS violations FROM (SELECT *, TRUE AS want FROM w) w FULL JOIN f USING (name, level)".replace("WHEN w.name IS NULL", "WHEN want IS NULL"))
def inventory_messages(spark, d):
    """Every level that is expected or there, how many messages it has, and how many of them aren't as they should be."""
    return references.inventory(messages(spark, d), message_spec(spark), "2024-01-01 03:00:00")


@query("message_violations", f"WITH {MESSAGES}, {SPEC_SQL} SELECT name, {WRONG} AS violation, count(*) AS messages FROM m LEFT JOIN spec USING (name, param) GROUP BY 1, 2")
def message_violations(spark, d):
    """What is wrong with the messages of each field: units, kinds, times, steps, grids, and what isn't common to most."""
    found = references.message_violations(messages(spark, d), message_spec(spark), "2024-01-01 03:00:00")
    return found.groupBy("name", "violation").agg(F.count("*").alias("messages"))


@query("json_csv_sink", f"WITH {ROWS} SELECT station, season, metric, {sql6('delta')}, outcome FROM sr")
def json_csv_sink(spark, d):
    path = shared_path(spark, "rows-csv")
    products.write_csv(station_rows(spark, d).select("station", "season", "metric", "delta", "outcome"), path)
    return rounded(spark.read.schema("station long, season string, metric string, delta double, outcome string").option("header", True).csv(path))


@query("compact_lossless", "SELECT 0::BIGINT AS only_left, 0::BIGINT AS only_right, TRUE AS smaller, count(*) AS rows_ FROM lineitem")
def compact_lossless(spark, d):
    """A product sorted and compressed harder holds the same rows in fewer bytes."""
    a, b = shared_path(spark, "product"), shared_path(spark, "product-zstd")
    products.write_product(B.table(spark, d, "lineitem"), a)
    products.rewrite_lossless(spark, a, b, "l_shipdate", "l_orderkey")
    smaller = products.size_of(spark, b) < products.size_of(spark, a)
    left, right = spark.read.parquet(a), spark.read.parquet(b)
    return products.same_rows(left, right).withColumn("smaller", F.lit(smaller)).crossJoin(F.broadcast(right.agg(F.count("*").alias("rows_"))))


_LIFE = {"invariant": "static", "epoch": "external", "climatology": "external", "time_series": "external", "initial_only": "initial"}
_FIELDS = [(f, _LIFE[l], l == "epoch") for f, l, *_ in B.FIELDS]
_OF = "[" + ", ".join(f"'{f}'" for f, *_ in _FIELDS) + f"][p_partkey % {len(_FIELDS)} + 1]"


@query("product_partition", f"WITH r AS (SELECT * FROM (VALUES {', '.join(f'({f!r}, {p!r}, {e})' for f, p, e in _FIELDS)}) t(field, product, epoch)), c AS (SELECT {_OF} AS field, p_retailprice AS height FROM part) SELECT product, field, CASE WHEN epoch THEN 2020 END AS epoch, count(*) AS cells, round(sum(height),6)+0.0 AS total FROM c JOIN r USING (field) GROUP BY 1,2,3")
def product_partition(spark, d):
    """One wide source split into static, external and initial products by the lifetime of its fields; epoch fields get an epoch."""
    p = B.table(spark, d, "part")
    cells = p.select(F.element_at(F.array(*[F.lit(f) for f, *_ in _FIELDS]), (F.col("p_partkey") % len(_FIELDS) + 1).cast("int")).alias("name"), F.col("p_retailprice").alias("height"))
    life = F.create_map(*[F.lit(x) for pair in _LIFE.items() for x in pair])
    of = fields.registry(B.field_table(spark)).select("name", "field", life[F.col("lifetime")].alias("product"), F.when(F.col("lifetime") == "epoch", F.lit(2020)).alias("epoch"))
    path = shared_path(spark, "products")
    products.write_product(cells.join(F.broadcast(of), "name").drop("name"), path, "product")
    return rounded(spark.read.parquet(path).groupBy("product", "field", "epoch").agg(F.count("*").alias("cells"), F.sum("height").alias("total")))


_EDGE = "least(x-x0, x1-x, y-y0, y1-y)"


@query("boundary_sink", f"WITH {B.GRID}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM grid) SELECT y AS row_, x AS col_, round(cos(0.5*pi()*{_EDGE}/5.0)*cos(0.5*pi()*{_EDGE}/5.0),6)+0.0 AS weight, height FROM grid, b WHERE {_EDGE} < 5")
def boundary_sink(spark, d):
    from skillgrid.functions.physics import relaxation_weight
    from skillgrid.operators.raster import edge_distance

    path = shared_path(spark, "boundary")
    frame = edge_distance(B.grid(spark, d)).where("cells < 5")
    products.write_product(frame.select(F.col("y").alias("row_"), F.col("x").alias("col_"), relaxation_weight(F.col("cells"), 5.0).alias("weight"), "height"), path)
    return rounded(spark.read.parquet(path))


#: Records of three times and two levels; those of other times have one thing in them that isn't right.
_RECORDS = f"""WITH {B.GRID}, t AS (SELECT unnest(range(8))::INT AS hour), n AS (SELECT count(*) AS cells FROM grid)"""
_DEFECTS = {3: "grid", 4: "geometry", 5: "sst_cells", 6: "static_identity", 7: "sst_range"}


def record_parts(spark, d):
    """State, static cells and levels, sea surface and what the states say of themselves, of eight times; defects from the fourth on."""
    g = B.grid(spark, d).repartition("y", "x")  # its times and levels are made where the cells are
    hours = spark.range(8).select(F.col("id").cast("int").alias("hour"), F.timestamp_seconds(1704067200 + 3600 * F.col("id")).alias("valid"))
    levels = g.select("y", "x", "height", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    static_levels = levels.select("y", "x", "k", (F.col("height") + 500.0 * F.col("k")).alias("HHL"), (F.col("height") + 500.0 * F.col("k") + 250).alias("HFL"))
    s = g.select("y", "x", "lat", "lon", "size").join(shuffled(static_levels), ["y", "x"]).crossJoin(F.broadcast(hours))
    one = (F.col("y") == 1) & (F.col("x") == 4)
    state = s.select("valid", "y", "x", "k", F.when((F.col("hour") == 3) & one, F.col("lat") + 1e-9).otherwise(F.col("lat")).alias("lat"), "lon", F.when((F.col("hour") == 4) & one, F.col("HHL") - 1).otherwise(F.col("HHL")).alias("HHL"), "HFL", (290.0 - 6 * F.col("k") + F.col("hour") + F.col("size") * 0.1).alias("T"))
    sst = g.select("y", "x", "size").crossJoin(F.broadcast(hours)).where(~((F.col("hour") == 5) & one)).select("valid", "y", "x", F.when((F.col("hour") == 7) & (F.col("size") == 3), 90.0).otherwise(280.0 + F.col("size") * 0.5 + F.col("hour")).alias("SST"))
    digest = digests.fingerprint(static_levels, ["y", "x", "k", "HHL", "HFL"])
    own = {"static_sha256": F.when(F.col("hour") == 6, F.lit("another")).otherwise(F.lit(digest)), **{k: F.lit(v) for k, v in clustered.SAID.items()}}
    said = hours.select("valid", F.explode(F.map_from_arrays(F.array(*map(F.lit, own)), F.array(*own.values()))).alias("key", "value"))
    return dict(state=state, static=g.select("y", "x", "lat", "lon", "land"), static_levels=static_levels, sst=sst, said=said, static_digest=digest)


@query("forcing_record_sink", f"{_RECORDS} SELECT hour, count(*) AS cells, round(avg(290.0 - 6*k + hour + size*0.1),6)+0.0 AS mean, count(*) FILTER (NOT land) AS water, round(avg(CASE WHEN NOT land THEN 280.0 + size*0.5 + hour END),6)+0.0 AS sst FROM grid, t, (SELECT unnest(range(2))::INT AS k) WHERE hour < 3 GROUP BY 1")
def forcing_record_sink(spark, d):
    """The records that fit are written by time and tile, and read back; the sea surface is that of water alone."""
    p = record_parts(spark, d)
    early = {n: p[n].where("valid < timestamp'2024-01-01 03:00:00'") for n in ("state", "sst", "said")}
    path = shared_path(spark, "records")
    clustered.write_records(**p | early, path=path, side=16)
    rows = clustered.read(spark, path, "T", "SST")
    return rounded(rows.groupBy(F.hour("valid").alias("hour")).agg(F.count("*").alias("cells"), F.avg("T").alias("mean"), F.count("SST").alias("water"), F.avg("SST").alias("sst")))


@query("forcing_record_report", f"{_RECORDS}, w AS (SELECT * FROM (VALUES {', '.join(f'({h}, {v!r})' for h, v in _DEFECTS.items())}) v(hour, violation)) SELECT t.hour, 2*cells AS cells, coalesce(violation, '') AS violations FROM t LEFT JOIN w USING (hour), n")
def forcing_record_report(spark, d):
    """Which times can't become a record, and why."""
    return clustered.record_report(**record_parts(spark, d)).select(F.hour("valid").alias("hour"), "cells", F.array_join("violations", ",").alias("violations"))


@query("depth_stack", f"WITH {B.PROFILE} SELECT column_id, count(*) AS layers, string_agg(value::INT, ',' ORDER BY z) AS stack FROM profile GROUP BY 1")
def depth_stack(spark, d):
    from skillgrid.operators.columns import as_arrays

    a = as_arrays(B.profile(spark, d), "column_id", "z", "value")
    return a.select("column_id", F.size("value").cast("long").alias("layers"), F.concat_ws(",", F.transform("value", lambda v: v.cast("int").cast("string"))).alias("stack"))


@query("state_sink", f"WITH {B.GRID} SELECT class, count(*) AS cells, round(sum(height*1.5),6)+0.0 AS total FROM grid GROUP BY class")
def state_sink(spark, d):
    path = shared_path(spark, "state")
    products.write_product(B.grid(spark, d).withColumn("t", F.col("height") * 1.5), path)
    return rounded(spark.read.parquet(path).groupBy("class").agg(F.count("*").alias("cells"), F.sum("t").alias("total")))


@query("sequence_manifest", "WITH r AS (SELECT o_orderdate AS valid, count(*) AS n FROM orders GROUP BY 1) SELECT valid, n, sha256(strftime(valid,'%Y-%m-%d')||':'||n) AS digest FROM r")
def sequence_manifest(spark, d):
    path = shared_path(spark, "manifest")
    r = B.table(spark, d, "orders").groupBy(F.col("o_orderdate").alias("valid")).agg(F.count("*").alias("n"))
    products.write_json(r.withColumn("digest", F.sha2(F.concat_ws(":", F.date_format("valid", "yyyy-MM-dd"), F.col("n").cast("string")), 256)), path)
    return spark.read.schema("valid timestamp_ntz, n long, digest string").json(path)


@query("weights_io", "SELECT count(*) AS targets, 4*count(*) AS written, 0::BIGINT AS different, TRUE AS other_grid_refused, TRUE AS other_method_refused FROM part")
def weights_io(spark, d):
    """Weights written with the digests of their grids, read back and compared row by row; one moved cell of either grid, or another method, is refused."""
    from skillgrid.operators import regrid
    from skillgrid.plans.q_grid import targets
    from skillgrid.plans.q_surface import cells, inverse_distance

    path, source, own = shared_path(spark, "weights"), cells(spark, d), targets(spark, d)
    w = inverse_distance(spark, d)
    regrid.save_weights(w, path, source, own, "inverse_distance", 0.1)
    back = regrid.load_weights(spark, path, source, own, "inverse_distance")

    def refused(*given) -> bool:
        try:
            regrid.load_weights(spark, path, *given)
        except ValueError:
            return True
        return False

    moved = source.withColumn("lat", F.when(F.col("donor") == 107, F.col("lat") + 1e-12).otherwise(F.col("lat")))
    shifted = own.withColumn("lon", F.when(F.col("target") == 3, F.col("lon") + 1e-12).otherwise(F.col("lon")))
    other = refused(moved, own) and refused(source, shifted)
    j = w.select("target", "rank", "donor", F.col("weight").alias("a")).join(back.select("target", "rank", "donor", F.col("weight").alias("b")), ["target", "rank", "donor"], "full")
    return j.agg(F.count_distinct("target").alias("targets"), F.count("b").alias("written"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("different"), F.lit(other).alias("other_grid_refused"), F.lit(refused(source, own, "kernel")).alias("other_method_refused"))


@query("bit_patterns", "SELECT count(*) AS cells, 0::BIGINT AS bits_different FROM part")
def bit_patterns(spark, d):
    p = B.table(spark, d, "part").select(F.lit("price").alias("var"), F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("value"))
    return quality.exact_compare(p, p, ["k"]).select("cells", "bits_different")


@query("file_index", "SELECT o_custkey AS path, o_orderdate AS valid, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::INT AS place, count(*) OVER (PARTITION BY o_custkey, o_orderdate) > 1 AS violation FROM orders")
def file_index(spark, d):
    """Where each time of each file stands; a time that a file has twice is a violation."""
    from pyspark.sql import Window

    o = B.table(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderdate").alias("valid"), "o_orderkey")
    place = F.row_number().over(Window.partitionBy("path").orderBy("valid", "o_orderkey")) - 1
    return o.select("path", "valid", place.alias("place"), (F.count("*").over(Window.partitionBy("path", "valid")) > 1).alias("violation"))
