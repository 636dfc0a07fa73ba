"""Queries of the data-quality and comparison family."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skillgrid.operators import quality as Q
from skillgrid.operators import digest, raster, temporal
from skillgrid.plans import bindings as B
from skillgrid.plans.q_grid import S121
from skillgrid.plans.q_time import VECTORS, vectors
from skillgrid.plans.registry import query, r6, rounded, sql6
from skillgrid.sources import fields

CELLS = "cells AS (SELECT 'quantity' AS var, l_orderkey AS a, l_partkey AS b, l_suppkey AS c, l_linenumber AS e, l_shipdate AS t, l_quantity AS value FROM lineitem UNION ALL SELECT 'discount', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_discount FROM lineitem)"


def cells(spark, d):
    li = B.table(spark, d, "lineitem")
    one = lambda n, c: F.struct(F.lit(n).alias("var"), F.col(c).alias("value"))
    return li.select(F.col("l_orderkey").alias("a"), F.explode(F.array(one("quantity", "l_quantity"), one("discount", "l_discount"))).alias("x")).select("a", "x.*")


@query("range_rules", f"WITH {CELLS}, r AS (SELECT * FROM (VALUES ('quantity',2.0,49.0),('discount',0.0,0.1)) t(var, lo, hi)) SELECT var, count(*) AS cells, count(*) FILTER (value<lo) AS below, count(*) FILTER (value>hi) AS above, count(*) FILTER (value IS NULL) AS nonfinite, count(*) FILTER (value<lo OR value>hi OR value IS NULL)=0 AS ok FROM cells JOIN r USING (var) GROUP BY var")
def range_rules(spark, d):
    return Q.range_rules(cells(spark, d), spark.createDataFrame([("quantity", 2.0, 49.0), ("discount", 0.0, 0.1)], "var string, lo double, hi double"))


GCELLS = "gc AS (SELECT 'height' AS var, y, x, height AS value FROM grid UNION ALL SELECT 'size', y, x, size::DOUBLE FROM grid)"
GCAND = "gd AS (SELECT var, y, x, value + CASE WHEN var='height' AND y=3 THEN 0.25 ELSE 0 END AS value FROM gc WHERE NOT (var='size' AND y=0 AND x=0))"


def grid_cells(spark, d):
    one = lambda n, c: F.struct(F.lit(n).alias("var"), c.alias("value"))
    return B.grid(spark, d).select("y", "x", F.explode(F.array(one("height", F.col("height")), one("size", F.col("size").cast("double")))).alias("v")).select("y", "x", "v.*")


def changed(spark, d):
    g = grid_cells(spark, d).where("not (var = 'size' and y = 0 and x = 0)")
    return g.withColumn("value", F.col("value") + F.when((F.col("var") == "height") & (F.col("y") == 3), 0.25).otherwise(0.0))


@query("numeric_compare", f"WITH {B.GRID}, {GCELLS}, {GCAND}, j AS (SELECT var, r.value AS r, c.value AS c, r.y IS NOT NULL AS in_r, c.y IS NOT NULL AS in_c FROM gc r FULL JOIN gd c USING (var, y, x)) SELECT var, count(*) FILTER (c IS NULL) AS missing, count(*) FILTER (r IS NULL) AS extra, count(*) FILTER (abs(c-r)>0) AS different, count(*) FILTER ((r IS NULL) <> (c IS NULL)) AS mask_different, round(max(abs(c-r)),6)+0.0 AS max_abs, round(max(abs(c-r)/greatest(abs(r),1e-30)),6)+0.0 AS max_rel, round(sqrt(avg((c-r)*(c-r))),6)+0.0 AS rms, round(sqrt(avg(r*r)),6)+0.0 AS reference_rms, min(r) AS reference_min, max(r) AS reference_max, count(*) FILTER (c::FLOAT <> r::FLOAT) AS different_as_float, round(sqrt(avg((c-r)*(c-r)))/sqrt(avg(r*r)),6)+0.0 AS normalized_rms FROM j GROUP BY var")
def numeric_compare(spark, d):
    return rounded(Q.numeric_compare(grid_cells(spark, d), changed(spark, d), ["y", "x"]))


@query("exact_compare", f"WITH {B.GRID}, {GCELLS}, {GCAND} SELECT var, count(*) AS cells, count(*) FILTER ((r.value IS NULL) <> (c.value IS NULL)) AS mask_different, count(*) FILTER (r.value <> c.value) AS bits_different, round(max(abs(r.value-c.value)),6)+0.0 AS max_abs FROM gc r FULL JOIN gd c USING (var, y, x) GROUP BY var")
def exact_compare(spark, d):
    return rounded(Q.exact_compare(grid_cells(spark, d), changed(spark, d), ["y", "x"]))


@query("value_compare", f"WITH {B.GRID}, {GCELLS}, {GCAND} SELECT var, round(max(abs(r.value-c.value)),6)+0.0 AS max_abs, round(avg(abs(r.value-c.value)),6)+0.0 AS mean_abs, round(sqrt(avg((r.value-c.value)*(r.value-c.value))),6)+0.0 AS rms, round(avg((r.value<>c.value)::INT),6)+0.0 AS fraction FROM gc r JOIN gd c USING (var, y, x) GROUP BY var")
def value_compare(spark, d):
    j = grid_cells(spark, d).withColumnRenamed("value", "r").join(changed(spark, d).withColumnRenamed("value", "c"), ["var", "y", "x"])
    e = F.abs(F.col("r") - F.col("c"))
    return rounded(j.groupBy("var").agg(F.max(e).alias("max_abs"), F.avg(e).alias("mean_abs"), F.sqrt(F.avg(e * e)).alias("rms"), F.avg((F.col("r") != F.col("c")).cast("double")).alias("fraction")))


@query("equivalent_terminal", f"WITH {B.CATALOG}, l AS (SELECT segment%2 AS run, valid, priority AS cell, sum(bytes) AS v FROM catalog GROUP BY 1,2,3), t AS (SELECT max(valid) AS valid FROM (SELECT valid FROM l WHERE run=0 INTERSECT SELECT valid FROM l WHERE run=1)), j AS (SELECT t.valid, a.v AS a, b.v AS b FROM t, (SELECT * FROM l, t WHERE run=0 AND l.valid=t.valid) a FULL JOIN (SELECT * FROM l, t WHERE run=1 AND l.valid=t.valid) b USING (cell)) SELECT valid, count(*) AS cells, count(*) FILTER ((a IS NULL) <> (b IS NULL)) AS mask_different, count(*) FILTER (a <> b) AS different, round(max(abs(a-b)),2)+0.0 AS max_abs FROM j GROUP BY valid")
def equivalent_terminal(spark, d):
    """Two runs at their last common time: which cells only one of them has, and how their values differ."""
    l = B.catalog(spark, d).groupBy((F.col("segment") % 2).alias("run"), "valid", F.col("priority").alias("cell")).agg(F.sum("bytes").alias("v"))
    times = l.groupBy("valid").agg(F.count_distinct("run").alias("n")).where("n = 2").agg(F.max("valid").alias("valid"))
    last = l.join(F.broadcast(times), "valid")
    cells = last.groupBy("valid", "cell").agg(F.max(F.when(F.col("run") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("run") == 1, F.col("v"))).alias("b"))
    return cells.groupBy("valid").agg(F.count("*").alias("cells"), F.count_if(F.col("a").isNull() != F.col("b").isNull()).alias("mask_different"), F.count_if(F.col("a") != F.col("b")).alias("different"), (F.round(F.max(F.abs(F.col("a") - F.col("b"))), 2) + F.lit(0.0)).alias("max_abs"))


@query("wind_invariants", f"WITH {B.WIND}, {VECTORS}, m AS (SELECT station, date_trunc('hour', ts) AS hour, max(speed) AS top FROM wind GROUP BY 1,2), l AS (SELECT station, max(hour) AS last FROM ev GROUP BY 1) SELECT station, count(*) AS hours, count(*) FILTER (s + 5e-4 < sqrt(u*u+v*v)) AS mean_below_vector, count(*) FILTER (top + 5e-4 < s) AS max_below_mean, bool_and(s + 5e-4 >= sqrt(u*u+v*v)) FILTER (hour=last) AS last_sound FROM ev JOIN m USING (station, hour) JOIN l USING (station) GROUP BY 1")
def wind_invariants(spark, d):
    """Hours whose mean speed is less than the length of their mean vector, or whose maximum is less than their mean; and whether the last hour is sound."""
    top = B.wind(spark, d).groupBy("station", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.max("speed").alias("top"))
    h = vectors(spark, d).join(top, ["station", "hour"]).withColumn("last", F.max("hour").over(Window.partitionBy("station")))
    length = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    return h.groupBy("station").agg(F.count("*").alias("hours"), F.count_if(F.col("s") + 5e-4 < length).alias("mean_below_vector"), F.count_if(F.col("top") + 5e-4 < F.col("s")).alias("max_below_mean"), F.bool_and(F.when(F.col("hour") == F.col("last"), F.col("s") + 5e-4 >= length)).alias("last_sound"))


def _rule_sql(source: str, rules: dict[str, str], prelude: str) -> str:
    return f"WITH {prelude}, src AS ({source}) " + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (NOT coalesce({r}, FALSE)) AS violations, count(*) FILTER (NOT coalesce({r}, FALSE))=0 AS ok FROM src" for n, r in rules.items())


def _rules(name: str, prelude: str, source_sql: str, rules: dict[str, str], frame) -> None:
    """A contract: named tests over one source; Spark and DuckDB read the same predicates."""

    @query(name, _rule_sql(source_sql, rules, prelude))
    def run(spark, d):
        return Q.check(frame(spark, d), {n: F.expr(r) for n, r in rules.items()})

    run.__doc__ = f"Violations of each rule of ``{name}``."


#: Grid cells with their neighbours' coordinates, how many cells their row has, and a sea surface where there is water.
GRID_CONTEXT = "SELECT *, lat - lag(lat) OVER (PARTITION BY x ORDER BY y) AS dlat, lon - lag(lon) OVER (PARTITION BY y ORDER BY x) AS dlon, height - lag(height) OVER (PARTITION BY y ORDER BY x) AS dh, count(*) OVER (PARTITION BY y) AS row_cells, count(*) OVER (PARTITION BY y, x) AS copies, CASE WHEN NOT land THEN 290.0 - height*0.006 END AS sst, size*0.02 AS snow, 260.0 + size*0.5 AS skin FROM grid"


def grid_context(spark, d):
    x, y = raster.along("x"), raster.along("y")
    g = B.grid(spark, d)
    return g.withColumns({
        "dlat": F.col("lat") - F.lag("lat").over(y), "dlon": F.col("lon") - F.lag("lon").over(x), "dh": F.col("height") - F.lag("height").over(x),
        "row_cells": F.count("*").over(Window.partitionBy("y")), "copies": F.count("*").over(Window.partitionBy("y", "x")),
        "sst": F.when(~F.col("land"), 290.0 - F.col("height") * 0.006), "snow": F.col("size") * 0.02, "skin": 260.0 + F.col("size") * 0.5,
    })


_rules("runtime_contract", B.GRID, GRID_CONTEXT, {"class_present": "class IS NOT NULL", "row_length": "row_cells = 50", "unique_cell": "copies = 1", "finite": "height IS NOT NULL AND skin IS NOT NULL", "snow_bounds": "snow >= 0 AND snow <= 0.9 + 1e-4", "snow_cold": "snow < 0.8 OR skin <= 273.15 + 1e-4", "glacier_dry": "size <> 50 OR land", "skin_range": "skin BETWEEN 180 AND 340"}, grid_context)
LEVELS = "SELECT *, z - lag(z) OVER (PARTITION BY column_id ORDER BY level) AS dz, 100000.0*exp(-z/8000.0) - lag(100000.0*exp(-z/8000.0)) OVER (PARTITION BY column_id ORDER BY level) AS dp FROM profile"


def levels(spark, d):
    w, p = Window.partitionBy("column_id").orderBy("level"), 100000.0 * F.exp(-F.col("z") / 8000.0)
    return B.profile(spark, d).withColumns({"dz": F.col("z") - F.lag("z").over(w), "dp": p - F.lag(p).over(w)})


_rules("support_field_contract", B.GRID, "SELECT *, CASE WHEN NOT land AND size < 4 THEN 1 ELSE 0 END AS unsupported, CASE WHEN NOT land AND size < 4 THEN size*0.2 END AS distance FROM grid", {"only_on_water": "unsupported = 0 OR NOT land", "distance_on_mask": "(unsupported = 1) = (distance IS NOT NULL)", "binary": "unsupported IN (0, 1)"}, lambda s, d: B.grid(s, d).withColumn("unsupported", F.expr("case when not land and size < 4 then 1 else 0 end")).withColumn("distance", F.expr("case when not land and size < 4 then size * 0.2 end")))
_rules("geometry_contract", B.PROFILE, LEVELS, {"thickness": "dz IS NULL OR dz >= 12", "spacing": "z > 0", "jacobian": "dz IS NULL OR dz/100.0 > 0.5"}, levels)
_rules("reuse_contract", B.GRID, "SELECT * FROM grid", {"spacing_matches": "abs(lat - (46 + 0.002*y)) < 1e-9", "window_inside": "y >= 0 AND x BETWEEN 0 AND 49", "range": "height BETWEEN -500 AND 9000"}, B.grid)


@query("closure_contract", f"WITH {B.GRID}, n AS (SELECT y, size%5 AS k, count(*) AS n, sum(count(*)) OVER (PARTITION BY y) AS t FROM grid GROUP BY 1,2), f AS (SELECT y, k, n/t::DOUBLE + CASE WHEN y=3 AND k=0 THEN 0.01 ELSE 0 END AS fraction FROM n) SELECT y, round(sum(fraction),6)+0.0 AS total, round(min(fraction),6)+0.0 AS lo, round(max(fraction),6)+0.0 AS hi, abs(sum(fraction)-1)<=1e-6 AND min(fraction)>=0 AND max(fraction)<=1 AS ok FROM f GROUP BY y")
def closure_contract(spark, d):
    n = B.grid(spark, d).groupBy("y", (F.col("size") % 5).alias("k")).agg(F.count("*").alias("n"))
    f = n.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("y")) + F.when((F.col("y") == 3) & (F.col("k") == 0), 0.01).otherwise(0.0))
    return rounded(Q.closure(f, "y", "fraction"))


_Q = lambda x: "NULL" if x is None else "'" + x + "'"
#: The registry in SQL, a row for each name.
REGISTRY = "reg AS (SELECT * FROM (VALUES " + ", ".join(f"({_Q(n)}, {_Q(f)}, {_Q(l)}, {_Q(s)}, {_Q(u)})" for f, l, s, a, u in B.FIELDS for n in (f, *a)) + ") t(name, field, lifetime, support, runits))"
_NAMES = [n for f, *_, a, _u in B.FIELDS for n in (f, *a)] + ["no_such_field"]
_LIST = "[" + ", ".join(map(_Q, _NAMES)) + "]"
_PLAIN = "regexp_replace(lower({0}), '[\\^\\s*/]', '', 'g')"
DECLARED = f"decl AS (SELECT DISTINCT ['static','external','initial'][p_size % 3 + 1] AS product, {_LIST}[p_partkey % {len(_NAMES)} + 1] AS name, ['m','K','M','kg / m**-3','degrees_north'][p_size % 5 + 1] AS units, [['y','x'],['epoch','y'],['month','y'],['time','y']][p_size % 4 + 1] AS axes FROM part)"


def declared(spark, d):
    pick = lambda names, at: F.element_at(F.array(*names), at)
    p, n = B.table(spark, d, "part"), F.col("p_size")
    axes = [F.array(*map(F.lit, a)) for a in (("y", "x"), ("epoch", "y"), ("month", "y"), ("time", "y"))]
    name = pick(map(F.lit, _NAMES), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    return p.select(pick(map(F.lit, ("static", "external", "initial")), (n % 3 + 1).cast("int")).alias("product"), name.alias("name"), pick(map(F.lit, ("m", "K", "M", "kg / m**-3", "degrees_north")), (n % 5 + 1).cast("int")).alias("units"), pick(axes, (n % 4 + 1).cast("int")).alias("axes")).distinct()


@query("lifetime_contract", f"WITH {REGISTRY}, {DECLARED}, j AS (SELECT decl.*, field, lifetime, support, runits FROM decl LEFT JOIN reg USING (name)) SELECT product, name, units, array_to_string(axes, ',') AS axes, field, CASE WHEN field IS NULL THEN 'unknown' WHEN runits IS NOT NULL AND {_PLAIN.format('units')} <> {_PLAIN.format('runits')} THEN 'units' WHEN NOT ((product='static' AND lifetime='invariant') OR (product='external' AND lifetime IN ('epoch','climatology','time_series')) OR (product='initial' AND lifetime IN ('initial_only','invariant'))) THEN 'lifetime' WHEN product='initial' AND lifetime='invariant' AND support<>'coordinate' THEN 'repeated' WHEN lifetime='invariant' AND (list_contains(axes,'time') OR list_contains(axes,'month') OR list_contains(axes,'epoch')) THEN 'axes' WHEN lifetime='climatology' AND NOT list_contains(axes,'month') THEN 'axes' WHEN lifetime='epoch' AND NOT list_contains(axes,'epoch') THEN 'axes' WHEN lifetime='time_series' AND support<>'coordinate' AND NOT list_contains(axes,'time') THEN 'axes' END AS violation FROM j")
def lifetime_contract(spark, d):
    """Declared fields against the closed list: unknown ones, other units, lifetimes that the product may not hold, axes that don't go with them."""
    out = fields.check_fields(declared(spark, d), fields.registry(B.field_table(spark)))
    return out.select("product", "name", "units", F.concat_ws(",", "axes").alias("axes"), "field", "violation")


_EDGE = "least(x-x0, x1-x, y-y0, y1-y)"


@query("attr_match", "WITH a AS (SELECT p_partkey AS k, p_brand AS txt, p_retailprice AS num FROM part), b AS (SELECT k, CASE WHEN k%500=0 THEN 'other' ELSE txt END AS txt, num + CASE WHEN k%400=1 THEN 1e-3 ELSE 1e-10 END AS num FROM a) SELECT a.k, a.txt = b.txt AS text_equal, abs(a.num-b.num) <= 1e-8 AS number_equal FROM a JOIN b USING (k) WHERE NOT (a.txt=b.txt AND abs(a.num-b.num) <= 1e-8)")
def attr_match(spark, d):
    a = B.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("txt"), F.col("p_retailprice").alias("num"))
    b = a.select("k", F.when(F.col("k") % 500 == 0, "other").otherwise(F.col("txt")).alias("txt2"), (F.col("num") + F.when(F.col("k") % 400 == 1, 1e-3).otherwise(1e-10)).alias("num2"))
    j = a.join(b, "k").select("k", (F.col("txt") == F.col("txt2")).alias("text_equal"), (F.abs(F.col("num") - F.col("num2")) <= 1e-8).alias("number_equal"))
    return j.where("not (text_equal and number_equal)")


@query("all_sites_covered", f"WITH {B.SITES}, {B.WIND} SELECT (SELECT count(DISTINCT station) FROM wind) AS observed, (SELECT count(*) FROM sites WHERE site < 25) AS mapped, (SELECT count(*) FROM (SELECT DISTINCT station FROM wind WHERE station NOT IN (SELECT site FROM sites))) AS excluded")
def all_sites_covered(spark, d):
    w, s = B.wind(spark, d).select(F.col("station").alias("site")).distinct(), B.sites(spark, d).select("site")
    one = w.agg(F.count("*").alias("observed"))
    return one.join(F.broadcast(s.where("site < 25").agg(F.count("*").alias("mapped")))).join(F.broadcast(w.join(s, "site", "left_anti").agg(F.count("*").alias("excluded"))))


@query("readiness_evidence", f"WITH {B.TRIPLETS} SELECT metric, count(*) AS rows_, count(DISTINCT season) AS seasons, count(DISTINCT station) AS stations, count(DISTINCT season)=4 AS complete FROM accepted GROUP BY metric")
def readiness_evidence(spark, d):
    n = F.count_distinct("season")
    return B.accepted(spark, d).groupBy("metric").agg(F.count("*").alias("rows_"), n.alias("seasons"), F.count_distinct("station").alias("stations"), (n == 4).alias("complete"))


_DIST = "sqrt(((m.lat-g.lat)*110.57)*((m.lat-g.lat)*110.57)+((m.lon-g.lon)*111.32*cos(radians(m.lat)))*((m.lon-g.lon)*111.32*cos(radians(m.lat))))"


@query("mapping_identity", f"WITH {B.GRID}, {B.SITES}, m AS (SELECT site, s.lat, s.lon, floor((s.lat-46)/0.002)::INT AS y, floor((s.lon-7)/0.003)::INT AS x, elevation FROM sites s), j AS (SELECT site, m.y, m.x, g.y IS NOT NULL AS in_bounds, coalesce(land, FALSE) AS on_land, {_DIST} AS km, {_DIST}*(1+(site%20)/100.0) AS reported, g.height AS height, g.height + CASE WHEN site%9=0 THEN 0.01 ELSE 0.0001 END AS reported_height FROM m LEFT JOIN grid g ON g.y=m.y AND g.x=m.x) SELECT site, y, x, in_bounds, on_land, round(km,6)+0.0 AS km, coalesce(abs(reported_height-height) <= 1e-3, FALSE) AS same_height, coalesce(abs(km-reported) <= greatest(0.02, 0.05*reported), FALSE) AS same_distance FROM j")
def mapping_identity(spark, d):
    """Reported cells of sites against the grid: in bounds, on land, of the same height to a millimetre, and as far away as reported to 20 m or 5 %."""
    from skillgrid.operators.spatial import planar_km

    m = B.sites(spark, d).withColumns({"y": F.floor((F.col("lat") - 46) / 0.002).cast("int"), "x": F.floor((F.col("lon") - 7) / 0.003).cast("int")})
    j = m.join(B.grid(spark, d).select("y", "x", "land", "height", F.col("lat").alias("glat"), F.col("lon").alias("glon")), ["y", "x"], "left")
    j = j.withColumn("km", planar_km(F.col("lat"), F.col("lon"), F.col("glat"), F.col("glon"), F.col("lat")))
    j = j.withColumns({"reported": F.col("km") * (1 + (F.col("site") % 20) / 100), "reported_height": F.col("height") + F.when(F.col("site") % 9 == 0, 0.01).otherwise(0.0001)})
    no = F.lit(False)
    same_distance = F.abs(F.col("km") - F.col("reported")) <= F.greatest(F.lit(0.02), 0.05 * F.col("reported"))
    return rounded(j.select("site", "y", "x", F.col("glat").isNotNull().alias("in_bounds"), F.coalesce("land", no).alias("on_land"), "km", F.coalesce(F.abs(F.col("reported_height") - F.col("height")) <= 1e-3, no).alias("same_height"), F.coalesce(same_distance, no).alias("same_distance")))


@query("identity_residual", f"WITH {B.WIND}, r AS (SELECT station, speed, abs(sqrt((speed*sin(radians(direction)))*(speed*sin(radians(direction)))+(speed*cos(radians(direction)))*(speed*cos(radians(direction))))-speed) AS e FROM wind) SELECT station, count(*) AS samples, count(*) >= 100 AS enough, max(e) <= 1e-9 AS holds, quantile_cont(e,0.99) <= 1e-9 AS holds_p99, min(speed) >= 0 AND max(speed) <= 1e6 AS in_range, max(speed) > min(speed) AS varies FROM r GROUP BY station")
def identity_residual(spark, d):
    from skillgrid.functions.physics import wind_uv

    u, v = wind_uv(F.col("speed"), F.col("direction"))
    e = F.abs(F.sqrt(u * u + v * v) - F.col("speed"))
    low, high = F.min("speed"), F.max("speed")
    return B.wind(spark, d).groupBy("station").agg(F.count("*").alias("samples"), (F.count("*") >= 100).alias("enough"), (F.max(e) <= 1e-9).alias("holds"), (F.percentile(e, F.lit(0.99)) <= 1e-9).alias("holds_p99"), ((low >= 0) & (high <= 1e6)).alias("in_range"), (high > low).alias("varies"))


@query("column_total", f"WITH {B.PROFILE}, c AS (SELECT column_id, sum(value*0.1*1000) AS one, sum(value*0.1*1000*(1+0.01*(level%3))) AS two FROM profile GROUP BY 1) SELECT column_id, {sql6('one', 'two')} FROM c")
def column_total(spark, d):
    """Totals over a column's layers, held as arrays."""
    arrays = B.profile(spark, d).groupBy("column_id").agg(F.array_sort(F.collect_list(F.struct("level", "value"))).alias("p"))
    total = lambda w: F.aggregate("p", F.lit(0.0), lambda acc, x: acc + x["value"] * 0.1 * 1000 * w(x))
    return rounded(arrays.select("column_id", total(lambda x: F.lit(1.0)).alias("one"), total(lambda x: 1 + 0.01 * (x["level"] % 3)).alias("two")))


_TAPER = "(0.5-0.5*cos(pi()*least(least(x-x0,x1-x,y-y0,y1-y)/6.0,1.0)))"


@query("filter_static", f"WITH {B.GRID}, {S121.format(n='a', v='height', k='', f='grid', p='y', o='x')}, {S121.format(n='b', v='height', k='', f='a', p='x', o='y')}, c AS (SELECT y, x, g.land, g.height AS h0, g.height-b.height AS height FROM grid g JOIN b USING (y,x)), {S121.format(n='e', v='height', k='', f='c', p='y', o='x')}, {S121.format(n='f', v='height', k='', f='e', p='x', o='y')}, fl AS (SELECT y, x, h0, CASE WHEN c.land THEN h0 - 0.9*(c.height-f.height) ELSE h0 END AS hf FROM c JOIN f USING (y,x)), ed AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM grid), bl AS (SELECT y, x, h0, (1-{_TAPER})*h0 + {_TAPER}*hf AS h1 FROM fl, ed), sc AS (SELECT unnest([5,25,50]) AS cells), k AS (SELECT cells, y//cells AS ty, x//cells AS tx, avg(h0) AS a0, avg(h1) AS a1 FROM bl, sc GROUP BY 1,2,3) SELECT cells::INT AS cells, count(*) AS blocks, round(sqrt(avg((a1-a0)*(a1-a0))),6)+0.0 AS rms, round(max(abs(a1-a0)),6)+0.0 AS largest, round(stddev_pop(a0),6)+0.0 AS roughness_before, round(stddev_pop(a1),6)+0.0 AS roughness_after, 0::BIGINT AS others_changed FROM k GROUP BY 1")
def filter_static(spark, d):
    """Terrain filtered on land and blended back in at the edges; how that changes means of 1, 5 and 10 km, and proof that no other field changed."""
    g = B.grid(spark, d)
    smooth = raster.shapiro(g.select("y", "x", "land", "height"), "height", "land", 4, 0.9).select("y", "x", F.col("height").alias("smooth"))
    e = g.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    new = raster.reblend(g.join(smooth, ["y", "x"]).crossJoin(F.broadcast(e)), "smooth", F.col("height"), 6.0)
    product = new.select(*[c for c in g.columns if c != "height"], F.col("smooth").alias("height"))
    rest = [c for c in g.columns if c not in ("y", "x", "height")]
    other = product.select("y", "x", F.xxhash64(*rest).alias("h")).join(g.select("y", "x", F.xxhash64(*rest).alias("h2")), ["y", "x"], "full").agg(F.count_if(~F.col("h").eqNullSafe(F.col("h2"))).alias("others_changed"))
    at = new.withColumn("cells", F.explode(F.array(*map(F.lit, (5, 25, 50)))))
    k = at.groupBy("cells", F.floor(F.col("y") / F.col("cells")).alias("ty"), F.floor(F.col("x") / F.col("cells")).alias("tx")).agg(F.avg("height").alias("a0"), F.avg("smooth").alias("a1"))
    change = F.col("a1") - F.col("a0")
    out = k.groupBy("cells").agg(F.count("*").alias("blocks"), F.sqrt(F.avg(change * change)).alias("rms"), F.max(F.abs(change)).alias("largest"), F.stddev_pop("a0").alias("roughness_before"), F.stddev_pop("a1").alias("roughness_after"))
    return rounded(out.crossJoin(F.broadcast(other)))


@query("tile_digest", f"WITH {B.GRID}, t AS (SELECT DISTINCT y//16 AS tile_y, x//16 AS tile_x FROM grid) SELECT tile_y::INT AS tile_y, tile_x::INT AS tile_x, CASE WHEN (tile_y, tile_x) = (0, 2) THEN 'gone' ELSE 'changed' END AS what FROM t WHERE (tile_y, tile_x) IN ((0, 0), (1, 1), (0, 2), (0, 3)) UNION ALL SELECT -1, 0, 'new'")
def tile_digest(spark, d):
    """Which tiles of a raster differ from a copy with one value off by 1e-9, one cell less, one cell twice, one tile less and one more."""
    g = B.grid(spark, d).select("y", "x", "height", "land")
    copy = g.where("not (y = 17 and x = 18) and not (y < 16 and x between 32 and 47)").withColumn("height", F.when((F.col("y") == 3) & (F.col("x") == 7), F.col("height") + 1e-9).otherwise(F.col("height")))
    copy = copy.unionAll(g.where("y = 2 and x = 49")).unionAll(g.where("y = 0 and x = 0").withColumn("y", F.lit(-3)))
    return digest.changed_tiles(digest.tile_digests(g, ["height", "land"], 16), digest.tile_digests(copy, ["height", "land"], 16))


MONTHS = "[" + ", ".join(f"size*0.01*{m}" for m in range(1, 13)) + "]::DOUBLE[]"


@query("runtime_assemble", f"WITH {B.GRID} SELECT y, x, height, CASE WHEN size <> 9 THEN 280.0+size*0.1 END::DOUBLE AS skin, (size % 24 + 2)::INT AS landuse, TIMESTAMP '2024-01-01' AS landuse_from, round(size*0.01*(3+(5.0/31)),6)+0.0 AS vegetation, round((size*0.01*12)::DOUBLE,6)+0.0 AS december, CASE WHEN size = 9 THEN 'surface' ELSE '' END AS missing, TRUE AS refused FROM grid")
def runtime_assemble(spark, d):
    """Static, surface and external fields on one raster, each by its recorded digest: the epoch in force on 20 March, and the monthly field between the 15ths. A part with one changed cell is refused, and so is a field of two parts."""
    g, size = B.grid(spark, d), F.col("size")
    when = "2024-03-20 00:00:00"
    epochs = g.select("y", "x", "size", F.explode(F.array(*[F.lit(y) for y in (2020, 2024, 2025)])).alias("year")).select("y", "x", F.make_timestamp("year", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("valid_from"), (size % 24 + F.when(F.col("year") == 2020, 1).when(F.col("year") == 2024, 2).otherwise(3)).cast("int").alias("value"))
    months = g.select("y", "x", "size", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")).select("y", "x", "month", (size * 0.01 * F.col("month")).alias("value"))
    parts = {"static": g.select("y", "x", "height"), "surface": g.where("size <> 9").select("y", "x", (280.0 + size * 0.1).alias("skin")), "landuse": digest.at_time(epochs, "landuse", when), "vegetation": digest.months_of(months, "vegetation")}
    recorded = {n: digest.fingerprint(p, p.columns) for n, p in parts.items()}

    def refused(other: dict) -> bool:
        try:
            digest.assemble(other, recorded, "static")
        except ValueError:
            return True
        return False

    changed = parts | {"surface": parts["surface"].withColumn("skin", F.when((F.col("y") == 1) & (F.col("x") == 1), F.col("skin") + 1e-9).otherwise(F.col("skin")))}
    out = digest.assemble(parts, recorded, "static")
    t = F.lit(when).cast("timestamp")
    this = F.month(temporal.month_anchor(t))
    v0, v1 = F.element_at("vegetation", this), F.element_at("vegetation", this % 12 + 1)
    return out.select("y", "x", "height", "skin", "landuse", F.col("landuse_from").cast("timestamp_ntz").alias("landuse_from"), r6(v0 + temporal.month_part(t) * (v1 - v0)).alias("vegetation"), r6(F.element_at("vegetation", 12)).alias("december"), F.array_join("missing", ",").alias("missing"), F.lit(refused(changed)).alias("refused"))


EPOCHS = "ex AS (SELECT f.field, yr, y, x, CASE f.field WHEN 'albedo' THEN size*0.01 ELSE size % 24 END::DOUBLE AS value FROM grid, (SELECT unnest(['albedo', 'landuse']) AS field) f, (SELECT unnest([2020, 2022]) AS yr) e), nw AS (SELECT f.field, yr, y, x, CASE WHEN f.field = 'albedo' THEN CASE WHEN yr = 2025 AND size = 30 THEN 1.2 WHEN yr = 2026 AND size = 4 THEN NULL ELSE size*0.012 END ELSE size % 22 END::DOUBLE AS value FROM grid, (SELECT unnest(['albedo', 'landuse']) AS field) f, (SELECT unnest(range(2021, 2029)) AS yr) e WHERE NOT (yr = 2024 AND y = 3 AND x = 3) AND NOT (yr = 2027 AND f.field = 'landuse') UNION ALL SELECT 'albedo', 2028, y, x, 0.5 FROM grid WHERE y = 1 AND x = 1)"


@query("epoch_append", f"WITH {B.GRID}, {EPOCHS}, n AS (SELECT (SELECT count(*) FROM grid) AS cells) SELECT make_timestamp(yr, 1, 1, 0, 0, 0) AS valid_from, min(places) AS cells, string_agg(field, ',' ORDER BY field) AS fields, CASE WHEN yr <= 2022 THEN 'not_later' WHEN count(*) < 2 THEN 'fields' WHEN min(places) <> any_value(cells) OR max(m) > any_value(cells) THEN 'incomplete' WHEN sum(bad) > 0 THEN 'fraction' END AS violation FROM (SELECT yr, field, count(*) AS m, count(DISTINCT (y, x)) AS places, count(*) FILTER (field = 'albedo' AND (value IS NULL OR value < 0 OR value > 1)) AS bad FROM nw GROUP BY 1, 2), n GROUP BY yr")
def epoch_append(spark, d):
    """Which of eight epochs can be appended to an external product of two: later ones, with the same fields on all cells, and shares from 0 to 1."""
    g, size = B.grid(spark, d), F.col("size")
    epoch = lambda rows: rows.select("field", F.make_timestamp("yr", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("timestamp_ntz").alias("valid_from"), "y", "x", F.col("value").cast("double").alias("value"))
    spread = lambda years: g.withColumn("field", F.explode(F.array(F.lit("albedo"), F.lit("landuse")))).withColumn("yr", F.explode(F.array(*map(F.lit, years))))
    albedo = F.col("field") == "albedo"
    old = epoch(spread([2020, 2022]).withColumn("value", F.when(albedo, size * 0.01).otherwise(size % 24)))
    share = F.when((F.col("yr") == 2025) & (size == 30), 1.2).when((F.col("yr") == 2026) & (size == 4), None).otherwise(size * 0.012)
    new = spread(range(2021, 2029)).withColumn("value", F.when(albedo, share).otherwise(size % 22)).where("not (yr = 2024 and y = 3 and x = 3) and not (yr = 2027 and field = 'landuse')")
    twice = g.where("y = 1 and x = 1").select(F.lit("albedo").alias("field"), F.lit(2028).alias("yr"), "y", "x", F.lit(0.5).alias("value"))
    return digest.epoch_report(old, epoch(new).unionByName(epoch(twice)), ["albedo"])


@query("column_total_differences", f"WITH {B.PROFILE}, c AS (SELECT column_id, sum(value*0.1*1000) AS one, sum(value*0.1*1000*(1+0.01*(level%3))) AS two, sum(value*0.1*1000)*0.98 AS three FROM profile GROUP BY 1), p AS (SELECT 'two-one' AS pair, two-one AS e FROM c UNION ALL SELECT 'three-one', three-one FROM c UNION ALL SELECT 'three-two', three-two FROM c) SELECT pair, round(avg(e),6)+0.0 AS mean, round(sqrt(avg(e*e)),6)+0.0 AS rmse, round(quantile_cont(abs(e),0.95),6)+0.0 AS p95, round(max(abs(e)),6)+0.0 AS largest FROM p GROUP BY 1")
def column_total_differences(spark, d):
    """How column totals by three methods differ from each other."""
    total = F.sum(F.col("value") * 0.1 * 1000)
    c = B.profile(spark, d).groupBy("column_id").agg(total.alias("one"), F.sum(F.col("value") * 0.1 * 1000 * (1 + 0.01 * (F.col("level") % 3))).alias("two"), (total * 0.98).alias("three"))
    p = c.select(F.explode(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), (F.col(a) - F.col(b)).alias("e")) for a, b in (("two", "one"), ("three", "one"), ("three", "two"))])).alias("p")).select("p.*")
    return rounded(p.groupBy("pair").agg(F.avg("e").alias("mean"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.percentile(F.abs("e"), F.lit(0.95)).alias("p95"), F.max(F.abs("e")).alias("largest")))
