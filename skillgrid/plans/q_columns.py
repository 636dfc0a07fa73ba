"""Queries of the array, map and profile family."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skillgrid.functions import physics as P
from skillgrid.operators import columns as C
from skillgrid.operators import raster
from skillgrid.operators.tiles import fused_slope_wind
from skillgrid.plans import bindings as B
from skillgrid.plans.q_campaign import ROWS, station_rows
from skillgrid.plans.q_grid import targets
from skillgrid.plans.q_surface import inverse_distance
from skillgrid.plans.registry import query, r6, rounded, sql6
from skillgrid.session import materialize

HEIGHTS = [120.0, 205.0, 333.0, 470.0]


def arrays(spark, d):
    return C.as_arrays(B.profile(spark, d), "column_id", "level", "z", "value")


@query("profile_interp", f"WITH {B.PROFILE}, t AS (SELECT unnest({HEIGHTS}::DOUBLE[]) AS target_z), b AS (SELECT column_id, z AS z0, value AS v0, lead(z) OVER w AS z1, lead(value) OVER w AS v1 FROM profile WINDOW w AS (PARTITION BY column_id ORDER BY level)), e AS (SELECT column_id, min(z) AS lo, max(z) AS hi, min(value) AS vmin, max(value) AS vmax, arg_min(value, z) AS vlo, arg_min(v1, z0) AS vnext, count(*) AS n, arg_min(z1, z0) AS znext FROM profile JOIN b USING (column_id) WHERE z=z0 GROUP BY 1), x AS (SELECT e.column_id, target_z, CASE WHEN target_z > hi THEN NULL WHEN target_z < lo THEN CASE WHEN n>1 THEN least(greatest(vlo + least(greatest((vnext-vlo)/(znext-lo),-1.0),1.0)*(target_z-lo), vmin), vmax) ELSE vlo END ELSE (SELECT CASE WHEN target_z=z0 THEN v0 ELSE v0+(v1-v0)*(target_z-z0)/(z1-z0) END FROM b WHERE b.column_id=e.column_id AND target_z>=z0 AND (target_z<z1 OR (z1 IS NULL AND target_z=z0)) LIMIT 1) END AS value FROM e, t) SELECT column_id, target_z, {sql6('value')} FROM x")
def profile_interp(spark, d):
    return rounded(C.interpolate_profiles(arrays(spark, d), "column_id", "z", "value", HEIGHTS))


@query("soil_temp_interp", f"WITH {B.PROFILE}, b AS (SELECT column_id, z AS z0, value AS v0, lead(z) OVER w AS z1, lead(value) OVER w AS v1, min(z) OVER (PARTITION BY column_id) AS lo FROM profile WINDOW w AS (PARTITION BY column_id ORDER BY level)) SELECT column_id, 250.0::DOUBLE AS target_z, round(coalesce(max(CASE WHEN 250>=z0 AND 250<z1 THEN v0+(v1-v0)*(250-z0)/(z1-z0) END), max(CASE WHEN z1 IS NULL AND 250=z0 THEN v0 END), CASE WHEN min(lo)>250 THEN arg_min(v0,z0) END),6)+0.0 AS value FROM b GROUP BY 1")
def soil_temp_interp(spark, d):
    return rounded(C.interpolate_profiles(arrays(spark, d), "column_id", "z", "value", [250.0], extrapolate=False))


@query("hydrostatic_integrate", f"WITH {B.PROFILE}, tv AS (SELECT column_id, level, z, 280.0+value*0.2 AS tv FROM profile), s AS (SELECT *, coalesce(-9.80665*(z-lag(z) OVER w)/(287.05*(tv+lag(tv) OVER w)/2),0) AS s FROM tv WINDOW w AS (PARTITION BY column_id ORDER BY level)) SELECT column_id, level, round(100000.0*exp(sum(s) OVER (PARTITION BY column_id ORDER BY level)),6)+0.0 AS pressure FROM s")
def hydrostatic_integrate(spark, d):
    rows = B.profile(spark, d).withColumn("tv", 280.0 + F.col("value") * 0.2)
    return rounded(C.hydrostatic(rows, "column_id", "level", "z", "tv", F.lit(100000.0)).select("column_id", "level", "pressure"))


SPECIES = ["cloud", "rain"]


def source_columns(spark, d):
    """A column for each order, six levels higher than its profile, with cloud and rain, and the levels of a target whose ground lies lower, alike or higher; some can't be done."""
    rows = arrays(spark, d)
    n = F.size("value") + 6
    hhl = F.transform(F.sequence(F.lit(0), n), lambda k: 50.0 + 110.0 * k + (F.col("column_id") % 7) * k)
    c = rows.select("column_id", hhl.alias("hhl"), F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.element_at("value", F.least(k + 1, F.size("value")).cast("int"))).alias("x"))
    c = c.withColumn("z", F.zip_with(F.slice("hhl", F.lit(2), F.size("hhl") - 1), F.slice("hhl", F.lit(1), F.size("hhl") - 1), lambda a, b: (a + b) / 2))
    over = lambda f: F.zip_with("z", "x", f)
    own = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: 20.0 + (F.col("column_id") % 6) * 60.0 + k * (90.0 + k * 5))
    return c.select("column_id", "hhl", own.alias("own_hhl"), over(lambda z, x: 290 - 0.0065 * z + 0.05 * x).alias("t"), over(lambda z, x: 1e5 * F.exp(-z / 8000)).alias("p"), over(lambda z, x: 0.004 + x * 1.5e-4).alias("qv"), over(lambda z, x: x * 0.1).alias("u"), over(lambda z, x: 3 - x * 0.05 + z * 0.01).alias("v"), over(lambda z, x: F.when(x > 25, x * 1e-5).otherwise(0.0)).alias("cloud"), over(lambda z, x: F.when(z < 400, x * 2e-6).otherwise(0.0)).alias("rain"))


@query("column_reconstruct")
def column_reconstruct(spark, d):
    """State of each column on the levels of its target, with cloud and rain; columns that can't be done keep a row with a violation."""
    state = C.reconstruct(source_columns(spark, d), "column_id", SPECIES)
    arrays_ = ["z", "t", "p", "qv", "u", "v", *SPECIES, "theta", "rho"]
    return rounded(C.by_level(state, ["column_id", "terrain", "anchor_m", "below", "buried", "violation"], *arrays_))


def donor_columns(spark, d):
    """Every cell as a donor: a column of twelve layers over its height, drier and thinner upwards."""
    size, n = F.col("size"), 12
    g = B.grid(spark, d).select((F.col("y").cast("long") * 50 + F.col("x")).alias("donor"), "size", (F.col("height") / 2).alias("ground"))
    hhl = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.col("ground") + k * (60.0 + size) + k * k * 8.0)
    c = g.withColumn("hhl", hhl).withColumn("z", F.zip_with(F.slice("hhl", 2, n), F.slice("hhl", 1, n), lambda a, b: (a + b) / 2))
    over = lambda f: F.transform("z", f)
    cloud = over(lambda z: F.when((z > 1200) & (z < 1500), size * 1e-5).otherwise(0.0))
    return c.select("donor", "hhl", over(lambda z: 293 - 0.0065 * z + size * 0.02).alias("t"), over(lambda z: 101000.0 * F.exp(-z / 8200)).alias("p"), over(lambda z: 0.008 * F.exp(-z / 2500) + size * 1e-5).alias("qv"), over(lambda z: size * 0.1 + z * 0.002).alias("u"), over(lambda z: 5.0 - size * 0.05).alias("v"), F.transform("hhl", lambda z: (z - F.col("ground")) * 1e-4 + size * 1e-3).alias("w"), cloud.alias("cloud"), over(lambda z: F.when(z < 900, size * 3e-6).otherwise(0.0)).alias("rain"))


def target_columns(spark, d):
    """Every target of the regridding as a cell of a raster with seven layers over its own ground."""
    t = F.col("target")
    ground = 400.0 + (t % 50) * 6 + F.floor(t / 50) * 2
    own = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: ground + k * 70.0 + k * k * 6.0)
    return targets(spark, d).select("target", F.floor(t / 50).cast("int").alias("y"), (t % 50).cast("int").alias("x"), own.alias("own_hhl"))


@query("state_transform")
def state_transform(spark, d):
    """From source columns to the state on the target raster in one go: sparse weights, interfaces, columns with cloud and rain, and the vertical wind over slopes."""
    state = C.transform_state(inverse_distance(spark, d), donor_columns(spark, d), target_columns(spark, d), SPECIES, 200.0, 200.0, side=32)
    return rounded(C.by_level(state, ["target", "terrain", "buried", "violation"], "z", "t", "p", "qv", "u", "v", "w", *SPECIES, "theta", "rho"))


@query("interface_remap", f"WITH {B.PROFILE}, a AS (SELECT column_id, level, value*500.0/sum(value) OVER (PARTITION BY column_id) AS t FROM profile), b AS (SELECT *, sum(greatest(20-t,0)) OVER p AS need, sum(greatest(t-20,0)) OVER p AS excess FROM a WINDOW p AS (PARTITION BY column_id)), u AS (SELECT column_id, level, CASE WHEN t<20 THEN 20 ELSE t-(t-20)*CASE WHEN excess<>0 THEN need/excess END END AS u FROM b) SELECT column_id, level, round(sum(u) OVER (PARTITION BY column_id ORDER BY level),6)+0.0 AS interface FROM u")
def interface_remap(spark, d):
    rows = B.profile(spark, d).withColumn("span", F.lit(500.0))
    return rounded(C.lift_layers(rows, "column_id", "level", "value", 20.0, "span").select("column_id", "level", "interface"))


GRADX = "CASE WHEN lag(height) OVER w IS NULL THEN (-3*height+4*lead(height) OVER w-lead(height,2) OVER w)/400.0 WHEN lead(height) OVER w IS NULL THEN (3*height-4*lag(height) OVER w+lag(height,2) OVER w)/400.0 ELSE (lead(height) OVER w-lag(height) OVER w)/400.0 END"


ZETA = (0.0, 1000.0, 2500.0, 5000.0, 7000.0)
_SLOPES = f"g AS (SELECT y, x, height, size, {GRADX} AS sx FROM grid WINDOW w AS (PARTITION BY y ORDER BY x)), h AS (SELECT y, x, {GRADX} AS sy FROM grid WINDOW w AS (PARTITION BY x ORDER BY y))"
_AGL = "least(hhl-min(hhl) OVER c, 4000.0)"
#: Interfaces by hand: slopes shrink with the terrain's share of each, winds stand between mass levels.
TERRAIN_W = f"""WITH {B.GRID}, {_SLOPES}, l AS (SELECT unnest(range(5))::INT AS k, unnest({list(ZETA)}::DOUBLE[]) AS zeta, unnest([1.0,1.0,0.66,0.33,0.0]::DOUBLE[]) AS quiet),
i AS (SELECT y, x, k, quiet, zeta+height*(1-zeta/7000) AS hhl, sx*(1-zeta/7000) AS dzdx, sy*(1-zeta/7000) AS dzdy, size*0.01*(k+1) AS given, size*0.5+k AS u, 2-0.1*k AS v FROM g JOIN h USING (y, x), l),
m AS (SELECT *, (hhl+lead(hhl) OVER c)/2 AS z FROM i WINDOW c AS (PARTITION BY y, x ORDER BY k)),
p AS (SELECT *, CASE WHEN k IN (0, 4) THEN 0 ELSE (hhl-lag(z) OVER c)/(z-lag(z) OVER c) END AS part, CASE k WHEN 0 THEN u WHEN 4 THEN lag(u) OVER c ELSE lag(u) OVER c END AS u0, CASE k WHEN 4 THEN lag(u) OVER c ELSE u END AS u1, CASE k WHEN 0 THEN v ELSE lag(v) OVER c END AS v0, CASE k WHEN 4 THEN lag(v) OVER c ELSE v END AS v1, {_AGL} AS agl FROM m WINDOW c AS (PARTITION BY y, x ORDER BY k)),
t AS (SELECT *, (u0+part*(u1-u0))*dzdx+(v0+part*(v1-v0))*dzdy AS terrain, (1296000000.0*agl+27*agl*agl*agl)/(1728000000000.0+324000*agl*agl) AS f FROM p),
w AS (SELECT y, x, k, (f*given+(1-f)*terrain)*quiet AS w FROM t)"""


def interfaces(spark, d):
    """Cells with arrays over five interfaces that follow the terrain less and less: heights, given vertical wind, and winds of the four layers between."""
    size = F.col("size")
    arr = lambda f, n: F.array(*[f(k) for k in range(n)])
    return B.grid(spark, d).select("y", "x", arr(lambda k: ZETA[k] + F.col("height") * (1 - ZETA[k] / 7000), 5).alias("hhl"), arr(lambda k: size * 0.01 * (k + 1), 5).alias("w"), arr(lambda k: size * 0.5 + k, 4).alias("u"), arr(lambda k: F.lit(2 - 0.1 * k), 4).alias("v"))


@query("terrain_w", f"{TERRAIN_W} SELECT y, x, k, {sql6('w')}, round((w+lead(w) OVER (PARTITION BY y, x ORDER BY k))/2,6)+0.0 AS w_mass FROM w")
def terrain_w(spark, d):
    """Vertical wind at interfaces: the slope wind at the ground, fading into the given one over 4 km; a third, two thirds and all of it taken away at the top three; then at mass levels."""
    levels = interfaces(spark, d).select("y", "x", F.posexplode("hhl").alias("k", "hhl"), "w", "u", "v")
    at = lambda c: F.get(c, F.col("k"))
    return rounded(C.slope_wind(levels.select("y", "x", "k", "hhl", at("w").alias("given"), at("u").alias("u"), at("v").alias("v")), 200.0, 200.0))


SINH = "((exp({0})-exp(-({0})))/2)"


COSH = "((exp({0})+exp(-({0})))/2)"
_POW = lambda z, s: f"pow({z}/{s},1.35)"
_B = lambda s: f"{SINH.format(_POW('8000.0', s) + '-' + _POW('zeta', s))}/{SINH.format(_POW('8000.0', s))}"
_DB = lambda s: f"(-1.35/{s}*pow(zeta/{s},0.35)*{COSH.format(_POW('8000.0', s) + '-' + _POW('zeta', s))}/{SINH.format(_POW('8000.0', s))})"


@query("sleve_geometry", f"WITH {B.GRID}, s AS (SELECT a.y, a.x, a.height AS h, avg(b.height) AS h1 FROM grid a JOIN grid b ON abs(a.y-b.y)<=2 AND abs(a.x-b.x)<=2 GROUP BY 1,2,3), l AS (SELECT unnest([0.0,20.0,60.0,500.0,2000.0,6000.0]::DOUBLE[]) AS zeta), z AS (SELECT y, x, zeta, zeta + h1*{_B('5000.0')} + (h-h1)*{_B('2500.0')} AS z, 1 + h1*{_DB('5000.0')} + (h-h1)*{_DB('2500.0')} AS jacobian FROM s, l), t AS (SELECT *, lead(z) OVER (PARTITION BY y, x ORDER BY zeta)-z AS thickness FROM z) SELECT y, x, zeta, {sql6('z', 'jacobian', 'thickness')}, jacobian <= 0.5 OR coalesce(thickness < 12.0, FALSE) AS rejected FROM t")
def sleve_geometry(spark, d):
    """Level heights over a smooth and a rough part of the terrain, which decay over 5 and 2.5 km; their Jacobian and thickness, and what is too steep or too thin."""
    g = B.grid(spark, d).select("y", "x", "height")
    smooth = raster.box_mean(g, "height", 2).withColumnRenamed("height", "h1")
    at = g.join(smooth, ["y", "x"]).withColumn("zeta", F.explode(F.array(*map(F.lit, (0.0, 20.0, 60.0, 500.0, 2000.0, 6000.0)))))
    zeta, h1, h2 = F.col("zeta"), F.col("h1"), F.col("height") - F.col("h1")
    sum_ = lambda f: h1 * f(zeta, 8000.0, 5000.0, 1.35) + h2 * f(zeta, 8000.0, 2500.0, 1.35)
    h = at.select("y", "x", "zeta", (zeta + sum_(P.sleve_basis)).alias("z"), (1 + sum_(P.sleve_slope)).alias("jacobian"))
    h = h.withColumn("thickness", F.lead("z").over(Window.partitionBy("y", "x").orderBy("zeta")) - F.col("z"))
    return rounded(h.withColumn("rejected", (F.col("jacobian") <= 0.5) | F.coalesce(F.col("thickness") < 12.0, F.lit(False))))


@query("staggering", f"WITH {B.GRID}, q AS (SELECT y, x, height*1.003 AS h FROM grid), a AS (SELECT y, x, coalesce((h+lag(h) OVER w)/2,h) AS west, coalesce((h+lead(h) OVER w)/2,h) AS east FROM q WINDOW w AS (PARTITION BY y ORDER BY x)), b AS (SELECT y, x, coalesce((h+lag(h) OVER w)/2,h) AS south, coalesce((h+lead(h) OVER w)/2,h) AS north FROM q WINDOW w AS (PARTITION BY x ORDER BY y)) SELECT y, x, {sql6('west', 'east', 'south', 'north')}, round((west+east)/2,6)+0.0 AS back_x, round((south+north)/2,6)+0.0 AS back_y FROM a JOIN b USING (y, x)")
def staggering(spark, d):
    """A cell field on the faces along both axes, and back on the cells."""
    g = B.grid(spark, d).select("y", "x", (F.col("height") * 1.003).alias("h"))
    (west, east), (south, north) = raster.faces(g, "h", "x"), raster.faces(g, "h", "y")
    f = g.select("y", "x", west.alias("west"), east.alias("east"), south.alias("south"), north.alias("north"))
    return rounded(f.withColumns({"back_x": (F.col("west") + F.col("east")) / 2, "back_y": (F.col("south") + F.col("north")) / 2}))


@query("level_reverse", f"WITH {B.PROFILE}, t AS (SELECT column_id, CASE WHEN column_id % 2 = 1 THEN -level ELSE level END AS place, z, value FROM profile), g AS (SELECT column_id, z - lag(z) OVER (PARTITION BY column_id ORDER BY place) AS dz FROM t), k AS (SELECT column_id, CASE WHEN count(dz)=0 THEN 'single' WHEN min(dz)>0 THEN 'up' WHEN max(dz)<0 THEN 'down' ELSE 'mixed' END AS direction FROM g GROUP BY 1) SELECT column_id, direction, string_agg(value::INT, ',' ORDER BY CASE WHEN direction='down' THEN -place ELSE place END) AS upward FROM t JOIN k USING (column_id) GROUP BY 1, 2")
def level_reverse(spark, d):
    """Whether a column's levels go up or down, and its values from the bottom up."""
    p = B.profile(spark, d).withColumn("place", F.when(F.col("column_id") % 2 == 1, -F.col("level")).otherwise(F.col("level")))
    return C.upward(C.as_arrays(p, "column_id", "place", "z", "value"), "z", "value").select("column_id", "direction", F.concat_ws(",", F.transform("value", lambda v: v.cast("int").cast("string"))).alias("upward"))


@query("flatten_report", f"WITH {ROWS} SELECT station, season, metric, source, stat, round(v,6)+0.0 AS value FROM (SELECT station, season, metric, 'candidate' AS source, 'rmse' AS stat, candidate_rmse AS v FROM sr UNION ALL SELECT station, season, metric, 'baseline', 'rmse', baseline_rmse FROM sr UNION ALL SELECT station, season, metric, 'candidate', 'bias', candidate_bias FROM sr UNION ALL SELECT station, season, metric, 'baseline', 'bias', baseline_bias FROM sr)")
def flatten_report(spark, d):
    """Nested source -> metric -> statistic maps, built from aggregates and flattened again."""
    one = lambda s: F.create_map(F.col("metric"), F.create_map(F.lit("rmse"), F.col(f"{s}_rmse"), F.lit("bias"), F.col(f"{s}_bias")))
    nested = station_rows(spark, d).select("station", "season", F.create_map(F.lit("candidate"), one("candidate"), F.lit("baseline"), one("baseline")).alias("m"))
    a = nested.select("station", "season", F.explode("m").alias("source", "m")).select("station", "season", "source", F.explode("m").alias("metric", "m"))
    return rounded(a.select("station", "season", "source", "metric", F.explode("m").alias("stat", "value")))


_TWICE = ", ".join(f"s{k} AS (SELECT a.y, a.x, avg(b.sin_a) AS sin_a, avg(b.cos_a) AS cos_a FROM s{k - 1} a JOIN s{k - 1} b ON abs(a.y-b.y)<=4 AND abs(a.x-b.x)<=4 GROUP BY 1,2)" for k in (1, 2))


@query("grid_rotation", f"WITH {B.GRID}, q AS (SELECT y, x, lat + 0.0001*size AS lat, lon FROM grid), r AS (SELECT y, x, coalesce(lead(lat,2) OVER w, lead(lat) OVER w, lat) - coalesce(lag(lat,2) OVER w, lag(lat) OVER w, lat) AS dlat, (coalesce(lead(lon,2) OVER w, lead(lon) OVER w, lon) - coalesce(lag(lon,2) OVER w, lag(lon) OVER w, lon))*cos(radians(lat)) AS dlon FROM q WINDOW w AS (PARTITION BY y ORDER BY x)), s0 AS (SELECT y, x, -dlat/sqrt(dlat*dlat+dlon*dlon) AS sin_a, abs(dlon/sqrt(dlat*dlat+dlon*dlon)) AS cos_a FROM r), {_TWICE} SELECT y, x, {sql6('sin_a', 'cos_a')} FROM s2")
def grid_rotation(spark, d):
    """Rotation of a raster of 500 m, smoothed over a kilometre, so twice."""
    g = B.grid(spark, d).select("y", "x", (F.col("lat") + 0.0001 * F.col("size")).alias("lat"), "lon")
    return rounded(raster.rotation(g, 500.0))


@query("udf_column")
def udf_column(spark, d):
    """The column kernel's rounds: how far each still moved log pressure, by how many it was let run, and how many columns had settled."""
    cols = materialize(source_columns(spark, d), "source-columns")
    out = None
    for rounds in (1, 2, 4, C.ROUNDS):
        s = C.reconstruct(cols, "column_id", SPECIES, rounds).where("violation is null")
        g = s.agg(F.lit(rounds).alias("rounds"), F.count("*").alias("columns"), F.max("residual").alias("residual"), F.count_if(F.col("residual") < 1e-9).alias("settled"))
        out = g if out is None else out.unionByName(g)
    return out


@query("udf_fused_w", f"{TERRAIN_W}, q AS (SELECT y, x, k, (w+lead(w) OVER (PARTITION BY y, x ORDER BY k))/2 AS w_mass FROM w) SELECT y, x, k, {sql6('w_mass')} FROM q WHERE k < 4")
def udf_fused_w(spark, d):
    """The same vertical wind at mass levels by one kernel over tiles of the raster with their borders."""
    made = fused_slope_wind(interfaces(spark, d), 200.0, 200.0, side=16)
    return rounded(made.select("y", "x", F.posexplode("w_mass").alias("k", "w_mass")))
