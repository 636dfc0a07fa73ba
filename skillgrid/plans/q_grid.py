"""Queries of the spatial, raster and regridding families."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skillgrid.functions import stats
from skillgrid.operators import campaign, raster, regrid, spatial, zonal
from skillgrid.operators.order import quantiles
from skillgrid.plans import bindings as B
from skillgrid.plans.registry import query, r6, rounded, sql6
from skillgrid.session import materialize, shared_path
from skillgrid.sources import clustered

KM = "sqrt(((s.lat-g.lat)*110.57)*((s.lat-g.lat)*110.57)+((s.lon-g.lon)*111.32*cos(radians({at})))*((s.lon-g.lon)*111.32*cos(radians({at}))))"


def _nearest_sql(at: str, more: str = "") -> str:
    return f"WITH {B.GRID}, {B.SITES}, p AS (SELECT site, y, x, {KM.format(at=at)} AS km FROM sites s, grid g), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY km, y, x) AS n FROM p) SELECT site, y, x, round(km,6)+0.0 AS km{more} FROM r WHERE n=1"


@query("nearest_cell", _nearest_sql("46.04"))
def nearest_cell(spark, d):
    return rounded(spatial.nearest_cell(B.sites(spark, d), B.grid(spark, d), ["site"], F.lit(46.04)))


@query("nearest_native_cell", _nearest_sql("s.lat", ", km > 2.0 AS beyond"))
def nearest_native_cell(spark, d):
    """Every site's cell; what is over 2 km away is marked, not left out."""
    return rounded(spatial.nearest_cell(B.sites(spark, d), B.grid(spark, d), ["site"]).withColumn("beyond", F.col("km") > 2.0))


AT_MEAN = "(SELECT avg(lat) FROM grid)"
PLANAR = "sqrt((({a}lat-{b}lat)*110.57)*(({a}lat-{b}lat)*110.57)+(({a}lon-{b}lon)*111.32*cos(radians(m)))*(({a}lon-{b}lon)*111.32*cos(radians(m))))"


@query("nearest_land_cell", f"WITH {B.GRID}, {B.SITES}, mm AS (SELECT {AT_MEAN} AS m), p AS (SELECT site, y, x, s.lat AS slat, s.lon AS slon, g.lat AS glat, g.lon AS glon, m, {PLANAR.format(a='s.', b='g.')} AS km FROM sites s, grid g, mm), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY km, y, x) AS n FROM p) WHERE n=1), q AS (SELECT o.site, g.y, g.x, {PLANAR.format(a='g.', b='o.g')} AS displacement, {PLANAR.format(a='g.', b='o.s')} AS km FROM o, grid g WHERE g.land), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY km, y, x) AS n FROM q WHERE displacement <= 0.4 + 1e-6*0.4) SELECT o.site, o.y AS y0, o.x AS x0, round(o.km,6)+0.0 AS km0, r.y, r.x, round(r.km,6)+0.0 AS km, round(r.displacement,6)+0.0 AS displacement, r.y<>o.y OR r.x<>o.x AS override FROM o LEFT JOIN r ON r.site=o.site AND r.n=1")
def nearest_land_cell(spark, d):
    """Land cells within 400 m of a site's cell; sites without one are violations and keep their rows."""
    out = spatial.nearest_land_cell(B.sites(spark, d).select("site", "lat", "lon"), B.grid(spark, d), ["site"], 0.4)
    return rounded(out.select("site", "y0", "x0", "km0", "y", "x", "km", "displacement", "override"))


ARC = "2*6371.0*asin(least(sqrt((cos(radians({a}.lat))*cos(radians({a}.lon))-cos(radians({b}.lat))*cos(radians({b}.lon)))*(cos(radians({a}.lat))*cos(radians({a}.lon))-cos(radians({b}.lat))*cos(radians({b}.lon)))+(cos(radians({a}.lat))*sin(radians({a}.lon))-cos(radians({b}.lat))*sin(radians({b}.lon)))*(cos(radians({a}.lat))*sin(radians({a}.lon))-cos(radians({b}.lat))*sin(radians({b}.lon)))+(sin(radians({a}.lat))-sin(radians({b}.lat)))*(sin(radians({a}.lat))-sin(radians({b}.lat))))/2,1.0))"


@query("nearest_great_circle", f"WITH {B.GRID}, {B.SITES} SELECT site, round(min({ARC.format(a='s', b='g')}),6)+0.0 AS km FROM sites s, grid g WHERE NOT land GROUP BY site")
def nearest_great_circle(spark, d):
    water = B.grid(spark, d).where("not land").select((F.col("y").cast("long") * 50 + F.col("x")).alias("donor"), "lat", "lon")
    near = spatial.k_nearest(B.sites(spark, d).select(F.col("site").alias("target"), "lat", "lon"), water, 1)
    return rounded(near.select(F.col("target").alias("site"), "km"))


BILINEAR = "b AS (SELECT site, s.lat AS lat, s.lon AS lon, floor((s.lat-46)/0.002)::INT AS y0, floor((s.lon-7)/0.003)::INT AS x0 FROM sites s), w AS (SELECT *, (lat-46)/0.002-y0 AS fy, (lon-7)/0.003-x0 AS fx FROM b), bl AS (SELECT site, a.height*(1-fy)*(1-fx)+b2.height*(1-fy)*fx+c.height*fy*(1-fx)+e.height*fy*fx AS value FROM w LEFT JOIN grid a ON a.y=y0 AND a.x=x0 LEFT JOIN grid b2 ON b2.y=y0 AND b2.x=x0+1 LEFT JOIN grid c ON c.y=y0+1 AND c.x=x0 LEFT JOIN grid e ON e.y=y0+1 AND e.x=x0+1)"


@query("bilinear_corners", f"WITH {B.GRID}, {B.SITES}, {BILINEAR} SELECT site, round(value,6)+0.0 AS value, value IS NULL AS outside FROM bl")
def bilinear_corners(spark, d):
    """Brackets of both axes, then four corners by one equi-join; sites without all four keep their rows and are marked."""
    return rounded(spatial.bilinear(B.sites(spark, d), B.grid(spark, d), "height", "site").select("site", F.col("height").alias("value"), "outside"))


TARGETS = "t AS (SELECT p_partkey AS target, 46.0011+0.002*(p_partkey//50) AS lat, 7.0013+0.003*(p_partkey%50) AS lon FROM part)"


def targets(spark, d):
    p = B.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("target"), (46.0011 + 0.002 * F.floor(F.col("p_partkey") / 50)).alias("lat"), (7.0013 + 0.003 * (F.col("p_partkey") % 50)).alias("lon"))


def donors(spark, d):
    return B.grid(spark, d).select((F.col("y").cast("long") * 50 + F.col("x")).alias("donor"), "lat", "lon", "height", "land", "size")


SPACING = f"sp AS (SELECT median(km) AS spacing FROM (SELECT a.y*50+a.x AS t, min({ARC.format(a='a', b='b')}) AS km FROM grid a JOIN grid b ON (a.y<>b.y OR a.x<>b.x) AND abs(a.y-b.y)<=1 AND abs(a.x-b.x)<=1 GROUP BY 1))"


def spacing(spark, d) -> float:
    return regrid.spacing_km(donors(spark, d).select("donor", "lat", "lon")).first()[0]


@query("knn_donors", f"WITH {B.GRID}, {TARGETS}, {SPACING}, p AS (SELECT target, g.y::BIGINT*50+g.x AS donor, {ARC.format(a='t', b='g')} AS km FROM t JOIN grid g ON abs(t.lat-g.lat) < 0.02 AND abs(t.lon-g.lon) < 0.03), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(km,9), donor) AS rank, min(km) OVER (PARTITION BY target) AS nearest FROM p) SELECT target, rank::INT AS rank, donor, round(km,6)+0.0 AS km, nearest <= 3*spacing AS covered FROM r, sp WHERE rank <= 10")
def knn_donors(spark, d):
    """Ten donors for every target; one whose nearest donor is over three spacings away isn't covered."""
    near = spatial.k_nearest(targets(spark, d), donors(spark, d), 10)
    covered = F.min("km").over(Window.partitionBy("target")) <= regrid.MOST_SPACINGS * spacing(spark, d)
    return rounded(near.withColumn("covered", covered).select("target", "rank", "donor", "km", "covered"))


@query("grid_spacing", f"WITH {B.GRID}, {SPACING} SELECT round(spacing,6)+0.0 AS spacing_km, round(0.05*spacing/13.0*1.0,9)+0.0 AS scale FROM sp")
def grid_spacing(spark, d):
    """The median distance to the next point, and the scale of the kernel that goes with it."""
    s = regrid.spacing_km(donors(spark, d).select("donor", "lat", "lon"))
    return s.select(r6("spacing_km").alias("spacing_km"), (F.round(regrid.SCALE * F.col("spacing_km") / regrid.SCALE_KM, 9) + F.lit(0.0)).alias("scale"))


def weights(spark, d):
    """Weights of ten donors for every target that has sound ones, worked out once."""
    km = spacing(spark, d)
    return materialize(regrid.rbf_weights(targets(spark, d), donors(spark, d).select("donor", "lat", "lon"), 10, regrid.kernel_scale(km), km, strict=False), "weights")


@query("rbf_weights")
def rbf_weights(spark, d):
    """Sum of weights and of their sizes for every target, 1 and no more than the limit; targets without sound weights are marked."""
    g = weights(spark, d).groupBy("target").agg(F.count("*").alias("donors"), F.sum("weight").alias("total"), F.sum(F.abs("weight")).alias("size"), F.max("nugget").alias("nugget"))
    return rounded(g.withColumn("sound", F.col("total").isNotNull()).drop("nugget"))


@query("rbf_apply", f"WITH {TARGETS} SELECT target, 5.0::DOUBLE AS constant FROM t")
def rbf_apply(spark, d):
    """A constant is preserved at every target; where weights aren't sound, the nearest donor's value stands in."""
    w = weights(spark, d)
    filled = w.withColumn("weight", F.coalesce("weight", F.when(F.col("rank") == 1, 1.0).otherwise(0.0)))
    return rounded(regrid.apply_weights(filled, donors(spark, d).withColumn("constant", F.lit(5.0)), "constant"))


def edges(spark, d):
    """Cells as edges with normals that turn with the cells' sizes, and the wind along them: of a uniform (3, 7) m/s, and of the cells' heights."""
    ne, nn = F.cos(F.radians(F.col("size") * 7.0)), F.sin(F.radians(F.col("size") * 7.0))
    return donors(spark, d).select("donor", "lat", "lon", ne.alias("ne"), nn.alias("nn"), (3 * ne + 7 * nn).alias("uniform"), (F.col("height") / 100).alias("vn"))


@query("rbf_vector")
def rbf_vector(spark, d):
    """(u, v) of every target from winds along nine edges' normals by the vector kernel: of any wind, and of a uniform one, which comes back where the weights are sound."""
    at, km = edges(spark, d), spacing(spark, d)
    w = materialize(regrid.vector_weights(targets(spark, d), at, 9, regrid.kernel_scale(km), km, strict=False), "vector-weights")
    uniform = regrid.wind_from_normals(w, at, "uniform").withColumnsRenamed({"u": "u_uniform", "v": "v_uniform"})
    return rounded(regrid.wind_from_normals(w, at).join(uniform, "target"))


@query("box_mean_2d", f"WITH {B.GRID} SELECT a.y, a.x, round(avg(b.height),6)+0.0 AS height FROM grid a JOIN grid b ON abs(a.y-b.y)<=2 AND abs(a.x-b.x)<=2 GROUP BY 1,2")
def box_mean_2d(spark, d):
    return rounded(raster.box_mean(B.grid(spark, d).select("y", "x", "height"), "height", 2))


S121 = "{n} AS (SELECT y, x, land, CASE WHEN land THEN (2*{v} + CASE WHEN coalesce(lag(land) OVER w, FALSE) THEN lag({v}) OVER w ELSE 0 END + CASE WHEN coalesce(lead(land) OVER w, FALSE) THEN lead({v}) OVER w ELSE 0 END)/(2.0 + CASE WHEN coalesce(lag(land) OVER w, FALSE) THEN 1 ELSE 0 END + CASE WHEN coalesce(lead(land) OVER w, FALSE) THEN 1 ELSE 0 END) ELSE {v} END AS {v}{k} FROM {f} WINDOW w AS (PARTITION BY {p} ORDER BY {o}))"


@query("smooth_121", f"WITH {B.GRID}, {S121.format(n='a', v='height', k='', f='grid', p='y', o='x')}, {S121.format(n='b', v='height', k='', f='a', p='x', o='y')} SELECT y, x, {sql6('height')} FROM b")
def smooth_121(spark, d):
    return rounded(raster.smooth_121(B.grid(spark, d).select("y", "x", "land", "height"), "height", "land").drop("land"))


@query("shapiro_filter", f"WITH {B.GRID}, q AS (SELECT y, x, land, sqrt(height) AS height FROM grid), {S121.format(n='a', v='height', k='', f='q', p='y', o='x')}, {S121.format(n='b', v='height', k='', f='a', p='x', o='y')}, c AS (SELECT y, x, g.land, g.height AS h0, g.height-b.height AS height FROM q g JOIN b USING (y,x)), {S121.format(n='e', v='height', k='', f='c', p='y', o='x')}, {S121.format(n='f', v='height', k='', f='e', p='x', o='y')} SELECT y, x, round(CASE WHEN c.land THEN h0 - 0.9*(c.height-f.height) ELSE h0 END,6)+0.0 AS height FROM c JOIN f USING (y,x)")
def shapiro_filter(spark, d):
    return rounded(raster.shapiro(B.grid(spark, d).select("y", "x", "land", F.sqrt("height").alias("height")), "height", "land", 4, 0.9).drop("land"))


GRAD = "CASE WHEN lag(h) OVER w IS NULL THEN (-3*h+4*lead(h) OVER w-lead(h,2) OVER w)/400.0 WHEN lead(h) OVER w IS NULL THEN (3*h-4*lag(h) OVER w+lag(h,2) OVER w)/400.0 ELSE (lead(h) OVER w-lag(h) OVER w)/400.0 END"


@query("gradient_2d", f"WITH {B.GRID}, q AS (SELECT y, x, height+size*size AS h FROM grid), a AS (SELECT y, x, {GRAD} AS dx FROM q WINDOW w AS (PARTITION BY y ORDER BY x)), b AS (SELECT y, x, {GRAD} AS dy FROM q WINDOW w AS (PARTITION BY x ORDER BY y)) SELECT y, x, {sql6('dx', 'dy')} FROM a JOIN b USING (y,x)")
def gradient_2d(spark, d):
    g = B.grid(spark, d).select("y", "x", (F.col("height") + F.col("size") * F.col("size")).alias("h"))
    return rounded(g.select("y", "x", raster.gradient(g, "h", "x", 200.0).alias("dx"), raster.gradient(g, "h", "y", 200.0).alias("dy")))


@query("neighborhood_median", f"WITH {B.GRID} SELECT a.y, a.x, round(a.height-median(b.height),6)+0.0 AS relative FROM grid a JOIN grid b ON abs(a.y-b.y)<=25 AND abs(a.x-b.x)<=25 GROUP BY a.y, a.x, a.height")
def neighborhood_median(spark, d):
    """Height over the median of a square of 5 km half-width, which is 25 cells of 200 m."""
    g = raster.box_median(B.grid(spark, d).select("y", "x", "height"), "height", round(5000 / 200))
    return rounded(g.select("y", "x", (F.col("height") - F.col("median")).alias("relative")))


@query("edge_distance", f"WITH {B.GRID}, e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM grid) SELECT y, x, least(x-x0, x1-x, y-y0, y1-y) AS cells FROM grid, e")
def edge_distance(spark, d):
    return raster.edge_distance(B.grid(spark, d)).select("y", "x", "cells")


FOOT = f"{B.GRID}, c AS (SELECT p_partkey AS site, (p_partkey//50)::INT AS y0, (p_partkey%50)::INT AS x0 FROM part)"


def centres(spark, d):
    return B.table(spark, d, "part").select(F.col("p_partkey").alias("site"), F.floor(F.col("p_partkey") / 50).cast("int").alias("y0"), (F.col("p_partkey") % 50).cast("int").alias("x0"))


@query("footprint_join", f"WITH {FOOT}, j AS (SELECT site, oy, ox, g.y AS y, g.land AS land, g.height AS height FROM c, (SELECT unnest(range(-6,7)) AS oy) a, (SELECT unnest(range(-6,7)) AS ox) b2 LEFT JOIN grid g ON g.y=y0+oy AND g.x=x0+ox WHERE sqrt(oy*oy+ox*ox)*0.2 <= 1.0) SELECT site, count(*) AS expected, count(y) AS in_domain, count(*) FILTER (land) AS land_cells, round(count(*) FILTER (land)/count(*)::DOUBLE,6)+0.0 AS coverage, min(height) FILTER (land) AS lowest, max(height) FILTER (land) AS highest, round(stddev_pop(height) FILTER (land),6)+0.0 AS roughness, count(y) < count(*) AS clipped FROM j GROUP BY site")
def footprint_join(spark, d):
    j = spatial.footprint(centres(spark, d), B.grid(spark, d), 1.0, 0.2)
    land = F.coalesce(F.col("land"), F.lit(False))
    n = F.count_if(land)
    return rounded(j.groupBy("site").agg(F.count("*").alias("expected"), F.count("lat").alias("in_domain"), n.alias("land_cells"), (n / F.count("*")).alias("coverage"), F.min(F.when(land, F.col("height"))).alias("lowest"), F.max(F.when(land, F.col("height"))).alias("highest"), F.stddev_pop(F.when(land, F.col("height"))).alias("roughness"), (F.count("lat") < F.count("*")).alias("clipped")))


FOOT_TIME = f"{FOOT}, j AS (SELECT site, t, g.y, g.x, g.height/100.0 + t*g.size/50.0 AS u, g.size/10.0 - t AS v, y0*0.1+t AS obs_u, 5.0-x0*0.1 AS obs_v, g.y=y0 AND g.x=x0 AS nearest FROM c JOIN grid g ON abs(g.y-y0)<=4 AND abs(g.x-x0)<=4 AND sqrt((g.y-y0)*(g.y-y0)+(g.x-x0)*(g.x-x0))*0.2 <= 0.8, (SELECT unnest(range(0,3)) AS t) tt WHERE g.land AND NOT (g.size=7 AND t=1)), e AS (SELECT *, (u-obs_u)*(u-obs_u)+(v-obs_v)*(v-obs_v) AS e2 FROM j), ne AS (SELECT site, sqrt(avg(e2)) AS nearest_rmse FROM e WHERE nearest GROUP BY 1), at_ AS (SELECT site, t, avg(u) AS mu, avg(v) AS mv, any_value(obs_u) AS ou, any_value(obs_v) AS ov, count(*) AS cells, avg(sqrt(e2)) AS mean, median(sqrt(e2)) AS median, quantile_cont(sqrt(e2),0.9) AS p90, max(sqrt(e2)) AS largest FROM e GROUP BY 1,2), wh AS (SELECT site, sqrt(avg((mu-ou)*(mu-ou)+(mv-ov)*(mv-ov))) AS mean_vector_rmse, count(*) AS times FROM at_ GROUP BY 1), ce AS (SELECT site, y, x, sqrt(avg(e2)) AS rmse FROM e JOIN wh USING (site) GROUP BY 1,2,3,times HAVING count(*)=times), fx AS (SELECT site, count(*) AS cells, median(rmse) AS median, quantile_cont(rmse,0.1) AS p10, quantile_cont(rmse,0.9) AS p90, min(rmse) AS best_rmse FROM ce GROUP BY 1)"


@query("footprint_stats", f"WITH {FOOT_TIME} SELECT site, times, cells, {sql6('nearest_rmse', 'mean_vector_rmse', 'median', 'p10', 'p90', 'best_rmse')} FROM wh LEFT JOIN ne USING (site) LEFT JOIN fx USING (site)")
def footprint_stats(spark, d):
    """Errors of the cells around every site over three times: of its own cell, of the mean vector, and of each cell that is there at every time."""
    return rounded(campaign.footprint_errors(footprint_times(spark, d), "site")[0].drop("best_y", "best_x"))


def footprint_times(spark, d):
    j = spatial.footprint(centres(spark, d), B.grid(spark, d), 0.8, 0.2).where("land")
    t = j.withColumn("t", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).where("not (size = 7 and t = 1)")
    return t.select("site", "t", "y", "x", (F.col("height") / 100 + F.col("t") * F.col("size") / 50).alias("u"), (F.col("size") / 10 - F.col("t")).alias("v"), (F.col("y0") * 0.1 + F.col("t")).alias("obs_u"), (5.0 - F.col("x0") * 0.1).alias("obs_v"), ((F.col("oy") == 0) & (F.col("ox") == 0)).alias("nearest"))


@query("footprint_spread", f"WITH {FOOT_TIME} SELECT site, t::INT AS t, cells, {sql6('mean', 'median', 'p90', 'largest')} FROM at_")
def footprint_spread(spark, d):
    """How the errors of the cells around every site spread at each time."""
    return rounded(campaign.footprint_errors(footprint_times(spark, d), "site")[1])


@query("best_cell", f"WITH {FOOT}, j AS (SELECT site, g.y, g.x, abs(g.height-950) AS e FROM c JOIN grid g ON abs(g.y-y0)<=4 AND abs(g.x-x0)<=4 AND sqrt((g.y-y0)*(g.y-y0)+(g.x-x0)*(g.x-x0))*0.2 <= 0.8 WHERE g.land), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY e, y, x) AS n FROM j) SELECT site, y, x, round(e,6)+0.0 AS e FROM r WHERE n=1")
def best_cell(spark, d):
    j = spatial.footprint(centres(spark, d), B.grid(spark, d), 0.8, 0.2).where("land").withColumn("e", F.abs(F.col("height") - 950))
    return rounded(j.groupBy("site").agg(F.min_by(F.struct("y", "x", "e"), F.struct("e", "y", "x")).alias("b")).select("site", "b.*"))


@query("neighbor_join", f"WITH {B.GRID}, p AS (SELECT 'x' AS axis, class, land, height, lead(class) OVER w AS c2, lead(land) OVER w AS l2, lead(height) OVER w AS h2 FROM grid WINDOW w AS (PARTITION BY y ORDER BY x) UNION ALL SELECT 'y', class, land, height, lead(class) OVER w, lead(land) OVER w, lead(height) OVER w FROM grid WINDOW w AS (PARTITION BY x ORDER BY y)) SELECT axis, class=c2 AS same_class, count(*) AS pairs, round(avg(abs(h2-height)),6)+0.0 AS mean_jump, round(max(abs(h2-height)),6)+0.0 AS max_jump FROM p WHERE land AND l2 GROUP BY 1,2")
def neighbor_join(spark, d):
    p = raster.neighbour_pairs(B.grid(spark, d), ["class", "land", "height"]).where("land and next_land")
    jump = F.abs(F.col("next_height") - F.col("height"))
    return rounded(p.groupBy("axis", (F.col("class") == F.col("next_class")).alias("same_class")).agg(F.count("*").alias("pairs"), F.avg(jump).alias("mean_jump"), F.max(jump).alias("max_jump")))


@query("terrain_metrics", f"WITH {B.GRID}, p AS (SELECT height, land, lead(land) OVER w AS l2, lead(height) OVER w AS h2 FROM grid WINDOW w AS (PARTITION BY y ORDER BY x) UNION ALL SELECT height, land, lead(land) OVER w, lead(height) OVER w FROM grid WINDOW w AS (PARTITION BY x ORDER BY y)), j AS (SELECT max(abs(h2-height)) AS m, quantile_cont(abs(h2-height),0.999) AS p999, avg(abs(h2-height)) AS a FROM p WHERE land AND l2) SELECT min(height) AS lowest, round(avg(height),6)+0.0 AS mean, max(height) AS highest, round(any_value(m),6)+0.0 AS max_jump, round(any_value(p999),6)+0.0 AS p999_jump, round(any_value(a),6)+0.0 AS mean_jump FROM grid, j WHERE land")
def terrain_metrics(spark, d):
    g = B.grid(spark, d)
    p = raster.neighbour_pairs(g, ["land", "height"]).where("land and next_land").select(F.abs(F.col("next_height") - F.col("height")).alias("j"))
    jumps = p.agg(F.max("j").alias("max_jump"), F.lit(quantiles(p, "j", [0.999])[0]).alias("p999_jump"), F.avg("j").alias("mean_jump"))
    return rounded(g.where("land").agg(F.min("height").alias("lowest"), F.avg("height").alias("mean"), F.max("height").alias("highest")).join(F.broadcast(jumps)))


@query("block_mean_change", f"WITH {B.GRID}, e AS (SELECT (max(y)+1)//5*5 AS ny, (max(x)+1)//5*5 AS nx FROM grid), b AS (SELECT y//5 AS by_, x//5 AS bx, avg(size*0.1) AS ch FROM grid, e WHERE y<ny AND x<nx AND land GROUP BY 1,2) SELECT round(avg(ch),6)+0.0 AS mean, round(sqrt(avg(ch*ch)),6)+0.0 AS rms, round(quantile_cont(abs(ch),0.99),6)+0.0 AS p99, round(max(abs(ch)),6)+0.0 AS largest, count(*) AS blocks FROM b")
def block_mean_change(spark, d):
    g = B.grid(spark, d)
    e = g.agg((F.floor((F.max("y") + 1) / 5) * 5).alias("ny"), (F.floor((F.max("x") + 1) / 5) * 5).alias("nx"))
    b = g.join(F.broadcast(e)).where("y < ny and x < nx and land").groupBy(F.floor(F.col("y") / 5).alias("by"), F.floor(F.col("x") / 5).alias("bx")).agg(F.avg(F.col("size") * 0.1).alias("ch"))
    return rounded(b.agg(F.avg("ch").alias("mean"), F.sqrt(F.avg(F.col("ch") * F.col("ch"))).alias("rms"), F.lit(quantiles(b.select(F.abs("ch").alias("a")), "a", [0.99])[0]).alias("p99"), F.max(F.abs("ch")).alias("largest"), F.count("*").alias("blocks")))


@query("category_fraction", f"WITH {B.GRID}, f AS (SELECT y//4 AS ty, x//4 AS tx, size % 5 AS category, count(*) AS n, sum(count(*)) OVER (PARTITION BY y//4, x//4) AS total FROM grid GROUP BY 1,2,3) SELECT ty, tx, category, round(n/total::DOUBLE,6)+0.0 AS fraction FROM f")
def category_fraction(spark, d):
    f = B.grid(spark, d).groupBy(F.floor(F.col("y") / 4).alias("ty"), F.floor(F.col("x") / 4).alias("tx"), (F.col("size") % 5).alias("category")).agg(F.count("*").alias("n"))
    return rounded(f.select("ty", "tx", "category", (F.col("n") / F.sum("n").over(Window.partitionBy("ty", "tx"))).alias("fraction")))


@query("argmax_category", f"WITH {B.GRID}, f AS (SELECT y//4 AS ty, x//4 AS tx, size % 5 AS category, count(*) AS n FROM grid GROUP BY 1,2,3), r AS (SELECT *, row_number() OVER (PARTITION BY ty, tx ORDER BY n DESC, category) AS k FROM f) SELECT ty, tx, category AS dominant FROM r WHERE k=1")
def argmax_category(spark, d):
    f = B.grid(spark, d).groupBy(F.floor(F.col("y") / 4).alias("ty"), F.floor(F.col("x") / 4).alias("tx"), (F.col("size") % 5).alias("category")).agg(F.count("*").alias("n"))
    return f.groupBy("ty", "tx").agg(F.max_by("category", F.struct("n", -F.col("category"))).alias("dominant"))


#: Two overlapping tiles: the first ends at column 30 and has holes, the second begins at column 24 and stands a little higher.
TILES = "tiles AS (SELECT 0 AS tile, y, x, CASE WHEN size <> 13 THEN height END AS terrain FROM grid WHERE x < 30 UNION ALL SELECT 1, y, x, height+0.5 FROM grid WHERE x >= 24), mosaic AS (SELECT y, x, arg_min(terrain, tile) AS terrain FROM tiles WHERE terrain IS NOT NULL GROUP BY 1,2)"
_SHARES = [(p, k, f"{a}+(size*{m}+{k}*3) % {n}") for p, a, m, n in (("sand", 20, 7, 40), ("silt", 15, 3, 25)) for k in range(6)]
_SOIL = ", ".join(f"CASE WHEN NOT (y BETWEEN 9 AND 17 AND x BETWEEN 18 AND 30) THEN ({e})::DOUBLE END AS {p}{k}" for p, k, e in _SHARES)
_OVER = "greatest(0, least(y*30.0+40, (cell_y+1)*70.0)-greatest(y*30.0+10, cell_y*70.0)) * greatest(0, least(x*30.0+35, (cell_x+1)*70.0)-greatest(x*30.0+5, cell_x*70.0))"
#: Which source depths each target layer overlaps, and by how many centimetres.
_DEPTHS = (((0, 5), (1, 5)), ((1, 5), (2, 15)), ((3, 30), (4, 10)), ((4, 30), (5, 50)))
_MIX = lambda p, k: "(" + "+".join(f"{p}{j}*{w}" for j, w in _DEPTHS[k]) + f")/{sum(w for _, w in _DEPTHS[k])}.0"
TEXTURE = "CASE WHEN clay>=40 AND sand<=45 AND silt<40 THEN 12 WHEN clay>=40 AND silt>=40 THEN 11 WHEN clay>=35 AND sand>45 THEN 10 WHEN clay>=27 AND clay<40 AND sand>20 AND sand<=45 THEN 9 WHEN clay>=27 AND clay<40 AND sand<=20 THEN 8 WHEN clay>=20 AND clay<35 AND silt<28 AND sand>45 THEN 7 WHEN clay>=7 AND clay<27 AND silt>=28 AND silt<50 AND sand<=52 THEN 6 WHEN silt>=80 AND clay<12 THEN 5 WHEN silt>=50 AND ((clay>=12 AND clay<27) OR (clay<12 AND silt<80)) THEN 4 WHEN silt+2*clay>=30 AND ((clay>=7 AND clay<20 AND sand>52) OR (clay<7 AND silt<50)) THEN 3 WHEN sand>=70 AND sand<90 AND silt+1.5*clay>=15 AND silt+2*clay<30 THEN 2 WHEN sand>=85 AND silt+1.5*clay<15 THEN 1 ELSE 6 END"


@query("public_static", f"WITH {B.GRID}, {TILES}, pix AS (SELECT g.y, g.x, m.terrain, size % 20 + 1 AS category, {_SOIL} FROM grid g LEFT JOIN mosaic m USING (y, x)), pixels AS (SELECT *, {', '.join(f'100-sand{k}-silt{k} AS clay{k}' for k in range(6))} FROM pix), o AS (SELECT *, {_OVER} AS area FROM (SELECT p.*, floor((y*30.0+10)/70)::INT+a AS cell_y, floor((x*30.0+5)/70)::INT+b AS cell_x FROM pixels p, (SELECT unnest([0,1]) AS a) aa, (SELECT unnest([0,1]) AS b) bb)), c AS (SELECT cell_y, cell_x, sum(terrain*area) FILTER (terrain IS NOT NULL)/sum(area) FILTER (terrain IS NOT NULL) AS terrain, {', '.join(f'sum({p}{k}*area)/sum(area) FILTER ({p}{k} IS NOT NULL) AS {p}{k}' for p in ('sand', 'silt', 'clay') for k in range(6))} FROM o WHERE area > 0 GROUP BY 1,2), f AS (SELECT cell_y, cell_x, category, sum(area) AS area, sum(sum(area)) OVER (PARTITION BY cell_y, cell_x) AS total FROM o WHERE area > 0 GROUP BY 1,2,3), d AS (SELECT cell_y, cell_x, arg_min(category, (-round(area/total,9), category)) AS category, max(area/total) AS share FROM f GROUP BY 1,2), m AS (SELECT cell_y, cell_x, {', '.join(f'{_MIX(p, k)} AS {p}_{k}' for p in ('sand', 'silt', 'clay') for k in range(4))} FROM c), lost AS (SELECT cell_y, cell_x FROM m WHERE sand_0 IS NULL), near AS (SELECT l.cell_y, l.cell_x, arg_min((m.cell_y, m.cell_x), ((l.cell_y-m.cell_y)**2+(l.cell_x-m.cell_x)**2, m.cell_y, m.cell_x)) AS src, sqrt(min((l.cell_y-m.cell_y)**2+(l.cell_x-m.cell_x)**2)) AS gap FROM lost l, m WHERE sand_0 IS NOT NULL GROUP BY 1,2), w AS (SELECT a.cell_y, a.cell_x, coalesce(gap, 0.0)::DOUBLE AS gap_cells, {', '.join(f'b.{p}_{k}' for p in ('sand', 'silt', 'clay') for k in range(4))} FROM m a LEFT JOIN near n ON n.cell_y=a.cell_y AND n.cell_x=a.cell_x JOIN m b ON (n.src IS NULL AND b.cell_y=a.cell_y AND b.cell_x=a.cell_x) OR (n.src IS NOT NULL AND (b.cell_y, b.cell_x) = n.src)) SELECT cell_y, cell_x, round(terrain,6)+0.0 AS terrain, category, round(share,6)+0.0 AS share, category <> 16 AS land, {', '.join(f'(SELECT {TEXTURE} FROM (SELECT sand_{k} AS sand, silt_{k} AS silt, clay_{k} AS clay))::INT AS texture{k}' for k in range(4))}, round(gap_cells,6)+0.0 AS gap_cells FROM c JOIN d USING (cell_y, cell_x) JOIN w USING (cell_y, cell_x)")
def public_static(spark, d):
    """Terrain, the leading category with its share, and four texture layers of cells of 70 m, from pixels of 30 m in two overlapping tiles; cells without soil are filled from the nearest."""
    g = B.grid(spark, d)
    tile = lambda k, rows, terrain: rows.select(F.lit(k).alias("tile"), "y", "x", terrain.alias("terrain"))
    terrain = zonal.mosaic(tile(0, g.where("x < 30"), F.when(F.col("size") != 13, F.col("height"))).unionAll(tile(1, g.where("x >= 24"), F.col("height") + 0.5)), "terrain")
    there = ~(F.col("y").between(9, 17) & F.col("x").between(18, 30))
    soil = {f"{p}{k}": F.when(there, F.expr(e).cast("double")) for p, k, e in _SHARES}
    pixels = g.join(terrain, ["y", "x"], "left").select("y", "x", "terrain", (F.col("size") % 20 + 1).alias("category"), *[c.alias(n) for n, c in soil.items()])
    pixels = pixels.withColumns({f"clay{k}": 100 - F.col(f"sand{k}") - F.col(f"silt{k}") for k in range(6)})
    over = materialize(zonal.over_cells(pixels, 30.0, 70.0, (10.0, 5.0)), "overlaps")
    cells = zonal.zonal_mean(over, "terrain").join(zonal.dominant(zonal.zonal_shares(over, "category"), "category"), ["cell_y", "cell_x"])
    return rounded(cells.join(zonal.soil_layers(over, "sand", "silt", "clay"), ["cell_y", "cell_x"]))


MASK = "size % 3 = 0"
LABELS = f"{B.GRID}, m AS (SELECT y, x, y*50+x AS node, height, size FROM grid WHERE {MASK}), reach AS (WITH RECURSIVE r(node, root) AS (SELECT node, node FROM m UNION SELECT n.node, r.root FROM r JOIN m a ON a.node=r.node JOIN m n ON (abs(n.y-a.y)+abs(n.x-a.x)=1)) SELECT node, min(root) AS root FROM r GROUP BY 1), lab AS (SELECT y, x, height, size, root, dense_rank() OVER (ORDER BY root) AS label FROM m JOIN reach USING (node))"


@query("connected_components", f"WITH {LABELS} SELECT y, x, label::INT AS label FROM lab")
def connected_components(spark, d):
    return raster.label_components(B.grid(spark, d), F.expr(MASK))


@query("component_stats", f"WITH {LABELS}, st AS (SELECT label, count(*) AS cells, count(*) FILTER (size > 30) AS unsupported, avg(y) AS cy, avg(x) AS cx, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM lab GROUP BY label), k AS (SELECT *, row_number() OVER (ORDER BY cells DESC, label) <= 20 OR row_number() OVER (ORDER BY unsupported DESC, label) <= 20 OR cells*0.04 >= 1.0 OR unsupported*0.04 >= 0.2 AS kept FROM st) SELECT label::INT AS label, 1::BIGINT AS bodies, cells, round(cells*0.04::DOUBLE,6)+0.0 AS km2, unsupported, round(unsupported/cells::DOUBLE,6)+0.0 AS fraction, round(cy,6)+0.0 AS cy, round(cx,6)+0.0 AS cx, y0, y1, x0, x1 FROM k WHERE kept UNION ALL SELECT NULL, count(*), coalesce(sum(cells),0)::BIGINT, round(coalesce(sum(cells),0)*0.04::DOUBLE,6)+0.0, coalesce(sum(unsupported),0)::BIGINT, round(CASE WHEN sum(cells)>0 THEN sum(unsupported)/sum(cells)::DOUBLE END,6)+0.0, NULL, NULL, NULL, NULL, NULL, NULL FROM k WHERE NOT kept")
def component_stats(spark, d):
    """Bodies that are among the 20 largest or the 20 with most unsupported cells, or have 1 km2, or 0.2 km2 without support; and one row, without a label, for all others."""
    g = B.grid(spark, d)
    lab = raster.label_components(g, F.expr(MASK)).join(g, ["y", "x"])
    s = materialize(lab.groupBy("label").agg(F.count("*").alias("cells"), F.count_if(F.col("size") > 30).alias("unsupported"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")), "bodies")
    top = lambda by: s.orderBy(F.desc(by), "label").limit(20).select("label")
    best = top("cells").unionByName(top("unsupported")).distinct().withColumn("best", F.lit(True))
    s = s.join(F.broadcast(best), "label", "left").withColumn("kept", F.coalesce("best", F.lit(False)) | (F.col("cells") * 0.04 >= 1.0) | (F.col("unsupported") * 0.04 >= 0.2))
    area = (F.col("cells") * 0.04).alias("km2")
    kept = s.where("kept").select("label", F.lit(1).cast("long").alias("bodies"), "cells", area, "unsupported", (F.col("unsupported") / F.col("cells")).alias("fraction"), "cy", "cx", "y0", "y1", "x0", "x1")
    total = s.where("not kept").agg(F.count("*").alias("bodies"), F.coalesce(F.sum("cells"), F.lit(0).cast("long")).alias("cells"), F.coalesce(F.sum("unsupported"), F.lit(0).cast("long")).alias("unsupported"))
    rest = total.select("bodies", "cells", area, "unsupported", F.try_divide("unsupported", "cells").alias("fraction"))
    return rounded(kept.unionByName(rest, allowMissingColumns=True))


@query("top_components", f"WITH {LABELS} SELECT label::INT AS label, count(*) AS cells FROM lab GROUP BY label ORDER BY count(*) DESC, label LIMIT 20")
def top_components(spark, d):
    s = raster.label_components(B.grid(spark, d), F.expr(MASK)).groupBy("label").agg(F.count("*").alias("cells"))
    return s.orderBy(F.desc("cells"), "label").limit(20)


@query("area_summary", f"WITH {B.GRID}, k AS (SELECT *, NOT land AS water, NOT land AND size<4 AS bad, size*0.25 AS km FROM grid) SELECT round(count(*) FILTER (water)*0.04::DOUBLE,6)+0.0 AS water_km2, round(count(*) FILTER (bad)*0.04::DOUBLE,6)+0.0 AS unsupported_km2, round(count(*) FILTER (bad)/nullif(count(*) FILTER (water),0)::DOUBLE,6)+0.0 AS fraction, round(quantile_cont(km::DOUBLE,0.5) FILTER (bad),6)+0.0 AS km_p50, round(quantile_cont(km::DOUBLE,0.9) FILTER (bad),6)+0.0 AS km_p90, (max(km) FILTER (bad))::DOUBLE AS km_largest FROM k")
def area_summary(spark, d):
    """Areas of water and of water without support, and how far away that support is."""
    water, lost = F.count_if(~F.col("land")), ~F.col("land") & (F.col("size") < 4)
    bad, km = F.count_if(lost), F.when(lost, F.col("size") * 0.25)
    q = F.percentile(km, F.array(F.lit(0.5), F.lit(0.9)))
    return rounded(B.grid(spark, d).agg((water * 0.04).alias("water_km2"), (bad * 0.04).alias("unsupported_km2"), F.try_divide(bad, water).alias("fraction"), q[0].alias("km_p50"), q[1].alias("km_p90"), F.max(km).alias("km_largest")))


@query("extrema_record", f"WITH {B.GRID}, r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY height*size, y, x) AS n FROM grid) SELECT class, y, x, round(height*size,6)+0.0 AS least_value FROM r WHERE n=1")
def extrema_record(spark, d):
    v = F.col("height") * F.col("size")
    return rounded(B.grid(spark, d).groupBy("class").agg(F.min_by(F.struct("y", "x", v.alias("least_value")), F.struct(v, "y", "x")).alias("b")).select("class", "b.*"))


@query("wind_maxima", f"WITH {B.GRID}, w AS (SELECT y, x, t, h, CASE h WHEN 10 THEN height/100 - size + t ELSE 1.5*(height/100 - size) END AS u, CASE h WHEN 10 THEN size*0.4 - x*0.1 ELSE size*0.9 + t END AS v FROM grid, (SELECT unnest([10, 50]) AS h) hh, (SELECT unnest(range(3)) AS t) tt), s AS (SELECT *, sqrt(u*u + v*v) AS speed FROM w WHERE y > 0 AND x > 0) SELECT h::INT AS height, round(max(speed),6)+0.0 AS strongest, arg_max(y, (round(speed,9), -t, -y, -x))::INT AS y, arg_max(x, (round(speed,9), -t, -y, -x))::INT AS x, count(*) FILTER (speed > 60) AS over, max(speed) <= 60 AS bounded FROM s GROUP BY h")
def wind_maxima(spark, d):
    """The strongest wind at 10 and 50 m over all core cells and three times, where it is, and how many are over 60 m/s."""
    at = lambda h, u, v: F.struct(F.lit(h).alias("height"), u.cast("double").alias("u"), v.cast("double").alias("v"))
    g = B.grid(spark, d).where("y > 0 and x > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("t"))
    base, size, t = F.col("height") / 100 - F.col("size"), F.col("size"), F.col("t")
    w = g.select("y", "x", "t", F.explode(F.array(at(10, base + t, size * 0.4 - F.col("x") * 0.1), at(50, 1.5 * base, size * 0.9 + t))).alias("w")).select("y", "x", "t", "w.*")
    return rounded(campaign.wind_maxima(w, 60.0))


@query("lookup_join", f"WITH {B.GRID}, l AS (SELECT * FROM (VALUES (0,1.5),(1,2.5),(2,4.0)) t(code, value)), j AS (SELECT y, x, coalesce(value, 7.0) AS value FROM grid LEFT JOIN l ON size%5=code) SELECT y, x, value::DOUBLE AS value FROM j")
def lookup_join(spark, d):
    l = spark.createDataFrame([(0, 1.5), (1, 2.5), (2, 4.0)], "code int, value double")
    return B.grid(spark, d).withColumn("code", F.col("size") % 5).join(F.broadcast(l), "code", "left").select("y", "x", F.coalesce("value", F.lit(7.0)).alias("value"))


@query("interval_overlap", f"WITH {B.PROFILE}, t AS (SELECT unnest([0.0,150.0,400.0]) AS top, unnest([150.0,400.0,900.0]) AS bot), o AS (SELECT column_id, top, greatest(least(z+60, bot)-greatest(z-40, top),0) AS w, value FROM profile JOIN t ON z-40 < bot AND top < z+60) SELECT column_id, top::DOUBLE AS top, round(sum(w*value)/sum(w),6)+0.0 AS mean FROM o WHERE w > 0 GROUP BY 1,2")
def interval_overlap(spark, d):
    t = spark.createDataFrame([(0.0, 150.0), (150.0, 400.0), (400.0, 900.0)], "top double, bot double")
    o = B.profile(spark, d).join(F.broadcast(t), (F.col("z") - 40 < F.col("bot")) & (F.col("top") < F.col("z") + 60))
    w = F.least(F.col("z") + 60, F.col("bot")) - F.greatest(F.col("z") - 40, F.col("top"))
    o = o.withColumn("w", w).where("w > 0")
    return rounded(o.groupBy("column_id", "top").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("mean")))


@query("point_gather", f"WITH {B.GRID} SELECT o.o_orderkey AS record, g.height FROM orders o JOIN grid g ON g.y = o.o_orderkey % (SELECT max(y)+1 FROM grid) AND g.x = o.o_custkey % 50")
def point_gather(spark, d):
    rows = B.grid(spark, d).agg((F.max("y") + 1).alias("ny"))
    o = B.table(spark, d, "orders").crossJoin(F.broadcast(rows)).select(F.col("o_orderkey").alias("record"), (F.col("o_orderkey") % F.col("ny")).alias("y"), (F.col("o_custkey") % 50).alias("x"))
    return o.join(B.grid(spark, d).select("y", "x", "height"), ["y", "x"]).select("record", "height")


@query("layer_attach", f"WITH {B.GRID} SELECT y, x, height, CASE WHEN land THEN size*2 END AS horizon FROM grid")
def layer_attach(spark, d):
    base, layer = B.grid(spark, d).select("y", "x", "height"), B.grid(spark, d).where("land").select("y", "x", (F.col("size") * 2).alias("horizon"))
    if set(base.columns) & set(layer.columns) - {"y", "x"}:
        raise ValueError("a layer of that name exists")
    return base.join(layer, ["y", "x"], "left")


EDGES = "e AS (SELECT min(x)+5 AS x0, max(x)-5 AS x1, min(y)+5 AS y0, max(y)-5 AS y1 FROM grid)"
TAPER = "(0.5-0.5*cos(pi()*least(least(x-x0,x1-x,y-y0,y1-y)/6.0,1.0)))"


@query("crop_reblend", f"WITH {B.GRID}, {EDGES} SELECT y-y0 AS y, x-x0 AS x, round((1-{TAPER})*900 + {TAPER}*height,6)+0.0 AS blended FROM grid, e WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1")
def crop_reblend(spark, d):
    """The raster without five cells at each edge, and edge weights made anew."""
    g = B.grid(spark, d)
    e = g.agg((F.min("x") + 5).alias("x0"), (F.max("x") - 5).alias("x1"), (F.min("y") + 5).alias("y0"), (F.max("y") - 5).alias("y1"))
    return rounded(raster.reblend(g.crossJoin(F.broadcast(e)).where("y between y0 and y1 and x between x0 and x1"), "height", F.lit(900.0), 6.0).select((F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), F.col("height").alias("blended")))


@query("regular_grid", "SELECT y::INT AS y, x::INT AS x, round((y-max(y) OVER ()/2.0)*200.0::DOUBLE,6)+0.0 AS north, round((x-max(x) OVER ()/2.0)*200.0::DOUBLE,6)+0.0 AS east FROM (SELECT DISTINCT p_partkey//50 AS y FROM part) a, (SELECT DISTINCT p_partkey%50 AS x FROM part) b")
def regular_grid(spark, d):
    g = B.grid(spark, d)
    e = g.agg(F.max("y").alias("my"), F.max("x").alias("mx"))
    axes = e.select(F.explode(F.sequence(F.lit(0), F.col("my"))).alias("y"), "mx", "my").select("y", F.explode(F.sequence(F.lit(0), F.col("mx"))).alias("x"), "mx", "my")
    return rounded(axes.select("y", "x", ((F.col("y") - F.col("my") / 2) * 200.0).alias("north"), ((F.col("x") - F.col("mx") / 2) * 200.0).alias("east")))


INNER = "i AS (SELECT y, x, height + (abs(y-19)+abs(x-24))*0.01 AS inner_ FROM grid WHERE y BETWEEN 10 AND 29 AND x BETWEEN 10 AND 39)"


def embedding(spark, d):
    g = B.grid(spark, d).select("y", "x", "height")
    off = (F.abs(F.col("y") - 19) + F.abs(F.col("x") - 24)) * 0.01
    return g, g.where("y between 10 and 29 and x between 10 and 39").withColumn("height", F.col("height") + off)


@query("embed_dem", f"WITH {B.GRID}, {INNER} SELECT g.y, g.x, coalesce(inner_, height) AS height, inner_ IS NOT NULL AS inside FROM grid g LEFT JOIN i USING (y,x)")
def embed_dem(spark, d):
    """A raster with another in it, whose edge differs from it by a quarter of a metre at most."""
    return raster.embedded(*embedding(spark, d), "height", 0.3)


@query("embed_gate", f"WITH {B.GRID}, {INNER}, e AS (SELECT abs(height-inner_) AS gap FROM grid JOIN i USING (y, x) WHERE y IN (10, 29) OR x IN (10, 39)) SELECT count(*) AS cells, round(max(gap),6)+0.0 AS largest, round(quantile_cont(gap,0.99),6)+0.0 AS p99, round(avg(gap),6)+0.0 AS mean, TRUE AS refused FROM e")
def embed_gate(spark, d):
    """How far the two rasters differ along the inner one's edge; a lower limit refuses to embed."""
    outer, inner = embedding(spark, d)
    try:
        raster.embedded(outer, inner, "height", 0.2)
        refused = False
    except ValueError:
        refused = True
    return rounded(raster.edge_gap(outer, inner, "height").withColumn("refused", F.lit(refused)))


#: A product of three times over the grid: a third is added each hour, and cells of size 50 hold the fill value.
HOURS = "SELECT unnest(range(3))::INT AS hour"


def clustered_grid(spark, d) -> str:
    path = shared_path(spark, "clustered")
    g = B.grid(spark, d).crossJoin(F.broadcast(spark.range(3).withColumnRenamed("id", "hour")))
    height = F.when(F.col("size") == 50, -9999.0).otherwise(F.col("height") + F.col("hour") / 3.0)
    clustered.write(g.select(F.timestamp_seconds(1704067200 + 3600 * F.col("hour")).alias("valid"), "y", "x", height.alias("height"), "size"), path, 16, {"height": -9999.0})
    return path


@query("grid_scan", f"WITH {B.GRID} SELECT y, x, round(CASE WHEN size <> 50 THEN height + 2/3.0 END,6)+0.0 AS height FROM grid")
def grid_scan(spark, d):
    """One field at one time, from the files of that time; masked cells are null."""
    return rounded(clustered.slice_2d(spark, clustered_grid(spark, d), "height", "2024-01-01 02:00:00"))


@query("point_scan", f"WITH {B.GRID}, {B.SITES}, p AS (SELECT site, floor((s.lat-46)/0.002)::INT AS y, floor((s.lon-7)/0.003)::INT AS x FROM sites s) SELECT site, hour, round(CASE WHEN size <> 50 THEN height + hour/3.0 END,6)+0.0 AS height, size FROM p JOIN grid USING (y, x), ({HOURS})")
def point_scan(spark, d):
    """The series of two fields at the cells of sites, from the files of their tiles."""
    at = B.sites(spark, d).select("site", F.floor((F.col("lat") - 46) / 0.002).cast("int").alias("y"), F.floor((F.col("lon") - 7) / 0.003).cast("int").alias("x"))
    rows = clustered.at_points(spark, clustered_grid(spark, d), at, "height", "size", side=16)
    return rounded(rows.select("site", F.hour("valid").alias("hour"), "height", "size"))


@query("axes_by_name", f"WITH {B.GRID} SELECT y, x, time, CASE WHEN size <> 7 THEN height + 1000.0*time END AS value FROM grid, (SELECT unnest(range(2))::INT AS time) WHERE x < 40 AND y IN (SELECT y FROM grid WHERE x < 40 GROUP BY y HAVING count(*) = 40)")
def axes_by_name(spark, d):
    """Rows of the grid as arrays whose axes stand in either order, with an axis of length one between them; time and cells are told by name."""
    g = B.grid(spark, d).where("x < 40")  # 40 cells a row at most
    value = lambda t: F.transform("cells", lambda c: F.when(c["size"] == 7, -1.0).otherwise(c["height"] + 1000.0 * t))
    rows = g.groupBy("y").agg(F.array_sort(F.collect_list(F.struct("x", "size", "height"))).alias("cells")).where(F.size("cells") == 40)
    first, second = value(0), value(1)
    words = lambda *a: F.array(*map(F.lit, a))
    time_first = F.col("y") % 2 == 0
    arrays = rows.select(
        "y", F.when(time_first, words("time", "level", "x")).otherwise(words("x", "level", "time")).alias("dims"), F.when(time_first, words(2, 1, 40)).otherwise(words(40, 1, 2)).alias("shape"),
        F.when(time_first, F.concat(first, second)).otherwise(F.flatten(F.zip_with(first, second, lambda a, b: F.array(a, b)))).alias("values"),
    )
    return clustered.unpack(arrays, ("time", "x"), fill=-1.0).where("violation is null").drop("violation")


@query("distribution_by_class", f"WITH {B.GRID} SELECT class, min(height) AS least_, round(quantile_cont(height,0.01),6)+0.0 AS p01, round(quantile_cont(height,0.5),6)+0.0 AS p50, round(quantile_cont(height,0.99),6)+0.0 AS p99, max(height) AS max FROM grid WHERE land GROUP BY class")
def distribution_by_class(spark, d):
    q = stats.distribution("height", (0.01, 0.5, 0.99))
    return rounded(B.grid(spark, d).where("land").groupBy("class").agg(F.min("height").alias("least_"), *q).drop("n"))


@query("grid_interp", f"WITH {B.GRID}, {B.SITES}, {BILINEAR}, p AS (SELECT site, height, {KM.format(at='s.lat')} AS km, y, x FROM sites s, grid g), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY km, y, x) AS n FROM p) SELECT r.site, height AS nearest, round(value,6)+0.0 AS linear FROM r JOIN bl USING (site) WHERE n=1")
def grid_interp(spark, d):
    """Nearest and linear interpolation; linear has no value outside the grid."""
    s, g = B.sites(spark, d), B.grid(spark, d)
    at = spatial.nearest_cell(s, g, ["site"]).select("site", "y", "x")
    near = at.join(g.select("y", "x", F.col("height").alias("nearest")), ["y", "x"]).select("site", "nearest")
    return rounded(near.join(spatial.bilinear(s, g, "height", "site").select("site", F.col("height").alias("linear")), "site"))


@query("udf_kernel_solve")
def udf_kernel_solve(spark, d):
    """The batched kernel solves themselves: one row for each target and donor."""
    return rounded(weights(spark, d))


@query("udtf_offsets", "SELECT p_partkey AS site, oy::INT AS oy, ox::INT AS ox FROM part, (SELECT unnest(range(-2,3)) AS oy) a, (SELECT unnest(range(-2,3)) AS ox) b WHERE sqrt(oy*oy+ox*ox) <= 2")
def udtf_offsets(spark, d):
    """Offsets of a footprint from two sequences; no Python table function is needed."""
    steps = F.sequence(F.lit(-2), F.lit(2))
    o = centres(spark, d).select("site", F.explode(steps).alias("oy")).select("site", "oy", F.explode(steps).alias("ox"))
    return o.where(F.sqrt(F.col("oy") * F.col("oy") + F.col("ox") * F.col("ox")) <= 2)
