"""Queries of the surface family: soil, skin and snow of every target from donors on its own surface."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from skillgrid.functions import physics as P
from skillgrid.operators import regrid, spatial, surface
from skillgrid.plans import bindings as B
from skillgrid.plans.q_grid import ARC, TARGETS, targets
from skillgrid.plans.registry import query, rounded, sql6
from skillgrid.session import materialize

BY_CODE = lambda values: "CASE code " + " ".join(f"WHEN {k} THEN {v!r}::DOUBLE" for k, v in enumerate(values, 1)) + " END"
#: What each method makes of a source layer's water content, and of the target's layer mean.
GIVEN = {"index": f"greatest((vwc-{BY_CODE(P.WILTING_POINT)})/({BY_CODE(P.FIELD_CAPACITY)}-{BY_CODE(P.WILTING_POINT)}),0.0)", "saturation": f"least(greatest(vwc/{BY_CODE(P.POROSITY)},0.0),1.0)", "absolute": "vwc"}
TAKEN = {"index": "wilting+{i}*(capacity-wilting)", "saturation": "{i}*most", "absolute": "{i}"}


def donors(spark, d):
    """Cells as donors: layers of the same water content for each cell, no soil temperature over water, some skins missing, snow on a quarter of the cells."""
    g, size = B.grid(spark, d), F.col("size")
    thick = [b - a for a, b in zip(P.SOIL_BOUNDS, P.SOIL_BOUNDS[1:])]
    swe = F.when(size % 4 == 0, size * 2.0).otherwise(0.0)
    return g.select(
        (F.col("y").cast("long") * 50 + F.col("x")).alias("donor"), "lat", "lon", "land", (size % 10 + 1).alias("soil"), F.col("height").alias("topo"), F.when(size != 13, 280 + size * 0.1).alias("skin"),
        F.array(*[F.when(F.col("land"), 281 + size * 0.05 - 0.3 * k) for k in range(8)]).alias("t"), F.array(*[(17.3 + size * 5.1) * (1 - 0.0517 * k) * t for k, t in enumerate(thick)]).alias("w"),
        swe.alias("swe"), F.when(swe > 0, 100 + size * 5.0).alias("snow_density"), (255 + size * 0.3).alias("snow_t"),
    )


def own(spark, d):
    t = F.col("target")
    return targets(spark, d).select("target", "lat", "lon", (t % 3 != 0).alias("land"), (t % 11 == 0).alias("glacier"), (t % 19 + 1).cast("int").alias("soil"), (900.0 + (t % 50) * 20).alias("topo"))


def hydraulics(spark):
    k = F.col("id")
    return spark.range(1, 20).select(k.cast("int").alias("soil"), (0.02 + 0.001 * k).alias("dry"), (0.06 + 0.002 * k).alias("wilting"), (0.2 + 0.008 * k).alias("capacity"), (0.35 + 0.006 * k).alias("most"))


def inverse_distance(spark, d):
    """Weights of the four nearest donors by inverse distance, which SQL can express too."""
    near = spatial.k_nearest(targets(spark, d), donors(spark, d).select("donor", "lat", "lon"), 4)
    share = 1 / (F.col("km") + 0.1)
    total = F.sum(share).over(Window.partitionBy("target"))
    return materialize(near.select("target", "rank", "donor", (share / total).alias("weight")), "inverse")


STENCIL = f"n AS (SELECT target, y::BIGINT*50+x AS donor, {ARC.format(a='t', b='g')} AS km FROM t JOIN grid g ON abs(t.lat-g.lat) < 0.02 AND abs(t.lon-g.lon) < 0.03), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(km,9), donor) AS rank FROM n), st AS (SELECT target, donor, rank, km, 1/(km+0.1)/sum(1/(km+0.1)) OVER (PARTITION BY target) AS weight FROM r WHERE rank <= 4), g AS (SELECT y::BIGINT*50+x AS donor, lat, lon, height, land, size FROM grid), j AS (SELECT st.*, height, land, size FROM st JOIN g USING (donor))"


@query("weights_apply", f"WITH {B.GRID}, {TARGETS}, {STENCIL} SELECT target, round(least(greatest(sum(weight*height),min(height)),max(height)),6)+0.0 AS height FROM j GROUP BY 1")
def weights_apply(spark, d):
    """A varying field by inverse-distance weights, within its donors' range."""
    return rounded(regrid.apply_weights(inverse_distance(spark, d), B.grid(spark, d).select((F.col("y").cast("long") * 50 + F.col("x")).alias("donor"), "height"), "height"))


def cells(spark, d):
    return B.grid(spark, d).select((F.col("y").cast("long") * 50 + F.col("x")).alias("donor"), "lat", "lon", "height", "land")


@query("same_surface_remap", f"WITH {B.GRID}, {TARGETS}, {STENCIL}, m AS (SELECT target, least(greatest(sum(weight*height) FILTER (land = (target % 3 <> 0))/sum(weight) FILTER (land = (target % 3 <> 0)), min(height) FILTER (land = (target % 3 <> 0))), max(height) FILTER (land = (target % 3 <> 0))) AS v FROM j GROUP BY 1), far AS (SELECT target, arg_min(height, (round(km,9), donor)) AS v, min(km) AS km FROM (SELECT m.target, donor, height, {ARC.format(a='t', b='g')} AS km FROM m JOIN t USING (target) JOIN g ON g.land = (m.target % 3 <> 0) WHERE m.v IS NULL) GROUP BY 1) SELECT m.target, round(coalesce(m.v, far.v),6)+0.0 AS height, CASE WHEN m.v IS NOT NULL THEN 'weights' ELSE 'nearest' END AS how, round(far.km,6)+0.0 AS km FROM m LEFT JOIN far ON far.target = m.target")
def same_surface_remap(spark, d):
    """Every target's height from cells of its own surface: by weights, or from the nearest such cell of all."""
    own = targets(spark, d).withColumn("own", F.col("target") % 3 != 0)
    long = surface.remap_long(inverse_distance(spark, d), cells(spark, d), own, [surface.Field("height", F.col("land"), F.col("own"), F.lit(True))])
    return rounded(long.select("target", F.col("value").alias("height"), "how", "km"))


@query("sst_target", f"WITH {B.GRID}, {TARGETS}, {STENCIL}, m AS (SELECT target, sum(weight*height) FILTER (NOT land)/sum(weight) FILTER (NOT land) AS water, sum(weight*height) AS every FROM j GROUP BY 1), far AS (SELECT target, min(km) AS km FROM (SELECT m.target, {ARC.format(a='t', b='g')} AS km FROM m JOIN t USING (target) JOIN g ON NOT g.land WHERE water IS NULL) GROUP BY 1) SELECT m.target, round(coalesce(water, every),6)+0.0 AS sst, water IS NULL AS unsupported, round(far.km,6)+0.0 AS candidate_km FROM m LEFT JOIN far ON far.target = m.target")
def sst_target(spark, d):
    """Same-surface value on water, the all-surface value where the stencil has none, which it was, and how far the nearest water is there."""
    src, at = cells(spark, d).withColumn("any", F.col("height")), targets(spark, d)
    fields = [surface.Field("height", F.col("land"), F.lit(False), F.lit(False)), surface.Field("any", F.lit(True), F.lit(True), F.lit(False))]
    both = materialize(surface.remap(inverse_distance(spark, d), src, at, fields)[0], "sst")
    lost = at.join(both.where("height is null").select("target"), "target", "left_semi")
    near = spatial.k_nearest(lost, src.where("not land").select("donor", "lat", "lon"), 1).select("target", F.col("km").alias("candidate_km"))
    out = both.join(near, "target", "left")
    return rounded(out.select("target", F.coalesce("height", "any").alias("sst"), F.col("height").isNull().alias("unsupported"), "candidate_km"))


def _fields(method: str) -> str:
    depths = ", ".join(str(b - a) for a, b in zip(P.SOIL_BOUNDS, P.SOIL_BOUNDS[1:]))
    return f"""{B.GRID}, {TARGETS}, layers AS (SELECT unnest(range(8))::INT AS k, unnest([{depths}]::DOUBLE[]) AS thick), h AS (SELECT k::INT AS class, 0.02+0.001*k AS dry, 0.06+0.002*k AS wilting, 0.2+0.008*k AS capacity, 0.35+0.006*k AS most FROM range(1, 20) r(k)),
d AS (SELECT y::BIGINT*50+x AS donor, lat, lon, land, height, size, size % 10 + 1 AS code, CASE WHEN size % 4 = 0 THEN size*2.0 ELSE 0.0 END::DOUBLE AS swe FROM grid),
w AS (SELECT d.*, k, (17.3+size*5.1)*(1-0.0517*k)*thick/(1000.0*thick) AS vwc FROM d, layers),
f AS (SELECT donor, 't'||k AS field, CASE WHEN land THEN 281+size*0.05-0.3*k END::DOUBLE AS v, land AS s FROM d, layers UNION ALL SELECT donor, 'w'||k, CASE WHEN code BETWEEN 3 AND 8 {'OR TRUE' if method == 'absolute' else ''} THEN {GIVEN[method]} END, land AND code BETWEEN 3 AND 8 FROM w
 UNION ALL SELECT donor, 'topo', height, TRUE FROM d UNION ALL SELECT donor, 'skin', CASE WHEN size <> 13 THEN 280+size*0.1 END, land FROM d UNION ALL SELECT donor, 'swe', swe, land FROM d UNION ALL SELECT donor, 'snow_depth', CASE WHEN swe > 0 THEN swe/(100+size*5.0) ELSE 0 END, land FROM d),
a AS (SELECT target, lat, lon, target % 3 <> 0 AS land, target % 3 <> 0 AND target % 11 <> 0 AS active, (target % 19 + 1)::INT AS class, 900.0 + (target % 50)*20 AS topo FROM t),
o AS (SELECT target, field, CASE WHEN field LIKE 'w%' THEN active WHEN field = 'topo' THEN TRUE ELSE land END AS own, CASE WHEN field LIKE 'w%' THEN active WHEN field IN ('topo', 'skin') THEN TRUE ELSE land END AS required FROM a, (SELECT DISTINCT field FROM f)),
n AS (SELECT target, d.donor, {ARC.format(a='t', b='d')} AS km FROM t JOIN d ON abs(t.lat-d.lat) < 0.02 AND abs(t.lon-d.lon) < 0.03), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(km,9), donor) AS rank FROM n),
st AS (SELECT target, donor, rank, km, 1/(km+0.1)/sum(1/(km+0.1)) OVER (PARTITION BY target) AS weight FROM r WHERE rank <= 4),
j AS (SELECT o.target, o.field, own, required, rank, km, weight, v, s = own AND v IS NOT NULL AS ok FROM o JOIN st USING (target) JOIN f ON f.donor = st.donor AND f.field = o.field),
g AS (SELECT target, field, any_value(own) AS own, any_value(required) AS required, sum(weight*v) FILTER (ok)/sum(weight) FILTER (ok) AS mean, arg_min(v, rank) FILTER (field = 'skin' AND v IS NOT NULL) AS any_v, arg_min(km, rank) FILTER (field = 'skin' AND v IS NOT NULL) AS any_km FROM j GROUP BY 1, 2),
lost AS (SELECT target, field, own FROM g WHERE mean IS NULL AND any_v IS NULL AND required),
far AS (SELECT target, field, arg_min(v, (round(km,9), donor)) AS v, min(km) AS km FROM (SELECT lost.target, lost.field, f.donor, f.v, {ARC.format(a='t', b='d')} AS km FROM lost JOIN t USING (target) JOIN f ON f.field = lost.field AND f.s = lost.own AND f.v IS NOT NULL JOIN d ON d.donor = f.donor) GROUP BY 1, 2),
came AS (SELECT g.target, g.field, required, coalesce(mean, any_v, far.v) AS v, CASE WHEN mean IS NOT NULL THEN 'weights' WHEN any_v IS NOT NULL THEN 'across' WHEN far.v IS NOT NULL THEN 'nearest' ELSE 'none' END AS how, CASE WHEN mean IS NULL THEN coalesce(any_km, far.km) END AS km FROM g LEFT JOIN far ON far.target = g.target AND far.field = g.field),
wide AS (SELECT target, {', '.join(f"max(v) FILTER (field = '{x}') AS {'source_topo' if x == 'topo' else x}" for x in [*[f't{k}' for k in range(8)], *[f'w{k}' for k in range(8)], 'topo', 'skin', 'swe', 'snow_depth'])} FROM came GROUP BY 1),
m AS (SELECT a.*, h.*, wide.* EXCLUDE (target), CASE WHEN a.land THEN -0.007*(topo-source_topo) ELSE 0 END AS lifted FROM a JOIN wide USING (target) LEFT JOIN h USING (class)),
m2 AS (SELECT * EXCLUDE (skin), skin+lifted AS skin, land AND coalesce(swe, 0) > 1e-9 AS has_snow FROM m),
sj AS (SELECT target, weight, 255+size*0.3 AS v, d.swe > 1e-9 AS ok FROM m2 JOIN st USING (target) JOIN d USING (donor) WHERE has_snow), sn AS (SELECT target, sum(weight*v) FILTER (ok)/sum(weight) FILTER (ok) AS snow_t FROM sj GROUP BY 1)"""


#: Overlaps of source and target layers by hand: (layer, metres) for each of the four target layers.
OVERLAPS = (((0, 0.01), (1, 0.02), (2, 0.06), (3, 0.01)), ((3, 0.17), (4, 0.03)), ((4, 0.4),), ((4, 0.11), (5, 0.69)))
#: Between which depths the middles of the target layers lie (0.05, 0.2, 0.5, 1.1 m), and how far.
BETWEEN = ((2, 0.03 / 0.04), (4, 0.02 / 0.36), (4, 0.32 / 0.36), (5, 0.56 / 1.08))
MIDDLES = (0.05, 0.2, 0.5, 1.1)
TRANSFER = ["CASE WHEN active THEN (" + "+".join(f"w{k}*{s}" for k, s in parts) + f")/{sum(s for _, s in parts)!r} END" for parts in OVERLAPS]
SHARE = lambda x: f"((729*{x}+27*{x}*{x}*{x})/(729+243*{x}*{x}))"
SOIL_T = [f"CASE WHEN land THEN t{k}+(t{k + 1}-t{k})*{part!r}+lifted*{SHARE(x)} ELSE skin END" for (k, part), x in zip(BETWEEN, MIDDLES)]


def _water(method: str) -> list[str]:
    return [f"CASE WHEN active THEN least(greatest({TAKEN[method].format(i=f'({i})')},dry),most) ELSE 0.0 END" for i in TRANSFER]


def _columns(parts: dict[str, str]) -> str:
    return ", ".join(f"round({x},6)+0.0 AS {n}" for n, x in parts.items())


_STATE = {"skin": "skin", **{f"soil_t{k}": x for k, x in enumerate(SOIL_T)}, **{f"vwc{k}": x for k, x in enumerate(_water("index"))}, **{f"transfer{k}": x for k, x in enumerate(TRANSFER)}, "swe": "CASE WHEN land THEN swe ELSE 0 END::DOUBLE", "snow_depth": "CASE WHEN land THEN snow_depth ELSE 0 END::DOUBLE", "snow_density": "CASE WHEN has_snow THEN swe/snow_depth ELSE 0 END::DOUBLE", "snow_temperature": "CASE WHEN has_snow THEN least(greatest(snow_t, least(greatest(skin-10,180.0),least(skin,273.15))),least(skin,273.15)) ELSE least(skin,273.15) END"}


def state(spark, d, method):
    return surface.surface_state(inverse_distance(spark, d), donors(spark, d), own(spark, d), hydraulics(spark), method)


@query("surface_state", f"WITH {_fields('index')} SELECT target, {_columns(_STATE)} FROM m2 LEFT JOIN sn USING (target)")
def surface_state(spark, d):
    """Soil and skin temperatures at the target's height, soil water by a moisture index and snow, from donors on the target's own surface."""
    return rounded(state(spark, d, "index")[0].select("target", *_STATE))


@query("surface_water", f"WITH {_fields('saturation')}, q AS (SELECT target, {_columns({f'saturation{k}': x for k, x in enumerate(_water('saturation'))})} FROM m2) SELECT * FROM q")
def surface_water(spark, d):
    """Soil water by the share of the pores."""
    return rounded(state(spark, d, "saturation")[0].select("target", *[F.col(f"vwc{k}").alias(f"saturation{k}") for k in range(4)]))


@query("surface_water_absolute", f"WITH {_fields('absolute')}, q AS (SELECT target, {_columns({f'absolute{k}': x for k, x in enumerate(_water('absolute'))})}, count(*) FILTER (active AND {TRANSFER[0]} < dry) OVER () AS dry_clips, count(*) FILTER (active AND {TRANSFER[0]} > most) OVER () AS full_clips FROM m2) SELECT * FROM q")
def surface_water_absolute(spark, d):
    """Soil water as it is, and how many targets' first layers were bounded by their class."""
    s = materialize(state(spark, d, "absolute")[0], "state")
    clips = s.agg(F.count_if("dry_clip0").alias("dry_clips"), F.count_if("full_clip0").alias("full_clips"))  # one row
    return rounded(s.select("target", *[F.col(f"vwc{k}").alias(f"absolute{k}") for k in range(4)]).crossJoin(F.broadcast(clips)))


@query("surface_fallbacks", f"WITH {_fields('index')} SELECT field, how, count(*) AS targets, count(*) FILTER (required) AS required, round(max(km),6)+0.0 AS max_km, round(quantile_cont(km,0.99),6)+0.0 AS p99_km FROM came GROUP BY 1, 2")
def surface_fallbacks(spark, d):
    """How the values of every field came about, and how far the donors that stood in were."""
    used = state(spark, d, "index")[1]
    return rounded(used.where("field <> 'snow_t'"))
