"""Queries of the column functions: each evaluates one function over a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.functions import physics as P
from skillgrid.functions import text as X
from skillgrid.plans import bindings as B
from skillgrid.plans.registry import ORACLES, QUERIES, r6

#: Inputs made from parts: temperature, pressure, humidity, heights, winds, soil shares; in both languages.
INPUTS = {
    "t": ("p_retailprice/10.0 + 170.0", None),
    "p": ("100000.0 - p_size*500.0", None),
    "q": ("0.001 + p_size*0.0002", None),
    "dz": ("p_size*20.0 - 500.0", None),
    "u": ("p_size*0.5 - 12.0", None),
    "v": ("(p_partkey % 31)*0.7 - 10.0", None),
    "lat": ("46.0 + (p_partkey % 97)*0.01", None),
    "lon": ("(p_partkey % 720)*1.0 - 90.3", None),
    "sand": ("(p_partkey % 21)*5.0", None),
    "clay": ("least(100.0 - (p_partkey % 21)*5.0, p_size*1.7)", None),
    "dist": ("(p_partkey % 61)*100.0", None),
}
INPUT_SQL = "i AS (SELECT p_partkey AS id, p_brand AS brand, p_size AS size, " + ", ".join(f"({e})::DOUBLE AS {k}" for k, (e, _) in INPUTS.items()) + " FROM part)"


def inputs(spark, d):
    p = B.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), *[F.expr(f"cast({e} as double)").alias(k) for k, (e, _) in INPUTS.items()])


def register(name: str, columns: Callable[[DataFrame], dict], sql: dict, where: str = "true") -> None:
    """A query with ``id`` and columns of the inputs; doubles are rounded here and in the SQL."""

    def run(spark, d):
        rows = inputs(spark, d).where(where)
        out = rows.select("id", *[c.alias(k) for k, c in columns(rows).items()])
        return out.select("id", *[r6(k).alias(k) if f.dataType.typeName() == "double" else F.col(k) for k, f in zip(out.columns[1:], out.schema.fields[1:])])

    run.__name__ = name
    run.__doc__ = f"``{name}`` of every row."
    QUERIES[name] = run
    ORACLES[name] = f"WITH {INPUT_SQL} SELECT id, {', '.join(f'{e} AS {k}' for k, e in sql.items())} FROM i WHERE {where}"


def d6(e: str) -> str:
    return f"round({e}, 6) + 0.0"


ES = "611.2*exp(17.67*(t-273.15)/((t-273.15)+243.5))"
MOD = lambda a, n: f"(({a}) - floor(({a})/{n})*{n})"

register("wind_uv", lambda i: dict(zip(("east", "north"), P.wind_uv(F.abs(i.u), i.lon))), {"east": d6("-abs(u)*sin(radians(lon))"), "north": d6("-abs(u)*cos(radians(lon))")})
register("wind_dir", lambda i: {"direction": P.wind_direction(i.u, i.v)}, {"direction": d6(MOD("270.0-degrees(atan2(v,u))", "360.0"))}, "u != 0 or v != 0")
S, C = "sin(radians(dist/100))", "(cos(radians(dist/100))*1.01)"
register("rotate_wind", lambda i: {**dict(zip(("gu", "gv"), P.earth_to_grid(i.u, i.v, F.sin(F.radians(i.dist / 100)), F.cos(F.radians(i.dist / 100)) * 1.01))), **dict(zip(("eu", "ev"), P.grid_to_earth(i.u, i.v, F.sin(F.radians(i.dist / 100)), F.cos(F.radians(i.dist / 100)) * 1.01)))}, {"gu": d6(f"u*{C}+v*{S}"), "gv": d6(f"v*{C}-u*{S}"), "eu": d6(f"(u*{C}-v*{S})/({S}*{S}+{C}*{C})"), "ev": d6(f"(u*{S}+v*{C})/({S}*{S}+{C}*{C})")})
register("obs_units", lambda i: {"kelvin": P.from_observed(i.t, "celsius"), "pascal": P.from_observed(i.p, "hectopascal"), "metres": P.from_observed(i.dz, "centimetre")}, {"kelvin": d6("t+273.15"), "pascal": d6("p*100"), "metres": d6("dz/100")})
register("rel_humidity", lambda i: {"rh": P.relative_humidity(i.t, i.q, i.p)}, {"rh": d6(f"100.0*(q*p/(0.622+(1-0.622)*q))/({ES})")})
register("q_from_dewpoint", lambda i: {"value": P.q_from_dewpoint(i.t, i.p)}, {"value": d6(f"0.622*({ES})/(p-(1-0.622)*({ES}))")})
EW = "least(610.94*exp(17.625*(t+60-273.15)/((t+60-273.15)+243.04)),0.99*p)"
register("q_sat", lambda i: {"value": P.q_saturation(i.t + 60, i.p)}, {"value": d6(f"0.622*{EW}/greatest(p-(1-0.622)*{EW},1.0)")})
register("height_adjust", lambda i: {"temperature": P.height_adjust_temperature(i.t, i.dz), "pressure": P.height_adjust_pressure(i.p, i.dz, i.t)}, {"temperature": d6("t-0.0065*dz"), "pressure": d6("p*exp(-9.80665*dz/(287.05*t))")})
register("unit_sphere", lambda i: dict(zip("xyz", P.unit_sphere(i.lat, i.lon))), {"x": d6("cos(radians(lat))*cos(radians(lon))"), "y": d6("cos(radians(lat))*sin(radians(lon))"), "z": d6("sin(radians(lat))")})
CH = "sqrt((cos(radians(lat))*cos(radians(lon))-cos(radians(46.5))*cos(radians(8.0)))*(cos(radians(lat))*cos(radians(lon))-cos(radians(46.5))*cos(radians(8.0)))+(cos(radians(lat))*sin(radians(lon))-cos(radians(46.5))*sin(radians(8.0)))*(cos(radians(lat))*sin(radians(lon))-cos(radians(46.5))*sin(radians(8.0)))+(sin(radians(lat))-sin(radians(46.5)))*(sin(radians(lat))-sin(radians(46.5))))"
register("arc", lambda i: {"km": P.arc_km(i.lat, i.lon, F.lit(46.5), F.lit(8.0))}, {"km": d6(f"2*6371.0*asin(least({CH}/2,1.0))")})
register("angle_units", lambda i: {"degrees": P.to_degrees(i.lon, F.when(i.size % 2 == 0, "radians").otherwise("degrees_east"))}, {"degrees": d6("CASE WHEN size % 2 = 0 THEN degrees(lon) ELSE lon END")})
R = "least(greatest(dist/4000.0,0.0),1.0)"
X4 = "least(greatest(dist,0.0),4000.0)"
register("blend", lambda i: {"weight": P.blend(i.dist, 4000.0)}, {"weight": d6(f"1-(1296000000.0*{X4}+27*{X4}*{X4}*{X4})/(1728000000000.0+324000*{X4}*{X4})")})
register("edge_taper", lambda i: {k: P.edge_taper(i.dist, 4000.0, k) for k in ("linear", "cosine", "smoother")}, {"linear": d6(R), "cosine": d6(f"0.5-0.5*cos(pi()*{R})"), "smoother": d6(f"{R}*{R}*{R}*({R}*({R}*6-15)+10)")})
SILT = "(100.0-sand-clay)"
TEXTURE = [
    f"sand>=85 AND {SILT}+1.5*clay<15",
    f"sand>=70 AND sand<90 AND {SILT}+1.5*clay>=15 AND {SILT}+2*clay<30",
    f"{SILT}+2*clay>=30 AND ((clay>=7 AND clay<20 AND sand>52) OR (clay<7 AND {SILT}<50))",
    f"{SILT}>=50 AND ((clay>=12 AND clay<27) OR (clay<12 AND {SILT}<80))",
    f"{SILT}>=80 AND clay<12",
    f"clay>=7 AND clay<27 AND {SILT}>=28 AND {SILT}<50 AND sand<=52",
    f"clay>=20 AND clay<35 AND {SILT}<28 AND sand>45",
    "clay>=27 AND clay<40 AND sand<=20",
    "clay>=27 AND clay<40 AND sand>20 AND sand<=45",
    "clay>=35 AND sand>45",
    f"clay>=40 AND {SILT}>=40",
    f"clay>=40 AND sand<=45 AND {SILT}<40",
]
register("soil_texture", lambda i: {"class": P.soil_texture(i.sand, 100.0 - i.sand - i.clay, i.clay)}, {"class": "CASE " + " ".join(f"WHEN {c} THEN {k}" for k, c in reversed(list(enumerate(TEXTURE, 1)))) + " ELSE 6 END"})
register("dry_mixing_ratio", lambda i: dict(zip(("vapour", "cloud", "rain"), P.dry_mixing_ratio([i.q, i.q / 2, i.q / 5]))), {"vapour": d6("q/(1-(q+q/2+q/5))"), "cloud": d6("(q/2)/(1-(q+q/2+q/5))"), "rain": d6("(q/5)/(1-(q+q/2+q/5))")})
register("snow_state", lambda i: {"density": F.try_divide(i.size * 5.0, i.dist / 1000), "temperature": P.snow_temperature(i.t)}, {"density": d6("CASE WHEN dist<>0 THEN size*5.0/(dist/1000) END"), "temperature": d6("least(greatest(t,greatest(t-10,180.0)),least(t,273.15))")})
register("relax_weight", lambda i: {"weight": P.relaxation_weight(i.dist, 3000.0)}, {"weight": d6("CASE WHEN dist>=3000 THEN 0.0 ELSE cos(0.5*pi()*dist/3000.0)*cos(0.5*pi()*dist/3000.0) END")})
register("wind10_weight", lambda i: {"weight": P.wind10_weight(i.size / 5.0, i.size / 5.0 + 8.0)}, {"weight": d6("least(greatest((10-size/5.0)/((size/5.0+8.0)-size/5.0),0.0),1.0)")})
register("shapiro_response", lambda i: {"response": P.shapiro_response(4, 0.9, i.size + 2.0)}, {"response": d6("1-0.9*pow(sin(pi()/(size+2.0)),4.0)")})
register("sleve_basis", lambda i: {"decay": P.sleve_basis(i.dist, 6000.0, 5000.0, 1.35)}, {"decay": d6("((exp(pow(6000.0/5000.0,1.35)-pow(dist/5000.0,1.35))-exp(-(pow(6000.0/5000.0,1.35)-pow(dist/5000.0,1.35))))/2)/((exp(pow(6000.0/5000.0,1.35))-exp(-pow(6000.0/5000.0,1.35)))/2)")})
register("land_temp_correction", lambda i: {"corrected": P.land_temperature(i.t, i.dz, i.dist / 1000)}, {"corrected": d6("t-0.007*dz*(729*least(dist/1000,3.0)+27*least(dist/1000,3.0)*least(dist/1000,3.0)*least(dist/1000,3.0))/(729+243*least(dist/1000,3.0)*least(dist/1000,3.0))")})
register("wrap_lon", lambda i: {"wrapped": P.wrap_lon(i.lon)}, {"wrapped": d6(MOD("lon+180.0", "360.0") + " - 180.0")})
CODE = "(size % 10 + 1)"
_CASE = lambda values: f"(CASE {CODE} " + " ".join(f"WHEN {k} THEN {v!r}" for k, v in enumerate(values, 1)) + " END)::DOUBLE"
VWC = "(size*0.08/(1000.0*(0.09-0.03)))"
register("soil_smi", lambda i: {"smi": P.soil_moisture_index(i.size * 0.08, 2, i.size % 10 + 1)}, {"smi": d6(f"CASE WHEN {CODE} BETWEEN 3 AND 8 THEN greatest(({VWC}-{_CASE(P.WILTING_POINT)})/({_CASE(P.FIELD_CAPACITY)}-{_CASE(P.WILTING_POINT)}),0.0) END::DOUBLE")})
register("soil_relsat", lambda i: {"saturation": P.relative_saturation(i.size * 0.5, 2, i.size % 10 + 1)}, {"saturation": d6(f"CASE WHEN {CODE} BETWEEN 3 AND 8 THEN least(greatest((size*0.5/(1000.0*(0.09-0.03)))/{_CASE(P.POROSITY)},0.0),1.0) END::DOUBLE")})
register("soil_vwc", lambda i: {"from_index": P.index_to_water(i.q * 100 - 0.2, F.lit(0.05), F.lit(0.08), F.lit(0.3), F.lit(0.42)), "from_saturation": P.saturation_to_water(i.q * 150, F.lit(0.05), F.lit(0.42)), "absolute": P.clip(i.q * 60, 0.05, 0.42)}, {"from_index": d6("least(greatest(0.08+(q*100-0.2)*(0.3-0.08),0.05),0.42)"), "from_saturation": d6("least(greatest(least(greatest(q*150,0.0),1.0)*0.42,0.05),0.42)"), "absolute": d6("least(greatest(q*60,0.05),0.42)")})
register("norm_units", lambda i: {"units": X.normalized_units(F.concat(F.lit("W m**-2 / K^"), i.brand))}, {"units": "regexp_replace(lower('W m**-2 / K^'||brand), '[\\^\\s*/]', '', 'g')"})
register("station_key", lambda i: {"key": X.station_key(i.brand, i.id.cast("string"))}, {"key": "brand||':'||id"})
register("step_hours", lambda i: {"hours": X.step_hours(F.concat((i.size * 30).cast("string"), F.when(i.size % 4 == 0, "m").when(i.size % 4 == 1, "h").when(i.size % 4 == 2, "d").otherwise("s")))}, {"hours": "CASE size%4 WHEN 0 THEN CASE WHEN size*30*60 % 3600=0 THEN size*30*60//3600 END WHEN 1 THEN size*30 WHEN 2 THEN size*30*24 ELSE CASE WHEN size*30 % 3600=0 THEN size*30//3600 END END::BIGINT"})
register("tile_ids", lambda i: {"one": X.tile_tag(i.lat, i.lon, 1), "three": X.tile_tag(i.lat, i.lon, 3)}, {k: f"(CASE WHEN floor(lat/{n})*{n}>=0 THEN 'N' ELSE 'S' END)||lpad(abs(floor(lat/{n})*{n})::INT::VARCHAR,2,'0')||(CASE WHEN floor(lon/{n})*{n}>=0 THEN 'E' ELSE 'W' END)||lpad(abs(floor(lon/{n})*{n})::INT::VARCHAR,3,'0')" for k, n in (("one", 1), ("three", 3))})
register("canonical_hash", lambda i: {"digest": X.canonical_digest("size", "brand")}, {"digest": """sha256('{"brand":"'||brand||'","size":'||size||'}')"""})
register("coalesce_alias", lambda i: {"value": X.first_given(F.when(i.size % 3 == 0, i.brand), F.when(i.size % 3 == 1, F.lit(" ")), i.id.cast("string"))}, {"value": "CASE WHEN size%3=0 THEN brand ELSE id::VARCHAR END"})
register("slope_aspect", lambda i: {**dict(zip(("slope", "aspect"), P.slope_of(i.u, i.v, F.lit(1.0)))), "horizon": P.horizon_zenith(i.u / 40)}, {"slope": d6("acos(least(greatest(1/sqrt(u*u+v*v+1),-1.0),1.0))"), "aspect": d6(MOD("pi()/2-atan2(v,u)", "(2*pi())")), "horizon": d6("90.0-greatest(degrees(u/40),0.0)")}, "u != 0 or v != 0")
register("class_code", lambda i: {"valid": X.class_code(i.size / 2.0, 20)}, {"valid": "(size/2.0 = floor(size/2.0)) AND size/2.0 BETWEEN 1 AND 20"})
register("season_label", lambda i: {"label": X.season_code(F.element_at(F.array(*map(F.lit, ("winter", " Spring", "SUMMER", "autumn", "harvest"))), i.size % 5 + 1))}, {"label": "CASE size%5 WHEN 0 THEN 'DJF' WHEN 1 THEN 'MAM' WHEN 2 THEN 'JJA' WHEN 3 THEN 'SON' END"})


def _parse_time(spark, d):
    o = B.table(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    s = F.when(k == 0, F.date_format("o_orderdate", "yyyyMMddHHmmss")).when(k == 1, F.date_format("o_orderdate", "yyyyMMddHHmm")).when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("never")
    return o.select(F.col("o_orderkey").alias("record"), X.parse_time(s).cast("timestamp_ntz").alias("valid"), X.iso_utc(F.when(k == 2, s)).alias("iso"))


QUERIES["parse_time_multi"] = _parse_time
ORACLES["parse_time_multi"] = "SELECT o_orderkey AS record, CASE WHEN o_orderkey%4=3 THEN NULL ELSE o_orderdate END AS valid, CASE WHEN o_orderkey%4=2 THEN strftime(o_orderdate,'%Y-%m-%dT%H:%M:%SZ') END AS iso FROM orders"
QUERIES["iso_utc"] = lambda spark, d: B.table(spark, d, "orders").select(F.col("o_orderkey").alias("record"), X.iso_utc(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T02:00:00+02:00"))).alias("iso"))
ORACLES["iso_utc"] = "SELECT o_orderkey AS record, strftime(o_orderdate,'%Y-%m-%dT00:00:00Z') AS iso FROM orders"


def _norm_external(spark, d):
    """A cover given as a fraction, the same in percent, and an albedo in percent: each column's largest value says which it is."""
    i = inputs(spark, d).select("id", (F.col("dist") / 6000).alias("share"), (F.col("dist") / 60).alias("cover"), (F.col("dist") / 70).alias("albedo"))
    out = P.as_fraction(P.as_percent(P.as_percent(i, "share", "share_percent"), "cover", "cover_percent"), "albedo", "albedo_share")
    return out.select("id", *[r6(c).alias(c) for c in ("share_percent", "cover_percent", "albedo_share")], "share_percent_ok", "cover_percent_ok", "albedo_share_ok")


QUERIES["norm_external"] = _norm_external
ORACLES["norm_external"] = f"WITH {INPUT_SQL}, m AS (SELECT max(dist/6000) AS a, max(dist/60) AS b, max(dist/70) AS c FROM i), n AS (SELECT id, dist/6000*(CASE WHEN a<=1 THEN 100 ELSE 1 END) AS share_percent, dist/60*(CASE WHEN b<=1 THEN 100 ELSE 1 END) AS cover_percent, dist/70/(CASE WHEN c>1 THEN 100 ELSE 1 END) AS albedo_share FROM i, m) SELECT id, {', '.join(d6(c) + ' AS ' + c for c in ('share_percent', 'cover_percent', 'albedo_share'))}, share_percent BETWEEN 0 AND 100 AS share_percent_ok, cover_percent BETWEEN 0 AND 100 AS cover_percent_ok, albedo_share BETWEEN 0 AND 1 AS albedo_share_ok FROM n"


def _grid_fingerprint(spark, d):
    """A digest of each raster row's coordinates, and one of the rows' digests in order."""
    g = B.grid(spark, d).select("y", "x", F.concat_ws(",", *[F.round(F.col(c) * 1e7).cast("long").cast("string") for c in ("lat", "lon")]).alias("c"))
    rows = g.groupBy("y").agg(F.sha2(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("x", "c"))), lambda p: p["c"])), 256).alias("digest"))
    whole = rows.agg(F.sha2(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("y", "digest"))), lambda p: p["digest"])), 256).alias("digest"))
    return rows.unionByName(whole.select(F.lit(-1).alias("y"), "digest"))


QUERIES["grid_fingerprint"] = _grid_fingerprint
ORACLES["grid_fingerprint"] = f"WITH {B.GRID}, r AS (SELECT y, sha256(string_agg(round(lat*1e7)::BIGINT||','||round(lon*1e7)::BIGINT, ';' ORDER BY x)) AS digest FROM grid GROUP BY y) SELECT y, digest FROM r UNION ALL SELECT -1, sha256(string_agg(digest, ';' ORDER BY y)) FROM r"
