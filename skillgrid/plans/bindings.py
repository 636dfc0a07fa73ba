"""Views of the driver's tables in the shapes that the operators take, in Spark and as SQL prelude."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillgrid.operators.strata import season


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, valid, season, lead, metric, obs, candidate, baseline) with holes in the observations and the candidate."""
    li = table(spark, sf_dir, "lineitem")
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    hole = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)
    one = lambda name, x, scale: F.struct(F.lit(name).alias("metric"), F.when(F.col("l_linenumber") != 7, x).alias("obs"), F.when(~hole, x * (1 + scale * d)).alias("candidate"), (x * (1 + t)).alias("baseline"))
    rows = li.select(F.col("l_suppkey").alias("station"), F.col("l_shipdate").alias("valid"), season(F.col("l_shipdate")).alias("season"), F.col("l_linenumber").alias("lead"), F.explode(F.array(one("vector", q, F.lit(1.0)), one("speed", F.col("l_extendedprice") / 1000.0, F.lit(0.7)))).alias("m"))
    return rows.select("station", "valid", "season", "lead", "m.*")


SEASON_SQL = "CASE WHEN month({0}) IN (12,1,2) THEN 'DJF' WHEN month({0}) IN (3,4,5) THEN 'MAM' WHEN month({0}) IN (6,7,8) THEN 'JJA' ELSE 'SON' END"
_T = "SELECT l_suppkey AS station, l_shipdate AS valid, " + SEASON_SQL.format("l_shipdate") + " AS season, l_linenumber AS lead, '{m}' AS metric, CASE WHEN l_linenumber <> 7 THEN {x} END AS obs, CASE WHEN NOT (l_returnflag='R' AND l_linenumber=1) THEN {x}*(1+{s}*l_discount) END AS candidate, {x}*(1+l_tax) AS baseline FROM lineitem"
TRIPLETS = "triplets AS (" + _T.format(m="vector", x="l_quantity", s="1.0") + " UNION ALL " + _T.format(m="speed", x="(l_extendedprice/1000.0)", s="0.7") + "), accepted AS (SELECT * FROM triplets WHERE obs IS NOT NULL AND candidate IS NOT NULL AND baseline IS NOT NULL)"


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplets(spark, sf_dir).where("obs is not null and candidate is not null and baseline is not null")


def wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, ts, kind, speed, direction)."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 25).alias("station"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), F.col("value").alias("speed"), ((F.col("event_id") * 37) % 360).cast("double").alias("direction"), "event_id")


WIND = "wind AS (SELECT user_id % 25 AS station, ts, event_type AS kind, value AS speed, ((event_id*37) % 360)::DOUBLE AS direction, event_id FROM events)"


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, hour, value): hourly means."""
    return wind(spark, sf_dir).groupBy("station", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("speed").alias("value"))


ENDPOINTS = "endpoints AS (SELECT user_id % 25 AS station, date_trunc('hour', ts) AS hour, avg(value) AS value FROM events GROUP BY 1, 2)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, height, land, class, lat, lon): a cell table with 50 columns."""
    p = table(spark, sf_dir, "part")
    y, x = F.floor(F.col("p_partkey") / 50), F.col("p_partkey") % 50
    return p.select(y.cast("int").alias("y"), x.cast("int").alias("x"), F.col("p_retailprice").alias("height"), (F.col("p_size") > 10).alias("land"), F.col("p_brand").alias("class"), (46 + 0.002 * y).alias("lat"), (7 + 0.003 * x).alias("lon"), F.col("p_size").alias("size"))


GRID = "grid AS (SELECT (p_partkey // 50)::INT AS y, (p_partkey % 50)::INT AS x, p_retailprice AS height, p_size > 10 AS land, p_brand AS class, 46 + 0.002*(p_partkey // 50) AS lat, 7 + 0.003*(p_partkey % 50) AS lon, p_size AS size FROM part)"


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, lat, lon, elevation): stations spread over the whole grid, between its cells."""
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    s = table(spark, sf_dir, "supplier").crossJoin(F.broadcast(n))
    k = (F.col("s_suppkey") * 7919) % F.col("n")
    return s.select(F.col("s_suppkey").alias("site"), (46.0007 + 0.002 * F.floor(k / 50)).alias("lat"), (7.0004 + 0.003 * (k % 50)).alias("lon"), F.abs(F.col("s_acctbal") / 3).alias("elevation"))


_K = "((s_suppkey*7919) % (SELECT count(*) FROM part))"
SITES = f"sites AS (SELECT s_suppkey AS site, 46.0007 + 0.002*({_K}//50) AS lat, 7.0004 + 0.003*({_K} % 50) AS lon, abs(s_acctbal/3) AS elevation FROM supplier)"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment, record, valid, complete, bytes)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("segment"), F.col("o_orderkey").alias("record"), F.col("o_orderdate").alias("valid"), (F.col("o_orderstatus") == "F").alias("complete"), F.col("o_totalprice").alias("bytes"), F.col("o_orderpriority").alias("priority"))


CATALOG = "catalog AS (SELECT o_custkey AS segment, o_orderkey AS record, o_orderdate AS valid, o_orderstatus='F' AS complete, o_totalprice AS bytes, o_orderpriority AS priority FROM orders)"


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(column_id, level, z, value): a profile for each order, levels upwards."""
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
    rows = li.select(F.col("l_orderkey").alias("column_id"), F.row_number().over(w).alias("level"), F.col("l_quantity").alias("value"))
    return rows.withColumn("z", F.col("level") * 100.0 + F.col("column_id") % 7)


PROFILE = "profile AS (SELECT *, level*100.0 + column_id % 7 AS z FROM (SELECT l_orderkey AS column_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate) AS level, l_quantity AS value FROM lineitem))"

#: The whole registry that the survey counts (69 fields): field, lifetime, support, other names, units.
_REGISTRY = """
x invariant coordinate - -
y invariant coordinate - -
lat invariant mass latitude degrees_north
lon invariant mass longitude degrees_east
azimuthal_equidistant invariant coordinate crs -
topo invariant mass terrain,orog m
topo_highres invariant mass - m
topo_driving invariant mass - m
topo_blend_weight invariant mass - -
terrain_large_scale invariant mass h1 m
terrain_small_scale invariant mass h2 m
HHL invariant interface - m
HFL invariant mass - m
SLEVE_JACOBIAN invariant mass - -
LAYER_THICKNESS invariant layer - m
landmask invariant cell FR_LAND -
soil_type invariant land - -
soil_type_layer invariant land - -
soil_layer invariant coordinate - -
soil_layer_bounds_cm invariant coordinate - -
soil_layer_bounds_m invariant coordinate - m
landuse_category invariant coordinate - -
soil_sand_percent invariant land - -
soil_silt_percent invariant land - -
soil_clay_percent invariant land - -
root_depth epoch vegetation ROOTDP m
vegetation_fraction_max epoch land PLCOV_MX -
vegetation_fraction_min epoch land PLCOV_MN -
leaf_area_index_max epoch vegetation LAI_MX -
leaf_area_index_min epoch vegetation LAI_MN -
ndvi_max epoch vegetation NDVI_MAX -
emissivity_max epoch cell EMISS_MAX -
soil_albedo_dry invariant land ALB_DRY -
soil_albedo_saturated invariant land ALB_SAT -
radiative_emissivity invariant cell EMISS_RAD -
epoch_time epoch coordinate - -
month climatology coordinate - -
time time_series coordinate - -
landuse epoch cell - -
landuse_fraction epoch cell - -
glacier_fraction epoch cell - -
urban_fraction epoch cell - -
LAI climatology vegetation leaf_area_index -
VEGFRA climatology land vegetation_fraction,PLCOV -
NDVI climatology vegetation - -
NDVI_MRAT climatology vegetation - -
ALBEDO climatology cell albedo,ALB_DIF12 -
EMISSIVITY climatology cell emissivity,EMISS -
EMISS_MRAT climatology cell - -
roughness_length epoch cell Z0 -
SST_CLIM climatology water T_SEA K
snow_water_equivalent_climatology climatology cell W_SNOW -
two_metre_temperature_climatology climatology cell T_2M_CLIM K
cloud_droplet_number_climatology climatology cell cdnc,CDNC -
SST time_series water sea_surface_temperature K
lake_temperature time_series lake - K
sea_ice_fraction time_series water - -
soil_temperature initial_only land TSLB K
soil_vwc initial_only land SMOIS m3 m-3
soil_water_transfer_index initial_only land - -
snow_water_equivalent initial_only cell SNOW -
snow_density initial_only cell - kg m-3
snow_depth initial_only cell SNOWH -
snow_temperature_initial initial_only snow T_SNOW K
skin_temperature initial_only cell TSK,surface_temperature K
source_topography_on_target initial_only cell - m
terrain_height_difference initial_only cell - m
soil_deep_temperature initial_only land - K
reference_layer_thickness invariant coordinate - m
"""
FIELDS = [(f, life, support, [] if names == "-" else names.split(","), None if units == "-" else units) for f, life, support, names, units in (row.split(" ", 4) for row in _REGISTRY.strip().splitlines())]


def field_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIELDS, "field string, lifetime string, support string, aliases array<string>, units string")
