"""The contract of forcing records: 25 records over the grid, most of them sound but for what is planted in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from skillgrid.operators import contracts
from skillgrid.plans import bindings as B
from skillgrid.plans.registry import query
from skillgrid.session import shuffled

#: What is planted in the fields of which record, at cells and levels chosen for each: (record, condition, expression), as SQL that both engines read to make the tables. The rules are written twice.
PLANTED = {
    "P": [(1, "k = 2 AND x = 7", "90.0"), (2, "k = 1 AND y = 3", "NULL")],
    "T": [(3, "k = 0 AND x < 2", "360.0"), (4, "y = 5 AND x = 5", "'nan'::DOUBLE")],
    "QV": [(5, "k = 3 AND x = 1", "0.2"), (6, "k = 3 AND x = 1", "-0.001"), (23, "k = 2 AND y = 4", "NULL")],
    "U": [(7, "x = 9", "250.0")],
    "W": [(8, "k = 1 AND x = 9", "-120.0"), (9, "k = 1 AND x = 4", "NULL")],
    "HHL": [(10, "k = 2 AND x = 3", "HHL0-500"), (11, "x = 3", "HHL0+0.25"), (24, "k = 3 AND x = 6", "NULL")],
    "HFL": [(12, "k = 3 AND y = 2", "HFL0-900")],
    "SST": [(13, "NOT land AND x < 9", "400.0"), (14, "x = 2 AND y = 2", "NULL"), (15, "land", "999.0")],
    "mask": [(16, "size = 20", "1"), (17, "size = 3", "2"), (18, "size = 2", "0")],
    "distance": [(19, "size = 2", "NULL"), (20, "size = 30", "1.5"), (18, "size = 2", "NULL")],
    "lat": [(21, "x = 8", "lat0+1e-9")],
    "lon": [(22, "y = 1", "lon0-1e-9")],
}
SOUND = {"P": "100000.0-9000*k-height", "T": "290.0-6*k", "QV": "0.01/(k+1)", "U": "size*1.0", "V": "5.0-size*0.5", "W": "size*0.1-k", "HHL": "HHL0", "HFL": "HFL0"}
SOUND_CELL = {"SST": "275.0+size*0.2", "mask": "CASE WHEN NOT land AND size < 4 THEN 1 ELSE 0 END", "distance": "CASE WHEN NOT land AND size < 4 THEN size*0.5 END", "lat": "lat0", "lon": "lon0"}


def _case(name: str, sound: str) -> str:
    whens = " ".join(f"WHEN record = {r} AND {c} THEN {x}" for r, c, x in PLANTED.get(name, []))
    return f"CASE {whens} ELSE {sound} END" if whens else sound


#: Attributes of a sound record, and what single records have instead (None: not there). ``{t}``: its own time.
ATTRIBUTES = {"product_type": "target_forcing_record", "water_representation": "dry-air mixing ratio", "static_sha256": "abc", "sha256": "f{r}", "w_vertical_coordinate": "static_HFL", "w_wind_basis": "grid_relative", "sst_source_sha256": "s1", "sst_native_source_sha256": "n1", "sst_target_product_sha256": "s1", "sst_source_variable": "SKT", "sst_valid_time": "{t}", "sst_policy_version": "2", "sst_remap_policy": "same_surface", "sst_compact_count": "3", "sst_candidate_maximum_km": "1.5", "geometry_serialization": "static_with_top_cover"}
OTHER = {(0, "product_type"): "other", (1, "water_representation"): None, (2, "static_sha256"): "abd", (3, "w_vertical_coordinate"): "model", (4, "w_wind_basis"): None, (5, "sst_source_sha256"): "", (6, "sst_native_source_sha256"): None, (7, "sst_target_product_sha256"): "s2", (8, "sst_source_variable"): "T_S", (9, "sst_valid_time"): "2020-01-01 00:00:00", (10, "sst_policy_version"): "1", (11, "sst_remap_policy"): "nearest", (12, "sst_compact_count"): "-1", (13, "sst_compact_count"): "many", (14, "sst_candidate_maximum_km"): "-2", (15, "sst_candidate_maximum_km"): "1.25", (23, "geometry_serialization"): "none"}
#: Counts that records state instead of the true ones, as what is added to them.
COUNTS = {16: ("sst_water_cell_count", 1), 17: ("sst_unsupported_count", -100000), 18: ("sst_compact_count", 100000)}
AXES = {"W": "time,z,y,x", "SST": "time,y,x", "SST_mask": "y,x", "SST_distance": "y,x", **{n: "time,z,y,x" for n in ("P", "T", "QV", "U", "V")}, "HHL": "z,y,x", "HFL": "z,y,x", "lat": "y,x", "lon": "y,x"}
OTHER_AXES = {(19, "W"): "time,y,x", (20, "SST"): "y,x", (21, "SST_mask"): None, (22, "SST_distance"): None, (23, "SST_mask"): "x,y", (24, "QV"): None}
BOUNDARY = {0: ("f0", "abc", 0), 1: ("f9", "abc", 0), 2: ("f2", "xyz", 0), 3: ("f3", "abc", 1)}


def _values(rows: list[tuple]) -> str:
    q = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x + "'"
    return ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows)


TIME = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * record"
_TEXTS = [(r, k, OTHER.get((r, k), v), v == "{t}" and (r, k) not in OTHER) for r in range(25) for k, v in ATTRIBUTES.items()]
_TEXTS = [(r, k, v.replace("{r}", str(r)), int(own)) for r, k, v, own in _TEXTS if v is not None]
_VARS = [(r, n, OTHER_AXES.get((r, n), a), "C" if (r, n) == (20, "SST") else " Kelvin" if n == "SST" else "1") for r in range(25) for n, a in AXES.items() if OTHER_AXES.get((r, n), a) is not None]
TABLES = f"""{B.GRID}, records AS (SELECT n_nationkey::INT AS record FROM nation), base AS (SELECT record, y, x, land, size, height, lat AS lat0, lon AS lon0 FROM grid, records),
geo AS (SELECT y, x, k, height+500.0*k AS HHL0, height+500.0*k+250 AS HFL0 FROM grid, (SELECT unnest(range(4))::INT AS k)),
vals AS (SELECT record, y, x, k, {', '.join(f'({_case(n, s)})::DOUBLE AS {n}' for n, s in SOUND.items())} FROM base JOIN geo USING (y, x)),
cells AS (SELECT record, y, x, {', '.join(f'({_case(n, s)})::DOUBLE AS {n}' for n, s in SOUND_CELL.items())} FROM base),
counted AS (SELECT (SELECT count(*) FROM grid WHERE NOT land) AS water, (SELECT count(*) FROM grid WHERE NOT land AND size < 4) AS masked),
texts(record, key, value, own) AS (VALUES {_values(_TEXTS)}), added(record, key, n) AS (VALUES {_values([(r, k, n) for r, (k, n) in COUNTS.items()])}),
attrs AS (SELECT record, key, CASE WHEN own = 1 THEN strftime({TIME}, '%Y-%m-%d %H:%M:%S') ELSE value END AS value FROM texts WHERE NOT (record = 18 AND key = 'sst_compact_count')
 UNION ALL SELECT record, 'sst_water_cell_count', (water + CASE WHEN record = 16 THEN 1 ELSE 0 END)::VARCHAR FROM records, counted UNION ALL SELECT record, 'sst_unsupported_count', (masked + CASE WHEN record = 17 THEN -100000 ELSE 0 END)::VARCHAR FROM records, counted UNION ALL SELECT 18, 'sst_compact_count', '100003'),
vars(record, var, axes, units) AS (VALUES {_values(_VARS)}), times AS (SELECT record, {TIME} AS t FROM records UNION ALL SELECT 5, TIMESTAMP '2024-06-01'), expected AS (SELECT record, CASE WHEN record = 6 THEN TIMESTAMP '2024-03-03' ELSE {TIME} END AS t FROM records),
bounds(record, initial_, static_, late) AS (VALUES {_values([(r, *v) for r, v in BOUNDARY.items()])})"""
_A = lambda key: f"max(value) FILTER (key = '{key}')"
#: The rules by hand, over facts of each record: counts of rows that fail, or 1 where a record's own statement does.
_VALUE_FAILS = {
    "pressure_finite": "P IS NULL OR isnan(P)", "temperature_finite": "T IS NULL OR isnan(T)", "vapour_finite": "QV IS NULL OR isnan(QV)", "wind_finite": "coalesce(U+V+W, 'nan'::DOUBLE) = 'nan'::DOUBLE", "heights_finite": "coalesce(HHL+HFL, 'nan'::DOUBLE) = 'nan'::DOUBLE",
    "pressure_range": "P < 100 OR P > 120000", "temperature_range": "T < 150 OR (T > 350)", "vapour_range": "QV < 0 OR QV > 0.1", "wind_speed": "U*U+V*V > 40000", "vertical_wind": "W > 100 OR W < -100",
    "interfaces_ascend": "HHL <= hb", "levels_ascend": "HFL <= fb", "geometry_there": "HHL0 IS NULL", "geometry_equal": "HHL <> HHL0 OR HFL <> HFL0",
}
_CELL_FAILS = {
    "surface_finite": "SST IS NULL", "landmask_there": "land IS NULL", "sst_range": "NOT land AND (SST < 180 OR SST > 350)", "mask_binary": "mask IS NULL OR (mask <> 0 AND mask <> 1)", "mask_on_water": "land AND mask <> 0",
    "distance_on_mask": "mask = 1 AND (distance IS NULL OR distance < 0)", "distance_off_mask": "mask <> 1 AND distance IS NOT NULL", "latitudes_equal": "c.lat <> g.lat", "longitudes_equal": "c.lon <> g.lon",
}
_RECORD_FAILS = {
    "product_type": "product_type IS DISTINCT FROM 'target_forcing_record'", "water_representation": "water_representation IS DISTINCT FROM 'dry-air mixing ratio'", "static_identity": "static_sha256 IS DISTINCT FROM 'abc'",
    "required_variables": "n_required < 11", "one_time": "n_times <> 1", "expected_time": "first_time <> expected_time", "w_axes": "w_axes IS DISTINCT FROM 'time,z,y,x'", "w_coordinate": "w_vertical_coordinate IS DISTINCT FROM 'static_HFL'", "w_basis": "w_wind_basis IS DISTINCT FROM 'grid_relative'",
    "sst_axes": "sst_axes IS DISTINCT FROM 'time,y,x'", "sst_units": "sst_units NOT IN (' Kelvin')", "has_water": "water = 0", "sst_source": "coalesce(sst_source_sha256, '') = ''", "sst_native_source": "coalesce(sst_native_source_sha256, '') = ''", "sst_identity": "sst_source_sha256 IS DISTINCT FROM sst_target_product_sha256",
    "sst_variable": "sst_source_variable IS DISTINCT FROM 'SKT'", "sst_time": "sst_valid_time IS DISTINCT FROM strftime(first_time, '%Y-%m-%d %H:%M:%S')", "sst_policy": "sst_policy_version IS DISTINCT FROM '2'", "sst_remap": "sst_remap_policy IS DISTINCT FROM 'same_surface'",
    "water_count": "wc IS DISTINCT FROM water", "compact_count": "cc IS NULL OR cc < 0 OR cc > wc", "unsupported_count": "uc < 0 OR uc > wc", "exception_counts": "cc IS NULL OR cc + uc > wc", "candidate_maximum": "cm < 0",
    "mask_there": "mask_axes IS NULL", "distance_there": "distance_axes IS NULL", "support_axes": "mask_axes IS DISTINCT FROM 'y,x' OR distance_axes IS DISTINCT FROM 'y,x'", "mask_count": "uc IS DISTINCT FROM n_mask", "distance_maximum": "abs(cm - coalesce(most, 0)) > 1e-9",
    "serialization": "geometry_serialization IS DISTINCT FROM 'static_with_top_cover'", "boundary_identity": "initial_ <> 'f' || record", "boundary_static": "static_ <> 'abc'", "boundary_time": "late = 1",
}
_PIVOT = ", ".join(f"{_A(k)} AS {k}" for k in ATTRIBUTES)
FOUND = f"""WITH {TABLES}, below AS (SELECT v.*, HHL0, HFL0, lag(HHL) OVER w AS hb, lag(HFL) OVER w AS fb FROM vals v LEFT JOIN geo USING (y, x, k) WINDOW w AS (PARTITION BY record, y, x ORDER BY k)),
fv AS (SELECT record, {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in _VALUE_FAILS.items())} FROM below GROUP BY 1), fc AS (SELECT record, {', '.join(f'count(*) FILTER ({c}) AS {n}' for n, c in _CELL_FAILS.items())}, count(*) FILTER (NOT land) AS water, count(*) FILTER (mask = 1) AS n_mask, max(distance) FILTER (mask = 1) AS most FROM cells c JOIN grid g USING (y, x) GROUP BY 1),
pa AS (SELECT record, {_PIVOT}, try_cast({_A('sst_water_cell_count')} AS BIGINT) AS wc, try_cast({_A('sst_compact_count')} AS BIGINT) AS cc, try_cast({_A('sst_unsupported_count')} AS BIGINT) AS uc, try_cast({_A('sst_candidate_maximum_km')} AS DOUBLE) AS cm FROM attrs GROUP BY 1),
pv AS (SELECT record, count(*) FILTER (var NOT LIKE 'SST\\_%' ESCAPE '\\') AS n_required, max(axes) FILTER (var = 'W') AS w_axes, max(axes) FILTER (var = 'SST') AS sst_axes, max(units) FILTER (var = 'SST') AS sst_units, max(axes) FILTER (var = 'SST_mask') AS mask_axes, max(axes) FILTER (var = 'SST_distance') AS distance_axes FROM vars GROUP BY 1),
pt AS (SELECT record, count(*) AS n_times, min(t) AS first_time FROM times GROUP BY 1), pe AS (SELECT record, t AS expected_time FROM expected),
fr AS (SELECT record, {', '.join(f'coalesce({c}, FALSE)::INT::BIGINT AS {n}' for n, c in _RECORD_FAILS.items())} FROM pa JOIN pv USING (record) JOIN pt USING (record) JOIN pe USING (record) JOIN fc USING (record) LEFT JOIN bounds USING (record)),
found AS (SELECT record, rule, 'value' AS scope, violations FROM (UNPIVOT (SELECT record, {', '.join(_VALUE_FAILS)} FROM fv) ON COLUMNS(* EXCLUDE (record)) INTO NAME rule VALUE violations)
 UNION ALL SELECT record, rule, 'cell', violations FROM (UNPIVOT (SELECT record, {', '.join(_CELL_FAILS)} FROM fc) ON COLUMNS(* EXCLUDE (record)) INTO NAME rule VALUE violations)
 UNION ALL SELECT record, rule, 'record', violations FROM (UNPIVOT fr ON COLUMNS(* EXCLUDE (record)) INTO NAME rule VALUE violations))"""


def found(spark, d):
    sql = lambda x: x.replace("'nan'::DOUBLE", "double('nan')").replace("NULL", "cast(NULL as double)")
    g = B.grid(spark, d).repartition("y", "x")  # its records and levels are made where the cells are
    geo = g.select("y", "x", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"), "height").select("y", "x", "k", (F.col("height") + 500.0 * F.col("k")).alias("HHL"), (F.col("height") + 500.0 * F.col("k") + 250).alias("HFL"))
    records = B.table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("record"))
    base = g.select("y", "x", "land", "size", "height", F.col("lat").alias("lat0"), F.col("lon").alias("lon0")).crossJoin(F.broadcast(records))  # 25 records
    both = g.join(shuffled(geo.select("y", "x", "k", F.col("HHL").alias("HHL0"), F.col("HFL").alias("HFL0"))), ["y", "x"]).crossJoin(F.broadcast(records))
    values = both.select("record", "y", "x", "k", *[F.expr(sql(_case(n, s))).cast("double").alias(n) for n, s in SOUND.items()])
    cells = base.select("record", "y", "x", *[F.expr(sql(_case(n, s)) if n != "mask" else _case(n, s)).cast("double").alias(n) for n, s in SOUND_CELL.items()])
    hour = lambda c: F.timestamp_seconds(F.lit(1704067200) + 3600 * F.col(c))
    texts = spark.createDataFrame(_TEXTS, "record int, key string, value string, own int").where("not (record = 18 and key = 'sst_compact_count')").select("record", "key", F.when(F.col("own") == 1, F.date_format(hour("record"), "yyyy-MM-dd HH:mm:ss")).otherwise(F.col("value")).alias("value"))
    n = g.agg(F.count_if(~F.col("land")).alias("water"), F.count_if(~F.col("land") & (F.col("size") < 4)).alias("masked"))
    stated = records.crossJoin(F.broadcast(n))
    counts = stated.select("record", F.lit("sst_water_cell_count").alias("key"), (F.col("water") + F.when(F.col("record") == 16, 1).otherwise(0)).cast("string").alias("value")).unionAll(stated.select("record", F.lit("sst_unsupported_count"), (F.col("masked") + F.when(F.col("record") == 17, -100000).otherwise(0)).cast("string"))).unionAll(spark.createDataFrame([(18, "sst_compact_count", "100003")], "record int, key string, value string"))
    variables = spark.createDataFrame(_VARS, "record int, var string, axes string, units string").withColumn("axes", F.split("axes", ","))
    times = records.select("record", hour("record").alias("time"), F.when(F.col("record") == 6, F.lit("2024-03-03").cast("timestamp")).otherwise(hour("record")).alias("expected"))
    times = times.unionAll(times.where("record = 5").select("record", F.lit("2024-06-01").cast("timestamp"), "expected"))
    bounds = spark.createDataFrame([(r, k, v) for r, (i, s, late) in BOUNDARY.items() for k, v in (("initial_sha256", i), ("static_sha256", s), ("first_valid_time", f"2024-01-01 {r + late:02d}:00:00"))], "record int, key string, value string")
    static = spark.createDataFrame([("sha256", "abc")], "key string, value string")
    scopes = contracts.forcing_scopes(values, cells, geo, g.select("y", "x", "land", "lat", "lon"), variables, texts.unionAll(counts), times, static, bounds)
    return contracts.failures(contracts.FORCING, scopes, records)


@query("forcing_contract", f"{FOUND} SELECT record, rule, scope, 'error' AS severity, violations, violations = 0 AS ok FROM found")
def forcing_contract(spark, d):
    """Violations of every rule by every record."""
    return found(spark, d)


@query("forcing_verdict", f"{FOUND} SELECT record, count(*) FILTER (violations > 0) = 0 AS passed, count(*) FILTER (violations > 0) AS errors, 0::BIGINT AS warnings, coalesce(string_agg(rule, ',' ORDER BY rule) FILTER (violations > 0), '') AS failed FROM found GROUP BY 1")
def forcing_verdict(spark, d):
    """Which records pass, and what the others fail."""
    return contracts.verdict(found(spark, d)).withColumn("failed", F.array_join("failed", ","))
