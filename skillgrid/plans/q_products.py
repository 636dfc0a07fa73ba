"""Product contracts over the given tables, with planted defects. What the tables hold is SQL that both engines read; the rules are written twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from skillgrid.operators import contracts, product_rules, raster
from skillgrid.plans import bindings as B
from skillgrid.plans.registry import query

NO = "cast(NULL as double)"


def _planted(sound: dict[str, str], planted: dict[str, list]) -> dict[str, str]:
    """SQL of every field: its sound value, but for (record, condition, other value)."""
    return {n: "CASE " + "".join(f"WHEN record = {r} AND {c} THEN {x} " for r, c, x in planted[n]) + f"ELSE {s} END" if n in planted else s for n, s in sound.items()}


def _fields(of: dict[str, str]) -> str:
    return ", ".join(f"cast({x} AS DOUBLE) AS {n}" for n, x in of.items())


def _fails(source: str, tests: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT record, '{n}' AS rule, count(*) AS violations FROM {source} WHERE {t} GROUP BY 1" for n, t in tests.items())


def _found(rules, scopes, records):
    return contracts.failures(rules, scopes, records).where("not ok").select("record", "rule", "violations")


def _records(spark, d):
    return B.table(spark, d, "nation").where("n_nationkey < 9").select(F.col("n_nationkey").cast("int").alias("record"))


NATIVE = _planted(
    {"P": "100000.0 - 9000*k - height", "QV": "0.01/(k+1)", "QC": "0.001*size", "HHL": "height + 500.0*k", "W": "size*0.1 - k"},
    {"P": [(1, "k = 2 AND x = 7", "200000.0"), (2, "k = 1 AND y = 3", NO)], "QV": [(3, "k = 0 AND x < 2", "1.5")], "QC": [(4, "k = 1 AND x = 5", "-0.5")], "HHL": [(5, "k = 1 AND y = 1", "-9999.0"), (6, "k = 0 AND x = 9", "height - 3.0")], "W": [(7, "k = 0 AND y < 2", "150.0")]},
)
_NATIVE = f"""WITH {B.GRID}, {B.SITES}, base AS (SELECT n_nationkey::INT AS record, y, x, k, height, size FROM grid, nation, (SELECT unnest(range(4))::INT AS k) WHERE n_nationkey < 9 AND NOT (n_nationkey = 8 AND k = 3 AND y = 0 AND x = 1)),
v AS (SELECT record, y, x, k, height, {_fields(NATIVE)} FROM base), used AS (SELECT DISTINCT floor((s.lat-46)/0.002)::INT AS y, floor((s.lon-7)/0.003)::INT AS x FROM sites s),
l AS (SELECT v.*, lag(P) OVER w AS pb, lag(HHL) OVER w AS hb, (y, x) IN (SELECT (y, x) FROM used) AS used FROM v WINDOW w AS (PARTITION BY record, y, x ORDER BY k)),
c AS (SELECT record, y, x, count(*) AS n, max(HHL) FILTER (k = 0) AS bottom, any_value(height) AS height FROM v GROUP BY 1, 2, 3)"""


@query("native_state_contract", _NATIVE + " " + _fails("l", {"finite": "P IS NULL", "pressure_decreases": "P >= pb", "heights_increase": "HHL <= hb", "moist_below_one": "QV + QC >= 1", "water_not_negative": "QC < 0 OR QV < 0", "w_range": "used AND W > 100", "w_range_unused": "NOT used AND W > 100"}) + " UNION ALL " + _fails("c", {"bottom_near_surface": "bottom < height - 1 OR bottom > height + 1", "levels": "n < 4"}))
def native_state_contract(spark, d):
    """States on their own levels; ranges are errors at the cells of sites and warnings elsewhere."""
    g = B.grid(spark, d)
    base = g.select("y", "x", "height", "size").crossJoin(F.broadcast(_records(spark, d))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).where("not (record = 8 and k = 3 and y = 0 and x = 1)")
    values = base.select("record", "y", "x", "k", *[F.expr(x).cast("double").alias(n) for n, x in NATIVE.items()])
    at = B.sites(spark, d).select(F.floor((F.col("lat") - 46) / 0.002).cast("int").alias("y"), F.floor((F.col("lon") - 7) / 0.003).cast("int").alias("x")).join(g.select("y", "x"), ["y", "x"], "left_semi")
    return _found(product_rules.NATIVE, product_rules.native_scopes(values, g.select("y", "x", F.col("height").alias("surface")), at), _records(spark, d))


#: A frame three cells wide with two levels.
FRAME = _planted({"T": "280.0 - k", "P": "90000.0 - 100*k", "QV": "0.01", "QC": "0", "QI": "0", "HFL": "height + 50.0*k", "HHL": "height + 100.0*k"}, {"T": [(1, "k = 0 AND x = 3", NO)], "HFL": [(2, "y = 0 AND x = 3 AND k = 1", "height")]})
WEIGHT = _planted({"weight": "1.0 - edge/3.0"}, {"weight": [(3, "edge = 1", "1.5"), (4, "edge = 0", "0.5")]})
_SAID = {"product_type": "lateral_boundary_state", "w_policy": "static_HFL", "water_conversion": "applied", "grid_fingerprint": "g", "static_sha256": "s", "relaxation_profile": "cos", "relaxation_update": "u", "relaxation_seconds": "600"}
SAID = [(r, k, "other" if (r, k) == (6, "static_sha256") else v) for r in range(9) for k, v in _SAID.items() if (r, k) != (0, "w_policy")]
AXES = [(r, n, "point" if (r, n) == (7, "QC") else a) for r in range(9) for n, a in product_rules.BOUNDARY_FIELDS.items() if (r, n) != (8, "QI")]
_rows = lambda rows: ", ".join(f"({r}, '{k}', '{v}')" for r, k, v in rows)
_BOUNDARY = f"""WITH {B.GRID}, e AS (SELECT *, least(x, (SELECT max(x) FROM grid)-x, y, (SELECT max(y) FROM grid)-y) AS edge FROM grid), f AS (SELECT n_nationkey::INT AS record, y, x, height, edge FROM e, nation WHERE edge < 3 AND n_nationkey < 9),
p AS (SELECT record, y, x, {_fields(WEIGHT)} FROM f), v AS (SELECT record, y, x, k, {_fields(FRAME)} FROM f, (SELECT unnest(range(2))::INT AS k)), said(record, key, value) AS (VALUES {_rows(SAID)}), axes(record, var, a) AS (VALUES {_rows(AXES)}), r AS (SELECT unnest(range(9))::INT AS record),
one AS (SELECT v.record, 'geometry_same' AS rule FROM v JOIN v AS z USING (y, x, k) WHERE z.record = 0 AND (v.HFL <> z.HFL OR v.HHL <> z.HHL) UNION SELECT record, 'edge_bound' FROM p GROUP BY 1 HAVING max(weight) FILTER (weight = 1) IS NULL
 UNION SELECT record, 'attributes_same' FROM r WHERE (SELECT string_agg(key||value, ',' ORDER BY key) FROM said s WHERE s.record = r.record) <> (SELECT string_agg(key||value, ',' ORDER BY key) FROM said s WHERE s.record = 0)
 UNION SELECT record, 'schema_same' FROM r WHERE (SELECT string_agg(var||a, ';' ORDER BY var) FROM axes s WHERE s.record = r.record) <> (SELECT string_agg(var||a, ';' ORDER BY var) FROM axes s WHERE s.record = 0)
 UNION SELECT record, 'fields' FROM axes GROUP BY 1 HAVING count(*) < 10 UNION SELECT record, 'axes' FROM axes WHERE var = 'QC' AND a <> 'level,point' UNION SELECT record, 'w_policy' FROM r WHERE record NOT IN (SELECT record FROM said WHERE key = 'w_policy') UNION SELECT 5, 'times_increase')"""


@query("boundary_contract", _BOUNDARY + " SELECT record, rule, 1::BIGINT AS violations FROM one UNION ALL " + _fails("v", {"finite": "T IS NULL"}) + " UNION ALL " + _fails("p", {"weights": "weight > 1"}))
def boundary_contract(spark, d):
    """A sequence of boundary states: the points, geometry, fields and attributes of the first hold for all."""
    frame = raster.edge_distance(B.grid(spark, d)).where("cells < 3").withColumnRenamed("cells", "edge").crossJoin(F.broadcast(_records(spark, d)))
    place = [F.col("record"), F.col("y").alias("row"), F.col("x").alias("column")]
    points = frame.select(*place, F.expr(WEIGHT["weight"]).cast("double").alias("weight"))
    values = frame.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(*place, "k", *[F.expr(x).cast("double").alias(n) for n, x in FRAME.items()])
    size = B.grid(spark, d).agg((F.max("x") + 1).alias("nx"), (F.max("y") + 1).alias("ny")).crossJoin(_records(spark, d))
    said = spark.createDataFrame(SAID, "record int, key string, value string").unionAll(size.select("record", F.explode(F.create_map(F.lit("nx"), F.col("nx").cast("string"), F.lit("ny"), F.col("ny").cast("string")))))
    axes = spark.createDataFrame(AXES, "record int, var string, axes string").select("record", "var", F.split("axes", ",").alias("axes"), F.lit("double").alias("type"))
    times = _records(spark, d).select("record", F.col("record").alias("place"), F.timestamp_seconds(3600 * (F.col("record") - F.when(F.col("record") == 5, 1).otherwise(0))).alias("time"))
    return _found(product_rules.BOUNDARY, product_rules.boundary_scopes(values, points, axes, said, times), _records(spark, d))


#: Three methods over the grid: the second has too much water, and a skin far above its soil; the third clips, reaches far and has snow of another depth.
METHODS = ("a", "b", "c")
LAYER = {"vwc": "CASE WHEN NOT land OR size = 50 THEN 0.0 WHEN record = 'b' AND x = 3 AND layer = 1 THEN 0.6 ELSE 0.2 + size*0.005 END", "temperature": "280.0 + layer"}
CELL = {"skin": "CASE WHEN record = 'b' AND x < 2 THEN 300.0 ELSE 281.0 + size % 10 END", "swe": "CASE WHEN land THEN size ELSE 0 END", "depth": "CASE WHEN record = 'c' AND x = 6 THEN 1 ELSE 0 END + CASE WHEN land THEN cast(size AS DOUBLE)/300 ELSE 0 END", "density": "300", "snow_temperature": "273.15"}
_SURFACE = f"""WITH {B.GRID}, m AS (SELECT unnest(['a', 'b', 'c']) AS record), l AS (SELECT record, y, x, layer, land, size, {_fields(LAYER)} FROM grid, m, (SELECT unnest([1, 2]) AS layer)), c AS (SELECT record, y, x, land, {_fields(CELL)} FROM grid, m)"""


@query("surface_plausibility", _SURFACE + " " + _fails("l", {"below_saturation": "land AND size <> 50 AND vwc > 0.5"}) + " UNION ALL " + _fails("c", {"snow_depth": "swe > 0 AND abs(depth - swe/density) > 0.5"}) + " UNION ALL SELECT record, 'jump_p99', 1 FROM c WHERE land GROUP BY 1 HAVING quantile_cont(abs(281.0 - skin), 0.99) > 15 UNION ALL SELECT record, 'state_shared', 1 FROM (SELECT DISTINCT c.record FROM c JOIN c AS z USING (y, x) WHERE z.record = 'a' AND (c.skin <> z.skin OR c.depth <> z.depth)) UNION ALL SELECT 'c', unnest(['clip_rate', 'fallback_near']), 1")
def surface_plausibility(spark, d):
    """Surface states of three methods: failures, warnings, and what must not depend on the method."""
    g = B.grid(spark, d)
    methods = spark.createDataFrame([(m,) for m in METHODS], "record string")
    both = g.crossJoin(F.broadcast(methods))
    layers = both.withColumn("layer", F.explode(F.array(F.lit(1), F.lit(2)))).select("record", "y", "x", "layer", *[F.expr(x).cast("double").alias(n) for n, x in LAYER.items()])
    cells = both.select("record", "y", "x", *[F.expr(x).cast("double").alias(n) for n, x in CELL.items()])
    static = g.select("y", "x", "land", (F.col("size") == 50).alias("glacier"), F.lit(0.05).alias("dry"), F.lit(0.5).alias("maximum"))
    said = spark.createDataFrame([(m, k, v) for m in METHODS for k, v in dict(method=m, static_sha256="s", source_sha256="q", valid_time="t", fallback_km="7" if m == "c" else "1", water_snow="zero").items()], "record string, key string, value string")
    clips = methods.crossJoin(F.broadcast(g.agg(F.count_if(F.col("land") & (F.col("size") != 50)).alias("n")))).select("record", F.lit("clips"), F.when(F.col("record") == "c", F.col("n")).otherwise(0).cast("string"))
    same = spark.createDataFrame([("static_sha256", "s"), ("source_sha256", "q")], "key string, value string")
    return _found(product_rules.SURFACE, product_rules.surface_scopes(layers, cells, static, said.unionAll(clips), same), methods)


#: A chain for each customer, a segment for each of its years; urgent and high orders are attempts, complete if they are done, and write at their date and a month later.
_CHAIN = """WITH o AS (SELECT *, (o_custkey*10 + year(o_orderdate) - 1992)::BIGINT AS record, year(o_orderdate) AS yr FROM orders), done AS (SELECT record, count(*) AS n, min(o_orderkey) AS a FROM o WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F' GROUP BY 1),
s AS (SELECT record, o_custkey AS chain, yr, n, a, CASE WHEN a % 5 > 0 THEN 'r' || record END AS restart FROM (SELECT DISTINCT record, o_custkey, yr FROM o) LEFT JOIN done USING (record)),
q AS (SELECT *, lag(yr) OVER w AS before, lag(restart) OVER w AS held FROM s WINDOW w AS (PARTITION BY chain ORDER BY yr)), k AS (SELECT record, 'r' || (record - 1) AS target FROM o WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'),
j AS (SELECT q.record, any_value(n) AS n, any_value(a) AS a, any_value(before) AS before, any_value(yr) AS yr, any_value(restart) AS restart, count(target) AS links FROM q LEFT JOIN k ON k.record = q.record AND k.target = q.held GROUP BY 1),
w AS (SELECT record, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [o_orderdate, o_orderdate, o_orderdate + INTERVAL 30 DAY] ELSE [o_orderdate, o_orderdate + INTERVAL 30 DAY] END) AS valid FROM o JOIN s USING (record) WHERE o_orderkey = a),
t AS (SELECT record, valid, count(*) AS c FROM w GROUP BY 1, 2), u AS (SELECT q.record, t.valid, c, yr, before FROM t JOIN q USING (record)), z AS (SELECT o.record, o_orderdate AS valid FROM o WHERE o_orderpriority = '1-URGENT' AND (o.record, o_orderdate) NOT IN (SELECT (record, valid) FROM t)) """


@query("chain_contract", _CHAIN + _fails("j", {"one_completed": "n IS NULL OR n <> 1", "interval": "a IS NULL OR a % 7 = 0", "ends_at_checkpoint": "a IS NULL OR a % 7 = 0", "static_identity": "a IS NULL OR a % 11 = 0", "has_outputs": "a IS NULL", "follows": "before <> yr - 1", "linked_once": "before IS NOT NULL AND links <> 1", "checkpoint_there": "yr % 2 = 0 AND restart IS NULL"}) + " UNION ALL " + _fails("u", {"times_once": "c > 1", "times_within": "valid > make_timestamp(yr + 1, 1, 1, 0, 0, 0) OR (valid = make_timestamp(yr, 1, 1, 0, 0, 0) AND before IS NOT NULL)"}) + " UNION ALL " + _fails("z", {"evaluated": "TRUE"}))
def chain_contract(spark, d):
    """Chains of segments: one completed attempt each with its interval, outputs of their own within it, a link to the segment before, and the times that are judged among the outputs."""
    day, year = F.col("o_orderdate").cast("timestamp"), F.year("o_orderdate")
    o = B.table(spark, d, "orders").select((F.col("o_custkey") * 10 + year - 1992).cast("long").alias("record"), F.col("o_custkey").alias("chain"), year.alias("place"), day.alias("valid"), F.col("o_orderkey").alias("attempt"), (F.col("o_orderstatus") == "F").alias("complete"), F.col("o_orderpriority").alias("priority"))
    begin = lambda y: F.make_timestamp(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    config = o.select("record", "chain", "place").distinct().withColumns({"start": begin(F.col("place")), "end": begin(F.col("place") + 1), "expected_static": F.lit("s"), "needs_restart": F.col("place") % 2 == 0})
    key = F.col("attempt")
    attempts = o.where("priority in ('1-URGENT', '2-HIGH')").select(
        "record", "attempt", "complete", begin(F.col("place")).alias("start_"), begin(F.when(key % 7 == 0, F.col("place")).otherwise(F.col("place") + 1)).alias("end_"), F.lit(None).cast("timestamp").alias("model_end"),
        F.when(key % 11 == 0, "t").otherwise("s").alias("static"), F.when(key % 5 > 0, F.concat(F.lit("r"), F.col("record").cast("string"))).alias("restart"),
    )
    later = F.col("valid") + F.expr("INTERVAL 30 DAY")
    outputs = o.select("record", "attempt", F.explode(F.when(key % 3 == 0, F.array("valid", "valid", later)).otherwise(F.array(F.col("valid"), later))).alias("valid"))
    urgent = o.where("priority = '1-URGENT'")
    links = urgent.where("complete").select("record", F.concat(F.lit("r"), (F.col("record") - 1).cast("string")).alias("restart"))
    scopes = product_rules.chain_scopes(config, attempts, outputs, links, urgent.select("record", "valid"))
    return _found(product_rules.CHAIN, scopes, config)


#: A product for each supplier, with its receipt; one in ten says something else in each of nine ways.
_RULE_OF = {1: ["status"], 2: ["digests_agree"], 3: ["forcing_unchanged"], 4: ["static_trusted"], 5: ["valid_time"], 6: ["boundary_checked"], 7: ["boundary_unchanged"], 8: ["water"], 9: ["authority", "digests_whole", "static_trusted"]}


@query("receipt_contract", "SELECT s_suppkey AS record, unnest(CASE s_suppkey % 10 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _RULE_OF.items()) + " END) AS rule, 1::BIGINT AS violations FROM supplier WHERE s_suppkey % 10 > 0")
def receipt_contract(spark, d):
    """Receipts against the digests of what is there."""
    s, n = B.table(spark, d, "supplier"), F.col("s_suppkey") % 10
    h = lambda *c: F.sha2(F.concat_ws("|", *c), 256)
    own, static, edge, other = h("s_name", F.col("s_acctbal").cast("string")), h(F.lit("static")), h("s_name", F.lit("edge")), h("s_name", F.lit("other"))
    path = F.concat(F.lit("records/"), F.col("s_suppkey").cast("string"))
    at = F.timestamp_seconds(3600 * F.col("s_suppkey"))
    products = s.select(F.col("s_suppkey").alias("record"), path.alias("path"), own.alias("sha256"), F.lit("static").alias("static_path"), static.alias("static_sha256"), at.alias("valid"), F.lit("edge").alias("boundary_path"), edge.alias("boundary_sha256"))
    said = F.when(n == 3, other).otherwise(own)
    text = F.to_json(F.struct(
        F.lit("forcing-manifest-v1").alias("schema"), F.when(n == 1, "FAIL").otherwise("PASS").alias("status"), F.date_format(at + F.when(n == 5, F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL 0 HOUR")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("valid_time"),
        F.when(n == 8, "moist").otherwise("dry-air mixing ratio").alias("water_representation"), F.when(n == 9, "").otherwise("native").alias("authority"), path.alias("forcing_file"), F.when(n == 2, other).otherwise(said).alias("forcing_sha256"),
        F.struct(path.alias("path"), said.alias("sha256")).alias("output"), F.struct(F.lit("static").alias("path"), F.when(n == 4, other).when(n == 9, F.upper(static)).otherwise(static).alias("sha256")).alias("static"),
        F.when(n != 6, F.struct(F.lit("edge").alias("path"), F.when(n == 7, other).otherwise(edge).alias("sha256"))).alias("boundary"),
    ))
    scopes = product_rules.receipt_scopes(s.select(F.col("s_suppkey").alias("record"), text.alias("text")), products)
    return _found(product_rules.RECEIPT, scopes, products)


_KINDS = ["view", "click", "purchase", "error", "signup"]


@query("output_contract", f"WITH {B.WIND}, h AS (SELECT station, kind, count(*) AS n FROM wind GROUP BY 1, 2) SELECT station AS record, 'variables' AS rule, 1::BIGINT AS violations FROM h GROUP BY 1 HAVING count(*) FILTER (n > 5 AND kind <> 'other') < 5 UNION ALL SELECT station, 'methods_' || kind, 1 FROM h WHERE n > 5 AND n % 4 = 0 UNION ALL SELECT DISTINCT station, 'heights', 1 FROM h WHERE station % 6 = 5")
def output_contract(spark, d):
    """Outputs of stations: variables are kinds with more than five events; what a variable means in time is left out where four divides their number."""
    n = B.wind(spark, d).groupBy(F.col("station").alias("record"), F.col("kind").alias("var")).count()
    variables = n.where("count > 5").select("record", "var", F.when(F.col("count") % 4 > 0, "time: mean").otherwise("area: mean").alias("cell_methods"))
    place = F.posexplode(F.when(F.col("record") % 6 == 5, F.array(F.lit(10.0), F.lit(40.0))).otherwise(F.array(F.lit(10.0), F.lit(50.0))))
    stations = n.select("record").distinct()
    return _found(product_rules.output_rules(_KINDS, [10.0, 50.0]), product_rules.output_scopes(variables, stations.select("record", place.alias("place", "height"))), stations)
