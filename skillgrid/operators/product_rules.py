"""Contracts of single products: native states, boundary sequences, surface states by method, chains of segments, receipts and outputs.

Each is a table of rules and a function that makes its scopes; ``contracts.failures`` compiles them. A scope keeps rows of values where they are and moves sums of them; the scope ``record`` has one row a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillgrid.operators.contracts import Rule, as_map, with_below


def _number(c: str) -> str:
    return f"({c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('inf'))"


def _digest(*columns: str) -> Column:
    """A sum of row hashes: the same for the same rows in any order."""
    return F.sum(F.xxhash64(*columns).cast("decimal(20,0)"))


#: A state on its own levels, counted upwards.
NATIVE = [
    Rule("finite", "value", " AND ".join(map(_number, ("P", "QV", "QC", "HHL", "W")))),
    Rule("pressure_decreases", "value", "coalesce(P < P_below, true)"), Rule("heights_increase", "value", "coalesce(HHL > HHL_below, true)"),
    Rule("moist_below_one", "value", "coalesce(QV + QC < 1, true)"), Rule("water_not_negative", "value", "coalesce(QV >= 0 AND QC >= 0, true)"),
    Rule("w_range", "value", "NOT used OR coalesce(W BETWEEN -100 AND 100, true)"), Rule("w_range_unused", "value", "used OR coalesce(W BETWEEN -100 AND 100, true)", "warning"),
    Rule("bottom_near_surface", "cell", "abs(bottom - surface) <= 1"), Rule("donors_there", "record", "donors_found = donors"), Rule("levels", "cell", "levels = most_levels"),
]


def native_scopes(values: DataFrame, surface: DataFrame, donors: DataFrame | None = None) -> dict[str, DataFrame]:
    """values: (record, y, x, k, P, QV, QC, HHL, W); surface: (y, x, surface); donors: cells (y, x) that weights use, in any number of rows: a range is an error there and a warning elsewhere. Without them all cells are used."""
    cell_at = ["record", "y", "x"]
    used = (surface if donors is None else donors).select("y", "x").distinct()
    value = with_below(values, cell_at, "k", "P", "HHL").join(used.withColumn("_u", F.lit(True)), ["y", "x"], "left").withColumn("used", F.coalesce("_u", F.lit(False)))
    cells = values.groupBy(*cell_at).agg(F.min_by("HHL", "k").alias("bottom"), F.count("*").alias("levels"))
    most = cells.groupBy("record").agg(F.max("levels").alias("most_levels"))
    cell = cells.join(most, "record").join(surface.select("y", "x", "surface"), ["y", "x"], "left")
    found = cells.join(used, ["y", "x"], "left_semi").groupBy("record").agg(F.count("*").alias("donors_found"))
    record = found.crossJoin(F.broadcast(used.agg(F.count("*").alias("donors"))))  # one row
    return {"value": value, "cell": cell, "record": values.select("record").distinct().join(record, "record", "left")}


#: Fields of a boundary state with their axes, and what must not change over a sequence; fixed values.
BOUNDARY_FIELDS = {"row": "point", "column": "point", "relaxation_weight": "point", **{n: "level,point" for n in ("T", "P", "QV", "QC", "QI", "HFL")}, "HHL": "half_level,point"}
BOUNDARY_SAME = ("water_conversion", "w_policy", "grid_fingerprint", "static_sha256", "relaxation_profile", "relaxation_update", "relaxation_seconds")
BOUNDARY = [
    Rule("product_type", "record", "a['product_type'] = 'lateral_boundary_state'"), Rule("w_policy", "record", "a['w_policy'] = 'static_HFL'"), Rule("water_known", "record", "a['water_conversion'] IN ('applied', 'not_applied')"),
    Rule("domain", "record", "try_cast(a['nx'] AS INT) > 0 AND try_cast(a['ny'] AS INT) > 0"), Rule("has_time", "record", "time IS NOT NULL"), Rule("times_increase", "record", "before IS NULL OR time > before"), Rule("interval", "record", "before IS NULL OR limit IS NULL OR unix_timestamp(time) - unix_timestamp(before) <= limit"),
    Rule("fields", "record", f"array_sort(map_keys(v)) = array({', '.join(repr(n) for n in sorted(BOUNDARY_FIELDS))})"),
    Rule("axes", "record", " AND ".join(f"coalesce(array_join(v['{n}'].axes, ',') = '{a}', true)" for n, a in BOUNDARY_FIELDS.items())), Rule("schema_same", "record", "schema = first_schema"), Rule("attributes_same", "record", "same <=> first_same"),
    Rule("points_same", "record", "points = first_points"), Rule("geometry_same", "record", "geometry = first_geometry"), Rule("edge_bound", "record", "edge"), Rule("enough_states", "record", "states >= least"),
    Rule("in_bounds", "point", "row BETWEEN 0 AND ny - 1 AND column BETWEEN 0 AND nx - 1"), Rule("point_once", "point", "copies = 1"), Rule("weights", "point", f"{_number('weight')} AND weight BETWEEN 0 AND 1"),
    Rule("finite", "value", " AND ".join(map(_number, ("T", "P", "QV", "QC", "QI", "HFL", "HHL")))),
]


def boundary_scopes(values: DataFrame, points: DataFrame, variables: DataFrame, attributes: DataFrame, times: DataFrame, limit: float | None = None, least: int = 2) -> dict[str, DataFrame]:
    """values: (record, row, column, k, T, P, QV, QC, QI, HFL, HHL); points: (record, row, column, weight); variables: (record, var, axes array, type); attributes: (record, key, value); times: (record, place, time), a row a record.

    The order of a sequence is that of its places; points and geometry are compared with those of the first by sums of hashes.
    """
    at = ["record", "row", "column"]
    a = as_map(attributes, "key", F.col("value"), "a")
    v = as_map(variables, "var", F.struct("axes", "type"), "v")
    size = a.select("record", *[F.expr(f"try_cast(a['{n}'] AS INT)").alias(n) for n in ("nx", "ny")])
    point = points.join(points.groupBy(*at).agg(F.count("*").alias("copies")), at).join(size, "record", "left")
    by_point = points.groupBy("record").agg(_digest("row", "column").alias("points"), F.bool_or(F.col("weight") == 1).alias("edge"))
    by_value = values.groupBy("record").agg(_digest("row", "column", "k", "HFL", "HHL").alias("geometry"))
    facts = times.join(a, "record", "left").join(v, "record", "left").join(by_point, "record", "left").join(by_value, "record", "left")
    schema = F.array_sort(F.map_entries("v"))
    same = F.array(*[F.try_element_at("a", F.lit(n)) for n in BOUNDARY_SAME])
    order = Window.orderBy("place")  # a row a state
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    facts = facts.withColumns({"schema": F.to_json(schema), "same": same}).withColumn("before", F.lag("time").over(order))
    facts = facts.withColumns({f"first_{n}": F.first(n).over(order) for n in ("schema", "same", "points", "geometry")} | {"states": F.count("*").over(whole)})
    record = facts.withColumns({"limit": F.lit(limit).cast("double"), "least": F.lit(least), "edge": F.coalesce("edge", F.lit(False))})
    return {"value": values, "point": point, "record": record}


#: A surface state of one method; the severity tells a failure from a warning.
SURFACE = [
    Rule("method_declared", "record", "a['method'] = record"), Rule("static_identity", "record", "a['static_sha256'] = s['static_sha256']"), Rule("source_identity", "record", "a['source_sha256'] = s['source_sha256']"), Rule("one_time", "record", "times = 1"),
    Rule("soil_water_finite", "layer", f"NOT active OR {_number('vwc')}"), Rule("above_dry", "layer", "NOT active OR coalesce(vwc >= dry - 1e-10, true)"), Rule("below_saturation", "layer", "NOT active OR coalesce(vwc <= maximum + 1e-10, true)"),
    Rule("glacier_dry", "layer", "NOT glacier OR vwc = 0"), Rule("soil_temperature", "layer", f"{_number('temperature')} AND temperature BETWEEN 180 AND 340"), Rule("skin_temperature", "cell", f"{_number('skin')} AND skin BETWEEN 180 AND 350"),
    Rule("snow_not_negative", "cell", f"{_number('swe')} AND {_number('depth')} AND swe >= 0 AND depth >= 0"), Rule("snow_density", "cell", f"coalesce(swe <= 1e-9, true) OR ({_number('density')} AND density > 0)"), Rule("below_ice", "cell", "coalesce(swe <= 1e-9 OR isnan(density) OR density <= 917, true)"),
    Rule("snow_storage", "cell", "coalesce(swe <= 10000 AND depth <= 20, true)"), Rule("snow_depth", "cell", "coalesce(swe <= 1e-9 OR isnan(density) OR density <= 0 OR abs(depth - swe / density) <= 1e-10 + 1e-8 * abs(swe / density), true)"),
    Rule("snow_temperature", "cell", f"coalesce(swe <= 1e-9, true) OR ({_number('snow_temperature')} AND snow_temperature BETWEEN least(greatest(skin - 10, 180), least(skin, 273.15)) AND least(skin, 273.15))"),
    Rule("no_snow_on_water", "cell", "keep_water_snow OR land OR swe <= 0"), Rule("jump_most", "cell", "NOT land OR abs(jump) <= 50"),
    Rule("jump_p99", "record", "jumps = 0 OR jump_p99 <= 15", "warning"), Rule("clip_rate", "record", "try_cast(a['clips'] AS BIGINT) <= 0.05 * active_layers", "warning"),
    Rule("fallback_known", "record", f"{_number('fallback_km')}"), Rule("fallback_far", "record", "coalesce(fallback_km <= 20, true)"), Rule("fallback_near", "record", "coalesce(fallback_km <= 5 OR fallback_km > 20, true)", "warning"),
    Rule("epoch_policy", "record", "coalesce(a['back_extrapolation'], 'unknown') IN ('none', 'unknown', 'research')"), Rule("epoch_researched", "record", "coalesce(a['back_extrapolation'] <> 'research', true)", "warning"), Rule("state_shared", "record", "state = first_state"),
]


def quantile_of_counts(q: float, limit: float, value: Column, where: Column) -> list[Column]:
    """Aggregates (jumps, jump_p99): how many values there are, and their q-quantile with linear interpolation, up to what a comparison with ``limit`` needs: the quantile itself if it lies between the largest value that
    isn't above the limit and the smallest that is, else one of these two, which is on its side of the limit. No value is sorted or kept.
    """
    v = F.when(where, value)
    n, above = F.count(v), F.count_if(F.coalesce(v > limit, F.lit(False)))
    place = (n - 1) * F.lit(q)
    low, first_above = F.floor(place), n - above  # places from 0
    under, over = F.max(F.when(v <= limit, v)), F.min(F.when(v > limit, v))
    between = under + (over - under) * (place - low)
    return [n.alias("jumps"), F.when(low >= first_above, over).when(low + 1 < first_above, under).when((low + 1 == first_above) & (place > low), F.coalesce(between, under)).otherwise(under).alias("jump_p99")]


def surface_scopes(layers: DataFrame, cells: DataFrame, static: DataFrame, attributes: DataFrame, identities: DataFrame) -> dict[str, DataFrame]:
    """layers: (record, y, x, layer, vwc, temperature), record being the method; cells: (record, y, x, skin, swe, depth, density, snow_temperature); static: (y, x, land, glacier, dry, maximum), active soil being land that
    isn't glacier; attributes: (record, key, value); identities: (key, value), a few rows. What doesn't depend on the method is compared over methods by sums of hashes.
    """
    kept = as_map(attributes, "key", F.col("value"), "a")
    one = ["record", "y", "x"]
    layer = layers.join(static, ["y", "x"], "left").withColumn("active", F.col("land") & ~F.col("glacier"))
    top = layers.where("layer = 1").select(*one, F.col("temperature").alias("_top"))
    water = kept.select("record", (F.coalesce(F.try_element_at("a", F.lit("water_snow")), F.lit("keep")) != "zero").alias("keep_water_snow"))
    cell = cells.join(static.select("y", "x", "land"), ["y", "x"], "left").join(top, one, "left").join(water, "record", "left").withColumn("jump", F.abs(F.col("_top") - F.col("skin")))
    by_layer = layer.groupBy("record").agg(F.count_if("active").alias("active_layers"), _digest("y", "x", "layer", "temperature").alias("_soil"))
    by_cell = cell.groupBy("record").agg(*quantile_of_counts(0.99, 15.0, F.col("jump"), F.col("land")), _digest("y", "x", "skin", "swe", "density", "depth", "snow_temperature").alias("_top_state"))
    constant = identities.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("s"))
    record = kept.join(by_layer, "record", "left").join(by_cell, "record", "left").crossJoin(F.broadcast(constant))
    all_methods = Window.orderBy("record").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row a method
    record = record.withColumns({"state": F.struct("_soil", "_top_state"), "fallback_km": F.expr("try_cast(a['fallback_km'] AS DOUBLE)"), "valid": F.try_element_at("a", F.lit("valid_time"))})
    record = record.withColumns({"first_state": F.first("state").over(all_methods), "times": F.size(F.collect_set(F.coalesce("valid", F.lit(""))).over(all_methods))})
    return {"layer": layer, "cell": cell, "record": record}


#: Segments of a chain, in their configured order.
CHAIN = [
    Rule("one_completed", "record", "completed = 1"), Rule("interval", "record", "start_ = start AND end_ = end"), Rule("ends_at_checkpoint", "record", "coalesce(model_end, end_) = end"), Rule("static_identity", "record", "static = expected_static"),
    Rule("has_outputs", "record", "outputs > 0"), Rule("times_once", "output", "copies = 1"), Rule("times_within", "output", "valid > start AND valid <= end OR first AND valid = start"), Rule("follows", "record", "first OR start = end_before"),
    Rule("linked_once", "record", "first OR links = 1"), Rule("checkpoint_there", "record", "NOT needs_restart OR restart IS NOT NULL"), Rule("evaluated", "evaluation", "there"),
]


def chain_scopes(config: DataFrame, attempts: DataFrame, outputs: DataFrame, links: DataFrame, evaluation: DataFrame) -> dict[str, DataFrame]:
    """config: (record, chain, place, start, end, expected_static, needs_restart); attempts: (record, attempt, complete, start_, end_, model_end, static, restart); outputs: (record, attempt, valid); links: (record, restart),
    what a segment continues from; evaluation: (record, valid), times that are judged. Outputs count if their attempt is the completed one.
    """
    order = Window.partitionBy("chain").orderBy("place")
    done = attempts.where("complete")
    one = done.groupBy("record").agg(F.count("*").alias("completed"), *[F.min_by(c, "attempt").alias(c) for c in ("attempt", "start_", "end_", "model_end", "static", "restart")])
    placed = config.join(one, "record", "left").withColumns({"first": F.row_number().over(order) == 1, "end_before": F.lag("end").over(order), "_restart": F.lag("restart").over(order)})
    linked = links.withColumnRenamed("restart", "_to").join(placed.select("record", "_restart"), "record").where("_to = _restart").groupBy("record").agg(F.count("*").alias("links"))
    own = outputs.join(placed.select("record", "attempt", "start", "end", "first"), ["record", "attempt"])
    times = own.groupBy("record", "valid", "start", "end", "first").agg(F.count("*").alias("copies"))
    counts = times.groupBy("record").agg(F.count("*").alias("outputs"))
    record = placed.join(linked, "record", "left").join(counts, "record", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("completed", "links", "outputs")})
    seen = times.select("record", "valid", F.lit(True).alias("_there"))
    judged = evaluation.join(seen, ["record", "valid"], "left").withColumn("there", F.coalesce("_there", F.lit(False)))
    return {"record": record, "output": times, "evaluation": judged}


_RECEIPT = "schema string, status string, valid_time string, water_representation string, authority string, forcing_file string, forcing_sha256 string, output struct<path string, sha256 string>, static struct<path string, sha256 string>, boundary struct<path string, sha256 string>"
_SHA = "'^[0-9a-f]{64}$'"
RECEIPT = [
    Rule("readable", "record", "r IS NOT NULL"), Rule("schema", "record", "r.schema = 'forcing-manifest-v1'"), Rule("status", "record", "r.status = 'PASS'"), Rule("forcing_path", "record", "r.output.path = path AND r.forcing_file = path"),
    Rule("digests_whole", "record", f"r.output.sha256 RLIKE {_SHA} AND r.static.sha256 RLIKE {_SHA} AND (r.boundary IS NULL OR coalesce(r.boundary.sha256 RLIKE {_SHA}, false))"), Rule("digests_agree", "record", "r.forcing_sha256 = r.output.sha256"), Rule("forcing_unchanged", "record", "r.output.sha256 = sha256"),
    Rule("static_path", "record", "r.static.path = static_path"), Rule("static_trusted", "record", "r.static.sha256 = static_sha256"), Rule("valid_time", "record", "try_to_timestamp(r.valid_time) = valid"), Rule("water", "record", "r.water_representation = 'dry-air mixing ratio'"), Rule("authority", "record", "length(r.authority) > 0"),
    Rule("boundary_checked", "record", "(r.boundary IS NULL) = (boundary_path IS NULL)"), Rule("boundary_path", "record", "r.boundary IS NULL OR boundary_path IS NULL OR coalesce(r.boundary.path = boundary_path, false)"), Rule("boundary_unchanged", "record", "r.boundary IS NULL OR boundary_path IS NULL OR coalesce(r.boundary.sha256 = boundary_sha256, false)"),
]


def receipt_scopes(receipts: DataFrame, products: DataFrame) -> dict[str, DataFrame]:
    """receipts: (record, text), JSON; products: (record, path, sha256, static_path, static_sha256, valid, boundary_path, boundary_sha256), what is there: digests of the closed tables. A text that isn't JSON fails every rule but those on boundaries."""
    parsed = F.from_json("text", _RECEIPT)
    empty = F.forall(F.array(*[parsed[n] for n in ("schema", "status", "forcing_file")]), lambda c: c.isNull())
    return {"record": products.join(receipts.select("record", F.when(~empty, parsed).alias("r")), "record", "left")}


def output_rules(variables: list[str], heights: list[float]) -> list[Rule]:
    """Rules of hourly outputs: the variables, exactly these heights to 1e-6, and for each variable what its values mean in time."""
    listed = ", ".join(f"{h!r}D" for h in map(float, heights))
    names = ", ".join(map(repr, variables))
    return [
        Rule("variables", "record", f"size(array_except(array({names}), map_keys(v))) = 0"), Rule("heights", "record", f"size(heights) = {len(heights)} AND forall(zip_with(heights, array({listed}), (a, b) -> coalesce(abs(a - b) <= 1e-6, false)), ok -> ok)"),
        *[Rule(f"methods_{n}", "record", f"v['{n}'] IS NULL OR coalesce(contains(v['{n}'].cell_methods, 'time:'), false)") for n in variables],
    ]


def output_scopes(variables: DataFrame, heights: DataFrame) -> dict[str, DataFrame]:
    """variables: (record, var, cell_methods); heights: (record, place, height), a few a record."""
    v = as_map(variables, "var", F.struct("cell_methods"), "v")
    h = heights.groupBy("record").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "height"))), lambda c: c["height"]).alias("heights"))
    return {"record": v.join(h, "record", "full")}
