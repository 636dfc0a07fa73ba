"""Contracts as tables of rules, compiled into one aggregation for each scope, whatever the number of rules.

A rule is a row: its name, the scope whose rows it reads, a test in SQL over their columns, and a severity. A test that is null fails. Scopes are views that the caller
gives, each with a ``record`` column: rows of values, of values with their neighbours, of cells, of records with their attributes, and so on. Every record gets a row for each rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillgrid.session import shuffled


@dataclass(frozen=True)
class Rule:
    name: str
    scope: str
    test: str
    severity: str = "error"


def rule_table(rules: DataFrame) -> list[Rule]:
    """Rules from a table (rule, scope, test, severity); there are few. Two of one name are an error."""
    found = [Rule(*r) for r in rules.select("rule", "scope", "test", "severity").collect()]
    if len({r.name for r in found}) < len(found):
        raise ValueError("two rules of one name")
    return found


def failures(rules: list[Rule], scopes: dict[str, DataFrame], records: DataFrame) -> DataFrame:
    """(record, rule, scope, severity, violations, ok) for every record of ``records`` and rule: how many of the scope's rows fail.

    A record without rows in a scope has no violations there; that it must have some is a rule of its own. Counts are summed before they are shuffled, so a record may have any number of rows.
    """
    unknown = {r.scope for r in rules} - set(scopes)
    if unknown:
        raise ValueError(f"rules of unknown scopes: {sorted(unknown)}")
    out = None
    for scope, rows in scopes.items():
        some = [r for r in rules if r.scope == scope]
        if not some:
            continue
        fails = rows.groupBy("record").agg(*[F.count_if(~F.coalesce(F.expr(r.test), F.lit(False))).alias(f"_{k}") for k, r in enumerate(some)])
        whole = records.select("record").distinct().join(fails, "record", "left")
        each = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(scope).alias("scope"), F.lit(r.severity).alias("severity"), F.coalesce(f"_{k}", F.lit(0)).cast("long").alias("violations")) for k, r in enumerate(some)])
        part = whole.select("record", F.explode(each).alias("r")).select("record", "r.*")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("ok", F.col("violations") == 0)


def verdict(found: DataFrame) -> DataFrame:
    """(record, passed, errors, warnings, failed): a record passes without a failed rule of severity error; ``failed`` lists those in order of their names."""
    bad = lambda s: F.count_if(~F.col("ok") & (F.col("severity") == s))
    names = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("rule"))))  # as many as there are rules at most
    return found.groupBy("record").agg((bad("error") == 0).alias("passed"), bad("error").alias("errors"), bad("warning").alias("warnings"), names.alias("failed"))


def with_below(levels: DataFrame, keys: list[str], level: str, *values: str) -> DataFrame:
    """Rows of levels with the values of the level below, null at the lowest."""
    w = Window.partitionBy(*keys).orderBy(level)
    return levels.withColumns({f"{v}_below": F.lag(v).over(w) for v in values})


#: Where a row of levels (y, x, k) and a geometry (_y, _x, _k) meet. As an equality of two columns the level would be a key to shuffle by.
ON_LEVEL = "y = _y AND x = _x AND k - _k = 0"


def as_map(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """(record, name): the few attributes or variables of each record as a map; of a key that is there twice the smallest value counts."""
    one = rows.groupBy("record", key).agg(F.min(value).alias("_v"))
    return one.groupBy("record").agg(F.map_from_entries(F.collect_list(F.struct(key, "_v"))).alias(name))


#: Variables that a forcing record must have, with the axes of those that are tested.
REQUIRED = ("P", "T", "QV", "U", "V", "W", "HHL", "HFL", "SST", "lat", "lon")
BINARY = "mask IS NOT NULL AND mask IN (0, 1)"
_ATTR = "a['{0}'] = '{1}'"
FORCING = [
    Rule("product_type", "record", _ATTR.format("product_type", "target_forcing_record")),
    Rule("water_representation", "record", _ATTR.format("water_representation", "dry-air mixing ratio")),
    Rule("static_identity", "record", "a['static_sha256'] = s['sha256']"),
    Rule("required_variables", "record", f"size(array_except(array({', '.join(repr(n) for n in REQUIRED)}), map_keys(v))) = 0"),
    Rule("one_time", "record", "size(times) = 1"),
    Rule("expected_time", "record", "times[0] = expected"),
    Rule("pressure_finite", "value", "NOT isnan(P) AND P IS NOT NULL"), Rule("temperature_finite", "value", "NOT isnan(T) AND T IS NOT NULL"), Rule("vapour_finite", "value", "NOT isnan(QV) AND QV IS NOT NULL"),
    Rule("wind_finite", "value", "U IS NOT NULL AND V IS NOT NULL AND W IS NOT NULL AND NOT isnan(U) AND NOT isnan(V) AND NOT isnan(W)"),
    Rule("heights_finite", "value", "HHL IS NOT NULL AND HFL IS NOT NULL AND NOT isnan(HHL) AND NOT isnan(HFL)"),
    Rule("surface_finite", "cell", "SST IS NOT NULL AND NOT isnan(SST)"),
    Rule("pressure_range", "value", "coalesce(P BETWEEN 100 AND 120000, true)"), Rule("temperature_range", "value", "coalesce(T BETWEEN 150 AND 350, true)"), Rule("vapour_range", "value", "coalesce(QV BETWEEN 0 AND 0.1, true)"),
    Rule("wind_speed", "value", "coalesce(sqrt(U * U + V * V) <= 200, true)"), Rule("vertical_wind", "value", "coalesce(abs(W) <= 100, true)"),
    Rule("w_axes", "record", "v['W'].axes = array('time', 'z', 'y', 'x')"), Rule("w_coordinate", "record", _ATTR.format("w_vertical_coordinate", "static_HFL")), Rule("w_basis", "record", _ATTR.format("w_wind_basis", "grid_relative")),
    Rule("sst_axes", "record", "v['SST'].axes = array('time', 'y', 'x')"), Rule("sst_units", "record", "lower(trim(v['SST'].units)) IN ('k', 'kelvin')"),
    Rule("landmask_there", "cell", "land IS NOT NULL"), Rule("has_water", "record", "n_water > 0"), Rule("sst_range", "cell", "coalesce(land OR SST BETWEEN 180 AND 350, true)"),
    Rule("sst_source", "record", "length(a['sst_source_sha256']) > 0"), Rule("sst_native_source", "record", "length(a['sst_native_source_sha256']) > 0"), Rule("sst_identity", "record", "a['sst_target_product_sha256'] = a['sst_source_sha256']"),
    Rule("sst_variable", "record", _ATTR.format("sst_source_variable", "SKT")), Rule("sst_time", "record", "to_timestamp(a['sst_valid_time']) = times[0]"), Rule("sst_policy", "record", _ATTR.format("sst_policy_version", "2")), Rule("sst_remap", "record", _ATTR.format("sst_remap_policy", "same_surface")),
    Rule("water_count", "record", "try_cast(a['sst_water_cell_count'] AS BIGINT) = n_water"), Rule("compact_count", "record", "try_cast(a['sst_compact_count'] AS BIGINT) BETWEEN 0 AND try_cast(a['sst_water_cell_count'] AS BIGINT)"),
    Rule("unsupported_count", "record", "try_cast(a['sst_unsupported_count'] AS BIGINT) BETWEEN 0 AND try_cast(a['sst_water_cell_count'] AS BIGINT)"),
    Rule("exception_counts", "record", "try_cast(a['sst_compact_count'] AS BIGINT) + try_cast(a['sst_unsupported_count'] AS BIGINT) <= try_cast(a['sst_water_cell_count'] AS BIGINT)"),
    Rule("candidate_maximum", "record", "try_cast(a['sst_candidate_maximum_km'] AS DOUBLE) >= 0 AND NOT isnan(try_cast(a['sst_candidate_maximum_km'] AS DOUBLE))"),
    Rule("mask_there", "record", "v['SST_mask'] IS NOT NULL"), Rule("distance_there", "record", "v['SST_distance'] IS NOT NULL"), Rule("support_axes", "record", "v['SST_mask'].axes = array('y', 'x') AND v['SST_distance'].axes = array('y', 'x')"),
    Rule("mask_binary", "cell", BINARY), Rule("mask_on_water", "cell", "coalesce(mask = 0 OR NOT land, true)"), Rule("mask_count", "record", "n_mask = try_cast(a['sst_unsupported_count'] AS BIGINT)"),
    Rule("distance_on_mask", "cell", "coalesce(mask <> 1, true) OR (distance >= 0 AND NOT isnan(distance))"), Rule("distance_off_mask", "cell", "coalesce(mask = 1, false) OR distance IS NULL OR isnan(distance)"),
    Rule("distance_maximum", "record", "abs(try_cast(a['sst_candidate_maximum_km'] AS DOUBLE) - coalesce(most_distance, 0.0D)) <= 1e-9"),
    Rule("interfaces_ascend", "value", "coalesce(HHL > HHL_below, true)"), Rule("levels_ascend", "value", "coalesce(HFL > HFL_below, true)"), Rule("geometry_there", "value", "static_HHL IS NOT NULL AND static_HFL IS NOT NULL"),
    Rule("geometry_equal", "value", "coalesce(HHL = static_HHL AND HFL = static_HFL, true)"), Rule("serialization", "record", _ATTR.format("geometry_serialization", "static_with_top_cover")),
    Rule("latitudes_equal", "cell", "lat = static_lat"), Rule("longitudes_equal", "cell", "lon = static_lon"),
    Rule("boundary_identity", "record", "b IS NULL OR b['initial_sha256'] = a['sha256']"), Rule("boundary_static", "record", "b IS NULL OR b['static_sha256'] = s['sha256']"), Rule("boundary_time", "record", "b IS NULL OR to_timestamp(b['first_valid_time']) = times[0]"),
]


def forcing_scopes(values: DataFrame, cells: DataFrame, static_values: DataFrame, static_cells: DataFrame, variables: DataFrame, attributes: DataFrame, times: DataFrame, static: DataFrame, boundary: DataFrame) -> dict[str, DataFrame]:
    """The scopes of ``FORCING``.

    values: (record, y, x, k, P, T, QV, U, V, W, HHL, HFL); cells: (record, y, x, SST, mask, distance, lat, lon); static_values: (y, x, k, HHL, HFL); static_cells: (y, x, land, lat, lon);
    variables: (record, var, axes, units); attributes and boundary: (record, key, value); times: (record, time, expected); static: (key, value), a few rows.
    """
    # shuffles go by the cell alone, so tables that come dealt by their cells stay where they are
    geometry = static_values.select(*[F.col(c).alias(f"_{c}") for c in ("y", "x", "k")], F.col("HHL").alias("static_HHL"), F.col("HFL").alias("static_HFL"))
    value = with_below(values, ["y", "x", "record"], "k", "HHL", "HFL").join(shuffled(geometry), F.expr(ON_LEVEL), "left").drop("_y", "_x", "_k")
    cell = cells.join(shuffled(static_cells.select("y", "x", "land", F.col("lat").alias("static_lat"), F.col("lon").alias("static_lon"))), ["y", "x"], "left")
    facts = cell.groupBy("record").agg(F.count_if(~F.col("land")).alias("n_water"), F.count_if(F.col("mask") == 1).alias("n_mask"), F.max(F.when((F.col("mask") == 1) & ~F.isnan("distance"), F.col("distance"))).alias("most_distance"))
    time = times.groupBy("record").agg(F.array_sort(F.collect_list("time")).alias("times"), F.max("expected").alias("expected"))
    constant = static.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("s"))  # the attributes of one product
    record = facts.join(time, "record", "left").join(as_map(attributes, "key", F.col("value"), "a"), "record", "left").join(as_map(variables, "var", F.struct("axes", "units"), "v"), "record", "left").join(as_map(boundary, "key", F.col("value"), "b"), "record", "left").crossJoin(F.broadcast(constant))
    return {"value": value, "cell": cell, "record": record}
