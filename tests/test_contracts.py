"""Contracts: what is planted is found, by the rule that is meant for it and by no other."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skillgrid.operators import contracts
from skillgrid.operators.contracts import FORCING, Rule
from skillgrid.plans.registry import QUERIES, load

load()
SF = "/root/testdata/sf0.001"


def product(spark, **change):
    """One sound record on 2 x 2 cells and 3 levels, and what is changed of it."""
    at = dt.datetime(2024, 1, 1, 6)
    cells = [(y, x, y == 0) for y in range(2) for x in range(2)]
    values = [dict(record=1, y=y, x=x, k=k, P=9e4 - k, T=280.0, QV=0.01, U=3.0, V=4.0, W=0.0, HHL=100.0 * k, HFL=100.0 * k + 50) for y, x, _ in cells for k in range(3)]
    surface = [dict(record=1, y=y, x=x, SST=285.0, mask=float(not land and x == 1), distance=2.5 if not land and x == 1 else None, lat=46.0 + y, lon=7.0 + x) for y, x, land in cells]
    attributes = {"product_type": "target_forcing_record", "water_representation": "dry-air mixing ratio", "static_sha256": "abc", "sha256": "me", "w_vertical_coordinate": "static_HFL", "w_wind_basis": "grid_relative", "sst_source_sha256": "s", "sst_native_source_sha256": "n", "sst_target_product_sha256": "s", "sst_source_variable": "SKT", "sst_valid_time": "2024-01-01 06:00:00", "sst_policy_version": "2", "sst_remap_policy": "same_surface", "sst_water_cell_count": "2", "sst_compact_count": "1", "sst_unsupported_count": "1", "sst_candidate_maximum_km": "2.5", "geometry_serialization": "static_with_top_cover"}
    axes = {n: ["time", "z", "y", "x"] for n in contracts.REQUIRED} | {"SST": ["time", "y", "x"], "SST_mask": ["y", "x"], "SST_distance": ["y", "x"]}
    land = [dict(y=y, x=x, land=a, lat=46.0 + y, lon=7.0 + x) for y, x, a in cells]
    static_values = [dict(y=r["y"], x=r["x"], k=r["k"], HHL=r["HHL"], HFL=r["HFL"]) for r in values]
    boundary = {"initial_sha256": "me", "static_sha256": "abc", "first_valid_time": "2024-01-01 06:00:00"}
    parts = dict(values=values, surface=surface, attributes=attributes, axes=axes, land=land, static_values=static_values, boundary=boundary, times=[at], expected=at)
    for name, edit in change.items():
        edited = edit(parts[name])
        parts[name] = parts[name] if edited is None else edited
    table = lambda rows, schema: spark.createDataFrame([tuple(r.values()) if isinstance(r, dict) else r for r in rows], schema)
    pairs = lambda m: table([(1, k, v) for k, v in m.items()], "record int, key string, value string")
    scopes = contracts.forcing_scopes(
        table(parts["values"], "record int, y int, x int, k int, P double, T double, QV double, U double, V double, W double, HHL double, HFL double"),
        table(parts["surface"], "record int, y int, x int, SST double, mask double, distance double, lat double, lon double"),
        table(parts["static_values"], "y int, x int, k int, HHL double, HFL double"), table(parts["land"], "y int, x int, land boolean, lat double, lon double"),
        table([(1, n, a, "K") for n, a in parts["axes"].items()], "record int, var string, axes array<string>, units string"), pairs(parts["attributes"]),
        table([(1, t, parts["expected"]) for t in parts["times"]], "record int, time timestamp, expected timestamp"), table([("sha256", "abc")], "key string, value string"), pairs(parts["boundary"]),
    )
    found = contracts.failures(FORCING, scopes, spark.createDataFrame([(1,)], "record int"))
    return {r.rule: r.violations for r in found.where("not ok").collect()}


def put(name, value):
    return lambda m: m.__setitem__(name, value)


def row(k, **new):
    return lambda rows: rows[k].update(new)


@pytest.mark.parametrize(
    "change, failed",
    [
        ({}, {}),
        (dict(values=row(0, P=float("nan"))), {"pressure_finite": 1, "pressure_range": 1}),  # NaN counts as larger than any pressure
        (dict(values=row(4, HHL=-1.0)), {"interfaces_ascend": 1, "geometry_equal": 1}),
        (dict(values=row(1, U=300.0)), {"wind_speed": 1}),
        (dict(surface=row(2, SST=100.0)), {"sst_range": 1}),
        (dict(surface=row(0, SST=100.0)), {}),  # over land it doesn't matter
        (dict(surface=row(0, mask=1.0, distance=1.0)), {"mask_on_water": 1, "mask_count": 1}),
        (dict(surface=row(3, distance=None)), {"distance_on_mask": 1, "distance_maximum": 1}),
        (dict(surface=row(2, distance=1.0)), {"distance_off_mask": 1}),
        (dict(surface=row(1, mask=None)), {"mask_binary": 1}),
        (dict(land=lambda rows: [r | {"land": True} for r in rows]), {"has_water": 1, "water_count": 1, "mask_on_water": 1}),
        (dict(land=row(0, land=None)), {"landmask_there": 1}),
        (dict(static_values=lambda rows: rows[1:]), {"geometry_there": 1}),
        (dict(attributes=put("sst_water_cell_count", None)), {"water_count": 1, "compact_count": 1, "unsupported_count": 1, "exception_counts": 1}),
        (dict(attributes=put("sst_candidate_maximum_km", "nan")), {"candidate_maximum": 1, "distance_maximum": 1}),
        (dict(axes=lambda m: {k: v for k, v in m.items() if k != "SST_mask"}), {"mask_there": 1, "support_axes": 1}),
        (dict(axes=lambda m: {k: v for k, v in m.items() if k != "HFL"}), {"required_variables": 1}),
        (dict(times=lambda t: [*t, dt.datetime(2024, 1, 2)]), {"one_time": 1}),
        (dict(boundary=lambda m: {}), {}),
        (dict(boundary=put("initial_sha256", "you")), {"boundary_identity": 1}),
        (dict(attributes=put("static_sha256", "xyz")), {"static_identity": 1}),
    ],
)
def test_one_defect_at_a_time(spark, change, failed):
    assert product(spark, **change) == failed


def test_every_rule_is_broken_by_some_record(spark):
    broken = {r.rule for r in QUERIES["forcing_contract"](spark, "/root/testdata/sf0.01").where("not ok").select("rule").distinct().collect()}
    assert {r.name for r in FORCING} - broken == {"landmask_there", "has_water", "geometry_there"} and len(FORCING) > 47


def test_rules_from_a_table(spark):
    rows = spark.createDataFrame([(1, 5), (1, 11), (2, None)], "record int, v int")
    table = spark.createDataFrame([("small", "r", "v < 10", "error"), ("there", "r", "v IS NOT NULL", "warning")], "rule string, scope string, test string, severity string")
    rules = contracts.rule_table(table)
    found = contracts.failures(rules, {"r": rows}, spark.createDataFrame([(1,), (2,), (3,)], "record int"))
    assert {(r.record, r.rule): r.violations for r in found.collect()} == {(1, "small"): 1, (1, "there"): 0, (2, "small"): 1, (2, "there"): 1, (3, "small"): 0, (3, "there"): 0}
    assert {r.record: (r.passed, r.warnings, r.failed) for r in contracts.verdict(found).collect()} == {1: (False, 0, ["small"]), 2: (False, 1, ["small", "there"]), 3: (True, 0, [])}
    with pytest.raises(ValueError):
        contracts.rule_table(table.union(table))
    with pytest.raises(ValueError):
        contracts.failures([Rule("x", "nowhere", "true")], {"r": rows}, rows)
