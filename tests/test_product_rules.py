"""Product contracts: each record has one defect, and fails the rules that are meant for it and no others."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgrid.operators import contracts
from skillgrid.operators import product_rules as R

NAN = float("nan")
T0 = dt.datetime(2024, 1, 1)


def hour(n):
    return T0 + dt.timedelta(hours=n)


def failed(rules, scopes, records):
    got = contracts.failures(rules, scopes, records).where("not ok").collect()
    out = {r.record: set() for r in records.collect()}
    for r in got:
        out[r.record].add(r.rule)
    return out


def test_native_states(spark):
    sound = lambda r: {(y, x, k): dict(record=r, y=y, x=x, k=k, P=9e4 - 100.0 * k, QV=0.01, QC=0.0, HHL=500.0 * k + 10, W=0.0) for y in range(2) for x in range(2) for k in range(3)}
    edits = [
        (None, {}, set()), ((0, 0, 1), {"P": 9e4}, {"pressure_decreases"}), ((0, 0, 1), {"HHL": 10.0}, {"heights_increase"}), ((1, 1, 2), {"QV": 0.6, "QC": 0.4}, {"moist_below_one"}), ((1, 1, 2), {"QC": -1e-9}, {"water_not_negative"}),
        ((0, 1, 0), {"W": 200.0}, {"w_range"}), ((1, 0, 0), {"W": 200.0}, {"w_range_unused"}), ((0, 0, 0), {"HHL": 12.5}, {"bottom_near_surface"}), ((0, 0, 2), {"W": NAN}, {"finite", "w_range"}), ((0, 0, 2), {"P": None}, {"finite"}), ((1, 0, 2), None, {"levels"}),
    ]
    rows = []
    for n, (at, new, _) in enumerate(edits):
        cells = sound(n)
        if new is None:
            del cells[at]
        elif at:
            cells[at].update(new)
        rows += cells.values()
    values = spark.createDataFrame([tuple(r.values()) for r in rows], "record int, y int, x int, k int, P double, QV double, QC double, HHL double, W double")
    surface = spark.createDataFrame([(y, x, 11.0) for y in range(2) for x in range(2)], "y int, x int, surface double")
    donors = surface.where("not (y = 1 and x = 0)").unionAll(surface.where("y = 0"))
    records = values.select("record").distinct()
    assert failed(R.NATIVE, R.native_scopes(values, surface, donors), records) == {n: e for n, (_, _, e) in enumerate(edits)}
    outside = donors.unionAll(spark.createDataFrame([(9, 9, 0.0)], surface.schema))
    assert "donors_there" in failed(R.NATIVE, R.native_scopes(values, surface, outside), records)[0]
    assert failed(R.NATIVE, R.native_scopes(values, surface), records)[6] == {"w_range"}  # without donors every cell is used


def test_boundary_sequences(spark):
    attributes = {"product_type": "lateral_boundary_state", "w_policy": "static_HFL", "water_conversion": "applied", "nx": "4", "ny": "3", "grid_fingerprint": "g", "static_sha256": "s", "relaxation_profile": "cos", "relaxation_update": "u", "relaxation_seconds": "600"}

    def edit(part, key, value):
        return lambda m: m[part].__setitem__(key, value) if value is not None else m[part].pop(key)

    edits = [
        (None, set()), (edit("attributes", "product_type", "x"), {"product_type"}), (edit("attributes", "w_policy", "x"), {"w_policy", "attributes_same"}), (edit("attributes", "water_conversion", "x"), {"water_known", "attributes_same"}),
        (edit("attributes", "nx", "0"), {"domain", "in_bounds"}), (edit("time", 0, hour(4)), {"times_increase"}), (edit("time", 0, hour(9)), {"interval"}), (edit("axes", "QC", None), {"fields", "schema_same"}),
        (edit("axes", "QC", "point"), {"axes", "schema_same"}), (edit("attributes", "static_sha256", "t"), {"attributes_same"}), (edit("points", (0, 3), None), {"points_same", "in_bounds"}), (edit("values", ("HFL", 1), 7.0), {"geometry_same"}), (edit("values", ("T", 1), NAN), {"finite"}),
        (edit("weights", 0, 0.5), {"edge_bound"}), (edit("weights", 1, 1.5), {"weights"}), (edit("weights", 1, NAN), {"weights"}), (edit("time", 0, None), {"has_time", "times_increase", "interval"}),
    ]
    tables = {n: [] for n in ("values", "points", "variables", "attributes", "times")}
    for n, (change, _) in enumerate(edits):
        m = dict(attributes=dict(attributes), time={0: hour(n)}, axes=dict(R.BOUNDARY_FIELDS), points={(0, 3): 1}, values={}, weights={0: 1.0, 1: 0.25})
        if change:
            change(m)
        at = [(0, 0), (0, 3 if (0, 3) in m["points"] else 4)]
        tables["points"] += [(n, y, x, m["weights"][k]) for k, (y, x) in enumerate(at)]
        tables["values"] += [(n, y, x, k, m["values"].get(("T", k), 280.0), 9e4, 0.01, 0.0, 0.0, m["values"].get(("HFL", k), 50.0 * k), 100.0 * k) for y, x in ((0, 0), (0, 3)) for k in range(2)]
        tables["variables"] += [(n, v, a.split(","), "double") for v, a in m["axes"].items()]
        tables["attributes"] += [(n, k, v) for k, v in m["attributes"].items()]
        tables["times"].append((n, n, m["time"].get(0)))
    schemas = dict(values="record int, row int, column int, k int, T double, P double, QV double, QC double, QI double, HFL double, HHL double", points="record int, row int, column int, weight double", variables="record int, var string, axes array<string>, type string", attributes="record int, key string, value string", times="record int, place int, time timestamp")
    frames = {n: spark.createDataFrame(rows, schemas[n]) for n, rows in tables.items()}
    records = frames["times"].select("record")
    got = failed(R.BOUNDARY, R.boundary_scopes(**frames, limit=7200), records)
    want = {n: e for n, (_, e) in enumerate(edits)}
    want[7] = want[7] | {"times_increase"}  # the state before it is late
    assert got == want
    assert failed(R.BOUNDARY, R.boundary_scopes(**{n: f.where("record = 0") for n, f in frames.items()}), records.where("record = 0")) == {0: {"enough_states"}}
    double = frames | {"points": frames["points"].unionAll(frames["points"].where("record = 0").limit(1))}
    assert failed(R.BOUNDARY, R.boundary_scopes(**double, limit=7200), records)[0] == {"point_once"}


def test_surface_states(spark):
    base = dict(skin=280.0, swe=0.0, depth=0.0, density=NAN, snow_temperature=NAN)
    snowy = dict(swe=100.0, density=400.0, depth=0.25, snow_temperature=272.0)
    at = lambda **new: lambda m: m["cells"][(0, 1)].update(new)
    soil = lambda key, **new: lambda m: m["layers"][key].update(new)
    says = lambda key, value: lambda m: m["attributes"].__setitem__(key, value)
    edits = {
        "a": (lambda m: None, set()), "declared": (says("method", "x"), {"method_declared"}), "static": (says("static_sha256", "x"), {"static_identity"}), "source": (says("source_sha256", "x"), {"source_identity"}),
        "nan": (soil((0, 1, 1), vwc=NAN), {"soil_water_finite", "below_saturation"}), "dry": (soil((0, 1, 2), vwc=0.04), {"above_dry"}), "wet": (soil((0, 1, 2), vwc=0.51), {"below_saturation"}), "ice": (soil((0, 2, 1), vwc=0.1), {"glacier_dry"}),
        "cold": (soil((0, 1, 2), temperature=170.0), {"soil_temperature", "state_shared"}), "skin": (at(skin=351.0), {"skin_temperature", "state_shared", "jump_most", "jump_p99"}), "snow": (at(**snowy), {"state_shared"}), "negative": (at(swe=-1.0), {"snow_not_negative", "state_shared"}),
        "density": (at(**snowy | dict(density=NAN)), {"snow_density", "state_shared"}), "heavy": (at(**snowy | dict(density=1000.0, depth=0.1)), {"below_ice", "state_shared"}), "much": (at(**snowy | dict(swe=12000.0, depth=30.0)), {"snow_storage", "state_shared"}), "depth": (at(**snowy | dict(depth=0.26)), {"snow_depth", "state_shared"}),
        "warm": (at(**snowy | dict(snow_temperature=274.0)), {"snow_temperature", "state_shared"}), "icy": (at(**snowy | dict(snow_temperature=269.0)), {"snow_temperature", "state_shared"}), "jump": (at(skin=300.0), {"jump_p99", "state_shared"}),
        "clips": (says("clips", "1"), {"clip_rate"}), "unknown": (says("fallback_km", "x"), {"fallback_known"}), "far": (says("fallback_km", "21"), {"fallback_far"}), "near": (says("fallback_km", "6"), {"fallback_near"}),
        "policy": (says("back_extrapolation", "maybe"), {"epoch_policy"}), "research": (says("back_extrapolation", "research"), {"epoch_researched"}), "lake": (lambda m: m["cells"][(0, 0)].update(snowy), {"no_snow_on_water", "state_shared"}),
    }
    layers, cells, attributes = [], [], []
    for name, (change, _) in edits.items():
        m = dict(cells={(0, x): dict(base) for x in range(3)}, layers={(0, x, k): dict(vwc=0.0 if x == 2 else 0.3, temperature=281.0) for x in range(3) for k in (1, 2)})
        m["attributes"] = dict(method=name, static_sha256="s", source_sha256="q", valid_time="t", clips="0", fallback_km="1.5", water_snow="zero")
        change(m)
        layers += [(name, *k, v["vwc"], v["temperature"]) for k, v in m["layers"].items()]
        cells += [(name, *k, v["skin"], v["swe"], v["depth"], v["density"], v["snow_temperature"]) for k, v in m["cells"].items()]
        attributes += [(name, k, v) for k, v in m["attributes"].items()]
    static = spark.createDataFrame([(0, 0, False, False, 0.05, 0.5), (0, 1, True, False, 0.05, 0.5), (0, 2, True, True, 0.05, 0.5)], "y int, x int, land boolean, glacier boolean, dry double, maximum double")
    scopes = R.surface_scopes(
        spark.createDataFrame(layers, "record string, y int, x int, layer int, vwc double, temperature double"), spark.createDataFrame(cells, "record string, y int, x int, skin double, swe double, depth double, density double, snow_temperature double"),
        static, spark.createDataFrame(attributes, "record string, key string, value string"), spark.createDataFrame([("static_sha256", "s"), ("source_sha256", "q")], "key string, value string"),
    )
    got = failed(R.SURFACE, scopes, spark.createDataFrame([(n,) for n in edits], "record string"))
    assert got == {n: e for n, (_, e) in edits.items()}


@pytest.mark.parametrize("values", [[1, 2, 3], [16, 17], [15] * 50 + [16], [1] * 99 + [100], [1] * 100 + [100], [1] * 199 + [16, 17], list(range(1, 31)), [15.0] * 98 + [15.1, 20.0], [3.0]])
def test_quantile_of_counts(spark, values):
    df = spark.createDataFrame([(float(v), True) for v in values] + [(999.0, False), (None, True)], "v double, land boolean")
    r = df.agg(*R.quantile_of_counts(0.99, 15.0, F.col("v"), F.col("land"))).first()
    assert r.jumps == len(values) and (r.jump_p99 > 15) == (np.quantile(values, 0.99) > 15)


def test_chains(spark):
    seg = lambda n, **new: dict(record=n, chain="c" if n < 3 else f"c{n}", place=n, start=hour(6 * n), end=hour(6 * n + 6), expected_static="s", needs_restart=n == 2) | new
    att = lambda n, **new: dict(record=n, attempt=1, complete=True, start_=hour(6 * n), end_=hour(6 * n + 6), model_end=None, static="s", restart=f"r{n}") | new
    config = [seg(n) for n in range(10)]
    config[9].update(needs_restart=True)
    attempts = [att(0), att(0, attempt=2, complete=False), att(1), att(2), att(3), att(3, attempt=2), att(5, end_=hour(30)), att(6, model_end=hour(99)), att(7, static="t"), att(8), att(9, restart=None)]
    outputs = [(n, 1, hour(6 * n + h)) for n in range(10) if n not in (4,) for h in range(0 if n > 2 or n == 0 else 1, 7)]
    outputs += [(0, 2, hour(1)), (8, 1, hour(49)), (7, 1, hour(70))]
    links = [(1, "r0"), (2, "r0"), (2, "other")]
    table = lambda rows, schema: spark.createDataFrame([tuple(r.values()) if isinstance(r, dict) else r for r in rows], schema)
    scopes = R.chain_scopes(
        table(config, "record int, chain string, place int, start timestamp, end timestamp, expected_static string, needs_restart boolean"), table(attempts, "record int, attempt int, complete boolean, start_ timestamp, end_ timestamp, model_end timestamp, static string, restart string"),
        table(outputs, "record int, attempt int, valid timestamp"), table(links, "record int, restart string"), table([(0, hour(3)), (1, hour(6)), (1, hour(7))], "record int, valid timestamp"),
    )
    got = failed(R.CHAIN, scopes, spark.createDataFrame([(n,) for n in range(10)], "record int"))
    none = {"one_completed", "interval", "ends_at_checkpoint", "static_identity", "has_outputs"}
    assert got == {0: set(), 1: {"evaluated"}, 2: {"linked_once"}, 3: {"one_completed"}, 4: none, 5: {"interval", "ends_at_checkpoint"}, 6: {"ends_at_checkpoint"}, 7: {"static_identity", "times_within"}, 8: {"times_once"}, 9: {"checkpoint_there"}}


def test_receipts(spark):
    h = lambda c: c * 64
    sound = dict(schema="forcing-manifest-v1", status="PASS", valid_time="2024-01-01T00:00:00Z", water_representation="dry-air mixing ratio", authority="x", forcing_file="f", forcing_sha256=h("a"), output=dict(path="f", sha256=h("a")), static=dict(path="s", sha256=h("b")), boundary=dict(path="b", sha256=h("c")))
    edits = [
        ({}, set()), (dict(schema="v2"), {"schema"}), (dict(status="FAIL"), {"status"}), (dict(forcing_file="g"), {"forcing_path"}), (dict(output=dict(path="g", sha256=h("a"))), {"forcing_path"}), (dict(forcing_sha256=h("d")), {"digests_agree"}),
        (dict(output=dict(path="f", sha256=h("d")), forcing_sha256=h("d")), {"forcing_unchanged"}), (dict(static=dict(path="t", sha256=h("b"))), {"static_path"}), (dict(static=dict(path="s", sha256=h("e"))), {"static_trusted"}), (dict(static=dict(path="s", sha256="B")), {"static_trusted", "digests_whole"}),
        (dict(valid_time="2024-01-01T01:00:00Z"), {"valid_time"}), (dict(water_representation="x"), {"water"}), (dict(authority=""), {"authority"}), (dict(boundary=None), {"boundary_checked"}), (dict(boundary=dict(path="x", sha256=h("c"))), {"boundary_path"}), (dict(boundary=dict(path="b", sha256=h("f"))), {"boundary_unchanged"}),
    ]
    n = len(edits)
    rows = [(k, json.dumps(sound | new)) for k, (new, _) in enumerate(edits)] + [(n, "no json")]
    products = spark.createDataFrame([(k, "f", h("a"), "s", h("b"), T0, "b", h("c")) for k in range(n + 2)], "record int, path string, sha256 string, static_path string, static_sha256 string, valid timestamp, boundary_path string, boundary_sha256 string")
    got = failed(R.RECEIPT, R.receipt_scopes(spark.createDataFrame(rows, "record int, text string"), products), products.select("record"))
    everything = {r.name for r in R.RECEIPT} - {"boundary_path", "boundary_unchanged"}
    assert got == {k: e for k, (_, e) in enumerate(edits)} | {n: everything, n + 1: everything}


def test_outputs(spark):
    rules = R.output_rules(["speed", "u"], [10.0, 50.0])
    variables = [(0, "speed", "time: mean"), (0, "u", "area: sum time: mean"), (1, "speed", "time: mean"), (2, "speed", "mean"), (2, "u", None), (3, "speed", "time: mean"), (3, "u", "time: mean")]
    heights = [(n, k, h) for n in (0, 1, 2) for k, h in enumerate((10.0, 50.0000001))] + [(3, 0, 50.0), (3, 1, 10.0)]
    scopes = R.output_scopes(spark.createDataFrame(variables, "record int, var string, cell_methods string"), spark.createDataFrame(heights, "record int, place int, height double"))
    got = failed(rules, scopes, spark.range(4).select(F.col("id").cast("int").alias("record")))
    assert got == {0: set(), 1: {"variables"}, 2: {"methods_speed", "methods_u"}, 3: {"heights"}}
