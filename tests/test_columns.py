"""Columns: closed forms, what can't be done, and plain loops over the whole tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgrid.operators import columns as C
from skillgrid.operators import raster, tiles
from skillgrid.plans import q_columns, q_surface
from skillgrid.plans.registry import QUERIES, load

load()
SF = "/root/testdata/sf0.01"
G, R = 9.80665, 287.05


def saturated(t, p):
    e = min(610.94 * math.exp(17.625 * (t - 273.15) / (t - 273.15 + 243.04)), 0.99 * p)
    return 0.622 * e / max(p - 0.378 * e, 1.0)


def plain_column(hhl, own, f, species):
    """One column, level by level; or the name of what is wrong with it."""
    if len(hhl) < 3 or len(own) < 2:
        return "shape"
    z, to = np.convolve(hhl, [0.5, 0.5], "valid"), np.convolve(own, [0.5, 0.5], "valid")
    if to[-1] > z[-1] + 1e-6:
        return "above_top"
    keep = z > own[0] if own[0] - hhl[0] > 1 else np.ones(len(z), bool)
    if keep.sum() < 2:
        return "buried"
    overlap = [k for k, h in enumerate(to) if max(hhl[0], own[0], z[0]) <= h <= z[-1]]
    if not overlap:
        return "no_anchor"

    def carry(v, bounds=None, least=None):
        zs, vs = z[keep], np.array(v)[keep]
        out = np.interp(to, zs, vs)
        slope = (vs[1] - vs[0]) / (zs[1] - zs[0])
        slope = slope if bounds is None else min(max(slope, bounds[0]), bounds[1])
        out = np.array([vs[0] + slope * (h - zs[0]) if h < zs[0] else x for h, x in zip(to, out)]).clip(vs.min(), vs.max())
        return out if least is None else np.maximum(out, least)

    t, u, v = carry(f["t"], (-0.012, 0.003)), carry(f["u"], (-0.02, 0.02)), carry(f["v"], (-0.02, 0.02))
    logp = np.log(f["p"])
    p = np.exp(carry(logp))
    with_cloud = "cloud" in species
    wet = [max((q + c) / max(saturated(a, b), 1e-12), 0.0) for q, c, a, b in zip(f["qv"], species.get("cloud", [0.0] * len(z)), f["t"], f["p"])]
    wet = carry(wet if with_cloud else [min(x, 1.0) for x in wet], (0.0, 0.0))
    others = {k: carry(x, (0.0, 0.0), 0.0) for k, x in species.items() if k != "cloud"}
    k0 = overlap[0]
    base = np.interp(to[k0], z, logp)
    for _ in range(8):
        full = np.array([saturated(a, b) for a, b in zip(t, p)])
        qv, qc = np.minimum(wet, 1) * full, np.maximum(wet - 1, 0) * full * with_cloud
        tv = t * (1 + 0.608 * qv - qc - sum(others.values(), np.zeros(len(to))))
        new = np.zeros(len(to))
        new[k0] = base
        for k in range(k0 + 1, len(to)):
            new[k] = new[k - 1] - G * (to[k] - to[k - 1]) / (R * 0.5 * (tv[k] + tv[k - 1]))
        for k in range(k0 - 1, -1, -1):
            new[k] = new[k + 1] + G * (to[k + 1] - to[k]) / (R * 0.5 * (tv[k] + tv[k + 1]))
        done, p = np.allclose(np.exp(new), p, rtol=1e-10, atol=1e-5), np.exp(new)
        if done:
            break
    out = {"z": to, "t": t, "p": p, "qv": qv, "u": u, "v": v, **others, "theta": t * (1e5 / p) ** (R / 1004.5), "rho": p / (R * t * (1 + 0.608 * qv - qc - sum(others.values(), np.zeros(len(to)))))}
    return out | ({"cloud": qc} if with_cloud else {})


def same(got, want):
    assert set(want) <= set(got)
    for name, x in want.items():
        assert got[name] == pytest.approx(x.tolist(), rel=1e-9, abs=1e-12), name


def test_every_column_of_the_table(spark):
    rows = q_columns.source_columns(spark, SF)
    got = {r.column_id: r.asDict() for r in C.reconstruct(rows, "column_id", q_columns.SPECIES).collect()}
    kinds = {}
    for r in rows.collect():
        want = plain_column(r.hhl, r.own_hhl, r.asDict(), {k: r[k] for k in q_columns.SPECIES})
        mine = got.pop(r.column_id)
        kinds[mine["violation"], mine["terrain"]] = kinds.get((mine["violation"], mine["terrain"]), 0) + 1
        if isinstance(want, str):
            assert (mine["violation"], mine["t"], mine["p"]) == (want, None, None)
        else:
            assert mine["violation"] is None and mine["residual"] < 1e-6
            same(mine, want)
    assert not got and {k for k, _ in kinds} >= {None, "above_top"} and {t for v, t in kinds if v is None} == {"lower", "higher"}


def column(spark, rows, species="cloud array<double>, rain array<double>"):
    return spark.createDataFrame(rows, "k long, hhl array<double>, own_hhl array<double>, t array<double>, p array<double>, qv array<double>, u array<double>, v array<double>" + (f", {species}" if species else ""))


def test_closed_forms(spark):
    """An isothermal dry column over a lower and the same ground: pressure is exponential from the anchor down; saturated air keeps its water, cloud is what is over saturation."""
    h = [0.0, 200.0, 400.0, 600.0, 800.0, 1000.0]
    z = np.array([100.0, 300, 500, 700, 900])
    p = 1e5 * np.exp(-G * z / (R * 280))
    flat = [280.0] * 5
    rows = [(1, h, [-300.0, -100.0, 300.0, 700.0], flat, p.tolist(), [0.0] * 5, [5.0] * 5, [0.0] * 5), (2, h, h[:5], flat, p.tolist(), [0.0] * 5, [5.0] * 5, [0.0] * 5)]
    got = {r.k: r for r in C.reconstruct(column(spark, rows, ""), "k").collect()}
    assert got[1].terrain == "lower" and got[2].terrain == "matched" and got[1].below == 1 and got[1].anchor_m == 100.0
    assert got[1].p == pytest.approx((1e5 * np.exp(-G * np.array([-200.0, 100, 500]) / (R * 280))).tolist()) and got[2].p == pytest.approx(p[:4].tolist())
    assert got[1].u == [5.0] * 3 and got[1].rho == pytest.approx((np.array(got[1].p) / (R * 280)).tolist())
    wet = [float(1.4 * saturated(280.0, x)) for x in p]
    water = [(7, h, h[:5], flat, p.tolist(), [0.9 * x for x in wet], [0.0] * 5, [0.0] * 5, [0.1 * x for x in wet], [1e-5] * 5)]
    r = C.reconstruct(column(spark, water), "k", ["cloud", "rain"]).first()
    full = [saturated(280.0, x) for x in r.p]
    assert r.qv == pytest.approx(full) and r.cloud == pytest.approx([0.4 * x for x in full]) and r.rain == pytest.approx([1e-5] * 4)
    tv = 280 * (1 + 0.608 * np.array(r.qv) - np.array(r.cloud) - 1e-5)
    assert np.diff(np.log(r.p)) == pytest.approx(-G * 200 / (R * 0.5 * (tv[1:] + tv[:-1])), rel=1e-6)


def test_columns_that_cannot_be_done(spark):
    h = [0.0, 200.0, 400.0, 600.0]
    good = dict(hhl=h, own=[0.0, 100.0, 300.0], t=[280.0, 279.0, 278.0], p=[99000.0, 97000.0, 95000.0], qv=[0.005] * 3, u=[1.0] * 3, v=[0.0] * 3, cloud=[0.0] * 3, rain=[0.0] * 3)
    changes = {"shape": dict(t=[280.0, 279.0]), "not_finite": dict(u=[1.0, float("nan"), 2.0]), "not_ascending": dict(hhl=[0.0, 200.0, 200.0, 600.0]), "out_of_range": dict(rain=[0.0, -1e-9, 0.0]), "above_top": dict(own=[0.0, 500.0, 900.0]), "buried": dict(own=[350.0, 400.0, 450.0]), "no_anchor": dict(own=[-300.0, -200.0, -100.0])}
    rows = [(k, *(good | c).values()) for k, c in enumerate([{}, *changes.values(), dict(p=None), dict(t=[280.0, None, 278.0])])]
    got = {r.k: (r.violation, r.t is None) for r in C.reconstruct(column(spark, rows), "k", ["cloud", "rain"]).collect()}
    assert got == {0: (None, False), **{k: (v, True) for k, v in enumerate(changes, 1)}, 8: ("shape", True), 9: ("not_finite", True)}
    flat = C.by_level(C.reconstruct(column(spark, rows[:2]), "k", ["cloud", "rain"]), ["k", "violation"], "t", "p").collect()
    assert sorted((r.k, r.level is None) for r in flat) == [(0, False), (0, False), (1, True)]


def test_arrays_by_weights_and_interfaces(spark):
    weights = spark.createDataFrame([(1, 1, 10, 1.5), (1, 2, 11, -0.5), (2, 1, 10, 0.5), (2, 2, 11, 0.5), (3, 1, 10, None)], "target long, rank int, donor long, weight double")
    columns = spark.createDataFrame([(10, [1.0, 5.0]), (11, [3.0, 1.0])], "donor long, x array<double>")
    got = {r.target: r.x for r in C.regrid_arrays(weights, columns, ["x"]).collect()}
    assert got == {1: [1.0, 5.0], 2: [2.0, 3.0], 3: [None, None]}  # the first would be 0 and 7: held in range
    row = spark.range(1).select(C.interfaces_from(F.lit(100.0), F.lit(300.0), F.array(F.lit(10.0), F.lit(45.0), F.lit(45.0)), 40.0).alias("h"), C.interfaces_from(F.lit(0.0), F.lit(90.0), F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)), 20.0).alias("even")).first()
    assert row.h == pytest.approx([100.0, 140.0, 220.0, 300.0]) and row.even == pytest.approx([0.0, 30.0, 60.0, 90.0])
    at = spark.createDataFrame([([0.0, 10.0, 20.0], [1.0, 2.0, 4.0], [-5.0, 5.0, 10.0, 15.0, 99.0])], "z array<double>, v array<double>, to array<double>").select(C.on_heights("v", "z", "to").alias("r")).first()
    assert at.r == pytest.approx([1.0, 1.5, 2.0, 3.0, 4.0])


def test_the_whole_transform_against_its_stages_in_loops(spark):
    """Weights, interfaces, columns and slope winds again for every target, one by one, with a whole raster in memory."""
    weights = {}
    for r in q_surface.inverse_distance(spark, SF).collect():
        weights.setdefault(r.target, []).append((r["rank"], r.donor, r.weight))
    donors = {r.donor: r.asDict() for r in q_columns.donor_columns(spark, SF).collect()}
    targets = {r.target: r for r in q_columns.target_columns(spark, SF).collect()}
    got = {}
    for r in QUERIES["state_transform"](spark, SF).collect():
        got.setdefault(r.target, []).append(r)
    assert set(got) == set(targets)
    species, states, cube = q_columns.SPECIES, {}, {}
    ys, xs = max(t.y for t in targets.values()) + 1, max(t.x for t in targets.values()) + 1
    hhl, w_in, u, v = (np.full((ys, xs, n), np.nan) for n in (8, 8, 7, 7))
    for k, t in targets.items():
        some = [(w, donors[d]) for _, d, w in sorted(weights[k])]
        mean = lambda f: np.clip(sum(w * np.array(f(d)) for w, d in some), np.min([f(d) for _, d in some], axis=0), np.max([f(d) for _, d in some], axis=0))  # noqa: B023, E731
        thick, ends = mean(lambda d: np.diff(d["hhl"])), mean(lambda d: [d["hhl"][0], d["hhl"][-1]])
        thick = thick * (ends[1] - ends[0]) / thick.sum()
        assert thick.min() > 20
        source = np.concatenate([[ends[0]], ends[0] + np.cumsum(thick)])
        states[k] = plain_column(source, np.array(t.own_hhl), {n: mean(lambda d, n=n: d[n]) for n in ("t", "p", "qv", "u", "v")}, {n: mean(lambda d, n=n: d[n]) for n in species})
        assert not isinstance(states[k], str)
        hhl[t.y, t.x], w_in[t.y, t.x] = t.own_hhl, np.interp(t.own_hhl, source, mean(lambda d: d["w"]))
        u[t.y, t.x], v[t.y, t.x] = states[k]["u"], states[k]["v"]
    cube = tiles.slope_wind(hhl, w_in, u, v, 200.0, 200.0)
    whole = 0
    for k, t in targets.items():
        rows = sorted(got[k], key=lambda r: r.level)
        for name, x in states[k].items():
            assert [r[name] for r in rows] == pytest.approx(np.round(x, 6).tolist(), rel=1e-7, abs=2e-6), name
        if np.isfinite(cube[t.y, t.x]).all():
            whole += 1
            assert [r.w for r in rows] == pytest.approx(cube[t.y, t.x].tolist(), abs=2e-6)
    assert whole > 0.9 * len(targets)


@pytest.mark.parametrize("side", [8, 64])
@pytest.mark.parametrize("half", [1, 7])
def test_medians_by_tiles(spark, side, half):
    """Holes, repeated values and several tiles."""
    rng = np.random.default_rng(half)
    values = rng.integers(0, 40, (30, 21)).astype(float)
    values[rng.random(values.shape) < 0.2] = np.nan
    rows = [(y, x, None if np.isnan(values[y, x]) else float(values[y, x])) for y in range(30) for x in range(21) if (y, x) != (4, 4)]
    values[4, 4] = np.nan
    cells = spark.createDataFrame(rows, "y int, x int, v double").withColumn("tile_y", F.lit("a"))
    got = {(r.y, r.x): r["median"] for r in raster.box_median(cells, "v", half, side=side).collect()}
    assert len(got) == len(rows)
    for (y, x), m in got.items():
        box = values[max(0, y - half) : y + half + 1, max(0, x - half) : x + half + 1]
        want = np.nanmedian(box) if np.isfinite(box).any() else None
        assert m == want


def test_a_wide_raster_keeps_its_components_apart(spark):
    """Columns beyond any fixed width: the last cell of a row isn't next to the first of the next."""
    wide = (1 << 20) + 5
    cells = spark.createDataFrame([(0, wide - 1), (1, 0), (1, 1), (0, 0)], "y int, x int").withColumn("m", F.lit(True))
    got = {(r.y, r.x): r.label for r in raster.label_components(cells, F.col("m")).collect()}
    assert got == {(0, 0): 1, (1, 0): 1, (1, 1): 1, (0, wide - 1): 2}
