"""Nearest neighbours and kernel weights against all pairs and plain loops, over clustered points and whole tables."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skillgrid.operators import nearest, regrid, spatial
from skillgrid.plans.registry import QUERIES, load

load()
SF = "/root/testdata/sf0.01"


def unit(lat, lon):
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=-1)


def km_between(a, b):
    return 2 * 6371.0 * np.arcsin(np.minimum(np.linalg.norm(a[:, None] - b[None], axis=2) / 2, 1.0))


@pytest.fixture
def clustered():
    """A third of all points in one place, a dense and a thin cloud; targets in the clouds, between and ten degrees off them."""
    rng = np.random.default_rng(8)
    points = np.concatenate([np.tile([46.5, 7.5], (60, 1)), rng.normal([46.2, 7.1], 0.001, (70, 2)), rng.normal([46, 8], 0.5, (50, 2))])
    targets = np.concatenate([rng.normal([46.2, 7.1], 0.002, (30, 2)), rng.normal([46, 8], 0.7, (30, 2)), [[46.5, 7.5], [56, 7], [46, -170]]])
    return targets, points


@pytest.mark.parametrize("leaf_rows, group_rows, k", [(1000, 4000, 5), (8, 4000, 5), (8, 11, 7), (4, 3, 1)])
def test_k_nearest_against_all_pairs(spark, clustered, monkeypatch, leaf_rows, group_rows, k):
    monkeypatch.setattr(nearest, "LEAF_ROWS", leaf_rows)
    monkeypatch.setattr(nearest, "GROUP_ROWS", group_rows)
    targets, points = clustered
    t = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(targets)] + [(900, None, 7.0), (901, float("nan"), 7.0)], "target long, lat double, lon double")
    d = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)] + [(999, 46.2, None)], "donor long, lat double, lon double")
    got = {}
    for r in spatial.k_nearest(t, d, k).collect():
        got.setdefault(r.target, []).append((r["rank"], r.donor))
    km = km_between(unit(*targets.T), unit(*points.T))
    want = {i: [(n, int(j)) for n, j in enumerate(np.lexsort((np.arange(len(points)), np.round(row, 9)))[:k], 1)] for i, row in enumerate(km)}
    lost = {900: [(1, None)], 901: [(1, None)]}  # a row with nulls: a violation
    assert {i: sorted(x) for i, x in got.items()} == want | lost


def test_leaves_are_even_and_far_targets_go_to_few(clustered):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(0, 1e-4, (4000, 2)), rng.normal(0, 1, (4000, 2))])
    tree = nearest.Tree(points, 5)
    leaf = tree.leaf(points)
    assert np.bincount(leaf, minlength=32).max() < 2 * len(points) / 32
    used = np.unique(leaf)
    tree.bound_by(used, *[np.array([f(points[leaf == n], axis=0) for n in used]) for f in (np.min, np.max)])
    far = np.array([[50.0, 3.0], [0.0, 0.0]])
    one = np.ones_like(far)
    visits = np.bincount(tree.touched(far, one, tree.reach(far, one, 3))[0])
    assert visits[0] <= 8 and visits[1] <= 12


def test_nearest_cells_are_planar_and_whole(spark, clustered, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF_ROWS", 8)
    targets, points = clustered
    sites = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(targets)] + [(99, None, None)], "site long, lat double, lon double").withColumn("leaf", F.lit(1)).withColumn("at0", F.lit(1))
    cells = spark.createDataFrame([(i // 7, i % 7, *map(float, p)) for i, p in enumerate(points)], "y int, x int, lat double, lon double")
    got = {r.site: (r.y, r.x) for r in spatial.nearest_cell(sites, cells, ["site"]).collect()}
    for i, (lat, lon) in enumerate(targets):
        km = np.hypot((points[:, 0] - lat) * 110.57, (points[:, 1] - lon) * 111.32 * np.cos(np.radians(lat)))
        assert km[got[i][0] * 7 + got[i][1]] == pytest.approx(km.min(), abs=1e-9)
    assert got[99] == (None, None) and len(got) == len(targets) + 1


def test_without_points_all_rows_stay(spark):
    t = spark.createDataFrame([(1, 46.0, 7.0)], "target long, lat double, lon double")
    d = spark.createDataFrame([], "donor long, lat double, lon double")
    assert [tuple(r)[:3] for r in spatial.k_nearest(t, d, 3).collect()] == [(1, 1, None)]
    some = d.union(spark.createDataFrame([(5, 46.0, 7.1)], d.schema))
    assert [tuple(r)[:3] for r in spatial.k_nearest(t, some, 3).collect()] == [(1, 1, 5)]
    weights = regrid.rbf_weights(t, some, 3, 0.002, strict=False).collect()
    assert [(r.target, r.donor, r.weight) for r in weights] == [(1, 5, None)]


# ---- kernels: plain loops over the whole table --------------------------------------------------


def solved(matrix, right):
    for nugget in (0.0, 1e-14, 1e-12, 1e-10, 1e-8, 1e-7, 1e-6):
        m = matrix + nugget * np.eye(len(matrix))
        if np.linalg.cond(m) <= 1e10:
            return np.linalg.solve(m, right)
    return np.full(np.shape(right), np.nan)


def table():
    con = duckdb.connect()
    grid = np.array(con.execute(f"SELECT 46 + 0.002*(p_partkey // 50), 7 + 0.003*(p_partkey % 50), p_retailprice, p_size, p_partkey // 50 * 50 + p_partkey % 50 FROM '{SF}/part.parquet' ORDER BY 5").fetchall(), dtype=float)
    own = np.array(con.execute(f"SELECT 46.0011 + 0.002*(p_partkey // 50), 7.0013 + 0.003*(p_partkey % 50), p_partkey FROM '{SF}/part.parquet' ORDER BY 3").fetchall(), dtype=float)
    cells = unit(grid[:, 0], grid[:, 1])
    near = np.sort(km_between(cells, cells), axis=1)[:, 1]
    km = km_between(unit(own[:, 0], own[:, 1]), cells)
    order = np.argsort(np.round(km, 9) * 1e12 + np.arange(len(grid)) * 1e-3, axis=1)
    return grid, own, cells, float(np.median(near)), km, order


def test_weights_of_the_whole_table(spark):
    grid, own, cells, spacing, km, order = table()
    scale = 0.05 * spacing / 13.0
    got = {}
    for r in QUERIES["udf_kernel_solve"](spark, SF).collect():
        got.setdefault(r.target, {})[r.donor] = r.weight
    for row, (lat, lon, target) in enumerate(own):
        pick = order[row][:10]
        arcs = km_between(cells[pick], cells[pick]) / 6371.0
        w = solved(np.exp(-((arcs / scale) ** 2)), np.exp(-((km[row][pick] / 6371.0 / scale) ** 2)))
        w = w / w.sum()
        sound = km[row][pick[0]] <= 3 * spacing and np.abs(w).sum() <= 10
        mine = got[int(target)]
        assert len(mine) == 10
        if sound:
            assert [mine[int(grid[j, 4])] for j in pick] == pytest.approx(w.tolist(), abs=2e-6)
        else:
            assert set(mine.values()) == {None}


def test_winds_of_the_whole_table(spark):
    """The vector kernel by a plain loop; a uniform wind comes back at every target with sound weights, whatever the normals."""
    grid, own, cells, spacing, km, order = table()
    scale = 0.05 * spacing / 13.0
    got = {r.target: r for r in QUERIES["rbf_vector"](spark, SF).collect()}
    a, b = np.radians(grid[:, 0]), np.radians(grid[:, 1])
    by_east = np.stack([-np.sin(b), np.cos(b), 0 * b], axis=-1)
    by_north = np.stack([-np.sin(a) * np.cos(b), -np.sin(a) * np.sin(b), np.cos(a)], axis=-1)
    ne, nn = np.cos(np.radians(grid[:, 3] * 7.0)), np.sin(np.radians(grid[:, 3] * 7.0))
    normal = ne[:, None] * by_east + nn[:, None] * by_north
    given = {"u": grid[:, 2] / 100, "u_uniform": 3 * ne + 7 * nn}
    off = []
    for row, (lat, lon, target) in enumerate(own):
        pick, r = order[row][:9], got[int(target)]
        if km[row][pick[0]] > 3 * spacing:
            assert r.u is None and r.v is None
            continue
        arcs = km_between(cells[pick], cells[pick]) / 6371.0
        left = normal[pick] @ normal[pick].T * np.exp(-((arcs / scale) ** 2))
        near = np.exp(-((km[row][pick] / 6371.0 / scale) ** 2))
        la, lo = np.radians(lat), np.radians(lon)
        for k, (component, onto) in enumerate((("u", np.array([-np.sin(lo), np.cos(lo), 0])), ("v", np.array([-np.sin(la) * np.cos(lo), -np.sin(la) * np.sin(lo), np.cos(la)])))):
            w = solved(left, near * (normal[pick] @ onto))
            w = w / np.sum(w * (normal[pick] @ onto))
            assert r[component] == pytest.approx(float(w @ given["u"][pick]), rel=1e-5, abs=1e-5)
            off.append(abs(r[f"{component}_uniform"] - (3, 7)[k]))
    assert np.median(off) < 0.05


def test_uniform_wind_over_random_normals():
    rng = np.random.default_rng(0)
    n, k = 300, 9
    lat, lon = 46 + rng.random(n) * 0.1, 7 + rng.random(n) * 0.1
    around = lambda x, s: x[:, None] + rng.normal(0, s, (n, k))
    dlat, dlon, turn = around(lat, 0.002), around(lon, 0.003), rng.uniform(0, 2 * np.pi, (n, k))
    east, north = regrid.tangents(dlat, dlon)
    normals = np.cos(turn)[..., None] * east + np.sin(turn)[..., None] * north
    t_east, t_north = regrid.tangents(lat, lon)
    w_east, w_north, took = regrid.vector_kernel_weights(unit(lat, lon), t_east, t_north, unit(dlat, dlon), normals, regrid.kernel_scale(13.0))
    blow = 0 * np.cos(turn) + 10 * np.sin(turn)  # 10 m/s from the south
    u, v = (w_east * blow).sum(axis=1), (w_north * blow).sum(axis=1)
    error = np.hypot(u, v - 10)
    assert np.isfinite(took).all() and np.median(error) < 0.05
