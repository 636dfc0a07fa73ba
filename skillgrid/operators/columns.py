"""Vertical profiles: one row a column with arrays, batches of columns in NumPy; or rows with windows where sums suffice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillgrid.functions.physics import EPSILON, GRAVITY, R_DRY, blend
from skillgrid.operators.raster import second_order
from skillgrid.operators.tiles import fused_slope_wind
from skillgrid.session import materialize, shuffled


def as_arrays(rows: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """One row for each column, its values as arrays in order."""
    s = F.array_sort(F.collect_list(F.struct(order, *values)))
    return rows.groupBy(key).agg(s.alias("_p")).select(key, *[F.col(f"_p.{v}").alias(v) for v in values])


def interpolate_one(z: np.ndarray, v: np.ndarray, at: np.ndarray, slope_limit: float, extrapolate: bool) -> np.ndarray:
    """Linear between levels; below the lowest with the first slope, held within the limit, and all within the source's range; nan above the top."""
    out = np.interp(at, z, v)
    if extrapolate and len(z) > 1:
        slope = np.clip((v[1] - v[0]) / (z[1] - z[0]), -slope_limit, slope_limit)
        low = at < z[0]
        out[low] = v[0] + slope * (at[low] - z[0])
        out = np.clip(out, v.min(), v.max())
    out[at > z[-1]] = np.nan
    return out


def interpolate_profiles(columns: DataFrame, key: str, z: str, value: str, at: list[float], slope_limit: float = 1.0, extrapolate: bool = True) -> DataFrame:
    """(key, target_z, value) of every column at fixed heights; null above its top."""
    target = np.array(at)

    def run(batches):
        for b in batches:
            keys = np.repeat(b.column(0).to_numpy(), len(target))
            out = [interpolate_one(np.array(x.as_py()), np.array(y.as_py()), target, slope_limit, extrapolate) for x, y in zip(b.column(1), b.column(2))]
            flat = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(target, len(out))), pa.array(flat, from_pandas=True)], [key, "target_z", value])

    kind = columns.schema[key].dataType.simpleString()
    return columns.select(key, z, value).mapInArrow(run, f"{key} {kind}, target_z double, {value} double")


def hydrostatic(rows: DataFrame, key: str, level: str, z: str, tv: str, p0: Column) -> DataFrame:
    """Pressure from the lowest level up: log p is a running sum of layer thickness over mean virtual temperature."""
    w = Window.partitionBy(key).orderBy(level)
    mean = (F.col(tv) + F.lag(tv).over(w)) / 2
    step = F.coalesce(-GRAVITY * (F.col(z) - F.lag(z).over(w)) / (R_DRY * mean), F.lit(0.0))
    return rows.withColumn("_s", step).withColumn("pressure", p0 * F.exp(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def saturation(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Specific humidity of saturated air over water."""
    tc = t - 273.15
    e = np.minimum(610.94 * np.exp(17.625 * tc / (tc + 243.04)), 0.99 * p)
    return EPSILON * e / np.maximum(p - (1 - EPSILON) * e, 1.0)


def quiet_top(n: int) -> list[float]:
    """Factors of vertical wind at n interfaces: none at the top, 0.33 and 0.66 below it."""
    return [1.0] * max(0, n - 3) + [0.66, 0.33, 0.0][max(0, 3 - n) :]


def slope_wind(levels: DataFrame, dx: float, dy: float, transition: float = 4000.0) -> DataFrame:
    """(y, x, k, w, w_mass) of interfaces (y, x, k, hhl, given, u, v), k from 0 at the ground; u and v of the layer over each interface, null over the top.

    The wind along the slope of each interface, with winds between mass levels, fades into the given vertical wind over ``transition`` metres; the top three are quiet. ``w_mass`` is the mean of the
    layer over an interface. Windows run along rows and columns of one level and up single columns.
    """
    up = Window.partitionBy("y", "x").orderBy("k")
    column = Window.partitionBy("y", "x")

    def slope(axis: str, step: float) -> Column:
        return second_order("hhl", Window.partitionBy("y" if axis == "x" else "x", "k").orderBy(axis), step)

    s = levels.withColumns({"_dx": slope("x", dx), "_dy": slope("y", dy), "_z": (F.col("hhl") + F.lead("hhl").over(up)) / 2, "_top": F.max("k").over(column), "_ground": F.min_by("hhl", "k").over(column)})
    below = lambda c: F.lag(c).over(up)
    part = (F.col("hhl") - below("_z")) / (F.col("_z") - below("_z"))
    wind = lambda c: F.when(F.col("k") == 0, F.col(c)).when(F.col("k") == F.col("_top"), below(c)).otherwise(below(c) + part * (F.col(c) - below(c)))
    terrain = wind("u") * F.col("_dx") + wind("v") * F.col("_dy")
    b = blend(F.col("hhl") - F.col("_ground"), transition)
    quiet = F.coalesce(*[F.when(F.col("_top") - F.col("k") == n, f) for n, f in enumerate((0.0, 0.33, 0.66))], F.lit(1.0))
    w = s.select("y", "x", "k", ((b * terrain + (1 - b) * F.col("given")) * quiet).alias("w"))
    return w.withColumn("w_mass", (F.col("w") + F.lead("w").over(up)) / 2)


def upward(columns: DataFrame, z: str, *values: str) -> DataFrame:
    """Columns with ``z`` and ``values`` from the bottom up, and the ``direction`` they came in: up, down, mixed or single."""
    steps = F.transform(F.sequence(F.lit(1), F.size(z) - 1), lambda i: F.element_at(z, i + 1) - F.element_at(z, i))
    c = columns.withColumn("_dz", F.when(F.size(z) > 1, steps))
    c = c.withColumn("direction", F.when(F.col("_dz").isNull(), "single").when(F.forall("_dz", lambda x: x > 0), "up").when(F.forall("_dz", lambda x: x < 0), "down").otherwise("mixed")).drop("_dz")
    return c.withColumns({v: F.when(F.col("direction") == "down", F.reverse(v)).otherwise(F.col(v)) for v in (z, *values)})


#: Metres that the target's ground lies above or below the source's before the column counts as higher or lower; slack of the top; virtual temperature's share of vapour.
MATCHED, TOP_SLACK, VIRTUAL = 1.0, 1e-6, 0.608
#: Bounds of the slopes with which a profile goes on below its lowest level, by field.
SLOPES = {"t": (-0.012, 0.003), "u": (-0.02, 0.02), "v": (-0.02, 0.02), "logp": (-np.inf, np.inf)}
ROUNDS = 8


class Levels:
    """How mass levels of target columns stand between those of their sources, for columns of one shape; all fields are interpolated alike."""

    def __init__(self, hhl: np.ndarray, own: np.ndarray):
        n = hhl.shape[1] - 1
        self.z, self.to = (hhl[:, 1:] + hhl[:, :-1]) / 2, (own[:, 1:] + own[:, :-1]) / 2
        difference = own[:, 0] - hhl[:, 0]
        self.case = np.where(difference > MATCHED, "higher", np.where(difference < -MATCHED, "lower", "matched"))
        self.start = np.where(self.case == "higher", (self.z <= own[:, :1]).sum(axis=1), 0)  # buried levels lie below it
        first = np.minimum(self.start, max(0, n - 2))[:, None]
        self.upper = np.clip((self.z[:, None, :] <= self.to[:, :, None]).sum(axis=2), first + 1, n - 1)
        at = lambda v, k: np.take_along_axis(v, k, axis=1)
        self.part = (self.to - at(self.z, self.upper - 1)) / (at(self.z, self.upper) - at(self.z, self.upper - 1))
        self.first, self.below = first, self.to < at(self.z, first)
        self.used = np.arange(n) >= self.start[:, None]
        bottom = np.maximum(np.maximum(hhl[:, 0], own[:, 0]), self.z[:, 0])
        overlap = (self.to >= bottom[:, None]) & (self.to <= self.z[:, -1:])
        self.anchor, self.anchored = np.argmax(overlap, axis=1)[:, None], overlap.any(axis=1)
        self.violation = np.where(self.to[:, -1] > self.z[:, -1] + TOP_SLACK, "above_top", np.where(n - self.start < 2, "buried", np.where(self.anchored, "", "no_anchor")))

    def carry(self, v: np.ndarray, slopes: tuple[float, float], least: float | None = None) -> np.ndarray:
        """A field on the target's levels: linear between levels, on below the lowest with a bounded slope, within the range of the levels that aren't buried."""
        at = lambda k: np.take_along_axis(v, k, axis=1)
        low = at(self.upper - 1)
        out = low + self.part * (at(self.upper) - low)
        z0, z1 = (np.take_along_axis(self.z, self.first + j, axis=1) for j in (0, 1))
        slope = np.clip((at(self.first + 1) - at(self.first)) / (z1 - z0), *slopes)
        out = np.where(self.below, at(self.first) + slope * (self.to - z0), out)
        out = np.clip(out, np.where(self.used, v, np.inf).min(axis=1, keepdims=True), np.where(self.used, v, -np.inf).max(axis=1, keepdims=True))
        return out if least is None else np.maximum(out, least)

    def anchor_value(self, v: np.ndarray) -> np.ndarray:
        """A field at the anchor's height, between any two levels of the source."""
        height = np.take_along_axis(self.to, self.anchor, axis=1)
        k = np.clip((self.z <= height).sum(axis=1, keepdims=True), 1, v.shape[1] - 1)
        z0, z1, v0, v1 = (np.take_along_axis(a, k - j, axis=1) for a in (self.z, v) for j in (1, 0))
        return v0 + (height - z0) / (z1 - z0) * (v1 - v0)


def settle(hhl: np.ndarray, own: np.ndarray, field: dict[str, np.ndarray], species: dict[str, np.ndarray], rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Columns of one shape (columns, levels) on their targets' levels: see ``reconstruct``."""
    levels = Levels(hhl, own)
    logp = np.log(field["p"])
    t, u, v = (levels.carry(field[k], SLOPES[k]) for k in ("t", "u", "v"))
    total = field["qv"] + species.get("cloud", 0.0)
    relative = np.maximum(total / np.maximum(saturation(field["t"], field["p"]), 1e-12), 0.0)
    if "cloud" not in species:
        relative = np.minimum(relative, 1.0)
    wet = levels.carry(relative, (0.0, 0.0))
    others = {k: levels.carry(x, (0.0, 0.0), 0.0) for k, x in species.items() if k != "cloud"}
    load = sum(others.values(), np.zeros_like(t))
    p, anchor = np.exp(levels.carry(logp, SLOPES["logp"])), levels.anchor_value(logp)
    todo, change = np.ones((len(t), 1), bool), np.full(len(t), np.inf)
    vapour = cloud = np.zeros_like(t)
    for _ in range(rounds):
        full = saturation(t, p)
        new_vapour = np.minimum(wet, 1.0) * full
        new_cloud = np.maximum(wet - 1.0, 0.0) * full if "cloud" in species else np.zeros_like(full)
        tv = t * (1 + VIRTUAL * new_vapour - new_cloud - load)
        step = GRAVITY * np.diff(levels.to, axis=1) / (R_DRY * (tv[:, 1:] + tv[:, :-1]) / 2)
        fallen = np.concatenate([np.zeros((len(t), 1)), np.cumsum(step, axis=1)], axis=1)
        new = np.exp(anchor - (fallen - np.take_along_axis(fallen, levels.anchor, axis=1)))
        near = (np.abs(new - p) <= 1e-5 + 1e-10 * np.abs(p)).all(axis=1)
        change = np.where(todo[:, 0], np.abs(np.log(new / p)).max(axis=1), change)
        vapour, cloud, p = np.where(todo, new_vapour, vapour), np.where(todo, new_cloud, cloud), np.where(todo, new, p)
        todo = todo & ~near[:, None]
        if not todo.any():
            break
    out = {"z": levels.to, "t": t, "p": p, "qv": vapour, "u": u, "v": v} | ({"cloud": cloud} if "cloud" in species else {}) | others
    out["theta"] = t * (1e5 / p) ** (R_DRY / 1004.5)
    out["rho"] = p / (R_DRY * t * (1 + VIRTUAL * vapour - cloud - load))
    more = {"terrain": levels.case, "anchor_m": np.take_along_axis(levels.to, levels.anchor, axis=1)[:, 0], "below": (levels.to < levels.z[:, :1]).sum(axis=1), "buried": levels.start, "residual": change, "violation": levels.violation}
    return {k: np.where(levels.violation[:, None] == "", x, np.nan) for k, x in out.items()} | more


def reconstruct(columns: DataFrame, key: str, species: list[str] = (), rounds: int = ROUNDS) -> DataFrame:
    """Full columns of a source on the levels of targets with another ground; one row a column, arrays from the ground up.

    columns: key, hhl (interfaces), own_hhl (the target's), t, p, qv, u, v and ``species`` (cloud, rain, ...: shares of the air) between the interfaces. Temperature, winds and
    log pressure are interpolated, below the lowest level with bounded slopes; source levels that a higher target's ground buries are left out. Vapour and cloud go as one generalised
    relative humidity, which is split at saturation once pressure is known; other species go by themselves. Pressure is hydrostatic both ways from an anchor, the lowest level that both
    columns have, over virtual temperatures that carry all condensate; it is settled with the split in at most ``rounds`` rounds.

    Returns key, z, t, p, qv, u, v, species, theta, rho (arrays), terrain (lower, matched or higher), anchor_m, below, buried, residual (the last change of log p) and violation. A column
    that can't be done keeps its row, with nulls and a violation: shape, not_finite, not_ascending, out_of_range, above_top, buried or no_anchor.
    """
    species = list(species)
    inputs = ["hhl", "own_hhl", "t", "p", "qv", "u", "v", *species]
    arrays = ["z", "t", "p", "qv", "u", "v", *[n for n in ("cloud",) if n in species], *[n for n in species if n != "cloud"], "theta", "rho"]
    plain = {"terrain": pa.string(), "anchor_m": pa.float64(), "below": pa.int64(), "buried": pa.int64(), "residual": pa.float64(), "violation": pa.string()}

    def sound(some: dict[str, np.ndarray]) -> np.ndarray:
        finite = np.logical_and.reduce([np.isfinite(x).all(axis=1) for x in some.values()])
        rising = (np.diff(some["hhl"], axis=1) > 0).all(axis=1) & (np.diff(some["own_hhl"], axis=1) > 0).all(axis=1)
        fine = (some["t"] > 100).all(axis=1) & np.logical_and.reduce([(some[n] > 0 if n == "p" else some[n] >= 0).all(axis=1) for n in ("p", "qv", *species)])
        return np.where(~finite, "not_finite", np.where(~rising, "not_ascending", np.where(~fine, "out_of_range", "")))

    def run(batches):
        for b in batches:
            lists = {n: b.column(k + 1) for k, n in enumerate(inputs)}
            size = {n: np.where(x.is_valid().to_numpy(zero_copy_only=False), np.diff(x.offsets.to_numpy()), -1) for n, x in lists.items()}
            n, m = size["hhl"] - 1, size["own_hhl"] - 1
            right = (n >= 2) & (m >= 1) & np.logical_and.reduce([size[k] == n for k in inputs[2:]])
            out = {k: [None] * b.num_rows for k in [*arrays, *plain]}
            out["violation"] = ["" if x else "shape" for x in right]
            for shape in np.unique(np.stack([n, m], axis=1)[right], axis=0):
                rows = np.flatnonzero(right & (n == shape[0]) & (m == shape[1]))
                take = pa.array(rows)
                some = {k: x.take(take).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) for k, x in lists.items()}
                wrong = sound(some)
                good = np.flatnonzero(wrong == "")
                for r, w in zip(rows, wrong):
                    out["violation"][r] = w
                if len(good):
                    some = {k: x[good] for k, x in some.items()}
                    done = settle(some["hhl"], some["own_hhl"], some, {k: some[k] for k in species}, rounds)
                    for k in arrays:
                        for r, x, w in zip(rows[good], done[k], done["violation"]):
                            out[k][r] = x if w == "" else None
                    for k in plain:
                        for r, x in zip(rows[good], done[k].tolist()):
                            out[k][r] = x
            out["violation"] = [w or None for w in out["violation"]]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(out[k], pa.list_(pa.float64())) for k in arrays], *[pa.array(out[k], kind) for k, kind in plain.items()]], [key, *arrays, *plain])

    kind = columns.schema[key].dataType.simpleString()
    names = ", ".join(f"`{n}` array<double>" for n in arrays)
    return columns.select(key, *inputs).mapInArrow(run, f"`{key}` {kind}, {names}, terrain string, anchor_m double, below long, buried long, residual double, violation string")


def by_level(columns: DataFrame, keys: list[str], *arrays: str) -> DataFrame:
    """One row a level, from 0 at the ground; a column without arrays keeps one row."""
    zipped = columns.select(*keys, F.posexplode_outer(F.arrays_zip(*arrays)).alias("level", "_l"))
    return zipped.select(*keys, "level", *[F.col(f"_l.{a}").alias(a) for a in arrays])


def regrid_arrays(weights: DataFrame, columns: DataFrame, names: list[str]) -> DataFrame:
    """(target, names): weighted sums of the donors' arrays, element by element and within the donors' range, in order of rank; levels are never rows of their own.

    A target has as many donors as its stencil, so its arrays meet in one row. Null weights or elements make nulls.
    """
    j = weights.select("target", "rank", "donor", "weight").join(shuffled(columns.select("donor", *names)), "donor")
    g = j.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("rank", "weight", *names))).alias("_s"))

    def summed(name: str) -> Column:
        first = F.get("_s", F.lit(0))[name]
        total = F.aggregate("_s", F.transform(first, lambda x: F.lit(0.0)), lambda a, s: F.zip_with(a, s[name], lambda p, x: p + s["weight"] * x))
        low = F.aggregate("_s", first, lambda a, s: F.zip_with(a, s[name], lambda p, x: F.least(p, x)))
        high = F.aggregate("_s", first, lambda a, s: F.zip_with(a, s[name], lambda p, x: F.greatest(p, x)))
        above = F.zip_with(total, low, lambda x, lo: F.when(x.isNotNull(), F.greatest(x, lo)))
        return F.zip_with(above, high, lambda x, hi: F.when(x.isNotNull(), F.least(x, hi)))

    return g.select("target", *[summed(n).alias(n) for n in names])


def interfaces_from(bottom: Column, top: Column, thickness: Column, least: float) -> Column:
    """Interfaces from the thicknesses of layers, which are scaled to the span; layers under ``least`` are lifted to it at the cost of the others' excess."""
    added = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))
    scaled = F.transform(thickness, lambda x: x * (top - bottom) / added(thickness, lambda y: y))
    need, excess = added(scaled, lambda x: F.greatest(least - x, F.lit(0.0))), added(scaled, lambda x: F.greatest(x - least, F.lit(0.0)))
    lifted = F.transform(scaled, lambda x: F.when(x < least, F.lit(least)).otherwise(x - (x - least) * F.coalesce(F.try_divide(need, excess), F.lit(0.0))))
    return F.aggregate(lifted, F.array(bottom), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def transform_state(weights: DataFrame, donors: DataFrame, targets: DataFrame, species: list[str], dx: float, dy: float, least: float = 20.0, transition: float = 4000.0, side: int = 128) -> DataFrame:
    """The state of source columns on a target raster: regridded by sparse weights, interfaces made whole, columns reconstructed over the target's ground, and their vertical wind brought to its slopes.

    donors: (donor, hhl, t, p, qv, u, v, w (at interfaces), species); targets: (target, y, x, own_hhl). Returns target, y, x and the arrays of ``reconstruct`` with w (at mass levels), terrain and
    violation. Stages are written once each, since rows of targets meet again by tile.
    """
    fields = ["t", "p", "qv", "u", "v", "w", *species]
    donors = donors.repartition("donor")  # by its files a table may be a task or two, whatever its columns cost
    given = donors.select("donor", *fields, F.zip_with(F.slice("hhl", F.lit(2), F.size("hhl") - 1), F.slice("hhl", F.lit(1), F.size("hhl") - 1), lambda a, b: a - b).alias("_thick"), F.array(F.get("hhl", F.lit(0)), F.element_at("hhl", -1)).alias("_ends"))
    come = regrid_arrays(weights, given, [*fields, "_thick", "_ends"])
    come = come.withColumn("hhl", interfaces_from(F.get("_ends", F.lit(0)), F.get("_ends", F.lit(1)), F.col("_thick"), least)).join(shuffled(targets.select("target", "y", "x", "own_hhl")), "target")
    come = materialize(come, "regridded")
    state = materialize(reconstruct(come, "target", species), "columns")
    wind = come.withColumn("w", on_heights("w", "hhl", "own_hhl")).select("target", "y", "x", F.col("own_hhl").alias("hhl"), "w").join(shuffled(state.select("target", "u", "v").where("u is not null")), "target")
    moved = fused_slope_wind(wind, dx, dy, transition, side).select("target", F.col("w_mass").alias("w"))
    return come.select("target", "y", "x").join(shuffled(state), "target").join(shuffled(moved), "target", "left")


def on_heights(values: str, heights: str, at: str) -> Column:
    """Array ``values`` at ``heights`` as an array at other heights: linear, held at both ends."""

    def one(x: Column) -> Column:
        k = F.size(F.filter(heights, lambda h: h <= x))
        (z0, v0), (z1, v1) = ((F.get(heights, k - j), F.get(values, k - j)) for j in (1, 0))
        return F.when(k == 0, v1).when(k == F.size(heights), v0).otherwise(v0 + (x - z0) / (z1 - z0) * (v1 - v0))

    return F.transform(at, one)


def lift_layers(rows: DataFrame, key: str, level: str, thickness: str, least: float, span: str) -> DataFrame:
    """Interfaces from thicknesses: scaled to the span, thin layers lifted to ``least`` at the cost of the others' excess, then summed."""
    w = Window.partitionBy(key)
    scaled = F.col(thickness) * F.col(span) / F.sum(thickness).over(w)
    r = rows.withColumn("_t", scaled)
    need, excess = F.sum(F.greatest(least - F.col("_t"), F.lit(0.0))).over(w), F.sum(F.greatest(F.col("_t") - least, F.lit(0.0))).over(w)
    r = r.withColumn("_u", F.when(F.col("_t") < least, F.lit(least)).otherwise(F.col("_t") - (F.col("_t") - least) * F.try_divide(need, excess)))
    return r.withColumn("interface", F.sum("_u").over(w.orderBy(level).rowsBetween(Window.unboundedPreceding, 0))).drop("_t", "_u")
