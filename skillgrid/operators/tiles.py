"""Rasters as square tiles with a border of their neighbours' cells, for kernels that need a neighbourhood: a task holds tiles, never a row or column of the raster."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.session import fresh

#: Cells along a tile's side.
SIDE = 128


class Tile:
    """The cells of a tile and its border: where each row stands, and which rows are the tile's own."""

    def __init__(self, y: np.ndarray, x: np.ndarray, ty: int, tx: int, side: int):
        self.y0, self.x0 = int(y.min()), int(x.min())
        self.at = (y - self.y0, x - self.x0)
        self.shape = (int(y.max()) - self.y0 + 1, int(x.max()) - self.x0 + 1)
        self.own = (y // side == ty) & (x // side == tx)

    def dense(self, values: np.ndarray, fill=np.nan) -> np.ndarray:
        """Values of rows as an array over the tile; further axes stay behind."""
        out = np.full((*self.shape, *values.shape[1:]), fill, values.dtype)
        out[self.at] = values
        return out

    def rows(self, dense: np.ndarray) -> np.ndarray:
        """Back to the tile's own rows."""
        return dense[self.at][self.own]


def over_tiles(cells: DataFrame, halo: int, run: Callable[[Tile, pa.Table], dict[str, pa.Array]], schema: str, side: int = SIDE) -> DataFrame:
    """``cells`` (y, x, ...) with the columns that ``run`` makes for the rows of each tile, from those of the tile and of ``halo`` cells around it.

    A cell is copied to the tiles whose border it lies in, which is one copy and (2 halo / side) more on average; one shuffle by tile.
    """
    if halo > side:
        raise ValueError("a border is no wider than a tile")
    ty, tx = fresh("tile_y", cells.columns), fresh("tile_x", cells.columns)
    near = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + s) / side).cast("int") for s in (-halo, 0, halo)]))
    dealt = cells.withColumn(ty, F.explode(near("y"))).withColumn(tx, F.explode(near("x")))
    names = cells.columns

    def one(key: tuple, table: pa.Table) -> pa.Table:
        tile = Tile(table["y"].to_numpy(), table["x"].to_numpy(), key[0].as_py(), key[1].as_py(), side)
        own = table.select(names).filter(pa.array(tile.own))
        made = run(tile, table) if own.num_rows else {}
        if not own.num_rows:
            return own_schema.empty_table()
        return pa.Table.from_arrays([*own.columns, *made.values()], names=[*names, *made])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = StructType([*cells.schema.fields, *StructType.fromDDL(schema).fields])
    own_schema = to_arrow_schema(full)
    return dealt.groupBy(ty, tx).applyInArrow(one, full)


def box_medians(values: np.ndarray, half: int) -> np.ndarray:
    """Median of the values that are there (not NaN) in the square around every cell.

    A histogram of value ranks for every row slides along x: at each step a column of each row's box goes out and one comes in, and the middle is found in two steps, by hundreds of
    ranks and then within one of those. Time is linear in cells times the box's side.
    """
    ny, nx = values.shape
    there = ~np.isnan(values)
    if not there.any():
        return np.full(values.shape, np.nan)
    levels, code = np.unique(values[there], return_inverse=True)
    width = max(1, int(np.ceil(np.sqrt(len(levels)))))
    ranks = np.full(values.shape, -1)
    ranks[there] = code
    padded = np.full((ny + 2 * half, nx), -1)
    padded[half : half + ny] = ranks
    fine, coarse = np.zeros((ny, width * width), np.int32), np.zeros((ny, width), np.int32)
    total, out = np.zeros(ny, np.int64), np.full(values.shape, np.nan)
    rows = np.arange(ny)
    window = np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1, axis=0)  # (ny, nx, box)

    def change(x: int, by: int) -> None:
        column = window[:, x]
        of, k = np.nonzero(column >= 0)
        rank = column[of, k]
        np.add.at(fine, (of, rank), by)
        np.add.at(coarse, (of, rank // width), by)
        np.add.at(total, of, by)

    def at_place(place: np.ndarray) -> np.ndarray:
        sums = np.cumsum(coarse, axis=1)
        block = np.minimum((sums <= place[:, None]).sum(axis=1), width - 1)
        left = place - np.where(block > 0, sums[rows, block - 1], 0)
        within = np.cumsum(fine[rows[:, None], block[:, None] * width + np.arange(width)], axis=1)
        return np.minimum(block * width + (within <= left[:, None]).sum(axis=1), len(levels) - 1)

    for x in range(min(half, nx)):
        change(x, 1)
    for x in range(nx):
        if x + half < nx:
            change(x + half, 1)
        if x - half - 1 >= 0:
            change(x - half - 1, -1)
        low, high = at_place(np.maximum(total - 1, 0) // 2), at_place(total // 2)
        out[:, x] = np.where(total > 0, (levels[low] + levels[np.where(total > 0, high, 0)]) / 2, np.nan)
    return out


def slope_wind(hhl: np.ndarray, w: np.ndarray, u: np.ndarray, v: np.ndarray, dx: float, dy: float, transition: float = 4000.0) -> np.ndarray:
    """Vertical wind at mass levels over (y, x, interface) heights, in one go: gradients of the interfaces, winds between mass levels, the blend into the given ``w`` over
    ``transition`` metres, the surface and the quiet top, and the mean at mass levels."""

    def slope(axis: int, step: float) -> np.ndarray:
        n = hhl.shape[axis]
        if n < 2:
            return np.full(hhl.shape, np.nan)
        return np.gradient(hhl, step, axis=axis, edge_order=2 if n > 2 else 1)

    middle = (hhl[..., 1:] + hhl[..., :-1]) / 2
    part = (hhl[..., 1:-1] - middle[..., :-1]) / (middle[..., 1:] - middle[..., :-1])
    between = lambda c: np.concatenate([c[..., :1], c[..., :-1] + part * (c[..., 1:] - c[..., :-1]), c[..., -1:]], axis=-1)
    terrain = between(u) * slope(1, dx) + between(v) * slope(0, dy)
    above = np.minimum(hhl - hhl[..., :1], transition)
    c = 3 * transition
    given = (9 * c * c * above + 27 * above**3) / (c**3 + 27 * c * above**2)
    out = given * w + (1 - given) * terrain
    for k, factor in zip((-1, -2, -3), (0.0, 0.33, 0.66)):
        if out.shape[-1] > -k:
            out[..., k] *= factor
    return (out[..., 1:] + out[..., :-1]) / 2


def fused_slope_wind(cells: DataFrame, dx: float, dy: float, transition: float = 4000.0, side: int = SIDE) -> DataFrame:
    """``cells`` (y, x, hhl, w, u, v: arrays from the ground up) with ``w_mass``, by one kernel over tiles with two cells around them. A cell without a neighbour along an axis has nulls."""

    def run(tile: Tile, table: pa.Table) -> dict[str, pa.Array]:
        levels = len(table["hhl"][0])
        cube = lambda c, n: tile.dense(table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n))
        made = tile.rows(slope_wind(cube("hhl", levels), cube("w", levels), cube("u", levels - 1), cube("v", levels - 1), dx, dy, transition))
        flat = pa.array(made.ravel(), from_pandas=True)
        return {"w_mass": pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, levels - 1), pa.int32()), flat)}

    return over_tiles(cells, 2, run, "w_mass array<double>", side)
