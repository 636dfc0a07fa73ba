"""Mosaics, zonal means and shares, and filled gaps, by hand."""

import pytest

from skillgrid.operators import zonal


def test_mosaic_takes_the_first_tile_with_a_value(spark):
    tiles = spark.createDataFrame([(0, 0, 0, None), (1, 0, 0, 2.0), (2, 0, 0, 3.0), (1, 0, 1, 5.0), (0, 0, 1, 4.0), (0, 0, 2, None)], "tile int, y int, x int, v double")
    assert {(r.y, r.x): r.v for r in zonal.mosaic(tiles, "v").collect()} == {(0, 0): 2.0, (0, 1): 4.0, (0, 2): None}


def test_means_and_shares_by_area(spark):
    """Pixels of 30 m over cells of 40 m: the second pixel lies a third in the first cell."""
    pixels = spark.createDataFrame([(0, 0, 1.0, 7), (0, 1, 4.0, 9), (0, 2, None, None)], "y int, x int, v double, k int")
    over = zonal.over_cells(pixels, 30.0, 40.0)
    assert {(r.x, r.cell_x): r.area for r in over.collect()} == {(0, 0): 900.0, (1, 0): 300.0, (1, 1): 600.0, (2, 1): 600.0, (2, 2): 300.0}
    means = {r.cell_x: r.v for r in zonal.zonal_mean(over, "v").collect()}
    assert means == {0: pytest.approx((900 + 4 * 300) / 1200), 1: 4.0, 2: None}
    shares = {(r.cell_x, r.k): r.share for r in zonal.zonal_shares(over, "k").collect()}
    assert shares == {(0, 7): 0.75, (0, 9): 0.25, (1, 9): 1.0}
    best = spark.createDataFrame([(0, 0, 16, 0.5), (0, 0, 3, 0.5), (0, 1, 16, 0.6), (0, 1, 3, 0.4)], "cell_y int, cell_x int, k int, share double")
    assert {r.cell_x: (r.k, r.share, r.land) for r in zonal.dominant(best, "k").collect()} == {0: (3, 0.5, True), 1: (16, 0.6, False)}


def test_pixels_before_the_origin(spark):
    over = zonal.over_cells(spark.createDataFrame([(0, 0)], "y int, x int"), 10.0, 10.0, (-5.0, 0.0)).collect()
    assert {(r.cell_y, r.cell_x, r.area) for r in over} == {(-1, 0, 50.0), (0, 0, 50.0)}


def test_gaps_are_filled_from_the_nearest(spark):
    cells = spark.createDataFrame([(0, 0, 1.0, 1.0), (0, 4, 2.0, 2.0), (0, 2, None, 9.0), (0, 3, None, None), (5, 5, None, 1.0)], "cell_y int, cell_x int, a double, b double")
    got = {(r.cell_y, r.cell_x): (r.a, r.b, r.gap_cells) for r in zonal.filled(cells, "a", "b").collect()}
    assert got == {(0, 0): (1.0, 1.0, 0.0), (0, 4): (2.0, 2.0, 0.0), (0, 2): (1.0, 1.0, 2.0), (0, 3): (2.0, 2.0, 1.0), (5, 5): (2.0, 2.0, pytest.approx(26**0.5))}
    none = zonal.filled(cells.where("a is null"), "a", "b").collect()
    assert len(none) == 3 and all(r.a is None for r in none)
