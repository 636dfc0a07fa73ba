"""Joins of tables that grow with the input move both sides, whatever Spark takes their sizes for; what is made on the way doesn't go through the driver."""

import re

import numpy as np
import pytest

import __spark_entry__ as entry
from skillgrid.operators.nearest import Tree
from skillgrid.sources import clustered

SF = "/root/testdata/sf0.01"


def broadcasts(df) -> list[str]:
    """Joins by cells, sites or targets that broadcast a side, as planned and as run; those of a few records or classes may."""
    first = df._jdf.queryExecution().executedPlan().toString()
    df.collect()
    return re.findall(r"BroadcastHashJoin \[_?(?:y|site|target)#.*", first + df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", ["best_cell", "footprint_spread", "forcing_contract", "forcing_verdict", "forcing_record_report", "surface_state", "surface_water", "state_transform"])
def test_no_table_is_broadcast(spark, name):
    assert broadcasts(entry.queries()[name](spark, SF)) == []


def test_footprints_are_shuffled_by_site_once(spark):
    """Errors at times and of cells come from rows of a site that are in one place: nothing is exchanged but by the footprint's cell, then by site."""
    plan = entry.queries()["footprint_stats"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    keys = set(re.findall(r"hashpartitioning\((.*?), \d+\)", plan))
    assert {re.sub(r"#\d+L?", "", k) for k in keys} == {"y, x", "site"}


def test_leaves_are_even_where_most_points_share_a_value():
    """Along an axis where more than half have the smallest value, that half is cut off; it doesn't stay whole to the last halving."""
    rng = np.random.default_rng(1)
    points = np.column_stack([rng.random((64_000, 2)), np.where(rng.random(64_000) < 0.7, 0.0, 16.0)])
    tree = Tree(points, 6)
    rows = np.bincount(tree.leaf(points), minlength=64)
    assert rows.min() > 0 and rows.max() < 4 * len(points) / 64


def test_points_in_many_rows_of_tiles(spark, tmp_path):
    """Points in three thousand rows of tiles, each with columns of its own, are one test of the reader that isn't as deep."""
    points = spark.range(3000).selectExpr("id AS site", "cast(id AS int) AS y", "cast(id * 7 % 2000 AS int) AS x")
    cells = points.where("y < 40").selectExpr("timestamp'2024-01-01 00:00:00' AS valid", "y", "x", "cast(y AS double) AS v")
    clustered.write(cells, f"{tmp_path}/p", 1)
    assert clustered.at_points(spark, f"{tmp_path}/p", points, "v", side=1).count() == 40
