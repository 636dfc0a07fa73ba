"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.session import drop, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: link every larger (or smaller) neighbour of a node to the smallest node of its neighbourhood.

    The smallest neighbour is an aggregate with partial minima, and goes back by an equi-join that adaptive execution can split,
    so no neighbourhood is ever gathered in one place.
    """
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = edges.unionAll(back) if large else edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    joined = both.join(least, "src")
    if large:
        out = joined.where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    else:
        out = joined.where("dst != m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionAll(least.select("src", F.col("m").alias("dst")))
    return out.where("src != dst").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (src, dst), undirected; component is the smallest node reachable.

    Large-star and small-star steps alternate until nothing changes; each round is written to the shared folder.
    Nodes without an edge are not returned. Null ends and loops are dropped. Rounds grow with the logarithm of the longest
    chain; if ``most_rounds`` don't do, that is an error, never a table of half-made components.
    """
    now = edges.where("src is not null and dst is not null and src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    now = materialize(now, "components")
    seen = None
    for _ in range(most_rounds + 1):
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst")), F.sum(F.pmod(F.xxhash64("dst", "src"), F.lit(1 << 30)))).first())
        if state == seen or not state[0]:
            break
        seen, last = state, now
        now = materialize(_star(_star(last, True), False), "components")
        drop(last)
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    children = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return children.unionAll(roots)
