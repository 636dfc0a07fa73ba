"""Nearest neighbours in one pass: leaves of equal numbers of points, and only those that a target's ball touches.

1. A bounded sample of the points is halved along its widest axis again and again; the halves' leaves hold about ``LEAF_ROWS`` points each. However
   unevenly points lie, their leaves are even.
2. The sample points next to a target bound how far its k-th neighbour can be. The target goes to every leaf whose points' box reaches into that ball, found by walking
   down the tree, and to no other: so a target far from all points goes to few leaves, and none is visited twice.
3. Leaves and their targets meet by one shuffle on the leaf. A leaf of more than ``GROUP_ROWS`` points (points in one place can't be halved) or
   targets is cut into blocks, and each pair of blocks is one piece of work.

What comes back are pairs that hold every target's k nearest for certain, with all ties and last digits; the caller ranks them by its own distance.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.session import drop, fresh, materialize

#: Points of a leaf, most halvings, sample points for each leaf, rows of one side of a piece of work.
LEAF_ROWS, DEPTH, SAMPLED, GROUP_ROWS = 1000, 14, 64, 4000
#: Distances to sample points that are worked out at once.
REACH_CELLS = 1 << 20
#: Relative width within which distances count as ties.
TIE = 1e-5


class Tree:
    """Halves of a sample, and the boxes of all points of each leaf once they are known. Nodes are numbered from 1, those under n are 2n and 2n + 1."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros(1 << depth, np.int64), np.full(1 << depth, np.inf)
        order, spans = np.arange(len(sample)), {1: (0, len(sample))}
        for node in range(1, 1 << depth):
            a, b = spans.pop(node)
            part, middle = sample[order[a:b]], (b - a) // 2
            if b - a > 1:
                axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                order[a:b] = order[a:b][np.argpartition(part[:, axis], middle)]
                cut, above = sample[order[a + middle], axis], part[:, axis] > part[:, axis].min()
                # more than half may share the smallest value: they are a half of their own
                self.axis[node], self.cut[node] = axis, max(cut, part[above, axis].min()) if above.any() else cut
                middle = int((part[:, axis] < self.cut[node]).sum())
                order[a:b] = order[a:b][np.argsort(sample[order[a:b], axis] >= self.cut[node], kind="stable")]
            spans[2 * node], spans[2 * node + 1] = (a, a + middle), (a + middle, b)
        self.sample = sample[order]
        self.starts = np.array([spans[n][0] for n in range(1 << depth, 2 << depth)] + [len(sample)])

    def leaf(self, at: np.ndarray) -> np.ndarray:
        node = np.ones(len(at), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (at[np.arange(len(at)), self.axis[node]] >= self.cut[node])
        return node - (1 << self.depth)

    def bound_by(self, leaves: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """With the boxes of the leaves that have points."""
        size, width = 2 << self.depth, low.shape[1]
        self.low, self.high = np.full((size, width), np.inf), np.full((size, width), -np.inf)
        self.low[(1 << self.depth) + leaves], self.high[(1 << self.depth) + leaves] = low, high
        for node in range((1 << self.depth) - 1, 0, -1):
            self.low[node] = np.minimum(self.low[2 * node], self.low[2 * node + 1])
            self.high[node] = np.maximum(self.high[2 * node], self.high[2 * node + 1])

    def reach(self, at: np.ndarray, scale: np.ndarray, k: int) -> np.ndarray:
        """A square distance within which each target has k points for certain: those of its own leaf's sample, or of the smallest part around it that has enough."""
        out, todo = np.full(len(at), np.inf), np.arange(len(at))
        own = self.leaf(at)
        for up in range(self.depth + 1):
            part = own[todo] >> up
            order = np.argsort(part, kind="stable")
            left = []
            for some in np.split(todo[order], np.flatnonzero(np.diff(part[order])) + 1):
                if not len(some):
                    continue
                p = int(own[some[0]] >> up)
                a, b = self.starts[p << up], self.starts[(p + 1) << up]
                if b - a < k:
                    left.append(some)
                    continue
                step = min(4096, max(1, REACH_CELLS // int(b - a)))  # a part of points in one place may have any number
                for c in range(0, len(some), step):
                    few = some[c : c + step]
                    out[few] = np.partition(squares(at[few], scale[few], self.sample[a:b]), k - 1, axis=1)[:, k - 1]
            todo = np.concatenate(left) if left else np.zeros(0, np.int64)
            if not len(todo):
                break
        return out

    def touched(self, at: np.ndarray, scale: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(target, leaf): leaves whose box reaches into the ball of each target."""
        target, node = np.arange(len(at)), np.ones(len(at), np.int64)
        for level in range(self.depth + 1):
            gap = np.maximum(0, np.maximum(self.low[node] - at[target], at[target] - self.high[node]))
            # no points: the gap is infinite
            keep = ((gap * scale[target]) ** 2).sum(axis=1) <= square[target] * (1 + TIE) + 1e-300
            keep &= np.isfinite(self.low[node, 0])
            target, node = target[keep], node[keep]
            if level < self.depth:
                target, node = np.repeat(target, 2), np.column_stack([2 * node, 2 * node + 1]).ravel()
        return target, node - (1 << self.depth)


def squares(at: np.ndarray, scale: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Square distances of targets (n, d) with scales (n, d) to points (m, d)."""
    out = np.zeros((len(at), len(points)))
    for j in range(at.shape[1]):
        d = (at[:, j, None] - points[:, j]) * scale[:, j, None]
        out += d * d
    return out


def _matrix(batch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch[n].to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch[n].to_numpy() for n in names]).astype(np.float64).reshape(-1, len(names))


def nearest(targets: DataFrame, points: DataFrame, k: int, target_at: list[Column], point_at: list[Column], rank: Callable[[DataFrame], DataFrame], scale: list[Column] | None = None, leaf_rows: int | None = None, group_rows: int | None = None) -> DataFrame:
    """``rank`` of pairs that hold the k nearest points of every target: all columns of ``targets`` beside all columns of ``points``. The result is a table of its own.

    The distance is that of coordinates (``target_at``, ``point_at``) times the target's ``scale``. Points with a null coordinate are nobody's neighbours; a target with
    one, or any target where there are no points, keeps its row with nulls for the point. Column names of the two sides must differ.
    """
    spark, d = targets.sparkSession, len(point_at)
    leaf_rows, group_rows = leaf_rows or LEAF_ROWS, group_rows or GROUP_ROWS
    every = [*targets.columns, *points.columns]
    coords = [fresh(f"at{j}", every) for j in range(d)]
    scales = [fresh(f"scale{j}", every) for j in range(d)]
    leaf, block, other = (fresh(n, every) for n in ("leaf", "block", "other"))
    whole = F.lit(True)
    for c in coords:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    placed = points.select("*", *[c.cast("double").alias(n) for c, n in zip(point_at, coords)]).where(whole)
    n_points = placed.count()
    depth = min(DEPTH, max(0, math.ceil(math.log2(max(1, n_points) / leaf_rows))))
    rate = min(1.0, (SAMPLED << depth) / max(1, n_points)) if depth else 1.0
    sample = placed.where(F.pmod(F.xxhash64(*coords, *points.columns), F.lit(1 << 30)) < int(rate * (1 << 30))) if depth else placed.limit(max(k, leaf_rows))
    tree = Tree(_matrix(sample.select(*coords).toArrow(), coords), depth)
    tree_given = spark.sparkContext.broadcast(tree)

    def code(batches):
        for b in batches:
            leaves = tree_given.value.leaf(_matrix(b, coords))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaves.astype(np.int32))], [*b.schema.names, leaf])

    kinds = lambda df: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    coded = materialize(placed.mapInArrow(code, f"{kinds(placed)}, `{leaf}` int"), "leaves")
    boxes = coded.groupBy(leaf).agg(F.count("*").alias("n"), *[f(c).alias(f"{g}{j}") for j, c in enumerate(coords) for f, g in ((F.min, "a"), (F.max, "b"))]).toArrow()  # a row for each leaf
    tree.bound_by(boxes[leaf].to_numpy(), *[_matrix(boxes, [f"{g}{j}" for j in range(d)]) for g in "ab"])
    tree_full = spark.sparkContext.broadcast(tree)

    def pair(batches):
        for b in batches:
            at, by = _matrix(b, coords), _matrix(b, scales)
            fine = np.isfinite(at).all(axis=1) & np.isfinite(by).all(axis=1)
            at, by = np.where(fine[:, None], at, 0.0), np.where(fine[:, None], by, 0.0)
            if not len(boxes):
                target, leaves = np.arange(len(at)), np.full(len(at), -1)
            else:
                some = np.flatnonzero(fine)
                t, leaves = tree_full.value.touched(at[some], by[some], tree_full.value.reach(at[some], by[some], k))
                lost = np.flatnonzero(~fine)
                target, leaves = np.concatenate([some[t], lost]), np.concatenate([leaves, np.full(len(lost), -1)])
            taken = b.take(pa.array(target))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaves.astype(np.int32))], [*b.schema.names, leaf])

    asked = targets.select("*", *[c.cast("double").alias(n) for c, n in zip(target_at, coords)], *[(F.lit(1.0) if scale is None else scale[j].cast("double")).alias(n) for j, n in enumerate(scales)])
    sent = materialize(asked.mapInArrow(pair, f"{kinds(asked)}, `{leaf}` int"), "visits")
    # leaves that take more than one piece of work on a side
    pieces = lambda rows: rows.groupBy(leaf).count().select(leaf, F.ceil(F.col("count") / group_rows).cast("int").alias("n"))
    of_points = {r[0]: -(-r[1] // group_rows) for r in zip(boxes[leaf].to_pylist(), boxes["n"].to_pylist())}
    of_targets = {r[0]: r[1] for r in pieces(sent).collect()}
    number = lambda many: F.coalesce(F.create_map(*[x for k, n in many.items() if n > 1 for x in (F.lit(k), F.lit(n))])[F.col(leaf)], F.lit(1)) if any(n > 1 for n in many.values()) else F.lit(1)
    dealt = lambda rows, own, others, mine, theirs: rows.withColumn(mine, F.pmod(F.xxhash64(*rows.columns), number(own)).cast("int")).withColumn(theirs, F.explode(F.sequence(F.lit(0), number(others) - 1)))
    left = dealt(sent, of_targets, of_points, block, other)
    right = dealt(coded, of_points, of_targets, other, block)
    ours, given = targets.columns, points.columns
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in targets.schema), *(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)])

    def meet(some: pa.Table, there: pa.Table) -> pa.Table:
        mine, theirs = some.select(ours), there.select(given)
        if not some.num_rows or not there.num_rows:
            # lost targets only: a block of a leaf may be empty
            mine = mine.filter(pa.compute.equal(some[leaf], -1))
            nothing = [pa.nulls(mine.num_rows, f.type) for f in theirs.schema]
            return pa.Table.from_arrays([*mine.columns, *nothing], names=every)
        at, by, to = _matrix(some, coords), _matrix(some, scales), _matrix(there, coords)
        rows, cols = [], []
        for a in range(0, len(at), 1000):
            s = squares(at[a : a + 1000], by[a : a + 1000], to)
            kth = np.partition(s, k - 1, axis=1)[:, k - 1] if len(to) > k else np.full(len(s), np.inf)
            r, c = np.nonzero(s <= kth[:, None] * (1 + TIE) + 1e-300)
            rows.append(r + a)
            cols.append(c)
        mine, theirs = mine.take(pa.array(np.concatenate(rows))), theirs.take(pa.array(np.concatenate(cols)))
        return pa.Table.from_arrays([*mine.columns, *theirs.columns], names=every)

    key = [leaf, block, other]
    found = materialize(rank(left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, out)), "nearest")
    drop(coded, sent)
    for sent_tree in (tree_given, tree_full):
        sent_tree.destroy()
    return found
