"""Hard-negative mining with exact integer scores from float32 matrix products.

Vectors are quantised to integers. A block of rows is multiplied with a block of anchors in a residue number system: modulo each of several
primes under 256, residues around zero, in float32, where sums of products stay below 2^24 and so are exact. The primes' product exceeds
twice the largest score there can be (the largest squared norm, of the whole table), so Chinese remaindering gives the signed score itself.

Two passes over all rows, for anchors in groups of ``GROUP_BYTES`` that are broadcast one at a time:

1. the ``positives`` best rows with the anchor's own label, by score and then by smaller id;
2. for each of them the best ``negatives`` rows with another label whose scores lie in the window under the positive's: scores are sorted
   once for an anchor and a block of rows, and each window begins where a binary search says.

Tasks keep running bests for every anchor of the group; only those are shuffled. Rows don't move, but once: the quantised table is dealt out evenly,
since the work grows with rows times anchors, not with bytes.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part; vectors of different lengths are
compared as if the shorter one ended in zeros; every row counts by itself, so a repeated row is found twice, and a repeated anchor gives its rows twice; rows with
the anchor's id aren't its positives or negatives; an anchor without positives gives no rows; an empty table gives no rows. Components or scores
too large for exact 64-bit arithmetic (a squared norm of 2^49 or more) are an error, as an overflow is. Other columns, whatever their names, are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillgrid.llm.ragged import offsets_of
from skillgrid.session import drop, materialize

#: The largest primes under 256, largest first: as many as a table's scores need are used.
PRIMES = [p for p in range(251, 180, -1) if all(p % d for d in range(2, 16))]
#: Bytes of the anchors of one group, and rows and anchors that are multiplied at once.
GROUP_BYTES, ROWS, ANCHORS = 32 << 20, 2048, 512
#: Squared norms from which scores wouldn't stay exact.
TOO_LARGE = 1 << 49
NONE = -np.iinfo(np.int64).max


class Residues:
    """Products of integer matrices modulo primes, put together exactly for results of at most ``bound`` either way."""

    def __init__(self, bound: int):
        self.primes, self.modulus = [], 1
        for p in PRIMES:
            if self.modulus > 2 * bound:
                break
            self.primes.append(p)
            self.modulus *= p
        # a residue from -p to p to its multiple of modulus / p, of which the sum is congruent to the result
        self.shares = []
        for p in self.primes:
            rest = self.modulus // p
            share = [r * pow(rest, -1, p) % p * rest for r in range(-p, p + 1)]
            self.shares.append(np.array(share, np.int64))
        self.most_columns = (1 << 24) // (126 * 126)

    def of(self, matrix: np.ndarray) -> list[np.ndarray]:
        """The matrix modulo each prime, around zero."""
        return [((matrix + p // 2) % p - p // 2).astype(np.float32) for p in self.primes]

    def times(self, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        """left x right^T."""
        total = 0
        for p, share, a, b in zip(self.primes, self.shares, left, right):
            r = np.zeros((len(a), len(b)), np.float32)
            for c in range(0, max(1, a.shape[1]), self.most_columns):
                r += a[:, c : c + self.most_columns] @ b[:, c : c + self.most_columns].T
                r -= np.rint(r * np.float32(1 / p)) * np.float32(p)
            total = total + share[r.astype(np.int16) + p]
        total %= self.modulus
        return np.where(2 * total > self.modulus, total - self.modulus, total)


def quantised(rows: DataFrame, vec_col: str, scale: float) -> DataFrame:
    """(vec_id, label, vector, norm2) of the rows that take part: floor(scale * x) of every component."""

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            off = lists.offsets.to_numpy().astype(np.int64)
            x = lists.flatten()
            fine = pc.fill_null(pc.is_finite(x), False).to_numpy(zero_copy_only=False) if len(x) else np.zeros(0, bool)
            off = off - off[0]
            whole = np.diff(offsets_of(fine)[off]) == np.diff(off)
            q = np.floor(scale * np.where(fine, pc.fill_null(x, 0).to_numpy(zero_copy_only=False).astype(np.float64), 0.0))
            if len(q) and (np.abs(q) >= 2.0**31).any():
                raise OverflowError("a component is too large")
            q = q.astype(np.int64)
            norm = np.diff(np.concatenate([[0.0], np.cumsum(q.astype(np.float64) ** 2)])[off])
            norm = np.where(norm < 2.0**52, np.diff(np.concatenate([[0], np.cumsum(q * q)])[off]), 2**62)
            vectors = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(q, pa.int64()))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vectors, pa.array(norm, pa.int64())], ["vec_id", "label", "vector", "norm2"])
            yield out.filter(pa.array(whole))

    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col(vec_col).cast("array<double>").alias("vector")).where("vec_id is not null and label is not null and vector is not null")
    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {kind}, vector array<long>, norm2 long")


def matrix_of(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Rows of ``width`` integers, zeros where a vector ends."""
    off = vectors.offsets.to_numpy().astype(np.int64)
    n = np.diff(off)
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(off[-1] - off[0]) - np.repeat(off[:-1] - off[0], n)] = vectors.flatten().to_numpy()
    return out


def merged(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` along the last axis, by score and then by smaller id."""
    s, i = np.concatenate([scores, more], axis=-1), np.concatenate([ids, more_ids], axis=-1)
    order = np.lexsort((i, -s), axis=-1)[..., :k]
    return np.take_along_axis(s, order, -1), np.take_along_axis(i, order, -1)


class Anchors:
    """A group of anchors: ids, labels, vectors, and after the first pass the scores of their positives, best first."""

    def __init__(self, table: pa.Table, width: int, bound: int):
        self.ids = table["vec_id"].to_numpy()
        self.labels = table["label"].to_numpy()
        self.vectors = matrix_of(table["vector"].combine_chunks(), width)
        self.width, self.bound, self.positives = width, bound, None


def blocks(batches, anchors: Anchors, rows: int):
    """(ids, labels, residues) of runs of ``rows`` rows, each in order of ids."""
    system = Residues(anchors.bound)
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            part = batch.slice(a, rows)
            part = part.take(pc.sort_indices(part.column(0)))
            yield part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False), system.of(matrix_of(part.column(2), anchors.width))


def ordered_scores(system: Residues, left: list[np.ndarray], right: list[np.ndarray], n: int) -> np.ndarray:
    """score * n + (n - 1 - place): one number that orders the n rows of a block by score and then by id."""
    return system.times(left, right) * n + np.arange(n - 1, -1, -1)


def nearest_alike(rows: DataFrame, anchors: Anchors, k: int, block: int = ROWS, at_once: int = ANCHORS) -> DataFrame:
    """(anchor, vec_id, score): for every anchor, by its number, the first ``k`` rows of its own label that each task has."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches):
        anchors = shared.value
        system, count = Residues(anchors.bound), len(anchors.ids)
        best, best_ids = np.full((count, k), NONE), np.zeros((count, k), np.int64)
        for ids, labels, left in blocks(batches, anchors, block):
            n = len(ids)
            for a in range(0, count, at_once):
                b = min(a + at_once, count)
                key = ordered_scores(system, system.of(anchors.vectors[a:b]), left, n)
                alike = (anchors.labels[a:b, None] == labels) & (anchors.ids[a:b, None] != ids)
                key = np.where(alike, key, NONE)
                top = np.partition(key, -k, axis=1)[:, -k:] if n > k else key
                there = top != NONE
                score, at = np.where(there, top // n, NONE), np.where(there, n - 1 - top % n, 0)
                best[a:b], best_ids[a:b] = merged(best[a:b], best_ids[a:b], score, ids[at], k)
        anchor, place = np.nonzero(best != NONE)
        yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int32)), pa.array(best_ids[anchor, place]), pa.array(best[anchor, place])], ["anchor", "vec_id", "score"])

    return rows.select("vec_id", "label", "vector").mapInArrow(run, "anchor int, vec_id long, score long")


def windowed(rows: DataFrame, anchors: Anchors, k: int, window: tuple[int, int], block: int = ROWS, at_once: int = ANCHORS) -> DataFrame:
    """(anchor, positive, vec_id, score): for every positive of every anchor, by their numbers, the first ``k`` rows of another label that each task has
    with window[0] * positive <= 100 * score <= window[1] * positive."""
    shared = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches):
        anchors = shared.value
        system, (count, slots) = Residues(anchors.bound), anchors.positives.shape
        best, best_ids = np.full((count, slots, k), NONE), np.zeros((count, slots, k), np.int64)
        given = anchors.positives != NONE
        positive = np.where(given, anchors.positives, 0)
        # scores that fit: none where there is no positive
        low = np.where(given, -((-window[0] * positive) // 100), 1)
        high = np.where(given, (window[1] * positive) // 100, 0)
        for ids, labels, left in blocks(batches, anchors, block):
            n = len(ids)
            for a in range(0, count, at_once):
                b = min(a + at_once, count)
                key = ordered_scores(system, system.of(anchors.vectors[a:b]), left, n)
                other = (anchors.labels[a:b, None] != labels) & (anchors.ids[a:b, None] != ids)
                key = np.sort(np.where(other, key, NONE), axis=1)
                # of all rows at most as high as the window's end, the last k
                end = np.stack([np.searchsorted(row, h * n + n) for row, h in zip(key, high[a:b])])
                at = end[:, :, None] - np.arange(1, k + 1)
                top = np.where(at >= 0, np.take_along_axis(key[:, None, :], np.maximum(at, 0), axis=2), NONE)
                score = np.where(top != NONE, top // n, NONE)
                score = np.where(score >= low[a:b, :, None], score, NONE)
                there = score != NONE
                best[a:b], best_ids[a:b] = merged(best[a:b], best_ids[a:b], score, ids[np.where(there, n - 1 - top % n, 0)], k)
        anchor, slot, place = np.nonzero(best != NONE)
        columns = [anchor.astype(np.int32), slot.astype(np.int32), best_ids[anchor, slot, place], best[anchor, slot, place]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "positive", "vec_id", "score"])

    return rows.select("vec_id", "label", "vector").mapInArrow(run, "anchor int, positive int, vec_id long, score long")


def mine(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), vec_col: str = "embedding", scale: float = 256.0, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). ``rows``: (vec_id, label, a vector); ``anchor``: a condition on vec_id."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = materialize(quantised(rows, vec_col, scale).repartition(tasks), "quantised")
    bound, width = table.agg(F.max("norm2"), F.max(F.size("vector"))).first()
    asked = table.where(anchor)
    count = asked.count()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not count:
        drop(table)
        return spark.createDataFrame([], schema)
    if bound >= TOO_LARGE:
        raise OverflowError(f"a squared norm of {bound} is too large")
    groups = max(1, -(-count * (8 * width + 16) // group_bytes))
    asked = asked.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
    by = lambda *keys: Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    out = None
    for group in range(groups):
        some = asked.where(F.col("group") == group).select("vec_id", "label", "vector").toArrow()
        if not some.num_rows:
            continue
        anchors = Anchors(some, width, max(1, bound))
        found = nearest_alike(table, anchors, positives).withColumn("positive", F.row_number().over(by("anchor")) - 1).where(F.col("positive") < positives)
        found = found.select("anchor", "positive", "vec_id", "score").toArrow()  # a few rows for each anchor of the group
        anchors.positives = np.full((len(anchors.ids), positives), NONE)
        first, slot, ids, score = (found[c].to_numpy() for c in found.column_names)
        anchors.positives[first, slot] = score
        known = pa.table({"anchor": pa.array(first), "positive": pa.array(slot), "anchor_id": pa.array(anchors.ids[first]), "positive_id": pa.array(ids), "positive_score": pa.array(score)})
        mined = windowed(table, anchors, negatives, window).withColumn("rank", F.row_number().over(by("anchor", "positive"))).where(F.col("rank") <= negatives)
        mined = mined.join(F.broadcast(spark.createDataFrame(known)), ["anchor", "positive"])
        part = materialize(mined.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "mined")
        out = part if out is None else out.unionAll(part)
    drop(table)
    return out
