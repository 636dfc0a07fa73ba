"""Digests of tables that merge: a number for each row, added up by tile and then for the table, so that identity needs no order and no place where all rows meet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sums(columns: list[str]) -> list[Column]:
    """Two sums of 64-bit hashes of rows, which count repeated rows and don't ask for an order. 0.0 and -0.0 are alike, and so are all NaN."""
    return [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)")).alias(f"_{seed}") for seed in (1, 2)]


def _text() -> Column:
    return F.concat_ws(":", F.col("rows").cast("string"), *[F.coalesce(F.col(f"_{s}"), F.lit(0)).cast("decimal(38,0)").cast("string") for s in (1, 2)])


def tile_digests(cells: DataFrame, values: list[str], side: int = 256) -> DataFrame:
    """(tile_y, tile_x, rows, digest, sums) of the cells (y, x, values) of square tiles; summed before they are shuffled."""
    tile = [F.floor(F.col(c) / side).cast("int").alias(f"tile_{c}") for c in ("y", "x")]
    g = cells.groupBy(*tile).agg(F.count("*").alias("rows"), *_sums(["y", "x", *values]))
    return g.withColumn("digest", _text())


def whole(tiles: DataFrame) -> str:
    """The table's digest from its tiles', of which only sums move."""
    return tiles.agg(F.sum("rows").alias("rows"), F.sum("_1").alias("_1"), F.sum("_2").alias("_2")).select(_text()).first()[0] or ""


def fingerprint(df: DataFrame, columns: list[str]) -> str:
    """A table's digest over some of its columns; the same as that of its tiles if these begin with y and x."""
    return df.agg(F.count("*").alias("rows"), *_sums(columns)).select(_text()).first()[0]


def changed_tiles(before: DataFrame, after: DataFrame) -> DataFrame:
    """(tile_y, tile_x, what): tiles whose digests differ: changed, gone or new."""
    at = ["tile_y", "tile_x"]
    j = before.select(*at, F.col("digest").alias("_a")).join(after.select(*at, F.col("digest").alias("_b")), at, "full")
    what = F.when(F.col("_b").isNull(), "gone").when(F.col("_a").isNull(), "new").when(F.col("_a") != F.col("_b"), "changed")
    return j.select(*at, what.alias("what")).where("what is not null")


def assemble(parts: dict[str, DataFrame], recorded: dict[str, str], base: str) -> DataFrame:
    """The fields of all parts (y, x, ...) on the cells of the part ``base``, with ``missing``: the parts that lack a cell.

    A part whose digest isn't the recorded one, a field that two parts own, or a part that was not recorded is an error, before anything is joined.
    """
    for name, part in parts.items():
        fields = [c for c in part.columns if c not in ("y", "x")]
        if recorded.get(name) != fingerprint(part, ["y", "x", *fields]):
            raise ValueError(f"{name} is not what was recorded")
    owned = [(f, n) for n, p in parts.items() for f in p.columns if f not in ("y", "x")]
    twice = sorted({f for f, _ in owned if sum(f == g for g, _ in owned) > 1})
    if twice:
        raise ValueError(f"fields of two parts: {twice}")
    marked = {n: p.withColumn(f"_has_{n}", F.lit(True)) for n, p in parts.items() if n != base}
    joined = reduce(lambda a, b: a.join(b, ["y", "x"], "left"), marked.values(), parts[base])
    lacks = F.array_compact(F.array(*[F.when(F.col(f"_has_{n}").isNull(), F.lit(n)) for n in marked])) if marked else F.array().cast("array<string>")
    return joined.withColumn("missing", lacks).drop(*[f"_has_{n}" for n in marked])


def at_time(external: DataFrame, field: str, when: str, back: bool = False) -> DataFrame:
    """(y, x, field, valid_from) of an external field (valid_from, y, x, value) at a time: that of the last epoch at or before it. Before the first there is an error, or, with ``back``, the first."""
    moment = F.lit(when).cast("timestamp")
    epochs = external.select(F.col("valid_from").cast("timestamp").alias("t")).agg(F.max(F.when(F.col("t") <= moment, F.col("t"))).alias("last"), F.min("t").alias("first")).first()
    chosen = epochs["last"] or (epochs["first"] if back else None)
    if chosen is None:
        raise ValueError(f"{field} has no epoch at {when}")
    return external.where(F.col("valid_from").cast("timestamp") == F.lit(chosen)).select("y", "x", F.col("value").alias(field), F.lit(chosen).alias(f"{field}_from"))


def months_of(external: DataFrame, field: str) -> DataFrame:
    """(y, x, field): the twelve values of a monthly field (month, y, x, value) as an array; a null where a month is missing."""
    g = external.groupBy("y", "x").agg(F.map_from_entries(F.collect_list(F.struct("month", "value"))).alias("_m"))  # twelve at most
    return g.select("y", "x", F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.try_element_at("_m", m)).alias(field))


def epoch_report(existing: DataFrame, new: DataFrame, fractions: list[str]) -> DataFrame:
    """(valid_from, cells, fields, violation) of every epoch of ``new``: null where it can be appended to ``existing``, else not_later (than all that are there), fields (others than the existing ones), incomplete (a
    field without one of the existing cells, or with one twice) or fraction (a share outside 0 to 1, or no number). Both: (field, valid_from, y, x, value).
    """
    held = existing.agg(F.max("valid_from").alias("_last"), F.array_sort(F.collect_set("field")).alias("_fields"))  # one row of a few names
    cells = existing.groupBy("field", "valid_from").count().agg(F.max("count").alias("_cells"))
    bad = F.col("value").isNull() | F.isnan("value") | (F.col("value") < 0) | (F.col("value") > 1)
    each = new.groupBy("valid_from", "field").agg(F.count("*").alias("n"), F.count_distinct("y", "x").alias("places"), F.count_if(F.col("field").isin(fractions) & bad).alias("bad"))
    g = each.groupBy("valid_from").agg(F.array_sort(F.collect_list("field")).alias("fields"), F.min("places").alias("cells"), F.max(F.col("n") - F.col("places")).alias("twice"), F.sum("bad").alias("bad"))
    g = g.crossJoin(F.broadcast(held)).crossJoin(F.broadcast(cells))
    wrong = F.when(F.col("valid_from") <= F.col("_last"), "not_later").when(F.col("_fields").isNotNull() & (F.size("_fields") > 0) & (F.col("fields") != F.col("_fields")), "fields").when((F.col("cells") != F.coalesce("_cells", "cells")) | (F.col("twice") > 0), "incomplete").when(F.col("bad") > 0, "fraction")
    return g.select("valid_from", "cells", F.array_join("fields", ",").alias("fields"), wrong.alias("violation"))


def append_epochs(existing: DataFrame, new: DataFrame, fractions: list[str]) -> DataFrame:
    """``existing`` with the epochs of ``new``; one that can't be appended is an error that names it, and nothing is."""
    wrong = epoch_report(existing, new, fractions).where("violation is not null").limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.valid_from}: {r.violation}" for r in wrong))
    return existing.unionByName(new)
