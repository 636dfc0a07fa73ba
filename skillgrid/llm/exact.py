"""Exact dedup by progressive refinement: length, then a hash of the beginning, then a hash of the whole.

Each step counts the rows of a key in narrow tables and lets on only rows whose key two rows or more have: beginnings are compared within lengths
that occur twice, whole contents within beginnings that do. The whole content is hashed for the rows that are left, unless every digest is asked for; grouped by it
are those rows alone. Counts and keepers come from aggregates with partial sums and go back to the rows by equi-joins: by broadcast while the keys are
few, and beyond that by shuffled joins, which adaptive execution splits where one group of copies holds a large part of the rows.

Texts are equal if identical after deleting ASCII white space; a null text is an empty one. Of equal texts the row with
the most code points in the original text stays, then the one with the smallest id (nulls first). Rows that are equal even in their id
are told apart by nothing, so both carry ``kept``. Very long texts are hashed whole like any other. An empty table gives an empty one; other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillgrid.session import drop, materialize

#: Characters of the normalised text that the second step hashes.
PREFIX = 256
#: Keys up to which a table of them is broadcast: lengths and beginnings of some 24 bytes each, groups of some 120.
BROADCAST_KEYS = 200_000


def squeezed(text: Column) -> Column:
    """A text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", "")


def _few(keys: DataFrame) -> DataFrame:
    """A written table of keys, marked for broadcast while it is known to be small."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row; the digest is null for rows that were single before the last step, unless ``digest_all``."""
    norm = squeezed(F.col(text_col))
    sizes = [F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_points"), F.length(norm).alias("n"), F.xxhash64(F.substring(norm, 1, PREFIX)).alias("head")]
    narrow = materialize(docs.select(*sizes, *([F.sha2(norm, 256).alias("whole")] if digest_all else [])), "exact-keys")
    # lengths, and then beginnings of those lengths, that more than one row has
    lengths = materialize(narrow.groupBy("n").count().where("count > 1").select("n"), "exact-lengths")
    heads = narrow.join(_few(lengths), "n", "left_semi").groupBy("n", "head").count().where("count > 1").select("n", "head")
    heads = materialize(heads, "exact-heads")
    if digest_all:
        hashed = narrow
    else:
        marked = docs.select(*sizes, norm.alias("norm")).join(_few(heads).withColumn("twice", F.lit(True)), ["n", "head"], "left")
        hashed = materialize(marked.select("doc_id", "n_points", "n", "head", F.when(F.col("twice"), F.sha2("norm", 256)).alias("whole")), "exact-whole")
    # only rows of those beginnings are grouped by their whole content
    first = F.min(F.struct((-F.col("n_points")).alias("m"), F.col("doc_id").alias("keep_id")))
    groups = hashed.join(_few(heads), ["n", "head"], "left_semi").groupBy("whole").agg(first.alias("first"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = materialize(groups.select(F.col("whole").alias("key"), F.col("first.keep_id").alias("keep_id"), "group_size", F.lit(True).alias("grouped")), "exact-groups")
    drop(lengths, heads)
    # rows without a digest join by what is known of them, so that they don't meet under one null key
    rows = hashed.withColumn("key", F.coalesce("whole", F.concat_ws(":", F.lit("single"), "doc_id", "n", "head"))).join(_few(groups), "key", "left")
    keep = F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("whole").alias("text_sha256"))
