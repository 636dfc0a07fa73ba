"""Mixing sources to target weights, with DataFrame and SQL functions only.

Words are summed by source, targets are shares of ``total`` of all words by weight, none above ``most``
times its source, and the excess goes to the others by weight until none is above. A source's rate is its
target over its words. A document is emitted floor(rate) times, and once more where a number hashed from
its id and ``SEED`` is at most its source's limit: one draw a document. The limit is near the fraction: of all documents in
order of their draws, those up to it take the words that come nearest to what floor(rate) leaves of the target, so that a source is off its target
by at most half the size of one document (of all rows of one id, which draw alike). A plan without limits has the fraction itself as probability,
and takes the target on average only.

The limit is found without an order of all documents: sizes are summed by source and one of ``RANGES`` ranges of draws, and only the range
in which the running sum meets what is left is looked at draw by draw.

Defined results: a null text has size 0 and is emitted like any other; a null source is a source, the last;
a source without words has target and rate 0; repeated rows draw alike; an empty table gives an empty one.
Other columns, whatever their names, are carried by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillgrid.session import fresh, materialize

#: Weights by a source's rank, repeating.
WEIGHTS = (3, 1, 2)
#: What the draws of all documents depend on besides their ids.
SEED = 0
#: Equal ranges of draws.
RANGES = 4_096
#: Sources up to which their table (some 60 bytes a row) is broadcast; beyond that it is joined by key.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int = SEED) -> Column:
    """A number from 0 to 1, exclusive, from an id and a seed."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _copies(doc_id: Column, rate: Column, seed: int, limit: Column | None = None) -> Column:
    more = draw(doc_id, seed) < rate - F.floor(rate) if limit is None else draw(doc_id, seed) <= limit
    return (F.floor(rate) + more.cast("long")).cast("long")


def source_rates(sized: DataFrame, weights: tuple = WEIGHTS, total: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target, rate): one row a source, so its windows run over sources, not documents.

    In order of cap over weight, a source is at its cap as long as the cap is no more than its share of what is left;
    the first that isn't sets the words a unit of weight gets.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("double")
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(1))
    s = s.withColumn("left", F.sum("source_size").over(all_rows) * F.lit(total) - (F.sum("cap").over(by_ratio) - F.col("cap")))
    s = s.withColumn("per", F.col("left") / (F.sum("weight").over(all_rows) - F.sum("weight").over(by_ratio) + F.col("weight")))
    s = s.withColumn("level", F.min(F.when(F.col("cap") > F.col("per") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "per"))).over(all_rows)["per"])
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
    s = s.select("source", "source_size", target.alias("target"))
    return s.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def _with_rates(rows: DataFrame, rates: DataFrame, source: str) -> DataFrame:
    """Attach each row's source; the source table is broadcast only while it is known to be small."""
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    name = fresh("mix_source", [*rows.columns, *rates.columns])
    rates = rates.withColumnRenamed("source", name)
    return rows.join(F.broadcast(rates) if few else rates, rows[source].eqNullSafe(F.col(name)), "left").drop(name)


def draw_limits(sized: DataFrame, rates: DataFrame, seed: int = SEED, ranges: int = RANGES) -> DataFrame:
    """(source, limit) of every source: with the documents that draw no more than it, the source comes nearest to its target; of two as near the one with fewer words."""
    rows = _with_rates(sized, rates.select("source", "source_size", "target", "rate"), "source")
    rows = rows.select("source", "size", (F.col("target") - F.floor("rate") * F.col("source_size")).alias("need"), draw(F.col("doc_id"), seed).alias("draw"))
    rows = rows.withColumn("range", F.floor(F.col("draw") * ranges))
    sums = rows.groupBy("source", "need", "range").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("range"))
    met = sums.withColumn("before", upto - F.col("size")).withColumn("upto", upto).where(F.col("upto") >= F.col("need"))
    met = materialize(met.groupBy("source", "need").agg(F.min(F.struct("range", "before")).alias("at")), "mix-ranges")
    name = fresh("met_source", rows.columns)
    inside = met.select(F.col("source").alias(name), F.col("at.range").alias("at"), F.col("at.before").alias("before"))
    few = inside.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    inside = rows.join(F.broadcast(inside) if few else inside, F.col("source").eqNullSafe(F.col(name)) & (F.col("range") == F.col("at")))
    inside = inside.groupBy("source", "need", "before", "draw").agg(F.sum("size").alias("size"))
    taken = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("draw"))
    # draws are multiples of 2^-32, so half of one less than a range's start is below all of the range
    none = met.select("source", "need", (F.col("at.range") / ranges - 2.0**-33).alias("limit"), F.col("at.before").alias("taken"))
    tried = inside.select("source", "need", F.col("draw").alias("limit"), taken.alias("taken")).unionByName(none)
    return tried.groupBy("source").agg(F.min(F.struct(F.abs(F.col("taken") - F.col("need")).alias("off"), "limit"))["limit"].alias("limit"))


def plan_mix(sized: DataFrame, weights: tuple = WEIGHTS, total: float = 1.5, most: int = 2, seed: int = SEED) -> DataFrame:
    """(source, source_size, target, rate, limit) from rows (doc_id, source, size), written once."""
    rates = materialize(source_rates(sized, weights, total, most), "mix-rates")
    limits = draw_limits(sized, rates, seed).withColumnRenamed("source", "of")
    return materialize(rates.join(limits, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").fillna(2.0, ["limit"]), "mix-plan")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size) of every row, written once so that later passes read no text."""
    return materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")), "mix-sizes")


def taken(sized: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row. ``plan``: of the same seed, where it has limits."""
    copies = _copies(F.col("doc_id"), F.col("rate"), seed, F.col("limit") if "limit" in plan.columns else None).alias("copies")
    rows = _with_rates(sized, plan, "source").select("doc_id", "size", "source_size", "target", copies)
    return rows.withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, total: float = 1.5, most: int = 2, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with its own columns. Texts aren't shuffled."""
    plan = plan_mix(sizes(docs, id_col, text_col, source_col), weights, total, most, seed)
    rate, limit, copy = (fresh(n, docs.columns) for n in ("mix_rate", "mix_limit", "mix_copy"))
    rows = _with_rates(docs, plan.select("source", F.col("rate").alias(rate), F.col("limit").alias(limit)), source_col)
    copies = _copies(F.col(id_col), F.col(rate), seed, F.col(limit))
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*docs.columns)
