"""Streams of samples: ending hours, de-duplication, pairing and running statistics.

Samples are (station, ts, value). An ending hour is (hour - 1h, hour], so windows run over the sample time less one microsecond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skillgrid.session import shared_path

LATE = "10 minutes"


def read_samples(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def ending_hours(samples: DataFrame, late: str = LATE) -> DataFrame:
    """(station, hour, samples, mean, highest) of closed hours; incomplete ones are kept and can be told by ``samples``."""
    te = samples.withColumn("te", F.col("ts").cast("timestamp") - F.expr("interval 1 microsecond")).withWatermark("te", late)
    g = te.groupBy("station", F.window("te", "1 hour").alias("w")).agg(F.count("value").alias("samples"), F.avg("value").alias("mean"), F.max("value").alias("highest"))
    return g.select("station", F.col("w.end").alias("hour"), "samples", "mean", "highest")


def by_completeness(hours: DataFrame, samples: int) -> DataFrame:
    """Hours with ``violation`` where their samples aren't all there; such an hour has no mean, rather than one of other weights."""
    whole = F.col("samples") == samples
    return hours.select("station", "hour", "samples", F.when(whole, F.col("mean")).alias("mean"), (~whole).alias("violation"))


def without_first(hours: DataFrame, starts: DataFrame) -> DataFrame:
    """Hours without the first of each station (station, first), whose interval began before the run did."""
    return hours.join(F.broadcast(starts.withColumnRenamed("first", "_first")), "station").where(F.col("hour") > F.col("_first")).drop("_first")


def first_of_overlap(samples: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """Keep-first de-duplication of restarted segments; state is bounded by the watermark."""
    return samples.withColumn("te", F.col("ts").cast("timestamp")).withWatermark("te", late).dropDuplicatesWithinWatermark(keys)


def last_of_overlap(samples: DataFrame, keys: list[str], segment: str, value: str, late: str = LATE) -> DataFrame:
    """(keys, te, segment, value, copies): of records that segments share, the one of the latest segment, once the watermark has passed their time; ``copies`` says how many there were."""
    te = samples.withColumn("te", F.col("ts").cast("timestamp")).withWatermark("te", late)
    return te.groupBy(*keys, "te").agg(F.max(segment).alias(segment), F.max_by(value, segment).alias(value), F.count("*").alias("copies"))


def pair(left: DataFrame, right: DataFrame, late: str = LATE) -> DataFrame:
    """Stream-stream join of (station, ts, value) by exact time."""
    l = left.select(F.col("station"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("obs")).withWatermark("ts", late)
    r = right.select(F.col("station").alias("s2"), F.col("ts").cast("timestamp").alias("t2"), F.col("value").alias("model")).withWatermark("t2", late)
    return l.join(r, F.expr("station = s2 and ts = t2 and t2 between ts - interval 1 minute and ts + interval 1 minute")).select("station", "ts", "obs", "model")


def running_sums(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable sums by group, for update or complete mode."""
    e = F.col("model") - F.col("obs")
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(e).alias("se"), F.sum(e * e).alias("sdd"))


def run_once(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is there, and return it: appended rows from a Parquet sink in the shared folder, complete results from the last batch."""
    spark = df.sparkSession
    out, state = shared_path(spark, f"stream-{name}"), shared_path(spark, f"stream-{name}-state")
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    else:
        # the whole result of every batch replaces that of the one before
        q = df.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).option("checkpointLocation", state).outputMode("complete").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(df.schema).parquet(out)
