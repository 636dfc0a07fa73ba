"""Queries of the streaming surface, over the events table as a stream; each equals its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from skillgrid.plans import bindings as B
from skillgrid.plans.registry import query, r6, rounded
from skillgrid.session import shared_path
from skillgrid.streaming import hourly

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: The last hours stay open until the watermark passes them, which is ten minutes behind the last sample.
CLOSED = "hour <= (SELECT max(ts) - INTERVAL 1 MICROSECOND - INTERVAL 10 MINUTE FROM events)"


def events(spark, d, copies: int = 1):
    """The events in order of time, in several files, as a stream of samples."""
    path = shared_path(spark, "events")
    e = B.table(spark, d, "events")
    if copies > 1:
        e = e.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_c")
    e.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    return hourly.read_samples(spark, path, SCHEMA).withColumn("station", F.col("user_id") % 25)


@query("stream_ending_hour", f"WITH h AS (SELECT user_id%25 AS station, date_trunc('hour', ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS hour, count(value) AS samples, avg(value) AS mean, max(value) AS highest FROM events GROUP BY 1,2) SELECT station, hour, samples, round(mean,6)+0.0 AS mean, highest FROM h WHERE {CLOSED} AND hour > (SELECT min(f.hour) FROM h f WHERE f.station = h.station)")
def stream_ending_hour(spark, d):
    """Closed hours but the first of each station, which the run may have begun within."""
    from skillgrid.operators.temporal import ending_hour

    starts = B.table(spark, d, "events").groupBy((F.col("user_id") % 25).alias("station")).agg(F.min(ending_hour(F.col("ts"))).alias("first"))
    out = hourly.run_once(hourly.without_first(hourly.ending_hours(events(spark, d)), starts), "hours")
    return rounded(out.withColumn("hour", F.col("hour").cast("timestamp_ntz")))


@query("stream_late", f"WITH h AS (SELECT user_id%25 AS station, date_trunc('hour', ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 HOUR AS hour, count(value) AS samples, avg(value) AS mean FROM events GROUP BY 1,2) SELECT station, hour, samples, CASE WHEN samples=2 THEN round(mean,6)+0.0 END AS mean, samples<>2 AS violation FROM h WHERE {CLOSED}")
def stream_late(spark, d):
    """Hours that lack a sample, or have one too many, are violations without a mean."""
    out = hourly.run_once(hourly.by_completeness(hourly.ending_hours(events(spark, d)), 2), "complete-hours")
    return out.select("station", F.col("hour").cast("timestamp_ntz").alias("hour"), "samples", r6("mean").alias("mean"), "violation")


@query("stream_dedup", "SELECT event_id, user_id%25 AS station FROM events")
def stream_dedup(spark, d):
    return hourly.run_once(hourly.first_of_overlap(events(spark, d, copies=2), ["event_id"]), "first").select("event_id", "station")


@query("stream_pair_join", "SELECT user_id%25 AS station, ts, value AS obs, round(value*1.1,6)+0.0 AS model FROM events WHERE event_type='click'")
def stream_pair_join(spark, d):
    e = events(spark, d).where("event_type = 'click'")
    model = events(spark, d).where("event_type = 'click'").withColumn("value", F.col("value") * 1.1)
    out = hourly.run_once(hourly.pair(e, model), "pairs")
    return out.select("station", F.col("ts").cast("timestamp_ntz").alias("ts"), "obs", r6("model").alias("model"))


@query("stream_stats", "SELECT user_id%25 AS station, count(*) AS n, round(sum(value*1.1+0.5-value),6)+0.0 AS se, round(sum((value*1.1+0.5-value)*(value*1.1+0.5-value)),6)+0.0 AS sdd FROM events GROUP BY 1")
def stream_stats(spark, d):
    e = events(spark, d).select("station", F.col("value").alias("obs"), (F.col("value") * 1.1 + 0.5).alias("model"))
    return rounded(hourly.run_once(hourly.running_sums(e, ["station"]), "sums", "complete"))


@query("stream_replace", "SELECT event_id, ts AS valid, 2 AS segment, round(value+2,6)+0.0 AS value, 2::BIGINT AS copies FROM events WHERE ts < (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_replace(spark, d):
    """Records that a restarted segment has again: the later one's replace the earlier's."""
    path = shared_path(spark, "events")
    e = B.table(spark, d, "events").withColumn("segment", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("value", F.col("value") + F.col("segment"))
    e.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    stream = hourly.read_samples(spark, path, SCHEMA + ", segment int")
    out = hourly.run_once(hourly.last_of_overlap(stream, ["event_id"], "segment", "value"), "replaced")
    return out.select("event_id", F.col("te").cast("timestamp_ntz").alias("valid"), "segment", r6("value").alias("value"), "copies")
