"""Station files: semicolon-separated text whose parameters are followed by columns pi, mi, dq and uc."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skillgrid.functions.physics import wind_uv
from skillgrid.functions.text import finite, parse_time

#: Least quality of a value that counts.
QUALITY = 4


def write_lines(lines: DataFrame, header: str, path: str) -> None:
    """One column of lines as text files that each begin with the header, so that no task writes them all."""
    lines.toDF(header).write.option("header", True).option("sep", "\u0001").option("quote", "").option("escapeQuotes", False).csv(path)


def read_long(spark: SparkSession, path: str, ids: int = 5) -> DataFrame:
    """(fields of the ids, valid, parameter, value, dq): read by position, because header names repeat.

    The header, which every file begins with, gives the parameters: those at ids, ids + 5, ids + 10 and so on. Rows shorter than the header are dropped.
    """
    lines = spark.read.text(path)
    first = lines.first()[0]
    head = [h.strip().lower() for h in first.split(";")]
    if any(head[i + 3] != "dq" for i in range(ids, len(head), 5)):
        raise ValueError("a parameter isn't followed by its dq three columns on")
    parts = lines.where(F.col("value") != first).select(F.split("value", ";").alias("f")).where(F.size("f") >= len(head))
    cell = lambda i: F.trim(F.element_at("f", i + 1))
    long = F.explode(F.array(*[F.struct(F.lit(head[i]).alias("parameter"), finite(cell(i)).alias("value"), finite(cell(i + 3)).alias("dq")) for i in range(ids, len(head), 5)]))
    rows = parts.select(*[cell(i).alias(head[i]) for i in range(ids)], long.alias("x")).select(*head[:ids], "x.*")
    return rows.withColumns({"valid": parse_time(F.col(head[1]))}).drop(head[1])


def vectors(pairs: DataFrame, keys: list[str], speed: str, direction: str) -> DataFrame:
    """``pairs`` with u, v and ``violation``: a negative speed, a direction outside 0 to 360, or keys that occur twice; such rows have no vector."""
    bad = F.when(F.col(speed) < 0, "speed").when(~F.col(direction).between(0, 360), "direction").when(F.count("*").over(Window.partitionBy(*keys)) > 1, "duplicate")
    u, v = wind_uv(F.col(speed), F.col(direction))
    out = pairs.withColumn("violation", bad)
    return out.withColumns({"u": F.when(F.col("violation").isNull(), u), "v": F.when(F.col("violation").isNull(), v)})


def accepted(long: DataFrame) -> DataFrame:
    """Finite values of sufficient quality."""
    return long.where(F.col("value").isNotNull() & (F.col("dq") >= QUALITY))


def rejected(long: DataFrame, keys: list[str]) -> DataFrame:
    return long.groupBy(*keys).agg(F.count_if(F.col("value").isNotNull() & (F.coalesce("dq", F.lit(0.0)) < QUALITY)).alias("rejected"))


def stations(long: DataFrame, key: str, latitude: str, longitude: str) -> DataFrame:
    """One row a station; ``conflict`` where its place changes, ``out_of_range`` where it isn't one."""
    fine = F.col(latitude).between(-90, 90) & F.col(longitude).between(-180, 180)
    place = F.struct(latitude, longitude)
    return long.groupBy(key).agg(F.min(place).alias("s"), (F.count_distinct(place) > 1).alias("conflict"), F.bool_or(~F.coalesce(fine, F.lit(False))).alias("out_of_range")).select(key, "s.*", "conflict", "out_of_range")
