"""Parquet, CSV and JSON products: partitioned writes, read-back and lossless rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_product(df: DataFrame, path: str, *partition: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; the commit protocol makes the folder appear as a whole."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, keys in order of their names, nulls kept."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def rewrite_lossless(spark: SparkSession, source: str, target: str, *order: str) -> None:
    """The same rows, sorted and compressed harder."""
    df = spark.read.parquet(source)
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(target)


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: how many rows each side has that the other hasn't."""
    a, b = left.exceptAll(right), right.exceptAll(left)
    return a.agg(F.count("*").alias("only_left")).join(F.broadcast(b.agg(F.count("*").alias("only_right"))))


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a product, as its file system counts them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
