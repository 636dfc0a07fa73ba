"""Lists in text files: paths in order, and keys with comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of the lines of one small file, or of several in order of their paths; each is read as one row, so that order is kept."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\\r?\\n")).alias("line", "value"))
    return whole.select("file", "line", F.trim("value").alias("value"))


def ordered_list(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, entry): the entries of a list of paths in their order, from 0; quotes around an entry go, blank lines don't count."""
    rows = _lines(spark, path).where("value != ''").select("file", "line", F.regexp_replace("value", "^['\"]|['\"],?$", "").alias("entry"))
    kept = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "entry"))).alias("_l"))  # a list is one file, read whole
    return kept.select("file", F.posexplode("_l").alias("place", "_e")).select("file", "place", F.col("_e.entry").alias("entry"))


def key_list(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """(key) of a list of keys, each once; lines that begin with # and blank ones don't count. Another number than ``expected`` is an error."""
    keys = _lines(spark, path).where("value != '' and value not like '#%'").select(F.regexp_replace("value", "^['\"]|['\"]$", "").alias("key")).distinct()
    if expected is not None and (n := keys.count()) != expected:
        raise ValueError(f"{n} keys, not {expected}")
    return keys
