"""Parsing, keys and digests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(text: Column) -> Column:
    """A double, or null for what isn't a finite number."""
    x = text.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def parse_time(text: Column) -> Column:
    """The first format that fits: yyyyMMddHHmmss, yyyyMMddHHmm, ISO; null if none does."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss")), F.try_to_timestamp(text, F.lit("yyyyMMddHHmm")), F.try_to_timestamp(text))


def iso_utc(text: Column) -> Column:
    return F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def snapped(time: Column, tolerance: float) -> Column:
    """A time without its fraction of a second, where that is no more than ``tolerance`` seconds; else as it is."""
    return F.when(F.unix_micros(time.cast("timestamp")) % 1000000 <= tolerance * 1e6, F.date_trunc("second", time.cast("timestamp"))).otherwise(time.cast("timestamp"))


def step_hours(step: Column) -> Column:
    """Hours of a number with a unit (s, m, h, d); a bare number is hours; null unless whole."""
    number, unit = F.regexp_extract(step, r"^(\d+)([smhd]?)$", 1).try_cast("long"), F.regexp_extract(step, r"^(\d+)([smhd]?)$", 2)
    seconds = number * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "d", 86400).otherwise(3600)
    return F.when(seconds % 3600 == 0, F.floor(seconds / 3600))


def normalized_units(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[\^\s*/]", "")


def station_key(abbreviation: Column, site: Column) -> Column:
    return F.concat_ws(":", abbreviation, site)


def tile_tag(lat: Column, lon: Column, step: int) -> Column:
    """Key of the tile of ``step`` degrees whose south-west corner covers a point."""
    a, b = (F.floor(lat / step) * step).cast("int"), (F.floor(lon / step) * step).cast("int")
    return F.concat(F.when(a >= 0, "N").otherwise("S"), F.lpad(F.abs(a).cast("string"), 2, "0"), F.when(b >= 0, "E").otherwise("W"), F.lpad(F.abs(b).cast("string"), 3, "0"))


def canonical_digest(*columns: str) -> Column:
    """sha256 of the columns as JSON, keys in order of their names and nothing between."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


#: Seasons by their names.
SEASONS = {"winter": "DJF", "spring": "MAM", "summer": "JJA", "autumn": "SON"}


def season_code(name: Column) -> Column:
    """DJF, MAM, JJA or SON of a season's name; null for anything else."""
    n = F.lower(F.trim(name))
    return F.coalesce(*[F.when(n == k, v) for k, v in SEASONS.items()])


def first_given(*columns: Column) -> Column:
    """The first of several columns that isn't null or an empty text."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c) for c in columns])


def aliased(df, name: str, aliases: list[str]):
    """``df`` with ``name`` from those of ``aliases`` that it has, the first that is given; none of them at all is an error."""
    there = [a for a in aliases if a in df.columns]
    if not there:
        raise ValueError(f"none of {', '.join(aliases)} is there for {name}")
    return df.withColumn(name, first_given(*[F.col(a) for a in there]))


def class_code(code: Column, most: int) -> Column:
    """Whether a code is a whole number from 1 to ``most``."""
    x = code.cast("double")
    return F.coalesce(~F.isnan(x) & (x == F.floor(x)) & x.between(1, most), F.lit(False))
