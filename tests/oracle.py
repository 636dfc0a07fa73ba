"""Compare a query with its oracle SQL in DuckDB, value by value, whatever the order of rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or isinstance(x, (bool, str)):
        return x
    if isinstance(x, decimal.Decimal):
        raise TypeError("a decimal: cast it in the SQL")
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(plain(y) for y in x.values())
    try:
        return int(x) if not hasattr(x, "asDict") else tuple(plain(y) for y in x)
    except (TypeError, ValueError):
        return float(x)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def expected(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    c.execute(sql)
    names = [d[0] for d in c.description]
    return names, rows_of(names, c.fetchall())


def difference(df, sql: str, sf_dir: str) -> str:
    """What differs, or nothing."""
    names, want = expected(sql, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    other = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(other)} of {len(got)} rows differ: {other[:2]}" if other else ""
