"""Every query that has an oracle equals it on the 0.01 tables; every other one runs."""

import pytest

import __spark_entry__ as entry
from oracle import difference

SF = "/root/testdata/sf0.01"
OWN = sorted(n for n in entry.QUERIES)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, name):
    df = entry.QUERIES[name](spark, SF)
    sql = entry.ORACLES.get(name)
    if sql:
        assert difference(df, sql, SF) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
