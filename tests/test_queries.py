"""Every query with SQL against DuckDB, every other one for its rows, on the smallest tables."""

import datetime
import math

import pytest

import __spark_entry__
from tests.conftest import SF

QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()
OWN = [n for n in QUERIES if n != "pipeline" and not n.startswith("op")]


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x if isinstance(x, (bool, int)) else str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted([tuple(value(r[k]) for k in order) for r in rows], key=str)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        assert got == table([d[0] for d in result.description], result.fetchall())
    else:
        assert got[1]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)
