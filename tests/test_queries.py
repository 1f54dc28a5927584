"""Every registered query against its SQL on the smallest tables."""

import decimal
import math
import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from ringspan.registry import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, (float, np.floating)) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return f"{float(v):.8g}"
    return str(v)


def rows(names, found):
    """Whole numbers are compared exactly, others to eight digits."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in found)


def test_whole_numbers_are_compared_exactly():
    assert rows(["a"], [(1706640381466000,)]) != rows(["a"], [(1706640381466163,)])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert rows(found.columns, found.collect()) == rows(want.columns, want.fetchall())
    else:
        assert len(found.columns) > 1 and found.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
