"""Every registered query of the library against its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb
import pytest

from graphloom import plans
from graphloom.plans.bindings import TABLES


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def plain(rows):
    def one(x):
        if isinstance(x, (float, decimal.Decimal)):
            return "nan" if x != x else f"{float(x):.9g}"
        if isinstance(x, (datetime.date, datetime.datetime)):
            return str(x)
        return str(x)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, data, con, name):
    got = plans.QUERIES[name](spark, data)
    if name not in plans.SQL:
        assert got.count() >= 0
        return
    want = con.sql(plans.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert plain(got.select(*cols).collect()) == plain(want.select(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
