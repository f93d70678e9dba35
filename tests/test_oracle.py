"""Every job with an oracle query must equal DuckDB on the same raw tables.

Runs at sf0.001 (the driver repeats this at sf0.01). The DuckDB SQL rebuilds
the canonical tables from the raw test tables on its own, so this also checks
the Spark-side mapping and staging.
"""

from __future__ import annotations

import pytest

from tests.conftest import SF_SMALL
from tools.oracle_check import compare, duck

import __spark_entry__ as E

SQL = E.oracle_sql()
NAMES = sorted(SQL)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_sql_key_is_a_query():
    assert set(SQL) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, wh, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    d_cols = [c[0] for c in cur.description]
    err = compare(name, df.columns, s_rows, d_cols, cur.fetchall())
    assert err is None, err


def test_rows_only_queries_run(spark, wh):
    for name in sorted(set(E.queries()) - set(SQL)):
        df = E.queries()[name](spark, SF_SMALL)
        assert df.count() >= 1, name


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "gross_revenue_inr" in df.columns
