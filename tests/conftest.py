from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tillpoint.session import build_session
    s = build_session(master="local[4]", app="tillpoint-tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def wh(spark):
    from tillpoint.sources.warehouse import warehouse
    return warehouse(spark, SF_SMALL)


def rows(df, cols=None):
    """Collected rows as sorted tuples (order-insensitive comparison)."""
    cols = cols or df.columns
    out = [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))
