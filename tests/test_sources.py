"""CSV / Parquet sources and sinks: every canonical table survives a CSV round
trip with its declared schema (dates parsed on read, decimals exact)."""

from __future__ import annotations

import tempfile

from tests.conftest import rows
from tillpoint.sources import io as IO
from tillpoint.sources.schemas import SCHEMAS
from tillpoint.sources.warehouse import TABLES


def test_csv_round_trip_of_every_table(spark, wh):
    d = tempfile.mkdtemp(prefix="tillpoint-csv-")
    IO.write_tables(wh.tables(), d, "csv")
    back = IO.load_tables(spark, d, TABLES, "csv")
    for name in TABLES:
        # file sources read every column as nullable; names and types must match
        assert [(f.name, f.dataType) for f in back[name].schema.fields] == \
            [(f.name, f.dataType) for f in IO.schema_of(name).fields], name
        assert rows(back[name]) == rows(wh[name].select(*[f.name for f in IO.schema_of(name).fields])), name


def test_parquet_round_trip_keeps_types(spark, wh):
    d = tempfile.mkdtemp(prefix="tillpoint-pq-")
    IO.write_tables({"fact_inventory": wh["fact_inventory"]}, d, "parquet")
    back = IO.load_tables(spark, d, ["fact_inventory"], "parquet")["fact_inventory"]
    assert [f.dataType for f in back.schema.fields] == [f.dataType for f in SCHEMAS["fact_inventory"].fields]
    assert back.count() == wh["fact_inventory"].count()


def test_views_registered_for_sql(spark, wh):
    names = wh.register_views(prefix="t_")
    assert "t_vw_clean_transactions" in names
    n = spark.sql("SELECT COUNT(*) AS n FROM t_vw_clean_transactions").collect()[0].n
    assert n == wh["clean_transactions"].count()
