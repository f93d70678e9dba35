"""Jobs that wrote or exchanged more than they read: what they write, their plans and their rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as Dec

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL, rows
from tillpoint import catalog
from tillpoint.plans import audit as A
from tillpoint.plans import incremental as INC
from tillpoint.sources import fixtures as FX
from tillpoint.sources.warehouse import Warehouse


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rule_jobs_do_not_write_the_split(spark):
    w = Warehouse(spark, SF_SMALL)
    scored = catalog.rule_scored_test(w)
    assert "model_split" not in w._memo
    staged = catalog.staged_split(w).filter("split = 'test'")
    assert scored.count() > 0
    assert rows(scored, ["transaction_id", "is_returned"]) == rows(staged, ["transaction_id", "is_returned"])


def test_staged_transactions_are_spelt_out_behind_the_exchange(spark):
    w = Warehouse(spark, SF_SMALL)
    expected = FX.fact_transactions(FX.transaction_lines(FX.read_source(spark, SF_SMALL)))
    assert rows(w["fact_transactions"]) == rows(expected)
    assert rows(w["clean_transactions"]) == rows(A.clean_transactions(expected))
    assert all(f.endswith(".zstd.parquet") for f in w["fact_transactions"].inputFiles())


def test_two_warehouses_of_a_folder_do_not_overwrite_each_other(spark):
    first = Warehouse(spark, SF_SMALL)["dim_products"]
    Warehouse(spark, SF_SMALL)["dim_products"]
    assert first.count() == len(first.select("product_id").collect())


def transactions(spark, data):
    t = spark.createDataFrame([(i, dt.date(2021, 1, d), 1, p, Dec("10.00"), q) for i, d, p, q in data],
                              "transaction_id string, transaction_date date, customer_id long, product_id long, "
                              "revenue decimal(12,2), quantity int")
    for c in set(A.CLEAN_COLUMNS) - set(t.columns):
        t = t.withColumn(c, F.lit(Dec("20.00")).cast("decimal(10,2)") if c == "unit_price" else
                         F.lit(Dec("0.35")).cast("decimal(5,2)") if c == "discount_pct" else F.lit(None).cast("string"))
    return t.select(*A.CLEAN_COLUMNS)


def test_a_batch_is_exchanged_once(spark):
    t = transactions(spark, [("T2", 1, 1, 5), ("T1", 1, 1, 6), ("T9", 2, 2, 1), ("T5", 3, 3, 1)]).withColumn("sale_month", F.lit(dt.date(2021, 1, 1)))
    kept = transactions(spark, [("T4", 1, 1, 1), ("T3", 2, 2, 1), ("T0", 4, 4, 1)]).withColumn("sale_month", F.lit(dt.date(2021, 1, 1)))
    better = INC.better_rows(t, kept)
    assert plan_of(better).count("Exchange") == 1 and "Join" not in plan_of(better)
    assert rows(better, ["transaction_id", "quantity", "_replaces"]) == [("T1", 6, "T4"), ("T5", 1, None)]


class Tables(dict):
    def derived(self, name, build):
        if name not in self:
            self[name] = build(self)
        return self[name]


def test_labels_of_repeated_and_missing_ids(spark):
    """An id on several rows meets every label of that id, as in a join; a NULL id meets none."""
    ids = [("T1", 1, 1, 1), ("T1", 2, 2, 5), (None, 3, 1, 1)] + [(f"U{i}", 4, i % 4, i % 5) for i in range(60)]
    products = spark.createDataFrame([(1, "Dresses", Dec("5"), Dec("30"), "dead"), (2, "Tops", Dec("5"), Dec("30"), "core"),
                                      (2, "Footwear", Dec("5"), Dec("30"), "dead")],
                                     "product_id long, category string, cost_price decimal(10,2), mrp decimal(10,2), heat_score string")
    w = Tables(clean_transactions=transactions(spark, ids), dim_products=products)
    expected = w["clean_transactions"].join(catalog.labelled(w).select("transaction_id", "is_returned"), "transaction_id")
    got = catalog.labelled_transactions(w)
    assert got.columns == expected.columns and rows(got) == rows(expected)
    # Two rows, each with three labels (its second product is listed twice)
    assert got.filter("transaction_id = 'T1'").count() == 6 and w["several_ids"].count() == 1
