"""The clean table in batches and distinct counts rolled up from bitmaps."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL, rows
from tillpoint import catalog
from tillpoint.operators import bitmaps as B
from tillpoint.plans import audit as A
from tillpoint.plans import sales as S
from tillpoint.plans.incremental import CleanTable
from tillpoint.sources import schemas as SC

COLUMNS = ["transaction_id", "transaction_date", "customer_id", "product_id", "revenue", "quantity"]


def transactions(spark, data):
    declared = SC.SCHEMAS["fact_transactions"]
    df = spark.createDataFrame(data, "transaction_id string, transaction_date date, customer_id long, product_id long, "
                                     "revenue double, quantity int")
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(declared[c].dataType).alias(c)
                       for c in A.CLEAN_COLUMNS])


def day(month, d=1):
    return dt.date(2021, month, d)


def kept(df):
    return rows(df, COLUMNS[:4])


def test_a_lower_id_overwrites_its_month_only(spark, tmp_path):
    clean = CleanTable(spark, str(tmp_path / "clean"))
    first = transactions(spark, [("T5", day(1), 1, 1, 10.0, 1), ("T6", day(1), None, 1, 10.0, 1),
                                 ("T7", day(2), 1, 1, 10.0, 1), ("T8", day(3), 1, 1, 0.0, 1)])
    done = clean.apply(first)
    assert sorted(done["appended"]) == [day(1), day(2)] and not done["skipped"] and not done["overwritten"]
    assert sorted(clean.apply(first)["skipped"]) == [day(1), day(2)]
    february = {f for f in clean._kept().inputFiles() if "2021-02" in f}
    done = clean.apply(transactions(spark, [("T4", day(1), None, 1, 10.0, 1), ("T9", day(1), 1, 1, 10.0, 1),
                                            ("T9", day(4), 1, 1, 10.0, 1)]))
    assert done["overwritten"] == [day(1)] and done["appended"] == [day(4)]
    assert kept(clean.read()) == sorted([("T4", day(1), None, 1), ("T5", day(1), 1, 1), ("T7", day(2), 1, 1),
                                         ("T9", day(4), 1, 1)], key=str)
    assert {f for f in clean._kept().inputFiles() if "2021-02" in f} == february
    assert clean.apply(first)["appended"] == [] and clean.changed_outside().count() == 0


def test_a_row_without_units_bars_later_rows_of_its_key(spark, tmp_path):
    clean = CleanTable(spark, str(tmp_path / "clean"))
    clean.apply(transactions(spark, [("T1", day(1), 1, 1, 10.0, 0)]))
    clean.apply(transactions(spark, [("T2", day(1), 1, 1, 10.0, 3)]))
    assert clean.read().count() == 0


def test_empty_batches_and_rows_without_a_date(spark, tmp_path):
    clean = CleanTable(spark, str(tmp_path / "clean"))
    none = transactions(spark, []).filter("false")
    assert clean.apply(none) == {"skipped": [], "appended": [], "overwritten": []} and clean.read().count() == 0
    clean.apply(transactions(spark, [("T3", None, 1, 1, 5.0, 1), ("T2", None, 1, 1, 5.0, 1)]))
    assert clean.apply(transactions(spark, [("T1", None, 1, 1, 5.0, 1)]))["overwritten"] == [None]
    assert kept(clean.read()) == [("T1", None, 1, 1)] and clean.changed_outside().count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_any_order_equal_the_whole(spark, tmp_path, seed):
    rng = random.Random(seed)
    data = [(f"T{i:04}", rng.choice([day(m, d) for m in (1, 2, 3) for d in (1, 9)] + [None]), rng.choice([None, 1, 2]),
             rng.choice([1, 2, 3]), rng.choice([0.0, 5.0, 7.5]), rng.choice([0, 1, 2])) for i in range(300)]
    rng.shuffle(data)
    clean = CleanTable(spark, str(tmp_path / "clean"))
    for part in (data[:100], data[100:180], data[50:150], data[180:]):
        clean.apply(transactions(spark, part))
    assert kept(clean.read()) == kept(A.clean_transactions(transactions(spark, data)))
    assert clean.changed_outside().count() == 0


def test_an_overwrite_that_broke_off_is_ended(spark, tmp_path, monkeypatch):
    """The driver is lost after the copy was written; the files of the month are gone, too."""
    clean = CleanTable(spark, str(tmp_path / "clean"))
    clean.apply(transactions(spark, [("T5", day(1), 1, 1, 10.0, 1), ("T6", day(1), 2, 1, 10.0, 1)]))
    better = transactions(spark, [("T1", day(1), 1, 1, 10.0, 1)])
    with monkeypatch.context() as m:
        ended = iter([None])

        def broken(self):
            next(ended)  # the call at the start of a batch passes, the one that overwrites fails
        m.setattr(CleanTable, "_end_pending", broken)
        with pytest.raises(StopIteration):
            clean.apply(better)
    again = CleanTable(spark, str(tmp_path / "clean"))
    again.apply(better)
    assert kept(again.read()) == [("T1", day(1), 1, 1), ("T6", day(1), 2, 1)]
    assert again.changed_outside().count() == 0


def test_lost_files_are_noticed(spark, tmp_path):
    clean = CleanTable(spark, str(tmp_path / "clean"))
    clean.apply(transactions(spark, [("T5", day(1), 1, 1, 10.0, 1), ("T6", day(2), 2, 1, 10.0, 1)]))
    extra = clean._kept().filter(F.col("sale_month") == F.lit(day(2)))
    extra.write.mode("append").partitionBy("sale_month").parquet(str(tmp_path / "clean" / "kept"))
    assert [r["sale_month"] for r in clean.changed_outside().collect()] == [day(2)]


# --- bitmaps --------------------------------------------------------------------------
def test_bitmap_counts_equal_distinct_counts(spark):
    rng = random.Random(7)
    data = [(rng.randrange(6), rng.choice([None, 0, -1, -32768, 1, 32768, 32769, rng.randrange(-90_000, 90_000)]))
            for _ in range(4000)] + [(9, None)]
    df = spark.createDataFrame(data, "g long, i long").repartition(5)
    fine = B.id_bitmaps(df, {"g": F.col("g")}, "i")
    assert rows(B.count_ids(fine, ["g"], "n")) == rows(
        df.filter("i IS NOT NULL").groupBy("g").agg(F.countDistinct("i").alias("n")))
    coarse = B.merge(fine, {"h": F.col("g") % 2})
    assert rows(B.count_ids(coarse, ["h"], "n")) == rows(
        df.filter("i IS NOT NULL").groupBy((F.col("g") % 2).alias("h")).agg(F.countDistinct("i").alias("n")))
    assert B.id_bitmaps(df.filter("false"), {"g": F.col("g")}, "i").count() == 0


def test_a_hot_group_is_reduced_before_the_exchange(spark):
    df = spark.range(200_000).select(F.lit(1).alias("g"), (F.col("id") % 70_000).alias("i"))
    made = B.id_bitmaps(df, {"g": F.col("g")}, "i")
    assert made.count() == 4  # buckets: 0, and three of 1 to 69999
    assert B.count_ids(made, ["g"], "n").first()["n"] == 70_000


def test_text_ids_are_numbered_densely(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "k string")
    assert rows(B.dense_numbers(df, "k", "n")) == [("a", 1), ("b", 2), ("c", 3)]


def test_rollups_copy_no_rows(spark, wh):
    for name in ("monthly_revenue_rollup", "reach"):
        plan = catalog.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan and "bitmap_or_agg" in plan, name


def test_months_without_known_customers_count_none(spark):
    tc = transactions(spark, [("T1", day(1), None, 1, 10.0, 1), ("T2", day(2), 4, 1, 10.0, 1)])
    tc = tc.withColumn("cost", F.lit(1).cast("decimal(12,2)")).withColumn("discount_pct", F.lit(0).cast("decimal(5,2)"))
    got = S.monthly_revenue_rollup(tc, S.daily_sales(tc), S.daily_ids(tc, "customer_id"))
    assert [r["unique_customers"] for r in got.collect()] == [0, 1]
    assert rows(got) == rows(S.monthly_revenue(tc), got.columns)
