"""Month partitions, buckets and the stored view, the membership filter, the capped stock recurrence."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL, rows
from tillpoint import catalog
from tillpoint.operators import membership
from tillpoint.plans import audit as A
from tillpoint.plans import ledger as LG
from tillpoint.sources import layout


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# --- month partitions ---------------------------------------------------------------
def test_churn_windows_read_their_months_only(spark, wh):
    plan = plan_of(catalog.queries()["churn_windows"](spark, SF_SMALL))
    assert "PartitionFilters: [isnotnull(sale_month" in plan and "(sale_month#" in plan and ">= 2000-02-01" in plan
    months = wh.by_month("clean_transactions")
    recent = layout.in_dates(months, "transaction_date", dt.date(2000, 2, 1))
    read = {r[0] for r in recent.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(read) < len(months.inputFiles()) / 2
    assert all(f.split("sale_month=")[1][:10] >= "2000-02-01" for f in read)


def test_filtered_targets_prune_the_sales_at_run_time(spark, wh):
    plan = plan_of(catalog.queries()["missed_target_channels"](spark, SF_SMALL))
    assert "dynamicpruningexpression(sale_month" in plan


def test_dates_at_the_ends_of_months(spark, tmp_path):
    days = [dt.date(2020, 1, 31), dt.date(2020, 2, 1), dt.date(2020, 2, 29), dt.date(2020, 3, 1), None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id long, day date")
    laid = layout.write_by_month(df, str(tmp_path / "t"), layout.month_of(F.col("day")), "day")
    assert sorted(r["id"] for r in laid.collect()) == [0, 1, 2, 3, 4]
    assert rows(layout.in_dates(laid, "day", dt.date(2020, 2, 1), dt.date(2020, 2, 29)), ["id"]) == [(1,), (2,)]
    assert rows(layout.in_dates(laid, "day", None, dt.date(2020, 1, 31)), ["id"]) == [(0,)]
    assert rows(layout.in_dates(laid, "day", dt.date(2020, 2, 29)), ["id"]) == [(2,), (3,)]


def test_a_large_month_is_written_by_many_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        day = F.when(F.col("id") % 10 < 8, F.lit("2020-01-05")).otherwise(F.lit("2020-02-05")).cast("date")
        df = spark.range(60_000).repartition(16).withColumn("day", day).withColumn("note", F.sha2(F.col("id").cast("string"), 256))
        laid = layout.write_by_month(df, str(tmp_path / "t"), layout.month_of(F.col("day")), "day")
        files = [f for f in laid.inputFiles() if "2020-01" in f]
        assert len(files) >= 4 and laid.count() == 60_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


# --- buckets and the stored view ---------------------------------------------------
def test_bucketed_tables_join_without_an_exchange(spark, wh, no_broadcast):
    plan = plan_of(A.date_consistency(wh.stored("fact_returns"), wh.stored("fact_transactions")))
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
    unbucketed = plan_of(A.date_consistency(wh["fact_returns"], wh["fact_transactions"]))
    assert "Exchange" in unbucketed


def test_stored_view_equals_the_staged_clean_table(spark, wh):
    view = wh.stored("vw_clean_transactions")
    assert rows(view) == rows(wh["clean_transactions"], view.columns)
    assert spark.sql(f"SHOW TABLES IN {wh.catalog()}").filter("NOT isTemporary").count() == 3


def test_bucket_count_follows_the_size(spark, monkeypatch):
    monkeypatch.setattr(layout, "plan_bytes", lambda df: df)
    assert layout.bucket_count(1) == layout.MIN_BUCKETS
    assert layout.bucket_count(1, 100 * layout.BUCKET_BYTES) == 128
    assert layout.bucket_count(1 << 60) == layout.MAX_BUCKETS


# --- membership filter ---------------------------------------------------------------
def test_the_filter_keeps_every_wanted_key(spark):
    wanted = spark.range(0, 3000, 3).select((F.col("id") * 1_000_003).alias("k"))
    table = spark.range(40_000).select((F.col("id") * 1_000_003).alias("k"))
    for bits in (64, 1 << 12, 1 << 16):
        kept = table.filter(membership.may_hold(membership.key_words(wanted, bits), F.col("k"), bits))
        assert kept.join(wanted, "k", "left_semi").count() == 1000
    assert kept.count() < 1200  # false positives of the largest filter
    assert membership.only_wanted(table, "k", wanted.filter("false")).count() == 0


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_orphans_do_not_depend_on_the_filter(spark, wh, monkeypatch, bits):
    """A filter that passes everything and one that passes little give the same counts."""
    expected = rows(A.referential_integrity(A.default_integrity_checks(wh)))
    monkeypatch.setattr(membership, "filter_bits", lambda n: bits)
    assert rows(A.referential_integrity(A.default_integrity_checks(wh))) == expected


def test_only_survivors_of_the_larger_parent_are_exchanged(spark, wh):
    keys = A.known_keys(wh["fact_transactions"], "transaction_id", wh["fact_returns"], "transaction_id")
    returned = wh["fact_returns"].select("transaction_id").distinct().count()
    everything = wh["fact_transactions"].select("transaction_id").distinct().count()
    assert keys.count() < 1.1 * returned + 50 < everything / 2


def test_orphans_with_null_keys_and_an_empty_child(spark):
    parent = spark.createDataFrame([(f"k{i}", "x" * 50) for i in range(500)], "k string, pad string")
    child = spark.createDataFrame([("k1",), ("k1",), ("zz",), (None,), (None,)], "k string")
    none = child.filter("false")
    got = A.referential_integrity([("a", child, parent, "k"), ("b", none, parent.filter("k > 'k2'"), "k")])
    assert rows(got) == [("a", 3), ("b", 0)]


# --- capped stock recurrence --------------------------------------------------------
def plain_capped(units, initial, pct_on=25):
    stock, pct, out = initial, 0, []
    for week, u in enumerate(units, 1):
        if stock <= 0:
            break
        live = week - 1
        demand = math.floor(round((u or 0) * math.exp(-0.055 * live) * (1 + 1.8 * pct / 100), 6))
        sold = min(demand, stock)
        if pct == 0 and live >= 9 and (initial - stock) / initial < 0.35:
            pct = pct_on
        out.append((week, stock, demand, sold, pct))
        stock -= sold
    return out


def test_sales_are_capped_and_the_series_ends_at_zero(spark):
    series = {(1, 1): ([3] * 26, 40), (1, 2): ([50, 50, 50], 60), (2, 1): ([0] * 12 + [10] * 14, 45),
              (2, 2): ([None, 5, None, 100], 8), (3, 1): ([7, 7], 0), (3, 2): ([1] * 26, 249)}
    data = [(p, s, w, u, init) for (p, s), (units, init) in series.items() for w, u in enumerate(units, 1)]
    weekly = spark.createDataFrame(data, "product_id long, store_id long, week_number int, units int, initial_stock int")
    products = spark.createDataFrame([(i, 99.99) for i in (1, 2, 3)], "product_id long, mrp double").withColumn(
        "mrp", F.col("mrp").cast("decimal(10,2)"))
    got = LG.capped_ledger(weekly.repartition(4), products).collect()
    expected = sorted((p, s, w, o, d, x, pct / 100) for (p, s), (units, init) in series.items()
                      for w, o, d, x, pct in plain_capped(units, init))
    assert sorted((r["product_id"], r["store_id"], r["week_number"], r["opening_stock"], r["demand"], r["units_sold"],
                   float(r["markdown_pct"])) for r in got) == expected
    assert all(r["closing_stock"] >= 0 and r["lost_units"] == r["demand"] - r["units_sold"] for r in got)
    assert {r["week_number"] for r in got if (r["product_id"], r["store_id"]) == (1, 2)} == {1, 2}
    assert not [r for r in got if r["product_id"] == 3 and r["store_id"] == 1]
    assert LG.capped_ledger(weekly.filter("false"), products).count() == 0
