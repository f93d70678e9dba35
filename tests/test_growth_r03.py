"""Steps whose rows, sorts or exchanges grew faster than the input: their plans and brute-force results."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as Dec

from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import rows
from tillpoint import catalog
from tillpoint.plans import audit as A
from tillpoint.plans import inventory as INV
from tillpoint.plans import ledger as LG
from tillpoint.plans import risk as K
from tillpoint.sources import fixtures as FX


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def source(spark):
    """Two parts, one of them listed twice; lines with and without part or date."""
    lines = [(1, 1, dt.datetime(1995, 1, 3), 4.0), (1, 6, dt.datetime(1995, 1, 20), 3.0), (1, 2, dt.datetime(1995, 7, 4), 9.0),
             (2, 1, dt.datetime(1995, 3, 3), 50.0), (2, 1, None, 7.0), (None, 1, dt.datetime(1995, 1, 3), 5.0),
             (3, 1, dt.datetime(1995, 1, 3), 5.0)]
    return {"lineitem": spark.createDataFrame([(p, s, d, q) for p, s, d, q in lines],
                                              "l_partkey long, l_suppkey long, l_shipdate timestamp, l_quantity double"),
            "part": spark.createDataFrame([(1, 7), (2, 3), (2, 3)], "p_partkey long, p_size long")}


def test_the_ledger_unfolds_its_weeks_last(spark):
    src = source(spark)
    products = spark.createDataFrame([(k, Dec("30.00"), Dec("10.00")) for k in (1, 2, 2)],
                                     "product_id long, mrp decimal(10,2), cost_price decimal(10,2)")
    for ledger in (LG.stock_ledger(FX.inventory_series(src), products), LG.capped_ledger(FX.capped_demand(src), products)):
        unfolded = plan_of(ledger).split("Generate", 1)[0]
        assert "Exchange" not in unfolded and "Sort" not in unfolded and "Window" not in plan_of(ledger)


def test_ledger_of_repeated_parts(spark):
    src = source(spark)
    products = spark.createDataFrame([(k, Dec("30.00"), Dec("10.00")) for k in (1, 2, 2)],
                                     "product_id long, mrp decimal(10,2), cost_price decimal(10,2)")
    units = {(1, 2, 1): 4, (1, 2, 3): 3, (1, 3, 1): 9, (2, 2, 9): 50}
    expected = []
    for p, size, copies in ((1, 7, 1), (2, 3, 2)):
        for s in range(1, 6):
            sold = [units.get((p, s, w), 0) for w in range(1, 27) for _ in range(copies * copies)]
            initial = copies * sum(units.get((p, s, w), 0) for w in range(1, 27)) + 5 + (size * 11 + s * 17) % 180
            before, on = 0, False
            for i, u in enumerate(sold):
                week = i // (copies * copies) + 1
                on = on or (week >= 9 and before * 100 < 35 * initial)
                expected.append((p, s, week, initial - before, u, initial - before - u, on))
                before += u
    for weekly in (FX.inventory_series(src), FX.inventory_inputs(src)):
        got = LG.stock_ledger(weekly, products).select("product_id", "store_id", "week_number", "opening_stock", "units_sold",
                                                       "closing_stock", F.col("markdown_pct") > 0).collect()
        assert sorted(tuple(r) for r in got) == sorted(expected)


def test_a_job_stages_the_tables_it_reads_only(spark):
    from tests.conftest import SF_SMALL
    from tillpoint.sources.warehouse import Warehouse
    w = Warehouse(spark, SF_SMALL)
    w["clean_transactions"].count()
    assert "fact_inventory" not in w.timings and "dim_products" not in w.timings
    assert set(w.tables()) > {"fact_inventory", "fact_sales_targets"}


def test_marked_rows_are_the_clean_ones(spark):
    data = [(f"T{i % 7}", None if i % 11 == 0 else dt.date(2020, 1 + i % 3, 1), None if i % 5 == 0 else i % 2, i % 3, 1 if i % 4 else 0,
             Dec(i % 4 - 1)) for i in range(400)]
    t = spark.createDataFrame(data, "transaction_id string, transaction_date date, customer_id long, product_id long, "
                                    "quantity int, revenue decimal(12,2)")
    for c in set(A.CLEAN_COLUMNS) - set(t.columns):
        t = t.withColumn(c, F.lit(0))
    near = t.withColumn("m", F.trunc("transaction_date", "month")).withColumn("piece", F.pmod(F.xxhash64(*A.DEDUP_KEYS), F.lit(3)))
    marked = A.mark_clean(near, ["m", "piece"])
    cols = list(t.columns)
    assert rows(marked.filter(A.IS_CLEAN), cols[:4] + ["revenue"]) == rows(A.clean_transactions(t), cols[:4] + ["revenue"])
    assert marked.count() == 400
    # the raw and the clean table share one exchange and one sort
    assert plan_of(marked).count("Exchange") == 1 and plan_of(marked).count("Sort ") == 1


def inventory(spark):
    """(product, store, week, opening, closing): NULL weeks and stores, repeated rows with other stock."""
    data = [(p, None if s == 3 else s, None if (p + w) % 9 == 0 else w, 100 - w + d, 90 - w + d, Dec("0.25") if w > 3 else Dec("0.00"))
            for p in range(1, 8) for s in range(1, 4) for w in range(1, 9) for d in range(1 + p % 2)]
    return (spark.createDataFrame(data, "product_id long, store_id long, week_number int, opening_stock int, closing_stock int, "
                                        "markdown_pct decimal(5,2)")
            .withColumn("units_sold", F.lit(1)).withColumn("closing_stock_reported", F.col("closing_stock"))
            .withColumn("week_date", F.lit(dt.date(2020, 1, 1))).withColumn("revenue", F.lit(Dec("3.00")).cast("decimal(12,2)"))
            .withColumn("days_on_shelf", F.col("week_number") * 7))


def test_last_snapshot_and_first_markdown_without_a_sort_of_the_inventory(spark):
    i = inventory(spark)
    p = spark.createDataFrame([(k, "Tops", Dec("10"), Dec("30")) for k in range(1, 8)],
                              "product_id long, category string, cost_price decimal(10,2), mrp decimal(10,2)")
    w = Window.partitionBy("product_id").orderBy(F.col("week_number").desc(), F.col("store_id").desc(), F.col("opening_stock").desc())
    last = i.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    got = INV.dead_stock(i, p, st_below=2.0, min_units=-1)
    cols = ["product_id", "store_id", "week_number", "opening_stock", "closing_stock"]
    assert rows(got, cols) == rows(last, cols)
    # the rows of the inventory meet a hash aggregate; what is sorted is a row per location
    assert "HashAggregate(keys=[product_id" in plan_of(got) and "partial_max_by" in plan_of(got)
    assert "SortAggregate" not in plan_of(got) and "ObjectHashAggregate" not in plan_of(got)
    w = Window.partitionBy("product_id").orderBy("store_id", "week_number", F.col("opening_stock").desc())
    first = i.filter("markdown_pct > 0").withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    got = LG.first_markdown_event(i).select("product_id", "store_id", F.col("markdown_week").alias("week_number"),
                                            F.col("stock_at_markdown").alias("opening_stock"))
    assert rows(got) == rows(first, got.columns)


def test_skus_are_counted_from_masks_of_weeks(spark):
    i = inventory(spark).withColumn("week_number", F.col("week_number") * 40 - 100)
    p = spark.createDataFrame([(k, "Tops" if k % 2 else None, "Winter" if k % 3 else "Summer") for k in (1, 2, 3, 4, 5, 6, 6)] + [(6, "Tops", "Summer")],
                              "product_id long, category string, season string")
    got = INV.sell_through_cohort(i, p, max_week=200)
    expected = (i.filter("week_number <= 200").join(p, "product_id").groupBy("category", "season", "week_number")
                .agg(F.countDistinct("product_id").alias("sku_count")))
    assert rows(got, ["category", "season", "week_number", "sku_count"]) == rows(expected)
    assert "Expand" not in plan_of(got) and "count(distinct" not in plan_of(got)


def test_training_rows_are_dealt_by_their_number(spark, monkeypatch):
    frame = spark.range(1000).select((F.col("id") % 97).alias("a"), F.col("id").alias("b")).coalesce(1)
    assert K.dealt(frame, ["a", "b"]).rdd.getNumPartitions() == 1
    monkeypatch.setattr(K, "TRAIN_ROWS_PER_TASK", 100)
    parts = K.dealt(frame, ["a", "b"]).rdd.glom().map(len).collect()
    assert len(parts) == 10 and sum(parts) == 1000 and max(parts) < 300


def test_passes_over_the_model_frame_do_not_join_the_products_again(spark, wh):
    assert "Join" not in plan_of(catalog.labelled(wh))
    stored = K.model_input(wh["clean_transactions"], wh["dim_products"], catalog.P.label_seed)
    assert rows(catalog.model_input(wh)) == rows(stored, catalog.model_input(wh).columns)
