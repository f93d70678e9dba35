"""Hand-made rows for the branches the bulk test data does not reach."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as Dec

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tillpoint.functions import labels as L
from tillpoint.plans import audit as A
from tillpoint.plans import customers as C
from tillpoint.plans import inventory as INV
from tillpoint.plans import returns as R
from tillpoint.plans import risk as K
from tillpoint.plans import sales as S
from tillpoint.sources.schemas import SCHEMAS

D0 = dt.date(2024, 1, 10)


def txn(spark, data):
    """data: (id, date, customer, product, store, qty, unit_price, disc, revenue, cost)."""
    full = [(i, d, c, p, s, q, Dec(str(u)), Dec(str(di)), Dec(str(r)), Dec(str(co)), "UPI", "Online", "X")
            for i, d, c, p, s, q, u, di, r, co in data]
    return spark.createDataFrame(full, SCHEMAS["fact_transactions"])


def test_clean_keeps_lowest_id_and_filters_after_ranking(spark):
    t = txn(spark, [
        ("T2", D0, 1, 10, 1, 1, 100, 0, 100, 50),   # same key as T1, higher id
        ("T1", D0, 1, 10, 1, 0, 100, 0, 100, 50),   # lowest id but quantity 0 -> the key disappears
        ("T3", D0, None, 10, 1, 1, 100, 0, 100, 50),  # guest
        ("T4", D0, None, 10, 1, 2, 100, 0, 100, 50),  # another guest, same key -> duplicate of T3
        ("T5", D0, 2, 10, 1, 1, 100, 0, 0, 50),      # revenue 0 -> dropped
        ("T6", D0, 3, 10, 1, 1, 100, 0, 100, 50),
        ("T6", D0, 3, 10, 1, 1, 100, 0, 100, 50),    # exact duplicate
    ])
    a = rows(A.clean_transactions(t), ["transaction_id"])
    b = rows(A.clean_by_first(t), ["transaction_id"])
    assert a == b == [("T3",), ("T6",)]
    # idempotent
    assert rows(A.clean_transactions(A.clean_transactions(t)), ["transaction_id"]) == a


def test_duplicate_summary_counts(spark):
    t = txn(spark, [("A", D0, None, 1, 1, 1, 10, 0, 10, 5), ("B", D0, None, 1, 1, 1, 10, 0, 10, 5),
                    ("C", D0, None, 1, 1, 1, 10, 0, 10, 5), ("D", D0, 7, 1, 1, 1, 10, 0, 10, 5)])
    r = A.duplicate_detection(t).collect()[0]
    assert (r.total_transactions, r.duplicate_rows, r.rows_to_remove) == (4, 3, 2)
    assert r.inflated_revenue_inr == Dec("20.00")


def test_leakage_tolerance_and_bucket_edges(spark):
    p = spark.createDataFrame([(10,)], "product_id long")
    s = spark.createDataFrame([(1,)], "store_id long")
    t = txn(spark, [
        ("G1", D0, 1, 10, 1, 1, 101, 0, 100, 1),    # gap exactly 1: not leakage
        ("G2", D0, 1, 10, 1, 1, 200, 0, 100, 1),    # gap 100: LOW (not > 100)
        ("G3", D0, 1, 10, 1, 1, 600, 0, 100, 1),    # gap 500: MEDIUM (not > 500)
        ("G4", D0, 1, 10, 1, 1, 700, 0, 100, 1),    # gap 600: HIGH
        ("G5", D0, 1, 10, 1, 1, 100, 0, 150, 1),    # gap -50: overbilling
        ("G6", D0, 1, 99, 1, 1, 700, 0, 100, 1),    # orphan product: dropped by the join
    ])
    got = {r.leakage_category: r.transaction_count for r in S.revenue_leakage(t, p, s).collect()}
    assert got == {L.LEAK_LOW: 1, L.LEAK_MEDIUM: 1, L.LEAK_HIGH: 1, L.LEAK_OVERBILLING: 1}


def test_return_window_edges(spark):
    t = txn(spark, [(f"T{k}", D0, 1, 1, 1, 1, 10, 0, 10, 5) for k in range(4)])
    r = spark.createDataFrame(
        [(f"R{k}", f"T{k}", 1, 1, 1, D0 + dt.timedelta(days=d), "x", 1, Dec("1"), Dec("1"), True)
         for k, d in enumerate([0, 90, 91, -1])], SCHEMAS["fact_returns"])
    got = {x.return_id: x.date_anomaly for x in A.date_consistency(r, t).collect()}
    assert got == {"R2": L.RETURN_OUTSIDE_WINDOW, "R3": L.RETURN_BEFORE_PURCHASE}


def test_return_flags_at_exact_rates_and_reason_ties(spark):
    p = spark.createDataFrame([(1, "a", "c", "b"), (2, "b", "c", "b"), (3, "c", "c", "b")],
                              "product_id long, product_name string, category string, brand string")
    # 100 units sold each; 8 returned -> NORMAL (not > 8); 15 -> ELEVATED (not > 15); 16 -> HIGH
    t = txn(spark, [(f"T{p_}", D0, 1, p_, 1, 100, 1, 0, 100, 1) for p_ in (1, 2, 3)])
    ret = []
    for prod, n, reasons in ((1, 8, ["b", "a"]), (2, 15, [None]), (3, 16, ["z"])):
        for k in range(n):
            ret.append((f"R{prod}-{k}", f"T{prod}", prod, 1, 1, D0, reasons[k % len(reasons)], 1,
                        Dec("1"), Dec("1"), k % 2 == 0))
    r = spark.createDataFrame(ret, SCHEMAS["fact_returns"])
    got = {x.product_id: (x.return_flag, x.top_return_reason) for x in R.return_profitability(t, r, p).collect()}
    # product 1: reasons a and b tie 4-4 -> 'a'; product 2: only NULL reasons -> NULL
    assert got == {1: (L.RETURN_NORMAL, "a"), 2: (L.RETURN_ELEVATED, None), 3: (L.RETURN_HIGH, "z")}


def test_scorecard_attainment_edges(spark):
    s = spark.createDataFrame([(1, "S1", "R", "Online")], "store_id long, store_name string, region string, channel string")
    g = spark.createDataFrame([(1, "2024-01", Dec("1000")), (1, "2024-02", Dec("1000")), (1, "2024-03", Dec("1000"))],
                              "store_id long, month string, target_revenue decimal(14,2)")
    t = txn(spark, [("A", dt.date(2024, 1, 5), 1, 1, 1, 1, 800, 0, 800, 1),     # exactly 80 %
                    ("B", dt.date(2024, 2, 5), 1, 1, 1, 1, 1000, 0, 1000, 1)])  # exactly 100 %; March: 0
    r = S.store_scorecard(t, g, s).collect()[0]
    assert (r.months_tracked, r.months_below_80pct, r.months_target_hit) == (3, 1, 1)
    assert r.total_actual_inr == Dec("1800") and r.cumulative_gap_inr == Dec("-1200")


def inv_rows(spark, data):
    """data: (product, store, week, opening, closing, markdown)."""
    out = [(f"I{p}-{s}-{w}", p, s, w, D0, o, o - c, c, c, 0, Dec(str(m)), Dec("1"), Dec("1"), Dec("0"))
           for p, s, w, o, c, m in data]
    return spark.createDataFrame(out, SCHEMAS["fact_inventory"])


def test_inventory_status_edges(spark):
    p = spark.createDataFrame([(k, f"P{k}", "Tops", "B", "Winter", Dec("10"), Dec("30")) for k in range(1, 6)],
                              "product_id long, product_name string, category string, brand string, season string, "
                              "cost_price decimal(10,2), mrp decimal(10,2)")
    s = spark.createDataFrame([(1, "R")], "store_id long, region string")
    i = inv_rows(spark, [(1, 1, 1, 100, 80, 0),    # ST .20 -> AT-RISK (not < .20)
                         (2, 1, 1, 100, 65, 0),    # ST .35 -> WATCH
                         (3, 1, 1, 100, 50, 0),    # ST .50 -> WATCH
                         (4, 1, 1, 0, 0, 0),       # opening 0 -> NULL ST -> HEALTHY (dropped)
                         (5, 1, 1, 100, 90, 0.25)])  # ST .10 with markdown -> falls to HEALTHY
    got = {r.product_id: r.inventory_status for r in INV.inventory_health(i, p, s).collect()}
    assert got == {1: L.STATUS_AT_RISK, 2: L.STATUS_WATCH, 3: L.STATUS_WATCH}


def test_dead_stock_takes_latest_week_then_store(spark):
    p = spark.createDataFrame([(1, "Tops", Dec("10"), Dec("30"))],
                              "product_id long, category string, cost_price decimal(10,2), mrp decimal(10,2)")
    i = inv_rows(spark, [(1, 1, 1, 100, 90, 0), (1, 1, 2, 90, 80, 0), (1, 2, 2, 100, 95, 0)])
    r = INV.dead_stock(i, p).collect()
    assert len(r) == 1 and (r[0].store_id, r[0].week_number, r[0].closing_stock) == (2, 2, 95)


def test_big_spenders_segment(spark):
    sc = spark.createDataFrame([(1, 3, 2, 4), (2, 5, 5, 5), (3, 1, 1, 1)], "customer_id long, r_score int, f_score int, m_score int")
    got = {r.customer_id: r.seg for r in sc.select("customer_id", C.segment_rule(L.SQL_SEGMENTS).alias("seg")).collect()}
    assert got == {1: L.SQL_SEGMENTS[5], 2: L.SQL_SEGMENTS[0], 3: L.SQL_SEGMENTS[4]}


def test_equal_quantile_edges_raise(spark):
    # every customer bought on the same day: all recency edges equal -> qcut raises
    t = txn(spark, [(f"T{k}", D0, k, 1, 1, 1, 10, 0, 10 + k, 5) for k in range(10)])
    with pytest.raises(Exception, match="bin edges must be unique"):
        C.rfm_scores_qcut(t, dt.date(2024, 2, 1)).collect()


def test_churn_zero_idle_days_gives_null_winback(spark):
    c = spark.createDataFrame([(1, "n", "Gold", "R", "18-24", "Online")],
                              "customer_id long, customer_name string, loyalty_tier string, region string, "
                              "age_group string, preferred_channel string")
    t = txn(spark, [("A", D0, 1, 1, 1, 1, 9000, 0, 9000, 5)])
    from tillpoint.params import RetailParams
    r = C.churn_scored(t, c, RetailParams(as_of=D0)).collect()[0]
    assert r.days_since_last_purchase == 0 and r.estimated_winback_value is None


def test_auc_with_ties_matches_pairwise_count(spark):
    data = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.7), (0, 0.7), (0, 0.3)]
    df = spark.createDataFrame(data, "is_returned int, score double")
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
    assert K.roc_auc(df).collect()[0].roc_auc == pytest.approx(want, abs=1e-12)


def test_threshold_table_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "is_returned int, score double")
    r = {x.threshold: (x.precision, x.recall, x.flagged) for x in K.threshold_table(df, (0.5,)).collect()}
    assert r == {0.5: (Dec("0.0000"), Dec("0.0000"), 0)}


def test_duplicate_rows_with_a_hot_key_match_the_window_form(spark):
    from pyspark.sql import Window
    hot = [(f"H{k:03d}", D0, None, 1, 1, 1, 10, 0, 10, 5) for k in range(100)]      # a third of all rows
    rest = [(f"R{k:03d}", D0, k % 50, 2 + k % 7, 1, 1, 10, 0, 10, 5) for k in range(200)]
    t = txn(spark, hot + rest)
    keys = list(A.DEDUP_KEYS)
    w = Window.partitionBy(*keys)
    want = (t.withColumn("occurrence_count", F.count(F.lit(1)).over(w))
             .withColumn("row_rank", F.row_number().over(w.orderBy("transaction_id")))
             .filter(F.col("occurrence_count") > 1))
    cols = ["transaction_id", "occurrence_count", "row_rank"]
    assert rows(A.duplicate_rows(t), cols) == rows(want, cols)


def test_label_encoding(spark):
    df = spark.createDataFrame([(1, "Tops", None, "dead"), (2, None, "Online", None), (3, "Bags", "In-Store", "core")],
                               "id long, category string, channel string, heat_score string")
    cols = ["id", "cat_encoded", "ch_encoded", "heat_encoded"]
    # sorted distinct: category [Bags, Tops, Unknown]; channel [In-Store, Online, Unknown]; heat [core, dead]
    assert rows(K.categorical_index(df), cols) == [(1, 1, 2, 1), (2, 2, 1, 0), (3, 0, 0, 0)]


def test_inventory_health_last_stock_mode(spark):
    p = spark.createDataFrame([(1, "P1", "Tops", "B", "Winter", Dec("10"), Dec("30"))],
                              "product_id long, product_name string, category string, brand string, season string, "
                              "cost_price decimal(10,2), mrp decimal(10,2)")
    s = spark.createDataFrame([(1, "R")], "store_id long, region string")
    # weeks: opening 100 -> 95 -> 90; 'max' reads closing 95 (week 1), 'last' reads 88 (week 3)
    i = inv_rows(spark, [(1, 1, 1, 100, 95, 0), (1, 1, 2, 95, 90, 0), (1, 1, 3, 90, 88, 0)])
    mx = INV.inventory_health(i, p, s).collect()[0]
    last = INV.inventory_health(i, p, s, stock_mode="last").collect()[0]
    assert (mx.remaining_units, last.remaining_units) == (95, 88)
    assert float(mx.sell_through_pct) == 5.0 and float(last.sell_through_pct) == 12.0


def test_integer_average_option(spark):
    sc = spark.createDataFrame([(1, 5, 5, 5, 3, 1, Dec("10"), Dec("10")), (2, 5, 5, 5, 4, 2, Dec("10"), Dec("10"))],
                               "customer_id long, r_score int, f_score int, m_score int, recency_days int, "
                               "frequency long, monetary_value decimal(12,2), avg_order_value decimal(12,2)")
    true_mean = C.rfm_segments(sc).collect()[0]
    t_sql = C.rfm_segments(sc, integer_avg=True).collect()[0]
    assert float(true_mean.avg_recency_days) == 4.0  # 3.5 rounds half up
    assert float(t_sql.avg_recency_days) == 3.0      # AVG(int) truncates to 3
    assert float(t_sql.avg_orders) == 1.0 and float(true_mean.avg_orders) == 1.5


def test_approximate_split_is_a_projection(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("transaction_id"), (F.col("id") % 2).alias("is_returned"))
    s = K.stratified_split(df, exact=False)
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    share = s.filter(F.col("split") == "train").count() / 2000
    assert 0.70 < share < 0.80


def test_approximate_distinct_option_is_close(spark, wh):
    exact = {r.month: r.unique_customers for r in S.monthly_revenue(wh["clean_transactions"]).collect()}
    approx = {r.month: r.unique_customers for r in S.monthly_revenue(wh["clean_transactions"], approx_distinct=True).collect()}
    assert exact.keys() == approx.keys()
    assert all(abs(approx[k] - exact[k]) <= max(2, 0.05 * exact[k]) for k in exact)
    plan = S.monthly_revenue(wh["clean_transactions"], approx_distinct=True)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_orphans_count_rows_and_null_keys(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,), (9,), (9,), (9,)], "k long")
    parent = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    checks = [("child", child, parent, "k"), ("parent", parent, parent, "k"), ("empty", child.filter("k = 1"), parent, "k")]
    got = rows(A.referential_integrity(checks), ["check_name", "orphan_count"])
    assert got == [("child", 4), ("empty", 0), ("parent", 0)]
