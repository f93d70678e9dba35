"""Revenue, season and store jobs.

Scale notes
* Everything that groups by a dimension attribute (category, store) first
  aggregates the fact by the dimension key, then joins the (now small)
  aggregate to the dimension: the fact table is shuffled once, by key, with
  map-side partial aggregation.
* Windows without PARTITION BY (MoM lag, rolling mean, ranks, overall means)
  run only on already-reduced rows: one row per month, store or season.
* Inner joins that only drop orphans are written as ``left_semi`` joins
  against the dimension's key (no columns carried, no fan-out).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.functions import labels as L
from tillpoint.functions.exprs import count_if, dbl, mean, month_key, nz, pct, ratio, round_up, sum_if
from tillpoint.operators import bitmaps
from tillpoint.operators.rank import global_ranks
from tillpoint.sources.layout import MONTH

UNB = Window.unboundedPreceding


# J12 ----------------------------------------------------------------------------
def distinct_count(c: str, approx: bool = False, rsd: float = 0.01) -> F.Column:
    """Exact COUNT(DISTINCT c) (two-phase aggregation with Expand when several
    appear together) or, as an option at scale, a HyperLogLog++ estimate."""
    return F.approx_count_distinct(c, rsd) if approx else F.countDistinct(c)


def monthly_revenue(tc: DataFrame, approx_distinct: bool = False) -> DataFrame:
    """Per month: transactions, unique customers, revenue, profit, margin %,
    mean discount %, previous month, MoM %, rolling 3-month mean, YTD."""
    d = F.col("transaction_date")
    m = (tc.groupBy(month_key(d).alias("month"), F.year(d).alias("yr"), F.month(d).alias("mo"))
           .agg(distinct_count("transaction_id", approx_distinct).alias("transactions"),
                distinct_count("customer_id", approx_distinct).alias("unique_customers"),
                F.sum("revenue").alias("gross_revenue"),
                F.sum(F.col("revenue") - F.col("cost")).alias("gross_profit"),
                mean("discount_pct").alias("_avg_disc")))
    return _monthly_measures(m)


def _monthly_measures(m: DataFrame) -> DataFrame:
    """The output of ``monthly_revenue`` from one row of totals per month."""
    by_month = Window.orderBy("month")
    prev = F.lag("gross_revenue").over(by_month)
    roll = by_month.rowsBetween(-2, 0)
    ytd = Window.partitionBy("yr").orderBy("mo").rowsBetween(UNB, 0)
    return (m.select(
        "month", "transactions", "unique_customers",
        F.round("gross_revenue", 0).alias("gross_revenue_inr"),
        F.round("gross_profit", 0).alias("gross_profit_inr"),
        pct("gross_profit", "gross_revenue", 1).alias("gross_margin_pct"),
        round_up(F.col("_avg_disc") * F.lit(100.0), 2).alias("avg_discount_pct"),
        prev.alias("prev_month_revenue"),
        round_up(dbl(F.col("gross_revenue") - prev) / dbl(nz(prev)) * F.lit(100.0), 1).alias("mom_growth_pct"),
        round_up(dbl(F.sum("gross_revenue").over(roll)) / dbl(F.count("gross_revenue").over(roll)), 0)
        .alias("rolling_3m_avg_revenue"),
        F.sum("gross_revenue").over(ytd).alias("ytd_revenue"))
        .orderBy("month"))


def daily_sales(tc: DataFrame) -> DataFrame:
    """Partials of a day: totals that add up to those of any longer period."""
    return (tc.groupBy("transaction_date")
              .agg(F.sum("revenue").alias("revenue"), F.sum(F.col("revenue") - F.col("cost")).alias("profit"),
                   F.sum("discount_pct").alias("discount"), F.count("discount_pct").alias("discounts")))


def daily_ids(tc: DataFrame, id_col: str) -> DataFrame:
    """Partials of a day: bitmaps of the ids that occur."""
    return bitmaps.id_bitmaps(tc, {"transaction_date": F.col("transaction_date")}, id_col)


def monthly_revenue_rollup(tc: DataFrame, days: DataFrame, buyers: DataFrame) -> DataFrame:
    """``monthly_revenue`` from ``daily_sales`` and the ``daily_ids`` of customers. Transaction ids are
    text and may be any: they are counted from the rows, as the only distinct count of that
    plan, and joined per month."""
    d = F.col("transaction_date")
    month = month_key(d)
    totals = (days.groupBy(month.alias("month"), F.year(d).alias("yr"), F.month(d).alias("mo"))
              .agg(F.sum("revenue").alias("gross_revenue"), F.sum("profit").alias("gross_profit"),
                   (dbl(F.sum("discount")) / dbl(nz(F.sum("discounts")))).alias("_avg_disc")))
    customers = bitmaps.count_ids(bitmaps.merge(buyers, {"month": month}), ["month"], "_customers")
    ids = tc.groupBy(month.alias("month")).agg(F.countDistinct("transaction_id").alias("transactions"))
    return _monthly_measures(totals.join(ids, "month").join(customers, "month", "left")
                             .withColumn("unique_customers", F.coalesce("_customers", F.lit(0))))


def reach(tc: DataFrame) -> DataFrame:
    """Unique customers, products and stores of every month, year and of all time, each level merged
    from the bitmaps of the level below, starting with days."""
    d = F.col("transaction_date")
    parts = []
    for id_col, out in (("customer_id", "customers"), ("product_id", "products"), ("store_id", "stores")):
        months = bitmaps.merge(daily_ids(tc, id_col), {"period": month_key(d)})
        years = bitmaps.merge(months, {"period": F.substring("period", 1, 4)})
        ever = bitmaps.merge(years, {"period": F.lit("all")})
        counts = [bitmaps.count_ids(x, ["period"], "n") for x in (months, years, ever)]
        parts += [c.select("period", F.lit(out).alias("counted"), "n") for c in counts]
    return reduce(DataFrame.unionByName, parts)


# J13 ----------------------------------------------------------------------------
def revenue_leakage(tc: DataFrame, p: DataFrame, s: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """|price x qty - revenue| above the tolerance, bucketed by the signed gap."""
    raw_gap = F.col("unit_price") * F.col("quantity") - F.col("revenue")
    x = (tc.filter(F.abs(raw_gap) > F.lit(tolerance))
           .join(p.select("product_id"), "product_id", "left_semi")
           .join(s.select("store_id"), "store_id", "left_semi")
           .withColumn("revenue_gap", F.round(raw_gap, 2)))
    gap = F.col("revenue_gap")
    bucket = (F.when(gap > L.LEAK_HIGH_ABOVE, F.lit(L.LEAK_HIGH))
               .when(gap > L.LEAK_MEDIUM_ABOVE, F.lit(L.LEAK_MEDIUM))
               .when(gap > 0, F.lit(L.LEAK_LOW))
               .otherwise(F.lit(L.LEAK_OVERBILLING)))
    return (x.withColumn("leakage_category", bucket)
             .withColumn("_abs", F.abs(gap))
             .groupBy("leakage_category")
             .agg(F.count(F.lit(1)).alias("transaction_count"),
                  F.round(F.sum("_abs"), 0).alias("total_leakage_inr"),
                  round_up(mean("_abs"), 0).alias("avg_gap_per_txn"),
                  F.countDistinct("store_id").alias("stores_affected"),
                  F.countDistinct("product_id").alias("products_affected"))
             .orderBy(F.col("total_leakage_inr").desc(), "leakage_category"))


# J14 ----------------------------------------------------------------------------
def store_scorecard(tc: DataFrame, g: DataFrame, s: DataFrame) -> DataFrame:
    """Per store over its target months: target, actual, attainment, gap,
    months below 80 % / at 100 %+, revenue rank and attainment rank."""
    actuals = (tc.groupBy("store_id", month_key("transaction_date").alias("month"))
                 .agg(F.sum("revenue").alias("act_revenue")))
    x = (g.select("store_id", "month", "target_revenue")
          .join(s.select("store_id", "store_name", "region", "channel"), "store_id")
          .join(actuals, ["store_id", "month"], "left")
          .withColumn("actual_revenue", F.coalesce(F.col("act_revenue"), F.lit(0)))
          .withColumn("revenue_gap_inr", F.round(F.col("actual_revenue") - F.col("target_revenue"), 0))
          .withColumn("attainment_pct", pct("actual_revenue", "target_revenue", 1)))
    agg = (x.groupBy("store_id", "store_name", "region", "channel")
             .agg(F.count("month").alias("months_tracked"),
                  F.sum("target_revenue").alias("_tgt"),
                  F.sum("actual_revenue").alias("_act"),
                  F.sum("revenue_gap_inr").alias("_gap"),
                  count_if(F.col("attainment_pct") < 80).alias("months_below_80pct"),
                  count_if(F.col("attainment_pct") >= 100).alias("months_target_hit")))
    # one row per store; stores grow with the data, so the ranks are distributed
    agg = agg.withColumn("_ratio", ratio("_act", "_tgt"))
    agg = global_ranks(agg, {"_act": "revenue_rank", "_ratio": "attainment_rank"})
    return (agg.select(
        "store_id", "store_name", "region", "channel", "months_tracked",
        F.round("_tgt", 0).alias("total_target_inr"),
        F.round("_act", 0).alias("total_actual_inr"),
        pct("_act", "_tgt", 1).alias("overall_attainment_pct"),
        F.round("_gap", 0).alias("cumulative_gap_inr"),
        "months_below_80pct", "months_target_hit",
        "revenue_rank", "attainment_rank")
        .orderBy(F.col("overall_attainment_pct").desc(), "store_id"))


def missed_target_channels(monthly: DataFrame, targets: DataFrame, months: tuple[int, ...],
                           below_pct: float = 80.0) -> DataFrame:
    """Sales by channel of the store-months that missed their target by far in the given calendar
    months. Both tables are partitioned by month: the targets' filter prunes the
    months of the sales at run time."""
    missed = (targets.filter(F.month(MONTH).isin(*months) & (F.col("attainment_pct") < below_pct))
              .select("store_id", MONTH, "month", "attainment_pct"))
    return (monthly.join(missed, ["store_id", MONTH])
            .groupBy("store_id", "month", "attainment_pct", "channel")
            .agg(F.count(F.lit(1)).alias("transactions"), F.sum("quantity").alias("units"),
                 F.sum("revenue").alias("revenue")))


# J15 ----------------------------------------------------------------------------
def season_case(month_col) -> F.Column:
    e = F.when(month_col.isin(*L.SEASON_FESTIVE[1]), F.lit(L.SEASON_FESTIVE[0]))
    e = e.when(month_col.isin(*L.SEASON_HOLIDAY[1]), F.lit(L.SEASON_HOLIDAY[0]))
    e = e.when(month_col.isin(*L.SEASON_MONSOON[1]), F.lit(L.SEASON_MONSOON[0]))
    return e.otherwise(F.lit(L.SEASON_REGULAR))


def season_performance(tc: DataFrame) -> DataFrame:
    """Daily sales -> season -> days, totals, daily mean, transactions per day,
    mean order value and an index against the overall daily mean."""
    daily = (tc.groupBy("transaction_date")
               .agg(F.sum("revenue").alias("daily_revenue"),
                    F.countDistinct("transaction_id").alias("daily_transactions"),
                    round_up(mean("revenue"), 2).alias("avg_order_value"))
               .withColumn("season_type", season_case(F.month("transaction_date"))))
    by = (daily.groupBy("season_type")
               .agg(F.countDistinct("transaction_date").alias("days_in_period"),
                    F.sum("daily_revenue").alias("_rev"),
                    F.count("daily_revenue").alias("_n"),
                    F.sum("daily_transactions").alias("_txn"),
                    mean("avg_order_value").alias("_aov")))
    everything = Window.partitionBy()  # over the (at most four) season rows
    season_mean = dbl("_rev") / dbl(nz("_n"))
    overall_mean = dbl(F.sum("_rev").over(everything)) / dbl(F.sum("_n").over(everything))
    return (by.select(
        "season_type", "days_in_period",
        F.round("_rev", 0).alias("total_revenue_inr"),
        round_up(season_mean, 0).alias("avg_daily_revenue_inr"),
        round_up(dbl("_txn") / dbl(nz("days_in_period")), 0).alias("avg_daily_transactions"),
        round_up("_aov", 0).alias("avg_order_value_inr"),
        round_up(season_mean / overall_mean * F.lit(100.0), 1).alias("revenue_index"))
        .orderBy(F.col("avg_daily_revenue_inr").desc(), "season_type"))


# J16 ----------------------------------------------------------------------------
def headline_kpis(tc: DataFrame) -> DataFrame:
    """Revenue, units, cost, profit, margin %, mean order value, known customers.
    (The product join of the original adds nothing to these totals and is pruned.)"""
    k = tc.agg(F.sum("revenue").alias("total_revenue"),
               F.sum("quantity").alias("total_units"),
               F.sum("cost").alias("total_cost"),
               F.count(F.lit(1)).alias("transactions"),
               F.countDistinct("customer_id").alias("unique_customers"))
    return k.select(
        "total_revenue", "total_units", "total_cost",
        (F.col("total_revenue") - F.col("total_cost")).alias("gross_profit"),
        pct(F.col("total_revenue") - F.col("total_cost"), "total_revenue", 1).alias("gross_margin_pct"),
        round_up(ratio("total_revenue", "transactions"), 2).alias("avg_order_value"),
        "transactions", "unique_customers")


# J17 ----------------------------------------------------------------------------
def _category_totals(tc: DataFrame, p: DataFrame) -> DataFrame:
    """Revenue per category, with the all-transactions total (orphan products
    count in the total, not in any category). Aggregates by product first."""
    per_product = tc.groupBy("product_id").agg(F.sum("revenue").alias("rev"))
    per_cat = (per_product.join(p.select("product_id", "category"), "product_id", "left")
                          .groupBy("category").agg(F.sum("rev").alias("revenue")))
    return per_cat.withColumn("_total", F.sum("revenue").over(Window.partitionBy()))


def category_revenue(tc: DataFrame, p: DataFrame) -> DataFrame:
    c = _category_totals(tc, p).filter(F.col("category").isNotNull())
    return (c.select("category", "revenue", pct("revenue", "_total", 1).alias("share_pct"))
             .orderBy(F.col("revenue").desc(), "category"))


# J18 ----------------------------------------------------------------------------
def category_concentration(tc: DataFrame, p: DataFrame, k: int = 2) -> DataFrame:
    """Share of revenue held by the top-k categories (ties by name)."""
    c = _category_totals(tc, p).filter(F.col("category").isNotNull())
    top = c.orderBy(F.col("revenue").desc(), "category").limit(k)
    return (top.agg(F.count(F.lit(1)).alias("top_k"),
                    F.sum("revenue").alias("top_revenue"),
                    F.max("_total").alias("total_revenue"))
               .withColumn("top_share_pct", pct("top_revenue", "total_revenue", 1)))


# J19 ----------------------------------------------------------------------------
def festive_uplift(tc: DataFrame, months=(10, 11)) -> DataFrame:
    """Festive vs regular months: revenue per active day and their ratio (one scan)."""
    fest = F.month("transaction_date").isin(*months)
    d = F.col("transaction_date")
    one = tc.agg(sum_if(fest, F.col("revenue")).alias("festive_revenue"),
                 sum_if(~fest, F.col("revenue")).alias("regular_revenue"),
                 F.countDistinct(F.when(fest, d)).alias("festive_days"),
                 F.countDistinct(F.when(~fest, d)).alias("regular_days"))
    f_daily = ratio("festive_revenue", "festive_days")
    r_daily = ratio("regular_revenue", "regular_days")
    return one.select("festive_revenue", "regular_revenue", "festive_days", "regular_days",
                      round_up(f_daily, 0).alias("festive_daily_avg"),
                      round_up(r_daily, 0).alias("regular_daily_avg"),
                      round_up(f_daily / F.nullif(r_daily, F.lit(0.0)), 2).alias("festive_uplift_x"))


# J20 ----------------------------------------------------------------------------
def monthly_trend(tc: DataFrame) -> DataFrame:
    """Month, revenue and transaction row count (non-NULL ids)."""
    return (tc.groupBy(month_key("transaction_date").alias("month"))
              .agg(F.sum("revenue").alias("revenue"), F.count("transaction_id").alias("transactions"))
              .orderBy("month"))

