"""Table derivations: weekly stock ledger (J25), first markdown event per
product (J24) and the store x month target spine (J26).

The ledger is a running sum per (product, store) in the order of the weeks, made in
an array: it holds one SKU-location's weeks (26 rows here, a few hundred
at most for multi-year ledgers), so no array grows with the data.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.exprs import dbl, idiv, month_key, round_up
from tillpoint.functions.labels import (DEMAND_DECAY_PER_WEEK, MARKDOWN_BELOW_SELL_THROUGH, MARKDOWN_DEMAND_LIFT,
                                        MARKDOWN_FROM_WEEKS_LIVE, UNITS_PER_TARGET_INR)
from tillpoint.operators.rank import edge_rows, global_row_number, keep_first



def as_series(weekly: DataFrame, units: str) -> DataFrame:
    """(product_id, store_id, weeks): the rows of a (product, store), a bounded group, as an array in the
    order of the weeks; series stay as they are."""
    if "weeks" in weekly.columns:
        return weekly
    return (weekly.groupBy("product_id", "store_id")
            .agg(F.sort_array(F.collect_list(F.struct("week_number", units, "initial_stock"))).alias("weeks")))


def stock_ledger(weekly_units: DataFrame, products: DataFrame, *,
                 markdown_from_week: int = 9, markdown_below_st: float = 0.35,
                 markdown_depth: float = 0.25, week1_date: dt.date = dt.date(1995, 1, 2)) -> DataFrame:
    """J25 — weekly roll-forward: opening = initial - units sold before the week,
    closing = opening - units; a markdown starts at the first week >= ``markdown_from_week``
    whose sell-through so far is below ``markdown_below_st`` and is kept afterwards.

    weekly_units: (product_id, store_id, week_number, units_sold, initial_stock), one row
    per week, or (product_id, store_id, weeks) with the weeks in order in an array; the initial stock
    is the same in all weeks of a (product, store).
    products: (product_id, mrp, cost_price).

    The running sums are made inside the array of a (product, store); its rows are only then
    unfolded, so they are neither exchanged nor sorted.
    """
    st_pct = int(round(markdown_below_st * 100))
    depth = F.lit(markdown_depth).cast("decimal(5,2)")
    prices = (products.filter(F.col("product_id").isNotNull()).groupBy("product_id")
              .agg(F.collect_list(F.struct("mrp", "cost_price")).alias("_prices")))
    x = as_series(weekly_units, "units_sold").join(prices.hint("shuffle_hash"), "product_id")
    # a product that is listed several times has as many rows a week
    x = x.withColumn("weeks", F.flatten(F.transform("weeks", lambda w: F.transform("_prices", lambda p: F.struct(
        w["week_number"].alias("week_number"), w["units_sold"].alias("units_sold"), w["initial_stock"].alias("initial_stock"),
        p["mrp"].alias("mrp"), p["cost_price"].alias("cost_price")))))).drop("_prices")
    # units sold up to each place, 0 before the first
    upto = F.aggregate("weeks", F.array(F.lit(0).cast("long")), lambda sums, w: F.concat(
        sums, F.array(F.element_at(sums, -1) + F.coalesce(w["units_sold"], F.lit(0)).cast("long"))))
    x = x.withColumn("_before", upto)
    started = F.transform("weeks", lambda w, i: F.coalesce(
        (w["week_number"] >= markdown_from_week)
        & (F.get("_before", i) * 100 < F.lit(st_pct) * w["initial_stock"]), F.lit(False)))
    x = (x.withColumn("_started", F.array_position(started, True))  # 1-based, 0: never
          # outer: Catalyst would evaluate the array twice to leave out empty ones, of which there are none
          .select("product_id", "store_id", "_before", "_started", F.posexplode_outer("weeks").alias("_place", "_week"))
          .select("product_id", "store_id", "_week.*", F.get("_before", F.col("_place")).alias("sold_before"),
                  ((F.col("_started") > 0) & (F.col("_place") + 1 >= F.col("_started"))).alias("_md_on")))
    x = (x.withColumn("opening_stock", (F.col("initial_stock") - F.col("sold_before")).cast("int"))
          .withColumn("closing_stock", (F.col("opening_stock") - F.col("units_sold")).cast("int"))
          .withColumn("markdown_pct", F.when(F.col("_md_on"), depth)
                      .otherwise(F.lit(0).cast("decimal(5,2)")).cast("decimal(5,2)"))
          .withColumn("effective_price",
                      F.round(F.col("mrp") * (F.lit(1) - F.col("markdown_pct")), 2).cast("decimal(10,2)")))
    margin = (dbl("effective_price") - dbl("cost_price")) / dbl(F.nullif(F.col("effective_price"), F.lit(0))) * F.lit(100.0)
    return x.select(
        inventory_id().alias("inventory_id"),
        "product_id", "store_id",
        F.col("week_number").cast("int").alias("week_number"),
        F.date_add(F.lit(week1_date), ((F.col("week_number") - 1) * 7).cast("int")).alias("week_date"),
        "opening_stock",
        F.col("units_sold").cast("int").alias("units_sold"),
        "closing_stock",
        F.col("closing_stock").alias("closing_stock_reported"),
        ((F.col("week_number") - 1) * 7).cast("int").alias("days_on_shelf"),
        "markdown_pct",
        "effective_price",
        round_up(margin, 2).cast("decimal(7,2)").alias("gross_margin_pct"),
        (F.col("units_sold") * F.col("effective_price")).cast("decimal(12,2)").alias("revenue"),
    )


def inventory_id() -> Column:
    """The id of a ledger row, made of its keys."""
    return F.concat_ws("-", F.lit("INV"), F.col("product_id").cast("string"), F.col("store_id").cast("string"),
                       F.col("week_number").cast("string"))


def capped_ledger(weekly_demand: DataFrame, products: DataFrame, *, markdown_pct: int = 25,
                  decay: float = DEMAND_DECAY_PER_WEEK, lift: float = MARKDOWN_DEMAND_LIFT,
                  markdown_from: int = MARKDOWN_FROM_WEEKS_LIVE,
                  below_st: float = MARKDOWN_BELOW_SELL_THROUGH) -> DataFrame:
    """Stock recurrence with sales capped at the stock (J25 with lost sales): each week's demand is
    the week's units, damped by ``exp(-decay x weeks live)`` and raised while a markdown is on;
    units sold are at most the opening stock; a markdown starts after ``markdown_from`` weeks
    with a sell-through below ``below_st`` and holds from the next week's demand on; the series ends
    when the stock is used up.

    Each week needs the one before, which no window expresses: the weeks of a (product, store),
    one bounded group, are folded in order by ``aggregate``, in the JVM.

    weekly_demand: (product_id, store_id, week_number, units, initial_stock), or (product_id, store_id, weeks)
    with the weeks in an array; weeks count from 1. The price joins a (product, store) before its
    weeks are unfolded.
    NULL units count as none; a location without stock has no rows."""
    weeks = as_series(weekly_demand, "units").select(
        "product_id", "store_id", F.array_max("weeks.initial_stock").cast("long").alias("initial"),
        F.sort_array(F.transform("weeks", lambda w: F.struct(
            w["week_number"].alias("week_number"), F.coalesce(w["units"], F.lit(0)).alias("units")))).alias("weeks"))
    below = int(round(below_st * 100))

    def step(state, week):
        live, opening, on = week["week_number"] - 1, state["stock"], state["pct"]
        wanted = (week["units"].cast("double") * F.exp(F.lit(-decay) * live.cast("double"))
                  * (F.lit(1.0) + F.lit(lift) * on.cast("double") / F.lit(100.0)))
        demand = F.floor(F.round(wanted, 6)).cast("long")
        sold = F.least(demand, opening)
        starts = (on == 0) & (live >= markdown_from) & ((state["initial"] - opening) * 100 < F.lit(below) * state["initial"])
        pct_now = F.when(starts, F.lit(markdown_pct)).otherwise(on).cast("int")
        row = F.struct(week["week_number"].cast("int").alias("week_number"), opening.alias("opening"),
                       demand.alias("demand"), sold.alias("sold"), pct_now.alias("pct"))
        after = F.struct(state["initial"].alias("initial"), (opening - sold).alias("stock"), pct_now.alias("pct"),
                         F.concat(state["rows"], F.array(row)).alias("rows"))
        return F.when(opening > 0, after).otherwise(state)

    none = F.array().cast("array<struct<week_number:int,opening:bigint,demand:bigint,sold:bigint,pct:int>>")
    start = F.struct(F.col("initial").alias("initial"), F.col("initial").alias("stock"), F.lit(0).alias("pct"), none.alias("rows"))
    prices = products.select("product_id", "mrp").hint("shuffle_hash")
    rows = weeks.join(prices, "product_id").select(
        "product_id", "store_id", "mrp", F.inline_outer(F.aggregate("weeks", start, step, lambda s: s["rows"]))).filter(F.col("opening").isNotNull())
    share = (F.col("pct").cast("decimal(5,2)") / F.lit(100)).cast("decimal(5,2)")
    priced = (rows
              .withColumn("markdown_pct", share)
              .withColumn("effective_price", F.round(F.col("mrp") * (F.lit(1) - F.col("markdown_pct")), 2).cast("decimal(10,2)")))
    return priced.select("product_id", "store_id", "week_number", F.col("opening").alias("opening_stock"), "demand",
                         F.col("sold").alias("units_sold"), (F.col("opening") - F.col("sold")).alias("closing_stock"),
                         (F.col("demand") - F.col("sold")).alias("lost_units"), "markdown_pct", "effective_price",
                         (F.col("sold") * F.col("effective_price")).cast("decimal(14,2)").alias("revenue"))


def first_markdown_event(inventory: DataFrame, nominal_stock: int = 150) -> DataFrame:
    """J24 — one row per product: the first inventory row with a markdown,
    first by store then week. Sell-through is measured against a nominal stock."""
    columns = ["week_number", "week_date", "markdown_pct", "days_on_shelf", "opening_stock"]
    per_store = edge_rows(inventory.filter(F.col("markdown_pct") > 0), ["product_id", "store_id"], "week_number", "opening_stock", columns)
    first = keep_first(per_store, ["product_id"], [F.col("store_id").asc()])
    st = F.lit(1.0) - dbl("opening_stock") / F.lit(float(nominal_stock))
    # sequential, zero-padded ids in product order (distributed row number)
    first = global_row_number(first, [F.col("product_id").asc()], out="_seq")
    return first.select(
        F.format_string("MD-%05d", F.col("_seq")).alias("markdown_id"),
        "product_id", "store_id",
        F.col("week_date").alias("markdown_date"),
        F.col("week_number").alias("markdown_week"),
        "markdown_pct",
        F.col("days_on_shelf").alias("days_on_shelf_at_md"),
        F.col("opening_stock").alias("stock_at_markdown"),
        round_up(st, 4).cast("decimal(7,4)").alias("sell_through_at_md"),
        F.lit("Auto-trigger").alias("approved_by"),
        F.lit("Slow-mover").alias("markdown_type"),
    )


def month_span(clean_txn: DataFrame) -> tuple[dt.date, int]:
    """First month and number of months of the sales, from one aggregate (one row)."""
    first, last = clean_txn.agg(F.min("transaction_date"), F.max("transaction_date")).first()
    if first is None:
        return dt.date(1970, 1, 1), 0
    return first.replace(day=1), (last.year - first.year) * 12 + last.month - first.month + 1


def target_spine(stores: DataFrame, clean_txn: DataFrame, *, rule, start: dt.date | None = None,
                 months: int | None = None) -> DataFrame:
    """J26 — store x month grid: target by ``rule(store_id, month_index)``,
    actual revenue from clean transactions (0 where none), units at 900 INR,
    attainment %. The months are those of the sales; ``start`` and ``months`` override
    the first month and their number. The grid is generated with ``explode(sequence)``
    per store."""
    if start is None or months is None:
        first, count = month_span(clean_txn)
        start, months = start or first, count if months is None else months
    if months <= 0:
        stores = stores.filter("false")
    grid = (stores.select("store_id")
                  .withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(max(0, months - 1)))))
                  .withColumn("month", month_key(F.add_months(F.lit(start), F.col("m")))))
    actual = (clean_txn.groupBy("store_id", month_key("transaction_date").alias("month"))
                       .agg(F.sum("revenue").alias("actual")))
    g = (grid.join(actual, ["store_id", "month"], "left")
             .withColumn("target_revenue", rule(F.col("store_id"), F.col("m")).cast("decimal(14,2)"))
             .withColumn("actual_revenue", F.coalesce(F.col("actual"), F.lit(0)).cast("decimal(14,2)")))
    return g.select(
        F.concat_ws("-", F.lit("TGT"), F.col("store_id").cast("string"), F.col("month")).alias("target_id"),
        "store_id", "month",
        F.lit(None).cast("string").alias("category"),
        "target_revenue", "actual_revenue",
        idiv(F.col("target_revenue"), UNITS_PER_TARGET_INR).cast("int").alias("target_units"),
        idiv(F.col("actual_revenue"), UNITS_PER_TARGET_INR).cast("int").alias("actual_units"),
        round_up(dbl("actual_revenue") / dbl(F.nullif(F.col("target_revenue"), F.lit(0))) * F.lit(100.0), 2)
        .cast("decimal(8,2)").alias("attainment_pct"),
    )
