"""Canonical retail tables derived from the driver's TPC-H-style test tables.

The mapping is deterministic and uses integer arithmetic in cents, so the
same tables can be rebuilt by any SQL engine (see ``tillpoint.oracle``).
Faults are injected by key arithmetic: duplicate rows, NULL customers and
payment methods, orphan products / stores / transactions, prices above MRP or
below half of cost, extreme discounts, revenue gaps, early and late returns,
and negative reported stock.

Everything here is a lazy DataFrame plan: scans, projections, one
lineitem-orders equi-join on the order key, and dimension joins that Spark /
AQE broadcast only when their measured size is under the threshold.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.functions.exprs import idiv, money_from_cents
from tillpoint.functions.labels import RETURN_REASONS

# Fixture rules (our own, documented in FIXTURES.md §3) ------------------------
CATEGORY_BY_TYPE = {
    "PROMO": "Footwear",
    "LARGE": "Dresses",
    "ECONOMY": "Outerwear",
    "MEDIUM": "Tops",
    "SMALL": "Bottoms",
    "STANDARD": "Accessories",
}
SEASON_BY_SIZE_MOD4 = ("Festive", "Winter", "Summer", "Monsoon")
HEAT_BY_SIZE_MOD5 = ("hero", "core", "core", "slow", "dead")
GENDER_BY_KEY_MOD4 = ("Men", "Women", "Unisex", "Kids")
CHANNELS = ("In-Store", "Online", "Omnichannel")
AGE_GROUPS = ("18-24", "25-34", "35-44", "45-54", "55+")
# loyalty tier by account-balance band: < 1700 Bronze, < 4300 Silver, < 7350 Gold, else Platinum
TIER_BOUNDS = ((1700.0, "Bronze"), (4300.0, "Silver"), (7350.0, "Gold"))
TIER_TOP = "Platinum"
# Orphans are injected on the fact side: lines of these orders carry a negated
# product / store key, which no dimension holds. The dimensions stay whole.
ORPHAN_PRODUCT_MOD, ORPHAN_PRODUCT_REM = 400, 399
ORPHAN_STORE_MOD, ORPHAN_STORE_REM = 60, 59
INVENTORY_STORES = 5
INVENTORY_WEEKS = 26
INVENTORY_EPOCH = dt.date(1995, 1, 1)
INVENTORY_WEEK1 = dt.date(1995, 1, 2)
LAUNCH_EPOCH = dt.date(1995, 1, 1)

REGIONS_BROADCAST = 1 << 19  # suppliers; a key and a region take about 40 bytes
SPREAD = 1 << 16

SOURCE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def read_source(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in SOURCE_TABLES}


def _pick(key, values) -> F.Column:
    """values[key % len(values)] as a CASE chain (no array literal per row)."""
    k = F.col(key) if isinstance(key, str) else key
    m = k % len(values)
    e = None
    for i, v in enumerate(values):
        e = F.when(m == i, F.lit(v)) if e is None else e.when(m == i, F.lit(v))
    return e


def part_pricing(part: DataFrame) -> DataFrame:
    """All parts with MRP and cost in cents (used for every transaction)."""
    mrp_c = F.round(F.col("p_retailprice") * 100).cast("long")
    return part.select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size",
        mrp_c.alias("mrp_c"),
        idiv(mrp_c * (F.lit(28) + F.col("p_size") % 20), 100).alias("cost_c"),
    )


def dim_products(src: dict[str, DataFrame]) -> DataFrame:
    p = part_pricing(src["part"])
    cat = None
    for t, c in CATEGORY_BY_TYPE.items():
        cat = F.when(F.col("p_type") == t, F.lit(c)) if cat is None else cat.when(F.col("p_type") == t, F.lit(c))
    key = F.col("p_partkey")
    return p.select(
        key.alias("product_id"),
        F.col("p_name").alias("product_name"),
        cat.alias("category"),
        F.col("p_type").alias("sub_category"),
        F.col("p_brand").alias("brand"),
        _pick(key, GENDER_BY_KEY_MOD4).alias("gender"),
        money_from_cents("cost_c", 10).alias("cost_price"),
        money_from_cents("mrp_c", 10).alias("mrp"),
        _pick(F.col("p_size"), SEASON_BY_SIZE_MOD4).alias("season"),
        F.date_add(F.lit(LAUNCH_EPOCH), (key % 180).cast("int")).alias("launch_date"),
        F.concat(F.lit("SUP-"), F.lpad((key % 40).cast("string"), 3, "0")).alias("supplier_code"),
        F.when(key % 8 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Vendor "), (key % 40).cast("string"))).alias("supplier_name"),
        F.when(key % 20 == 0, F.lit(None).cast("string"))
        .otherwise(F.substring_index(F.col("p_name"), " ", 1)).alias("color"),
        _pick(F.col("p_size"), HEAT_BY_SIZE_MOD5).alias("heat_score"),
    )


def _supplier_region(src) -> DataFrame:
    geo = src["nation"].join(src["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "n_name", "r_name")
    # nation x region is 25 rows by definition of the schema: a proven bound
    return src["supplier"].join(F.broadcast(geo), F.col("s_nationkey") == F.col("n_nationkey"))


def dim_stores(src: dict[str, DataFrame]) -> DataFrame:
    s = _supplier_region(src)
    key = F.col("s_suppkey")
    return s.select(
        key.alias("store_id"),
        F.col("s_name").alias("store_name"),
        F.col("r_name").alias("region"),
        _pick(key, CHANNELS).alias("channel"),
        (F.lit(1200) + (key * 131) % 6800).cast("int").alias("store_size_sqft"),
        F.date_add(F.lit(dt.date(1990, 1, 1)), (key % 1500).cast("int")).alias("opening_date"),
        F.lit(None).cast("string").alias("store_manager"),
        money_from_cents(F.lit(8000000) + (key * 7919) % 52000000, 12).alias("monthly_rent_inr"),
        F.when(key % 12 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("store"), key.cast("string"), F.lit("@retail.test"))).alias("contact_email"),
    )


def dim_customers(src: dict[str, DataFrame]) -> DataFrame:
    geo = src["nation"].join(src["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "n_name", "r_name")
    c = src["customer"].join(F.broadcast(geo), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    bal = F.col("c_acctbal")
    tier = None
    for bound, name in TIER_BOUNDS:
        tier = F.when(bal < bound, F.lit(name)) if tier is None else tier.when(bal < bound, F.lit(name))
    tier = tier.otherwise(F.lit(TIER_TOP))
    return c.select(
        key.alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.when(key % 17 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("c"), key.cast("string"), F.lit("@mail.test"))).alias("email"),
        F.when(key % 25 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("+91-"), F.lpad(key.cast("string"), 10, "0"))).alias("phone"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("region"),
        _pick(key, ("Male", "Female", "Other")).alias("gender"),
        _pick(key, AGE_GROUPS).alias("age_group"),
        tier.alias("loyalty_tier"),
        F.date_add(F.lit(dt.date(1992, 1, 1)), (key % 1000).cast("int")).alias("registration_date"),
        _pick(key, CHANNELS).alias("preferred_channel"),
    )


def _orphaned(key: str, order_key, mod: int, rem: int) -> F.Column:
    return F.when(order_key % mod == rem, -F.col(key)).otherwise(F.col(key))


def joined_lines(src: dict[str, DataFrame], pieces: int = 0) -> DataFrame:
    """One row per lineitem with what ``line_columns`` needs of its order, part and supplier. ``pieces``: the rows lie
    in so many partitions by ``l_partkey``, where they met their part. Regions of up to ``REGIONS_BROADCAST``
    suppliers are broadcast, behind all exchanges."""
    li = src["lineitem"].select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_discount", "l_returnflag", "l_linestatus", F.col("l_shipdate").cast("date").alias("l_shipdate"))
    o = src["orders"].select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority")
    pr = part_pricing(src["part"]).select("p_partkey", "mrp_c", "cost_c")
    sr = _supplier_region(src).select(F.col("s_suppkey"), F.col("r_name").alias("store_region"))
    few = src["supplier"].count() <= REGIONS_BROADCAST
    located = lambda x: x.join(F.broadcast(sr) if few else sr, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    lines = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
    lines = lines if few else located(lines)
    if pieces:
        lines, pr = lines.repartition(pieces, "l_partkey"), pr.repartition(pieces, "p_partkey")
    lines = lines.join(pr, F.col("l_partkey") == F.col("p_partkey"))
    return (located(lines) if few else lines).drop("p_partkey", "s_suppkey")


def part_spread(lineitem: DataFrame) -> tuple[int, int, int | None]:
    """(lines, most lines in one of ``SPREAD`` hash buckets of the part, lowest part)."""
    buckets = (lineitem.groupBy(F.pmod(F.xxhash64("l_partkey"), F.lit(SPREAD)).alias("_b"))
               .agg(F.count(F.lit(1)).alias("n"), F.min("l_partkey").alias("k")))
    r = buckets.agg(F.sum("n").alias("lines"), F.max("n").alias("most"), F.min("k").alias("lowest")).first()  # one row
    return r["lines"] or 0, r["most"] or 0, r["lowest"]


def transaction_lines(src: dict[str, DataFrame]) -> DataFrame:
    """One row per lineitem with the transaction columns in cents plus the
    lineitem fields the returns mapping needs. Not yet duplicated."""
    return line_columns(joined_lines(src))


def line_columns(x: DataFrame, *others: str) -> DataFrame:
    """The columns of ``transaction_lines``, spelt out from ``joined_lines``, and those of ``others`` that are not
    among them."""
    ok = F.col("l_orderkey")
    qty = F.col("l_quantity").cast("int")
    dp = F.when(ok % 200 == 1, F.lit(75)).otherwise(F.round(F.col("l_discount") * 100).cast("long") * 5)
    up = (F.when(ok % 200 == 0, idiv(F.col("mrp_c") * 110, 100))
           .when(ok % 200 == 2, idiv(F.col("cost_c") * 40, 100))
           .otherwise(idiv(F.col("mrp_c") * (F.lit(100) - F.col("dp")), 100)))
    adj = (F.when(ok % 50 == 0, F.lit(70000)).when(ok % 50 == 1, F.lit(25000))
            .when(ok % 50 == 2, F.lit(5000)).when(ok % 50 == 3, F.lit(-5000)).otherwise(F.lit(0)))
    tid = F.concat_ws("-", ok.cast("string"), F.col("l_linenumber").cast("string"),
                      F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                      F.date_format(F.col("l_shipdate").cast("date"), "yyyyMMdd"))
    return (x.withColumn("dp", dp)
             .withColumn("up_c", up)
             .withColumn("qty", qty)
             .withColumn("rev_c", F.col("up_c") * F.col("qty") - adj)
             .select(
                 tid.alias("transaction_id"),
                 F.col("o_orderdate").cast("date").alias("transaction_date"),
                 F.when(ok % 14 == 0, F.lit(None).cast("long")).otherwise(F.col("o_custkey")).alias("customer_id"),
                 _orphaned("l_partkey", ok, ORPHAN_PRODUCT_MOD, ORPHAN_PRODUCT_REM).alias("product_id"),
                 _orphaned("l_suppkey", ok, ORPHAN_STORE_MOD, ORPHAN_STORE_REM).alias("store_id"),
                 F.col("qty").alias("quantity"),
                 money_from_cents("up_c", 10).alias("unit_price"),
                 (F.col("dp").cast("decimal(18,0)") / F.lit(100)).cast("decimal(5,2)").alias("discount_pct"),
                 money_from_cents("rev_c", 12).alias("revenue"),
                 money_from_cents(F.col("cost_c") * F.col("qty"), 12).alias("cost"),
                 F.when(ok % 25 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("payment_method"),
                 _pick(ok + F.col("l_linenumber"), CHANNELS).alias("channel"),
                 F.col("store_region").alias("region"),
                 F.col("rev_c"), ok.alias("l_orderkey"), F.col("l_linenumber"),
                 F.col("l_returnflag"), F.col("l_linestatus"),
                 *[c for c in others if c not in ("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")],
             ))


TRANSACTION_COLUMNS = ("transaction_id", "transaction_date", "customer_id", "product_id", "store_id",
                       "quantity", "unit_price", "discount_pct", "revenue", "cost", "payment_method",
                       "channel", "region")


def fact_transactions(lines: DataFrame, others: Sequence[str] = ()) -> DataFrame:
    """Raw transactions: every line once, plus a second exact copy of the lines
    with (orderkey * 7 + linenumber) % 67 = 0. Copies are generated with
    ``explode`` in the same pass: no second scan, no self-join. ``others``: further columns to keep."""
    copies = F.when((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 67 == 0, F.lit(2)).otherwise(F.lit(1))
    return (lines.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
                 .select(*TRANSACTION_COLUMNS, *others))


def fact_returns(lines: DataFrame) -> DataFrame:
    ok = F.col("l_orderkey")
    r = lines.filter((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
                     & F.col("customer_id").isNotNull())
    shift = (F.when(ok % 97 == 0, F.lit(-3)).when(ok % 97 == 1, F.lit(120))
              .otherwise(F.col("l_linenumber") * 5))
    return r.select(
        F.concat(F.lit("R-"), F.col("transaction_id")).alias("return_id"),
        F.when(ok % 101 == 0, F.concat(F.lit("X"), F.col("transaction_id")))
        .otherwise(F.col("transaction_id")).alias("transaction_id"),
        "product_id", "customer_id", "store_id",
        F.date_add(F.col("transaction_date"), shift.cast("int")).alias("return_date"),
        _pick(ok + F.col("l_linenumber"), RETURN_REASONS).alias("return_reason"),
        F.col("quantity").alias("quantity_returned"),
        money_from_cents(idiv(F.col("rev_c") * (F.lit(85) + ok % 15), 100), 12).alias("refund_amount"),
        money_from_cents(idiv(F.col("rev_c") * 8, 100), 10).alias("restocking_cost"),
        (ok % 7 >= 2).alias("resaleable"),
    )


def _weekly_stock(src: dict[str, DataFrame], initial_stock, units: str) -> DataFrame:
    """(product_id, store_id, weeks) per product and store, zeros where nothing shipped: the weeks in order as an
    array of (week_number, ``units``, initial_stock). ``initial_stock(store_id, p_size, total)``.

    The lines meet at their product once; everything after that, up to the weeks themselves, stays in that
    partition, so the grid of products, stores and weeks is never exchanged nor sorted. A part that is
    listed several times has as many entries a week, and its total counts each."""
    week = (F.lit(1) + (idiv(F.datediff(F.col("l_shipdate").cast("date"), F.lit(INVENTORY_EPOCH)), 7)
                        % INVENTORY_WEEKS)).cast("int")
    lines = (src["lineitem"]
             .select(F.col("l_partkey").alias("product_id"),
                     (F.lit(1) + F.col("l_suppkey") % INVENTORY_STORES).alias("store_id"),
                     week.alias("week_number"), F.col("l_quantity").cast("int").alias("q"))
             .filter(F.col("product_id").isNotNull() & F.col("store_id").isNotNull())
             .repartition("product_id"))
    shipped = (lines.groupBy("product_id", "store_id")
               .agg(*[F.sum(F.when(F.col("week_number") == k, F.col("q"))).alias(f"w{k}")
                      for k in range(1, INVENTORY_WEEKS + 1)])
               .select("product_id", F.struct("store_id", F.struct(
                   F.array(*[F.coalesce(F.col(f"w{k}"), F.lit(0)).cast("int") for k in range(1, INVENTORY_WEEKS + 1)]).alias("units"),
                   sum(F.coalesce(F.col(f"w{k}"), F.lit(0)) for k in range(1, INVENTORY_WEEKS + 1)).alias("total"))).alias("_s"))
               .groupBy("product_id").agg(F.map_from_entries(F.collect_list("_s")).alias("_shipped")))
    parts = (src["part"].filter(F.col("p_partkey").isNotNull())
             .groupBy(F.col("p_partkey").alias("product_id")).agg(F.collect_list(F.struct("p_size")).alias("_parts")))
    stores = F.sequence(F.lit(1).cast("long"), F.lit(INVENTORY_STORES).cast("long"))
    none = F.struct(F.array_repeat(F.lit(0), INVENTORY_WEEKS).alias("units"), F.lit(0).cast("long").alias("total"))
    x = (parts.join(shipped, "product_id", "left")
         .select("product_id", "_parts", "_shipped", F.explode(stores).alias("store_id"))
         .select("product_id", "store_id", "_parts", F.coalesce(F.try_element_at("_shipped", F.col("store_id")), none).alias("_s")))
    total = F.size("_parts") * F.col("_s.total")
    entry = lambda u, i, p: F.struct((i + 1).cast("int").alias("week_number"), u.alias(units),
                                     initial_stock(F.col("store_id"), p["p_size"], total).cast("int").alias("initial_stock"))
    return x.select("product_id", "store_id", F.flatten(F.transform(
        "_s.units", lambda u, i: F.transform("_parts", lambda p: entry(u, i, p)))).alias("weeks"))


def inventory_series(src: dict[str, DataFrame]) -> DataFrame:
    """``inventory_inputs`` with one row per product and store, its weeks in an array."""
    return _weekly_stock(src, lambda store, size, total: total + 5 + (size * 11 + store * 17) % 180, "units_sold")


def inventory_inputs(src: dict[str, DataFrame]) -> DataFrame:
    """(product_id, store_id, week_number, units_sold, initial_stock) for the stock
    ledger (job J25): the full product x store x week grid (zeros where nothing
    shipped). The initial stock is the location's total over the weeks plus a key-based reserve."""
    return inventory_series(src).select("product_id", "store_id", F.inline("weeks"))


def capped_demand(src: dict[str, DataFrame]) -> DataFrame:
    """Input of the capped stock recurrence, one row per product and store: the shipped units of each week
    as demand, against a nominal initial stock of 40 to 249 units that does not follow from the shipments."""
    return _weekly_stock(src, lambda store, size, total: F.lit(40) + (F.col("product_id") * 11 + store * 17) % 210, "units")


def faulty_transactions(txn: DataFrame) -> DataFrame:
    """Transactions as the text fields of a CSV export with planted faults, by the first two hex
    digits of md5(transaction_id): a date and a price that do not parse, a missing store, a quantity
    below the range, an unknown product, a missing quantity (filled on load) and a missing id."""
    mark = F.substring(F.md5(F.col("transaction_id")), 1, 2)
    planted = {"transaction_date": ("a0", F.lit("31/02/1997")), "unit_price": ("a1", F.lit("n/a")), "store_id": ("a2", F.lit(None)),
               "quantity": ("a3", F.lit("-4")), "product_id": ("a4", F.lit("999999999"))}
    text = txn.select(mark.alias("_mark"), *[F.col(c).cast("string").alias(c) for c in txn.columns])
    for column, (digits, value) in planted.items():
        text = text.withColumn(column, F.when(F.col("_mark") == digits, value.cast("string")).otherwise(F.col(column)))
    text = text.withColumn("quantity", F.when(F.col("_mark") != "a5", F.col("quantity")))
    return text.withColumn("transaction_id", F.when(F.col("_mark") != "a6", F.col("transaction_id"))).drop("_mark")


def negative_report_flag(product_id, week_number) -> F.Column:
    """Rows whose reported closing stock carries a sign error."""
    return (product_id + week_number) % 33 == 0


def target_rule(store_id, month_index) -> F.Column:
    """Monthly revenue target in INR for the test data."""
    return F.lit(90000) + (store_id * 37 + month_index * 13) % 80000
