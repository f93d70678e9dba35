"""Data-quality audit jobs (J01-J11) and the clean-transactions table.

Scale notes
* Counters over one table are computed in a single scan (one ``agg`` with all
  counters, then ``stack`` to long form) instead of one scan per counter.
* Duplicate detection aggregates by the business key: partial aggregation
  collapses a hot key map-side, so no task ever holds a whole duplicate group.
* Clean transactions rank inside the business-key window with ``rn = 1``;
  Spark adds a partial ``WindowGroupLimit`` before the shuffle, which again
  keeps a hot key to one row per map task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.functions import labels as L
from tillpoint.functions.exprs import count_if, idiv, pct
from tillpoint.operators.rank import keep_first, prefix_sum
from tillpoint.operators.membership import only_wanted
from tillpoint.operators.scalars import combine_scalars
from tillpoint.sources import schemas as SC
from tillpoint.sources.layout import plan_bytes

COPIES_PER_CHUNK = 4096  # exact copies that one task expands at a time
DEDUP_KEYS = ("transaction_date", "product_id", "customer_id", "revenue")
PANDAS_DEDUP_KEYS = ("transaction_date", "customer_id", "product_id", "revenue")
CLEAN_COLUMNS = ("transaction_id", "transaction_date", "customer_id", "product_id", "store_id",
                 "quantity", "unit_price", "discount_pct", "revenue", "cost", "payment_method",
                 "channel", "region")


def _stack(df: DataFrame, label_cols: list[tuple[str, ...]], value_names: list[str],
           label_names: list[str]) -> DataFrame:
    """Wide one-row counters -> long rows via ``stack`` (one pass, no union of scans).

    label_cols: per output row, the literal labels followed by the value columns."""
    n = len(label_cols)
    parts = []
    for row in label_cols:
        labels, cols = row[: len(label_names)], row[len(label_names):]
        parts += [f"'{x}'" for x in labels] + [f"`{c}`" for c in cols]
    expr = f"stack({n}, {', '.join(parts)}) as ({', '.join(label_names + value_names)})"
    return df.selectExpr(expr)


# J01 ----------------------------------------------------------------------------
def null_rate_audit(tables: dict[str, DataFrame], columns: list[tuple[str, str]]) -> DataFrame:
    """Per (table, column): rows, NULL count, NULL % (2 dp), worst first.
    One scan per table whatever the number of audited columns."""
    by_table: dict[str, list[str]] = {}
    for t, c in columns:
        by_table.setdefault(t, []).append(c)
    parts = []
    for t, cols in by_table.items():
        aggs = [F.count(F.lit(1)).alias("total_rows")]
        aggs += [F.sum(F.col(c).isNull().cast("long")).alias(f"n_{i}") for i, c in enumerate(cols)]
        wide = tables[t].agg(*aggs)
        rows = [(t, c, "total_rows", f"n_{i}") for i, c in enumerate(cols)]
        parts.append(_stack(wide, rows, ["total_rows", "null_count"], ["table_name", "column_name"]))
    out = reduce(DataFrame.unionByName, parts)
    return (out.withColumn("null_pct", pct("null_count", "total_rows", 2))
               .orderBy(F.col("null_pct").desc(), "table_name", "column_name"))


AUDITED_NULL_COLUMNS = [("fact_transactions", "customer_id"), ("fact_transactions", "payment_method"),
                        ("dim_products", "supplier_name"), ("dim_customers", "email")]


# J02 ----------------------------------------------------------------------------
def duplicate_detection(t: DataFrame, keys=DEDUP_KEYS, value_col: str = "revenue") -> DataFrame:
    """Summary of business-key duplicates: rows, rows in duplicated groups,
    rows to remove, % removed, revenue those extra rows add.

    The value column is part of the key, so every extra copy carries the same
    value: the summary is exact from per-key counts (partial + final hash
    aggregation, no sort, no window)."""
    g = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    extra = F.col("n") - 1
    s = g.agg(
        F.sum("n").alias("total_transactions"),
        F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(F.lit(0))).alias("duplicate_rows"),
        F.sum(extra).alias("rows_to_remove"),
        F.sum(extra * F.col(value_col)).alias("inflated_revenue_inr"),
    )
    return s.select("total_transactions", "duplicate_rows", "rows_to_remove",
                    pct("rows_to_remove", "total_transactions", 2).alias("duplicate_pct"),
                    "inflated_revenue_inr")


def duplicate_rows(t: DataFrame, keys=DEDUP_KEYS, order_col: str = "transaction_id") -> DataFrame:
    """Row form of J02: every row of a duplicated business key with its
    occurrence count and its rank inside the key (by ``order_col``); rows with
    rank > 1 are the ones the clean view removes.

    A hot key is split at every step. Rows are first counted per (key, id), so exact
    copies shrink map-side to one group; groups are numbered by distributed running
    sums in (key, id) order (a key's own first number is the running sum over the
    keys before it); and a group is expanded again in chunks of ``COPIES_PER_CHUNK``
    rows that are dealt out over the tasks."""
    groups = t.groupBy(*keys, order_col).agg(F.count(F.lit(1)).alias("_m"))
    counts = (groups.groupBy(*keys).agg(F.sum("_m").alias("occurrence_count"))
              .filter(F.col("occurrence_count") > 1))
    key_order = [F.col(k).asc_nulls_first() for k in keys]
    counts = prefix_sum(counts, key_order, "occurrence_count", out="_key_end")
    c = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "occurrence_count",
                      (F.col("_key_end") - F.col("occurrence_count")).alias("_before"))
    cond = reduce(lambda a, b: a & b, [groups[k].eqNullSafe(c[f"_k_{k}"]) for k in keys])
    dup = groups.join(c, cond).drop(*[f"_k_{k}" for k in keys])
    ranked = prefix_sum(dup, key_order + [F.col(order_col).asc()], "_m", out="_end")
    first = F.col("_end") - F.col("_m") - F.col("_before")  # rank of the group's first row, from 0
    chunk = F.col("_chunk") * COPIES_PER_CHUNK
    dealt = (ranked.select(order_col, *keys, "occurrence_count", first.alias("_first"), "_m")
             .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), idiv(F.col("_m") - 1, COPIES_PER_CHUNK))))
             # a given number: AQE would merge the few, small chunk rows into one task
             .repartition(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                          F.xxhash64(*keys, order_col, "_chunk")))
    return (dealt.withColumn("_nth", F.explode(F.sequence(
                chunk + 1, F.least(chunk + COPIES_PER_CHUNK, F.col("_m")))))
            .select(order_col, *keys, "occurrence_count", (F.col("_first") + F.col("_nth")).alias("row_rank")))


# J03 ----------------------------------------------------------------------------
def negative_stock(i: DataFrame, p: DataFrame) -> DataFrame:
    """Inventory rows whose reported closing stock is negative, with product attributes."""
    bad = i.filter(F.col("closing_stock_reported") < 0)
    return (bad.join(p.select("product_id", "product_name", "category"), "product_id")
               .select("product_id", "product_name", "category", "store_id", "week_date",
                       F.col("closing_stock").alias("system_closing_stock"),
                       F.col("closing_stock_reported").alias("reported_closing_stock"),
                       "opening_stock", "units_sold",
                       F.lit(L.NEGATIVE_STOCK_LABEL).alias("anomaly_type"))
               .orderBy("reported_closing_stock", "product_id", "store_id", "week_date"))


# J04 ----------------------------------------------------------------------------
def price_anomalies(t: DataFrame, p: DataFrame, max_discount: float = 0.70,
                    min_cost_ratio: float = 0.50) -> DataFrame:
    """Price above MRP, below half of cost, or discount above 70 %: first matching flag."""
    x = t.join(p.select("product_id", "mrp", "cost_price"), "product_id")
    flag = (F.when(F.col("unit_price") > F.col("mrp"), F.lit(L.PRICE_ABOVE_MRP))
             .when(F.col("unit_price") < F.col("cost_price") * F.lit(min_cost_ratio), F.lit(L.PRICE_BELOW_COST))
             .when(F.col("discount_pct") > F.lit(max_discount), F.lit(L.DISCOUNT_OVER_LIMIT)))
    return (x.withColumn("anomaly_flag", flag)
             .filter(F.col("anomaly_flag").isNotNull())
             .select("transaction_id", "transaction_date", "product_id", "mrp", "cost_price",
                     "unit_price", "discount_pct", "anomaly_flag",
                     F.round(F.col("unit_price") - F.col("cost_price"), 2).alias("margin_per_unit"))
             .orderBy("anomaly_flag", "transaction_date", "transaction_id"))


# J05 ----------------------------------------------------------------------------
def known_keys(parent: DataFrame, key: str, child: DataFrame, child_key: str) -> DataFrame:
    """Distinct ``key`` of a parent. Where the parent is the larger table, a membership filter of
    the child's keys is applied to its scan first, so only keys that the child may ask for
    are exchanged."""
    keys = parent.select(F.col(key).alias("_k"))
    wanted = child.select(F.col(child_key).alias("_k"))
    return (only_wanted(keys, "_k", wanted) if plan_bytes(keys) > plan_bytes(wanted) else keys).distinct()


def referential_integrity(checks: list[tuple[str, DataFrame, DataFrame, str]]) -> DataFrame:
    """Orphan counts: child rows with no parent on ``key`` (a NULL child key is an orphan).

    checks: (label, child, parent, key). Each child key is counted under its own type in a
    map-side aggregate; only the distinct keys are tagged, cast and anti-joined, all checks at
    once. A parent that serves one check and is larger than the child is filtered by the
    child's keys before its keys are exchanged (``known_keys``)."""
    parents: dict[tuple[int, str], list[tuple[int, DataFrame]]] = {}
    for i, (_, _, parent, key) in enumerate(checks):
        parents.setdefault((id(parent), key), []).append((i, parent))
    tag_of = {i: tag for tag, uses in enumerate(parents.values()) for i, _ in uses}
    per_key = reduce(DataFrame.unionByName, [
        child.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
        .select(F.lit(i).alias("_c"), F.lit(tag_of[i]).alias("_p"), F.col("_k").cast("string").alias("_k"), "_n")
        for i, (_, child, _, key) in enumerate(checks)])

    def keys_of(tag: int, key: str, uses: list[tuple[int, DataFrame]]) -> DataFrame:
        i, parent = uses[0]
        keys = (known_keys(parent, key, checks[i][1], key) if len(uses) == 1
                else parent.select(F.col(key).alias("_k")).distinct())
        return keys.select(F.lit(tag).alias("_p"), F.col("_k").cast("string").alias("_k"))

    known = reduce(DataFrame.unionByName, [keys_of(tag, key, uses)
                                           for tag, ((_, key), uses) in enumerate(parents.items())])
    wide = per_key.join(known, ["_p", "_k"], "left_anti").agg(*[
        F.coalesce(F.sum(F.when(F.col("_c") == i, F.col("_n"))), F.lit(0)).cast("long").alias(f"v{i}")
        for i in range(len(checks))])
    return _stack(wide, [(label, f"v{i}") for i, (label, *_) in enumerate(checks)], ["orphan_count"], ["check_name"])


def default_integrity_checks(w) -> list:
    return [
        (L.ORPHAN_RETURNS, w["fact_returns"], w["fact_transactions"], "transaction_id"),
        (L.ORPHAN_TXN_PRODUCT, w["fact_transactions"], w["dim_products"], "product_id"),
        (L.ORPHAN_TXN_STORE, w["fact_transactions"], w["dim_stores"], "store_id"),
        (L.ORPHAN_INV_PRODUCT, w["fact_inventory"], w["dim_products"], "product_id"),
    ]


# J06 ----------------------------------------------------------------------------
def date_consistency(r: DataFrame, t: DataFrame, max_days: int = 90, dedup: bool = False) -> DataFrame:
    """Returns dated before the purchase or more than ``max_days`` after it.
    Joined to raw transactions, so duplicated purchases repeat the return (as audited);
    ``dedup`` joins each distinct (transaction, date) once instead."""
    if dedup:
        t = t.select("transaction_id", "transaction_date").distinct()
    x = r.select("return_id", "transaction_id", "return_date").join(
        t.select("transaction_id", "transaction_date"), "transaction_id")
    days = F.datediff(F.col("return_date"), F.col("transaction_date"))
    flag = (F.when(F.col("return_date") < F.col("transaction_date"), F.lit(L.RETURN_BEFORE_PURCHASE))
             .when(days > max_days, F.lit(L.RETURN_OUTSIDE_WINDOW)))
    return (x.filter((F.col("return_date") < F.col("transaction_date")) | (days > max_days))
             .select("return_id", "transaction_date", "return_date",
                     days.alias("days_to_return"), flag.alias("date_anomaly")))


# J07 ----------------------------------------------------------------------------
def clean_transactions(t: DataFrame, keys=DEDUP_KEYS, order_col: str = "transaction_id") -> DataFrame:
    """Keep the lowest id per business key (NULL customers group together),
    then drop rows with revenue <= 0 or quantity <= 0.

    ``revenue > 0`` is a predicate on a window key, so Catalyst pushes it below
    the window; ``quantity > 0`` is not and must stay after the ranking."""
    w = Window.partitionBy(*keys).orderBy(F.col(order_col))
    return (t.filter(F.col("revenue") > 0)
             .withColumn("_rn", F.row_number().over(w))
             .filter((F.col("_rn") == 1) & (F.col("quantity") > 0))
             .select(*CLEAN_COLUMNS))


IS_CLEAN = "_clean"


def mark_clean(t: DataFrame, near: list[str], keys=DEDUP_KEYS, order_col: str = "transaction_id",
               dealt: bool = False) -> DataFrame:
    """All rows of ``t`` with ``_clean``: would ``clean_transactions`` keep the row? ``near``: columns that
    follow from the keys, at least the last; rows are exchanged by them (``dealt``: they have been) and sorted by the first of them first."""
    w = Window.partitionBy(near[0], *keys, *near[1:]).orderBy(F.col(order_col))
    kept = (F.row_number().over(w) == 1) & (F.col("revenue") > 0) & (F.col("quantity") > 0)
    return (t if dealt else t.repartition(*near)).withColumn(IS_CLEAN, F.coalesce(kept, F.lit(False)))


# J08 ----------------------------------------------------------------------------
def dq_summary(t: DataFrame, tc: DataFrame, i: DataFrame, p: DataFrame) -> DataFrame:
    """Five (metric, value) rows; 'duplicates removed' is raw - clean (it also
    counts rows dropped for revenue or quantity <= 0, as the original metric does)."""
    one = combine_scalars(
        t.agg(F.count(F.lit(1)).alias("raw"), F.sum(F.col("customer_id").isNull().cast("long")).alias("guests")),
        tc.agg(F.count(F.lit(1)).alias("clean")),
        i.agg(count_if(F.col("closing_stock_reported") < 0).alias("neg")),
        p.agg(F.sum(F.col("supplier_name").isNull().cast("long")).alias("nosup")),
    ).withColumn("removed", F.col("raw") - F.col("clean"))
    m = L.DQ_METRICS
    return _stack(one.select(*[F.col(c).cast("string").alias(c) for c in ("raw", "removed", "guests", "neg", "nosup")]),
                  [(m[0], "raw"), (m[1], "removed"), (m[2], "guests"), (m[3], "neg"), (m[4], "nosup")],
                  ["value"], ["metric"])


# J09 ----------------------------------------------------------------------------
def constraint_audit(tables: dict[str, DataFrame], settle=lambda part: part) -> DataFrame:
    """Declared DDL constraints as a violation report:
    PRIMARY KEY / UNIQUE: rows beyond the first per key (NULL keys count as violations);
    FOREIGN KEY: non-NULL child keys without a parent;
    NOT NULL: NULL cells; DEFAULT: NULL cells where a default is declared (they were
    not filled on load); RANGE: values outside a declared range. One scan per table
    counts all NOT NULL, DEFAULT and RANGE rules. ``settle`` takes each part that exchanges keys (a few rows come out):
    one that computes it at once keeps the exchanges of one part on disk, not of all."""
    parts = []
    for t, cols in SC.PRIMARY_KEYS.items():
        parts.append(settle(_key_violations(tables[t], t, "PRIMARY KEY", f"pk_{t}", cols)))
    for t, cols in SC.UNIQUE_KEYS.items():
        parts.append(settle(_key_violations(tables[t], t, "UNIQUE", f"uq_{t}_{'_'.join(cols)}", cols)))
    # foreign keys grouped by referenced key: one anti join per parent table
    by_parent: dict[tuple[str, str], list[tuple[str, str]]] = {}
    for child, ccol, parent, pcol in SC.FOREIGN_KEYS:
        by_parent.setdefault((parent, pcol), []).append((child, ccol))
    for (parent, pcol), kids in by_parent.items():
        parts.append(settle(_fk_violations(tables, parent, pcol, kids)))
    for t in SC.SCHEMAS:
        rules = [("NOT NULL", f"nn_{t}_{c}", F.col(c).isNull()) for c in SC.not_null_columns(t)]
        rules += [("DEFAULT", f"df_{t}_{c}", F.col(c).isNull()) for c in SC.DEFAULTS.get(t, {})]
        rules += [("RANGE", f"rg_{t}_{r[1]}", ~F.expr(SC.range_rule(*r[1:]))) for r in SC.RANGES if r[0] == t]
        wide = tables[t].agg(*[F.sum(F.coalesce(bad, F.lit(False)).cast("long")).alias(f"c{i}")
                               for i, (_, _, bad) in enumerate(rules)])
        long = _stack(wide, [(t, kind, name, f"c{i}") for i, (kind, name, _) in enumerate(rules)],
                      ["violations"], ["table_name", "constraint_type", "constraint_name"])
        parts.append(long)
    return reduce(DataFrame.unionByName, parts)


def _fk_violations(tables: dict[str, DataFrame], parent: str, pcol: str,
                   kids: list[tuple[str, str]]) -> DataFrame:
    """All foreign keys that reference ``parent.pcol`` in one plan: each child's
    non-NULL keys reduced to (constraint, key, rows), unioned, anti-joined once
    against the parent's distinct keys, then one conditional sum per
    constraint (so a constraint with no violation still reports 0)."""
    names = [f"fk_{child}_{ccol}" for child, ccol in kids]
    tagged = reduce(DataFrame.unionByName, [
        tables[child].select(F.lit(i).alias("_c"), F.col(ccol).alias("_k")).filter(F.col("_k").isNotNull())
        for i, (child, ccol) in enumerate(kids)])
    per_key = tagged.groupBy("_c", "_k").agg(F.count(F.lit(1)).alias("_n"))
    parents = (known_keys(tables[parent], pcol, tables[kids[0][0]], kids[0][1]) if len(kids) == 1
               else tables[parent].select(F.col(pcol).alias("_k")).distinct())
    orphans = per_key.join(parents, "_k", "left_anti")
    wide = orphans.agg(*[F.coalesce(F.sum(F.when(F.col("_c") == i, F.col("_n"))), F.lit(0)).cast("long").alias(f"v{i}")
                         for i in range(len(kids))])
    rows = [(child, "FOREIGN KEY", names[i], f"v{i}") for i, (child, _) in enumerate(kids)]
    return _stack(wide, rows, ["violations"], ["table_name", "constraint_type", "constraint_name"])


def _key_violations(df: DataFrame, table: str, kind: str, name: str, cols) -> DataFrame:
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    anynull = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    v = g.agg(F.sum(F.when(anynull, F.col("n")).otherwise(F.col("n") - 1)).alias("violations"))
    return v.select(F.lit(table).alias("table_name"), F.lit(kind).alias("constraint_type"),
                    F.lit(name).alias("constraint_name"),
                    F.coalesce(F.col("violations"), F.lit(0)).cast("long").alias("violations"))


# J10 ----------------------------------------------------------------------------
def audit_counters(t: DataFrame, i: DataFrame, p: DataFrame, keys=PANDAS_DEDUP_KEYS) -> DataFrame:
    """pandas-style audit: duplicate rows (rows - distinct keys, NULLs equal),
    NULL customers / payments / suppliers and negative stock, with % (1 dp)."""
    raw = t.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("customer_id").isNull().cast("long")).alias("nc"),
        F.sum(F.col("payment_method").isNull().cast("long")).alias("np"),
    ).agg(F.sum("n").alias("raw_transactions"), F.count(F.lit(1)).alias("_keys"),
          F.sum("nc").alias("null_customer"), F.sum("np").alias("null_payment"))
    one = combine_scalars(
        raw,
        i.agg(count_if(F.col("closing_stock_reported") < 0).alias("negative_stock")),
        p.agg(F.count(F.lit(1)).alias("products"),
              F.sum(F.col("supplier_name").isNull().cast("long")).alias("null_supplier")),
    ).withColumn("duplicate_rows", F.col("raw_transactions") - F.col("_keys"))
    return one.select(
        "raw_transactions", "duplicate_rows",
        pct("duplicate_rows", "raw_transactions", 1).alias("duplicate_pct"),
        "null_customer", pct("null_customer", "raw_transactions", 1).alias("null_customer_pct"),
        "null_payment", pct("null_payment", "raw_transactions", 1).alias("null_payment_pct"),
        "negative_stock",
        "null_supplier", pct("null_supplier", "products", 1).alias("null_supplier_pct"),
    )


# J11 ----------------------------------------------------------------------------
def clean_by_first(t: DataFrame, keys=PANDAS_DEDUP_KEYS, order_col: str = "transaction_id") -> DataFrame:
    """pandas ``drop_duplicates(keep='first')`` then ``revenue > 0 and quantity > 0``.

    "First" needs an explicit order: the smallest ``order_col``. A window top-1 whose
    partial limit runs before the shuffle, so a hot key is reduced map-side; it must
    agree with J07 row for row."""
    return (keep_first(t.select(*CLEAN_COLUMNS), list(keys), [F.col(order_col).asc()])
            .filter("revenue > 0 AND quantity > 0"))
