"""The canonical star schema for one input folder, each table built once per session.

``Warehouse(spark, sf_dir)`` derives the eight canonical tables (plus the
clean-transactions "silver" table) from the driver's test tables when a job first
reads them and, by default, stages them as Parquet under the session's checkpoint folder. A job
pays for the tables it reads only. The clean transactions are rows of the raw ones with a
mark: their dedup and the raw table share one exchange, one sort and one set of files. Jobs
then read staged Parquet: each job's plan starts at a columnar scan with
pushed filters and pruned columns instead of re-deriving the star schema, and
the lineage of every job is cut at the staged tables (a lost executor re-reads
files instead of recomputing the mapping).
"""

from __future__ import annotations

import hashlib
import os
import threading
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.session import app_id, staging_root
from tillpoint.sources import fixtures as fx
from tillpoint.sources import layout

TABLES = ("dim_products", "dim_stores", "dim_customers", "fact_transactions", "fact_returns",
          "fact_inventory", "fact_markdown_events", "fact_sales_targets", "clean_transactions")

ROWS_PER_PIECE = 16 << 20  # lines of all months; a month is sorted and written in a piece for each
ROWS_PER_TASK = 1 << 20  # lines of all months that a task sorts and writes where they lie by part

_LOCK = threading.Lock()
_CACHE: dict[tuple, "Warehouse"] = {}


def warehouse(spark: SparkSession, sf_dir: str, stage: bool = True) -> "Warehouse":
    """Memoised per (application, folder): staging happens once per session."""
    key = (app_id(spark), os.path.abspath(sf_dir), stage)
    with _LOCK:
        wh = _CACHE.get(key)
        if wh is None:
            wh = Warehouse(spark, sf_dir, stage=stage)
            _CACHE[key] = wh
        return wh


class Warehouse:
    def __init__(self, spark: SparkSession, sf_dir: str, stage: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        self.stage = stage
        self._tables: dict[str, DataFrame] = {}
        self._by_month: dict[str, DataFrame] = {}
        self._memo: dict[str, object] = {}
        self._memo_lock = threading.RLock()
        self.timings: dict[str, float] = {}
        tag = hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:10]
        # of its own: a second warehouse of the folder must not overwrite files that this one's frames read
        self.root = os.path.join(staging_root(spark), app_id(spark), f"{tag}-{uuid.uuid4().hex[:8]}")

    # ------------------------------------------------------------------
    def __getitem__(self, name: str) -> DataFrame:
        with self._memo_lock:
            if name not in self._tables:
                self._build(name)
            return self._tables[name]

    def tables(self) -> dict[str, DataFrame]:
        return {name: self[name] for name in TABLES}

    def by_month(self, name: str) -> DataFrame:
        """A month-partitioned table with its partition column ``sale_month``; ``w[name]`` is
        the same scan without it."""
        self[name]
        return self._by_month[name]

    def catalog(self) -> str:
        """Schema of the stored catalog, built once per session: returns and transactions in
        buckets of the transaction id and the view ``vw_clean_transactions``. Their files are
        below the staging folder."""
        def build(_) -> str:
            from tillpoint.plans.audit import CLEAN_COLUMNS, DEDUP_KEYS
            tag = hashlib.sha1(self.root.encode()).hexdigest()[:12]
            schema, path = f"tillpoint_{tag}", f"{self.root}/catalog"
            layout.create_schema(self.spark, schema, path)
            names = ("fact_transactions", "fact_returns")
            buckets = layout.bucket_count(*[self[n] for n in names])
            for n in names:
                layout.write_bucketed(self[n], f"{schema}.{n}", f"{path}/{n}", "transaction_id", buckets)
            layout.create_clean_view(self.spark, schema, CLEAN_COLUMNS, DEDUP_KEYS)
            return schema
        return self.memo("catalog", build)

    def stored(self, name: str) -> DataFrame:
        """A bucketed table or the stored view of the catalog."""
        return self.spark.table(f"{self.catalog()}.{name}")

    def drop_catalog(self) -> None:
        with self._memo_lock:
            if "catalog" in self._memo:
                self.spark.sql(f"DROP DATABASE IF EXISTS {self._memo.pop('catalog')} CASCADE")

    def register_views(self, prefix: str = "") -> list[str]:
        """Expose the staged tables to ``spark.sql``; the clean table is also
        registered as ``vw_clean_transactions``."""
        names = []
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
        self["clean_transactions"].createOrReplaceTempView(prefix + "vw_clean_transactions")
        return names + [prefix + "vw_clean_transactions"]

    def derived(self, name: str, build, rows_per_file: int = 0) -> DataFrame:
        """A derived table (e.g. the model split) written once per session under
        the staging folder and read back by every later job that needs it. ``rows_per_file``: the most in a file."""
        with self._memo_lock:
            if name not in self._memo:
                self._memo[name] = self._write(name, build(self), rows_per_file=rows_per_file)
            return self._memo[name]

    def settled(self, df: DataFrame) -> DataFrame:
        """``df``, a few rows, computed now and anew at each call; the files of its exchanges go."""
        return self._write(f"settled-{uuid.uuid4().hex[:12]}", df)

    def memo(self, name: str, build):
        """A driver-side object built once per session (e.g. a fitted model)."""
        with self._memo_lock:
            if name not in self._memo:
                self._memo[name] = build(self)
            return self._memo[name]

    # ------------------------------------------------------------------
    def _write(self, name: str, df: DataFrame, sort_by: str | None = None, rows_per_file: int = 0) -> DataFrame:
        if not self.stage:
            return df
        path = f"{self.root}/{name}"
        out = df.sortWithinPartitions(sort_by) if sort_by else df
        with layout.lean_writes(self.spark):
            (out.write.mode("overwrite").option("compression", layout.CODEC).option("maxRecordsPerFile", rows_per_file)
             .parquet(path))
        return self.spark.read.parquet(path)

    def _put(self, name: str, df: DataFrame, sort_by: str | None = None, month: Column | None = None) -> DataFrame:
        """Stage a table; with ``month`` (first day of a row's month) in folders by month."""
        t0 = time.time()
        if month is None:
            staged = self._write(name, df, sort_by)
        else:
            self._by_month[name] = (layout.write_by_month(df, f"{self.root}/{name}", month, sort_by) if self.stage
                                    else df.withColumn(layout.MONTH, month))
            staged = self._by_month[name].drop(layout.MONTH)
        self.timings[name] = round(time.time() - t0, 3)
        self._tables[name] = staged
        return staged

    def _build(self, name: str) -> None:
        """Stage ``name`` and what it is made of."""
        from tillpoint.plans.ledger import first_markdown_event, inventory_id, stock_ledger, target_spine

        src = fx.read_source(self.spark, self.sf_dir)
        if name in ("dim_products", "dim_stores", "dim_customers"):
            self._put(name, getattr(fx, name)(src))
        elif name in ("fact_transactions", "clean_transactions"):
            self._build_transactions(src)
        elif name == "fact_returns":
            # A second plan over the line mapping: its filters on the return flag and status reach the
            # lineitem scan, so only that slice reaches the order join.
            self._put(name, fx.fact_returns(fx.transaction_lines(src)), sort_by="return_date")
        elif name == "fact_inventory":
            ledger = stock_ledger(fx.inventory_series(src), self["dim_products"], week1_date=fx.INVENTORY_WEEK1)
            bad = fx.negative_report_flag(F.col("product_id"), F.col("week_number"))
            inventory = ledger.withColumn(
                "closing_stock_reported",
                F.when(bad, -F.col("closing_stock")).otherwise(F.col("closing_stock")).cast("int"))
            # the id only spells out the keys: made by the jobs that read it
            staged = self._put(name, inventory.drop("inventory_id"))
            self._tables[name] = staged.select(inventory_id().alias("inventory_id"), *staged.columns)
        elif name == "fact_markdown_events":
            self._put(name, first_markdown_event(self["fact_inventory"]))
        elif name == "fact_sales_targets":
            self._put(name, target_spine(self["dim_stores"], self["clean_transactions"], rule=fx.target_rule),
                      sort_by="store_id", month=F.to_date(F.concat(F.col("month"), F.lit("-01"))))
        else:
            raise KeyError(name)

    def _build_transactions(self, src: dict[str, DataFrame]) -> None:
        from tillpoint.plans.audit import IS_CLEAN, clean_transactions

        sold_in = layout.month_of(F.col("transaction_date"))
        if not self.stage:
            txn = fx.fact_transactions(fx.transaction_lines(src))
            self._put("fact_transactions", txn, month=sold_in)
            self._put("clean_transactions", clean_transactions(txn), month=sold_in)
            return
        t0 = time.time()
        laid = layout.write_laid(marked_transactions(src), f"{self.root}/fact_transactions")
        self._by_month["fact_transactions"] = laid.drop(IS_CLEAN)
        self._by_month["clean_transactions"] = laid.filter(F.col(IS_CLEAN)).drop(IS_CLEAN)
        for name in ("fact_transactions", "clean_transactions"):
            self._tables[name] = self._by_month[name].drop(layout.MONTH)
        self.timings["fact_transactions"] = round(time.time() - t0, 3)


def marked_transactions(src: dict[str, DataFrame]) -> DataFrame:
    """The raw transactions with ``sale_month`` and the mark of the clean ones, gathered and sorted by month in each
    partition. The rows are exchanged as numbers; ids and texts are spelt out, and copies made, behind the last
    exchange."""
    from tillpoint.plans.audit import DEDUP_KEYS, mark_clean

    lines, most, lowest = fx.part_spread(src["lineitem"])
    if lines > ROWS_PER_PIECE and lowest >= 0 and most <= max(ROWS_PER_TASK, 4 * lines // fx.SPREAD):
        # A business key holds its product, which is a part's number or, for an orphan, that number below zero. So
        # without a hot part the tasks in which the lines meet their part can sort and write them, too.
        near = [layout.MONTH, "l_partkey"]
        dealt = fx.joined_lines(src, -(-lines // ROWS_PER_TASK)).withColumn(layout.MONTH, layout.month_of(F.col("o_orderdate")))
    else:
        near = [layout.MONTH, "_piece"]
        raw = fx.joined_lines(src)
        dealt = (fx.line_columns(raw, *raw.columns).withColumn(layout.MONTH, layout.month_of(F.col("transaction_date")))
                 .withColumn("_piece", F.pmod(F.xxhash64(*DEDUP_KEYS), F.lit(1 + lines // ROWS_PER_PIECE)))
                 .select(*raw.columns, *near).repartition(*near))
    return mark_clean(fx.fact_transactions(fx.line_columns(dealt, *near), near), near, dealt=True).drop(near[1])
