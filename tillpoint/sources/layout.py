"""Physical layouts of staged tables: month partitions and bucketed catalog tables.

* **Month partitions.** A fact is written in folders by the first day of its month
  (``sale_month``, DATE). A ``REBALANCE`` on the month gathers a month's rows into few
  files and, under AQE, deals a large month over many tasks. A range of dates then reads the
  folders of its months only (static pruning, ``in_dates``), and a join on ``sale_month``
  with a filtered table prunes at run time.
* **Buckets.** Tables that are joined on the same key again and again are written in the
  same number of buckets of that key, sorted inside, as catalog tables: the join needs no
  exchange. The number of buckets follows the size of the largest table.
"""

from __future__ import annotations

import datetime as dt
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONTH = "sale_month"
BUCKET_BYTES = 128 << 20
MIN_BUCKETS, MAX_BUCKETS = 8, 1 << 15
CODEC = "zstd"  # of staged files: ids made of digits take about half the bytes they take with snappy


def month_of(date: Column) -> Column:
    return F.trunc(date, "month")


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size; for a scan of files, their bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


TEXT_CODEC = "gzip"  # of CSV and JSON files, a part a task; readers tell it by the name

HASHED = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, own: dict[str, str]):
    """The session's settings with ``own`` among them, until it is left."""
    was = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def lean_writes(spark: SparkSession):
    """For writes of whole tables. The files of a write's exchanges are removed when it ends, not when the driver
    collects its garbage. AQE joins by a hash table where every partition of the smaller side is measured to be
    small (up to the size of a coalesced one): the larger side is then neither sorted nor spilled."""
    return settings(spark, {HASHED: spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"), CLEANED: "true"})


def write_by_month(df: DataFrame, path: str, month: Column, sort_by: str) -> DataFrame:
    """Write ``df`` in folders by month and return a scan of them, ``sale_month`` last."""
    laid = df.withColumn(MONTH, month).hint("rebalance", MONTH)
    with lean_writes(df.sparkSession):
        laid.sortWithinPartitions(MONTH, sort_by).write.mode("overwrite").option("compression", CODEC).partitionBy(MONTH).parquet(path)
    return df.sparkSession.read.schema(laid.schema).parquet(path)


def write_laid(df: DataFrame, path: str) -> DataFrame:
    """Like ``write_by_month`` for rows that hold ``sale_month`` and are gathered and sorted by it already."""
    with lean_writes(df.sparkSession):
        df.write.mode("overwrite").option("compression", CODEC).partitionBy(MONTH).parquet(path)
    schema = df.select(*[c for c in df.columns if c != MONTH], MONTH).schema
    return df.sparkSession.read.schema(schema).parquet(path)


def in_dates(df: DataFrame, date_col: str, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """Rows of a month-partitioned table dated from ``first`` to ``last`` (both included): only
    the folders of those months are listed and read."""
    if first is not None:
        df = df.filter((F.col(MONTH) >= F.lit(first.replace(day=1))) & (F.col(date_col) >= F.lit(first)))
    if last is not None:
        df = df.filter((F.col(MONTH) <= F.lit(last.replace(day=1))) & (F.col(date_col) <= F.lit(last)))
    return df


def bucket_count(*tables: DataFrame) -> int:
    """Power of two with about ``BUCKET_BYTES`` of the largest table a bucket."""
    largest = max(plan_bytes(t) for t in tables)
    wanted = max(1, -(-largest // BUCKET_BYTES))
    return min(MAX_BUCKETS, max(MIN_BUCKETS, 1 << (wanted - 1).bit_length()))


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` as a catalog table in one sorted file a bucket; its files are in ``path``."""
    (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
     .option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)


def create_schema(spark: SparkSession, name: str, path: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{path}'")


def create_clean_view(spark: SparkSession, schema: str, columns: tuple[str, ...], keys: tuple[str, ...]) -> str:
    """A stored view over the catalog's transactions: of the rows that agree in ``keys`` the one with
    the lowest id, if it has revenue and units. The aggregate reduces copies before any
    exchange."""
    view = f"{schema}.vw_clean_transactions"
    fields = ", ".join(f"'{c}', {c}" for c in columns)
    spark.sql(f"""
        CREATE OR REPLACE VIEW {view} AS
        SELECT kept.* FROM (SELECT min_by(named_struct({fields}), transaction_id) AS kept
                            FROM {schema}.fact_transactions WHERE revenue > 0 GROUP BY {', '.join(keys)}) firsts
        WHERE kept.quantity > 0""")
    return view
