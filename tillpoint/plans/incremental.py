"""The clean table (J07) kept up to date batch by batch.

A business key holds its date, so it lives in one month. ``kept`` is partitioned by month and
holds the first row of every key with revenue, also those without units, which may still
bar later rows of their key; ``read`` leaves them out. A batch

1. is compared by month, from its keys and ids alone, with what is stored, if anything is;
2. meets the keys of its other months as hashes of key and id; a month in which every key of the batch is kept with
   that id already is done. Rows whose key's hash is on one row go on as they are; the others
   meet the kept keys and ids in one aggregate by key, which reduces them to their first row per
   key (before the exchange, so a hot key is small);
3. is appended where all its keys are new; a month in which a kept row gives way to a lower
   id is written anew (dynamic partition overwrite), all other months stay as they are.

``digests`` holds per month the number of keys and an order-free sum of key hashes; a batch adds a
row for each of its months, the latest counts. A month of the batch whose digest equals the stored one has been applied before and is skipped;
``changed_outside`` compares them with the files.

The lowest id per key does not depend on the order or the number of times in which batches
come, so a batch that failed is applied again. A month is overwritten from a written copy
(``pending``), and an overwrite that was broken off is ended before the next batch. One
writer at a time. Equal keys with equal ids: the row that was kept first stays. Rows without
a date form a month of their own. An empty batch changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillpoint.operators.membership import filter_bits, key_words, may_hold
from tillpoint.plans.audit import CLEAN_COLUMNS, DEDUP_KEYS
from tillpoint.sources import schemas as SC
from tillpoint.sources.layout import CODEC, MONTH, lean_writes, month_of

ID, REPLACES, HASH = "transaction_id", "_replaces", "_key_hash"
DIGEST_SCHEMA = f"{MONTH} date, n_keys long, digest decimal(38,0), batch long"


class CleanTable:
    """A clean table in the folder ``root``, created empty if it is not there."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        declared = SC.SCHEMAS["fact_transactions"]
        self.schema = T.StructType([T.StructField(c, declared[c].dataType, True) for c in CLEAN_COLUMNS]
                                   + [T.StructField(MONTH, T.DateType(), True)])
        spark.createDataFrame([], self.schema).write.mode("ignore").partitionBy(MONTH).parquet(f"{root}/kept")
        spark.createDataFrame([], DIGEST_SCHEMA).write.mode("ignore").parquet(f"{root}/digests")

    def read(self) -> DataFrame:
        return self._kept().filter(F.col("quantity") > 0).select(*CLEAN_COLUMNS)

    def apply(self, batch: DataFrame) -> dict[str, list]:
        """Take in a batch of raw transactions. Returns the months that were skipped, appended to
        and overwritten (a row per month reaches the driver)."""
        self._end_pending()
        incoming = (batch.filter(F.col("revenue") > 0).select(*CLEAN_COLUMNS)
                    .withColumn(MONTH, month_of(F.col("transaction_date"))))
        months = [r[MONTH] for r in incoming.select(MONTH).distinct().collect()]
        stored = {r[MONTH]: (r["n_keys"], r["digest"]) for r in self._digests().filter(among(months)).collect()}
        skipped = []
        if stored:
            firsts = (incoming.filter(among(list(stored))).groupBy(MONTH, *DEDUP_KEYS)
                      .agg(F.min(F.struct(ID)).alias("_first")).select(MONTH, *DEDUP_KEYS, f"_first.{ID}"))
            with lean_writes(self.spark):
                now = digests(firsts).collect()
            skipped = [r[MONTH] for r in now if stored[r[MONTH]] == (r["n_keys"], r["digest"])]
        touched = [m for m in months if m not in skipped]

        kept = self._kept()
        changes, _ = self._changes(incoming, kept, touched)
        found = {r[MONTH]: r["n"] for r in changes.groupBy(MONTH).agg(F.count(REPLACES).alias("n")).collect()}
        replaced, appended = [m for m in found if found[m]], [m for m in found if not found[m]]

        columns = [*CLEAN_COLUMNS, MONTH]
        if appended:
            new = changes.filter(among(appended)).select(*columns)
            with lean_writes(self.spark):
                in_months(new).write.mode("append").option("compression", CODEC).partitionBy(MONTH).parquet(f"{self.root}/kept")
        if replaced:
            better = changes.filter(among(replaced))
            gone = better.filter(F.col(REPLACES).isNotNull()).select(*[F.col(k).alias(f"_k_{k}") for k in DEDUP_KEYS])
            same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in DEDUP_KEYS])
            stay = kept.filter(among(replaced)).join(gone, same, "left_anti")
            merged = in_months(stay.select(*columns).unionByName(better.select(*columns)))
            with lean_writes(self.spark):
                merged.write.mode("overwrite").option("compression", CODEC).partitionBy(MONTH).parquet(f"{self.root}/pending")
            self._end_pending()
        if touched:
            last = self.spark.read.schema(DIGEST_SCHEMA).parquet(f"{self.root}/digests").agg(F.max("batch")).first()[0]
            now = digests(self._kept().filter(among(touched))).withColumn("batch", F.lit((last or 0) + 1).cast("long"))
            now.coalesce(1).write.mode("append").parquet(f"{self.root}/digests")
        return {"skipped": skipped, "appended": appended, "overwritten": replaced}

    def changed_outside(self) -> DataFrame:
        """Months whose files do not hold the keys that were written."""
        was = self._digests().select(F.col(MONTH).alias("_m"), F.col("n_keys").alias("_n"), F.col("digest").alias("_d"))
        return (digests(self._kept()).join(was, F.col(MONTH).eqNullSafe(F.col("_m")), "full")
                .filter(~(F.col("n_keys").eqNullSafe(F.col("_n")) & F.col("digest").eqNullSafe(F.col("_d"))))
                .select(F.coalesce(MONTH, "_m").alias(MONTH)))

    # ------------------------------------------------------------------
    def _changes(self, incoming: DataFrame, kept: DataFrame, months: list) -> tuple[DataFrame, list]:
        """``better_rows`` of these months, staged, and the months among them in which a key is not settled."""
        incoming, kept = (x.filter(among(months)).withColumn(HASH, key_hash()) for x in (incoming, kept))
        ids = F.xxhash64(F.col(ID).cast("string")).alias("_id")
        met = (incoming.select(MONTH, HASH, ids, F.lit(1).alias("_new")).unionByName(kept.select(MONTH, HASH, ids, F.lit(0).alias("_new")))
               .groupBy(MONTH, HASH).agg(F.count(F.lit(1)).alias("_n"), F.sum("_new").alias("_new"),
                                         (F.min("_id") == F.max("_id")).alias("_one_id")))
        unsettled = (F.col("_new") > 0) & ~(F.col("_one_id") & (F.col("_new") < F.col("_n")))
        several = F.col("_n") > 1
        seen = Observation()
        found = met.observe(seen, F.collect_set(F.when(unsettled, F.col(MONTH))).alias("months"),
                            F.max(unsettled & F.col(MONTH).isNull()).alias("undated"), F.sum(several.cast("long")).alias("several"))
        shared = self._stage("shared", found.filter(several & (F.col("_new") > 0)).select(HASH))
        dated, undated, n = (seen.get[k] for k in ("months", "undated", "several"))
        open_months = [m for m in months if (m in dated if m is not None else undated)]
        bits = filter_bits(n or 0)
        words = key_words(shared, bits)
        incoming, kept = (x.filter(among(open_months)) for x in (incoming, kept))
        several = may_hold(words, F.col(HASH), bits)  # all rows of such keys and a few others
        alone = incoming.filter(~several).select(*CLEAN_COLUMNS, F.lit(None).cast("string").alias(REPLACES), MONTH)
        return self._stage("changes", alone.unionByName(better_rows(incoming.filter(several), kept.filter(several)))), open_months

    def _kept(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/kept")

    def _digests(self) -> DataFrame:
        rows = self.spark.read.schema(DIGEST_SCHEMA).parquet(f"{self.root}/digests")
        return (rows.groupBy(MONTH).agg(F.max_by(F.struct("n_keys", "digest"), "batch").alias("_last"))
                .select(MONTH, "_last.*"))

    def _stage(self, name: str, rows: DataFrame) -> DataFrame:
        with lean_writes(self.spark):
            rows.write.mode("overwrite").option("compression", CODEC).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{name}")

    def _end_pending(self) -> None:
        """Overwrite the months of a complete ``pending`` copy and remove it."""
        pending = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/pending")
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/pending/_SUCCESS")
        files = pending.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if files.exists(done):
            # its files lie by month already: they are read and written where they are, without an exchange
            months = self.spark.read.schema(self.schema).parquet(f"{self.root}/pending")
            (months.sortWithinPartitions(MONTH, "transaction_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", CODEC)
             .partitionBy(MONTH).parquet(f"{self.root}/kept"))
            files.delete(pending, True)


def better_rows(incoming: DataFrame, kept: DataFrame) -> DataFrame:
    """The first row of every key of ``incoming`` that is new, or whose id is lower than that of the kept row
    (``REPLACES``)."""
    rest = [c for c in CLEAN_COLUMNS if c not in (ID, *DEDUP_KEYS)]
    rows = incoming.select(MONTH, *DEDUP_KEYS, F.struct(ID, *rest).alias("_row"), F.lit(None).cast("string").alias(REPLACES))
    known = kept.select(MONTH, *DEDUP_KEYS, F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col(ID).alias(REPLACES))
    # the lowest row of a key: structs compare by their first field, the id, NULL lowest
    met = rows.unionByName(known).groupBy(MONTH, *DEDUP_KEYS).agg(F.min("_row").alias("_row"), F.max(REPLACES).alias(REPLACES))
    return (met.filter(F.col("_row").isNotNull()).select(MONTH, *DEDUP_KEYS, "_row.*", REPLACES)
            .filter(F.col(REPLACES).isNull() | (F.col(ID) < F.col(REPLACES)))
            .select(*CLEAN_COLUMNS, REPLACES, MONTH))


def key_hash() -> Column:
    """Hash of the business key: equal for equal keys, of whatever type a batch has them."""
    declared = SC.SCHEMAS["fact_transactions"]
    return F.xxhash64(*[F.col(k).try_cast(declared[k].dataType) for k in DEDUP_KEYS])


def among(months: list) -> Column:
    """Rows of these months (None: without one); a static partition filter."""
    dated = [m for m in months if m is not None]
    inside = F.col(MONTH).isin(dated) if dated else F.lit(False)
    return inside | F.col(MONTH).isNull() if None in months else inside


def in_months(rows: DataFrame) -> DataFrame:
    """Few files a month; under AQE a large month is dealt over many tasks."""
    return rows.hint("rebalance", MONTH).sortWithinPartitions(MONTH, "transaction_date")


def digests(rows: DataFrame) -> DataFrame:
    """Per month the number of keys and the sum of the hashes of key and id."""
    return (rows.groupBy(MONTH)
            .agg(F.count(F.lit(1)).alias("n_keys"),
                 F.sum(F.xxhash64(*DEDUP_KEYS, ID).cast("decimal(20,0)")).cast("decimal(38,0)").alias("digest")))
