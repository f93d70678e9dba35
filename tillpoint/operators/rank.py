"""Distributed global ranking, NTILE and quantile buckets.

A window with ORDER BY but no PARTITION BY runs in a single task. For ranks
over all customers (NTILE scores, rank-based quantile cuts, stratified
splits) we use instead:

1. ``repartitionByRange(n, order)`` + ``sortWithinPartitions(order)``: rows are
   totally ordered across partitions (the order ends with a unique key);
2. ``spark_partition_id()`` and ``monotonically_increasing_id()`` in the same
   projection give each row its partition and its position inside it;
3. the frame is checkpointed (reliable, to the checkpoint folder) so the ids
   and the per-partition counts come from one materialisation;
4. per-partition counts (n rows, a proven bound) give offsets through a window
   over that tiny table; they are broadcast back.

Global row number = partition offset + position in partition + 1. No task
sees more than one range partition; the result does not depend on the range
bounds Spark samples, because the order is total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.session import ensure_checkpoint_dir


def global_row_number(df: DataFrame, order: list[Column], out: str = "_rn",
                      num_partitions: int | None = None, total_out: str | None = None) -> DataFrame:
    """Add ``out`` = ROW_NUMBER() OVER (ORDER BY order) without a single-task window
    (and, if ``total_out`` is given, the total row count).
    ``order`` must end with a unique key so the numbering is deterministic."""
    ensure_checkpoint_dir(df.sparkSession)
    # Without an explicit count, AQE may coalesce adjacent range partitions
    # (they stay in range order), so tiny inputs do not produce hundreds of files.
    ranged = df.repartitionByRange(num_partitions, *order) if num_partitions else df.repartitionByRange(*order)
    ranged = (ranged.sortWithinPartitions(*order)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = ranged.checkpoint(eager=True)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", "_first",
                            F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
                            F.sum("_cnt").over(Window.partitionBy()).alias("_tot"))
    # offsets has one row per range partition (n rows): broadcast is size-bounded
    res = (ranged.join(F.broadcast(offsets), "_pid")
                 .withColumn(out, F.col("_off") + (F.col("_mid") - F.col("_first")) + 1))
    if total_out:
        res = res.withColumnRenamed("_tot", total_out)
    return res.drop("_pid", "_mid", "_first", "_off", "_tot")


def ntile_of(rn, n, k: int) -> Column:
    """NTILE(k) bucket of 1-based row number ``rn`` among ``n`` rows: the first
    (n mod k) buckets hold one row more than the others."""
    rn, n = F.col(rn) if isinstance(rn, str) else rn, F.col(n) if isinstance(n, str) else n
    q = (n / k).cast("long")
    m = n % k
    big = m * (q + 1)
    return F.when(rn <= big, ((rn - 1) / (q + 1)).cast("long") + 1).otherwise(
        m + ((rn - big - 1) / F.nullif(q, F.lit(0))).cast("long") + 1).cast("int")


def rank_qcut_of(rn, n, k: int) -> Column:
    """Bucket of ``qcut(rank(method='first'), k)``: the smallest b in 1..k with
    rn <= 1 + (n-1) * b / k, i.e. max(1, ceil(k * (rn-1) / (n-1)))."""
    rn, n = F.col(rn) if isinstance(rn, str) else rn, F.col(n) if isinstance(n, str) else n
    num = (rn - 1) * k
    den = n - 1
    b = ((num + den - 1) / F.nullif(den, F.lit(0))).cast("long")
    return F.when(den <= 0, F.raise_error(F.lit("qcut: bin edges must be unique (fewer than 2 rows)"))) \
            .otherwise(F.greatest(F.lit(1), b)).cast("int")


def ntile(df: DataFrame, order: list[Column], k: int, out: str,
          num_partitions: int | None = None) -> DataFrame:
    """NTILE(k) OVER (ORDER BY order), distributed. Adds column ``out``."""
    ranked = global_row_number(df, order, out="_rn_" + out, num_partitions=num_partitions,
                               total_out="_n_" + out)
    return (ranked.withColumn(out, ntile_of(F.col("_rn_" + out), F.col("_n_" + out), k))
                  .drop("_rn_" + out, "_n_" + out))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order`` (Spark plans a partial
    WindowGroupLimit before the shuffle, so a hot key shrinks map-side)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def edge_rows(df: DataFrame, keys: list[str], order: str, tie: str, columns: list[str], last: bool = False) -> DataFrame:
    """``keys`` and ``columns`` of one row per key: the first (``last``: last) by ``order``, NULL lowest; of
    equal ones the one with the highest ``tie``. Both are INT columns, packed into one BIGINT, and
    all ``columns`` come from the same row. For columns of fixed width (numbers, dates) this is a
    hash aggregate: rows are neither sorted nor exchanged, unlike in ``keep_first``."""
    high = F.coalesce(F.col(order).cast("long"), F.lit(1 - 2 ** 31)) * F.lit(2 ** 32)
    low = F.coalesce(F.col(tie).cast("long"), F.lit(-2 ** 31))
    edge, place = (F.max_by, high + low) if last else (F.min_by, high - low)
    return df.groupBy(*keys).agg(*[edge(c, place).alias(c) for c in columns])


def prefix_sum(df: DataFrame, order: list[Column], value: str, out: str,
               total_out: str | None = None) -> DataFrame:
    """Running SUM(value) OVER (ORDER BY order ROWS UNBOUNDED PRECEDING) without
    a single-task window: rows are range-partitioned on the (unique) order and
    checkpointed; each range partition is summed locally (one window partition
    per range partition, so no task holds more than one range) and shifted by
    the totals of the partitions before it (one row per partition, broadcast)."""
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (df.repartitionByRange(*order).sortWithinPartitions(*order)
                .withColumn("_pid", F.spark_partition_id()))
    ranged = ranged.checkpoint(eager=True)
    totals = ranged.groupBy("_pid").agg(F.sum(value).alias("_tot"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_off"),
                            F.sum("_tot").over(Window.partitionBy()).alias("_all"))
    local = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    res = (ranged.withColumn("_loc", F.sum(value).over(local))
                 .join(F.broadcast(offsets), "_pid")
                 .withColumn(out, F.col("_off") + F.col("_loc")))
    if total_out:
        res = res.withColumnRenamed("_all", total_out)
    return res.drop("_pid", "_loc", "_off", "_all")


def global_ranks(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """For each column and output of ``values``, RANK() OVER (ORDER BY column DESC NULLS LAST)
    without a single-task window: rows per distinct value of every column, one distributed
    running sum over the values of all of them, joined back per column."""
    names = list(values)
    places = [f"_v{i}" for i in range(len(names))]

    def sizes_of(i: int, name: str) -> DataFrame:
        own = df.groupBy(F.col(name).alias("_v")).agg(F.count(F.lit(1)).alias("_size"))
        others = [F.lit(None).cast(df.schema[n].dataType).alias(places[j]) for j, n in enumerate(names) if j != i]
        return own.select(F.lit(i).alias("_tag"), F.col("_v").alias(places[i]), *others, "_size").select("_tag", *places, "_size")

    sizes = sizes_of(0, names[0])
    for i, name in enumerate(names[1:], 1):
        sizes = sizes.unionByName(sizes_of(i, name))
    order = [F.col("_tag").asc(), *[F.col(p).desc_nulls_last() for p in places]]
    ends = prefix_sum(sizes, order, "_size", "_last", total_out="_total")
    rows = F.call_function("div", F.col("_total"), F.lit(len(names)))  # every row counts once a column
    for i, (name, out) in enumerate(values.items()):
        ranks = ends.filter(F.col("_tag") == i).select(
            F.col(places[i]).alias("_value"), (F.col("_last") - F.col("_size") + 1 - rows * i).alias(out))
        df = df.join(ranks, df[name].eqNullSafe(ranks["_value"])).drop("_value")
    return df


def global_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """RANK() of one column, see ``global_ranks``."""
    return global_ranks(df, {value: out})
