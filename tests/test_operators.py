"""Properties of the composed operators and partition-count invariance."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL, rows
from tillpoint.operators.rank import global_row_number, ntile, ntile_of, rank_qcut_of
from tillpoint.operators.scalars import combine_scalars


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 3), (3, 7), (4, None)])
def test_global_row_number_equals_row_number(spark, seed, parts):
    rnd = random.Random(seed)
    data = [(i, rnd.randint(0, 20)) for i in range(300)]  # many ties on v
    df = spark.createDataFrame(data, "id long, v int")
    order = [F.col("v").desc(), F.col("id").asc()]
    got = rows(global_row_number(df, order, num_partitions=parts), ["id", "_rn"])
    want = rows(df.withColumn("_rn", F.row_number().over(Window.orderBy(*order))), ["id", "_rn"])
    assert got == want


def test_distributed_ntile_equals_window_ntile(spark):
    for n in (1, 2, 4, 5, 7, 23, 101):
        df = spark.createDataFrame([(i, i % 6) for i in range(n)], "id long, v int")
        order = [F.col("v").asc(), F.col("id").asc()]
        got = rows(ntile(df, order, 5, "b", num_partitions=3), ["id", "b"])
        want = rows(df.withColumn("b", F.ntile(5).over(Window.orderBy(*order))), ["id", "b"])
        assert got == want, n


def test_ntile_arithmetic(spark):
    for n in range(1, 30):
        df = spark.range(1, n + 1).select(F.col("id").alias("rn"), F.lit(n).cast("long").alias("n"))
        got = [r.b for r in df.select(ntile_of("rn", "n", 5).alias("b")).orderBy("rn").collect()]
        want = [r.b for r in spark.range(n).select(F.ntile(5).over(Window.orderBy("id")).alias("b")).collect()]
        assert got == want, n


@pytest.mark.parametrize("n", [2, 5, 7, 11, 1499, 1500])
def test_rank_qcut_matches_pandas(spark, n):
    df = spark.range(1, n + 1).select(F.col("id").alias("rn"), F.lit(n).cast("long").alias("n"))
    got = [r.b for r in df.select(rank_qcut_of("rn", "n", 5).alias("b")).orderBy("rn").collect()]
    want = pd.qcut(pd.Series(range(1, n + 1), dtype=float), 5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
    assert got == want


def test_combine_scalars_no_join(spark):
    a = spark.range(10).agg(F.count(F.lit(1)).alias("n"))
    b = spark.range(5).agg(F.sum("id").alias("s"))
    one = combine_scalars(a, b)
    r = one.collect()
    assert len(r) == 1 and (r[0].n, r[0].s) == (10, 10)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["clean_transactions", "monthly_revenue", "rfm_scores_ntile", "stratified_split",
                                  "churn_risk", "top_return_reason"])
def test_same_result_for_1_4_16_shuffle_partitions(spark, wh, name):
    import __spark_entry__ as E
    q = E.queries()[name]
    results = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "4", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            results.append(rows(q(spark, SF_SMALL)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]


def test_raw_equals_clean_plus_removed(spark, wh):
    import __spark_entry__ as E
    m = {r.metric: int(r.value) for r in E.queries()["dq_summary"](spark, SF_SMALL).collect()}
    clean = wh["clean_transactions"].count()
    vals = list(m.values())
    assert vals[0] == clean + vals[1]


def test_segment_counts_and_shares(spark, wh):
    import __spark_entry__ as E
    seg = E.queries()["rfm_segments"](spark, SF_SMALL).collect()
    customers = E.queries()["customer_metrics"](spark, SF_SMALL).count()
    assert sum(r.customer_count for r in seg) == customers
    assert abs(sum(r.segment_pct for r in seg) - 100.0) < 0.5
    cats = E.queries()["category_revenue"](spark, SF_SMALL).collect()
    assert sum(r.share_pct for r in cats) <= 100.5


@pytest.mark.parametrize("desc", [False, True])
def test_prefix_sum_equals_running_window(spark, desc):
    from tillpoint.operators.rank import prefix_sum
    rnd = random.Random(7)
    df = spark.createDataFrame([(i, rnd.randint(0, 9)) for i in range(500)], "k long, v long")
    order = [F.col("k").desc() if desc else F.col("k").asc()]
    got = rows(prefix_sum(df, order, "v", "cs"), ["k", "cs"])
    want = rows(df.withColumn("cs", F.sum("v").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))),
                ["k", "cs"])
    assert got == want


def test_auc_with_one_score_per_row(spark):
    from tillpoint.plans.risk import roc_auc
    rnd = random.Random(3)
    data = [(rnd.randint(0, 1), rnd.random()) for _ in range(400)]
    df = spark.createDataFrame(data, "is_returned int, score double")
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    want = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
    assert roc_auc(df).collect()[0].roc_auc == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("n", [0, 1, 37, 300])
def test_sample_exact_matches_hash_order_limit(spark, n):
    from tillpoint.operators.sampling import hash_order_key, sample_exact
    df = spark.createDataFrame([(f"id{i}", i % 5) for i in range(300)], "k string, v int").repartition(7)
    got = rows(sample_exact(df, n, "k", seed=9), ["k"])
    want = rows(df.orderBy(hash_order_key("k", 9), "k").limit(n), ["k"])
    assert got == want and len(got) == n
