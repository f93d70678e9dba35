"""Cut values from histograms against windows; encodings and ranks that leave the rows in place."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import rows
from tillpoint import catalog
from tillpoint.operators import rank, rank_cuts
from tillpoint.plans import customers as C
from tillpoint.plans import risk as K


@pytest.mark.parametrize("n,k", [(1, 5), (3, 5), (5, 5), (37, 4), (2000, 5)])
def test_buckets_equal_ntile(spark, n, k, monkeypatch):
    monkeypatch.setattr(rank_cuts, "BINS", 8)  # many passes
    rng = random.Random(n)
    data = [(i * 977 - 5000, rng.choice([0, 7, -10 ** 12, 10 ** 15]) if i % 3 else 7, rng.randrange(-50, 50), 1) for i in range(n)]
    df = spark.createDataFrame(data, "id long, wide long, narrow long, same long").repartition(3).checkpoint()
    orders = ["wide", "narrow", "same"]
    cuts = rank_cuts.rank_cuts(df, orders, "id", lambda m: rank_cuts.ntile_ends(m, k))
    got = df.select("id", *[rank_cuts.bucket_of(F.col(o), F.col("id"), cuts[o]).alias(o) for o in orders])
    want = df.select("id", *[F.ntile(k).over(Window.orderBy(o, "id")).alias(o) for o in orders])
    assert rows(got) == rows(want)


def test_rank_qcut_ends():
    for n in range(2, 60):
        for k in (2, 3, 5):
            bucket = [max(1, -(-k * (r - 1) // (n - 1))) for r in range(1, n + 1)]
            assert rank_cuts.rank_qcut_ends(n, k) == [max(r for r in range(1, n + 1) if bucket[r - 1] <= b) for b in range(1, k)]
    with pytest.raises(ValueError):
        rank_cuts.rank_qcut_ends(1, 5)


def test_no_rows(spark):
    df = spark.createDataFrame([], "id long, x long")
    assert rank_cuts.rank_cuts(df, ["x"], "id", lambda n: [n]) == {"x": []}


def test_scores_take_one_checkpoint_and_no_range_sort(spark, wh, monkeypatch):
    taken, plans = [], []
    frame = type(wh["dim_products"])
    checkpoint = frame.checkpoint

    def counted(df, *a, **kw):
        taken.append(df.columns)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpoint(df, *a, **kw)

    monkeypatch.setattr(frame, "checkpoint", counted)
    for scores in (catalog.ntile_scores, catalog.qcut_scores):
        taken.clear()
        out = scores(wh)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        assert len(taken) == 1 and not set(taken[0]) & set(C.ATTRS)
    assert not any("rangepartitioning" in p for p in plans)


def test_encoding_does_not_exchange_the_rows(spark, wh):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = K.categorical_index(wh["dim_products"].withColumn("channel", F.lit("Online")))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning(coalesce(" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_code_tables_are_joined_by_sorting_with_equal_results(spark, wh, monkeypatch):
    df = wh["dim_products"].withColumn("channel", F.lit("Online"))
    expected = rows(K.categorical_index(df), ["product_id", "cat_encoded", "ch_encoded", "heat_encoded"])
    monkeypatch.setattr(K, "CODES_BROADCAST_BYTES", 0)
    assert rows(K.categorical_index(df), ["product_id", "cat_encoded", "ch_encoded", "heat_encoded"]) == expected


def test_ranks_of_two_columns(spark):
    data = [(i, (i * 7) % 5 if i % 6 else None, float(i % 3)) for i in range(50)]
    df = spark.createDataFrame(data, "id long, a long, b double").repartition(4)
    got = rank.global_ranks(df, {"a": "ra", "b": "rb"}).select("id", "ra", "rb")
    over = lambda c: F.rank().over(Window.orderBy(F.col(c).desc_nulls_last()))
    assert rows(got) == rows(df.select("id", over("a").alias("ra"), over("b").alias("rb")))
