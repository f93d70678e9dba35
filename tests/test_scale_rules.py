"""Plans that must not depend on a single task or on the driver, and exactness."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF_SMALL, rows
from tillpoint.functions.exprs import idiv
from tillpoint.operators.rank import global_rank
from tillpoint.operators.sampling import cut_values, hash_order_key, sample_exact
from tillpoint.plans import audit as A
from tillpoint.plans import ledger as LG
from tillpoint.plans import risk as K
from tillpoint.sources import schemas as SC


def test_hot_key_of_duplicate_rows_is_split(spark):
    """60,000 exact copies of one key: no task holds more than its share of the result."""
    hot = spark.range(60_000).select(F.lit("t1").alias("transaction_id"))
    rest = spark.range(2_000).select(F.concat(F.lit("r"), (F.col("id") % 1_000).cast("string")).alias("transaction_id"))
    t = (hot.unionByName(rest)
         .select("transaction_id", F.lit("1995-01-01").cast("date").alias("transaction_date"),
                 F.when(F.col("transaction_id") == "t1", -1).otherwise(
                     F.substring("transaction_id", 2, 9).cast("long")).cast("long").alias("product_id"),
                 F.lit(None).cast("long").alias("customer_id"), F.lit(5).cast("decimal(12,2)").alias("revenue")))
    out = A.duplicate_rows(t).withColumn("_p", F.spark_partition_id())
    got = out.collect()
    assert len(got) == 62_000
    hot_ranks = sorted(r["row_rank"] for r in got if r["transaction_id"] == "t1")
    assert hot_ranks == list(range(1, 60_001))
    per_task = Counter(r["_p"] for r in got)
    assert max(per_task.values()) < 0.75 * len(got)


def test_integer_division_is_exact_above_2_53(spark):
    row = spark.range(1).select(idiv(F.lit(9007199254740993), F.lit(1)).alias("a"),
                                idiv(F.lit(-7), F.lit(2)).alias("b")).first()
    assert (row["a"], row["b"]) == (9007199254740993, -3)


@pytest.mark.parametrize("n", [0, 1, 17, 499, 500, 900])
def test_sample_equals_the_sorted_prefix(spark, n):
    df = spark.range(500).select(F.concat(F.lit("k"), (F.col("id") % 400).cast("string")).alias("k"), "id")
    got = [r["k"] for r in sample_exact(df, n, "k", seed=9).collect()]
    order = sorted((r["h"], r["k"]) for r in df.select("k", hash_order_key("k", 9).alias("h")).collect())
    assert Counter(got) == Counter(k for _, k in order[:n])


def test_cut_values_per_class(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("_class"), F.md5(F.col("id").cast("string")).alias("_h"),
                                  F.col("id").alias("_k"))
    cuts = {r["_class"]: r for r in cut_values(df, F.round(F.col("_n") * 0.3)).collect()}
    for c in range(3):
        ordered = sorted((r["_h"], r["_k"]) for r in df.filter(F.col("_class") == c).collect())
        want = cuts[c]["_want"]
        assert want == round(0.3 * len(ordered)) and (cuts[c]["_cut_h"], cuts[c]["_cut_k"]) == ordered[want - 1]


def test_split_does_not_sort_or_shuffle_the_frame(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("transaction_id"),
                                  (F.col("id") % 2).cast("int").alias("is_returned"), F.lit("wide").alias("other"))
    split = K.stratified_split(df)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    got = split.groupBy("is_returned", "split").count().collect()
    assert {(r["is_returned"], r["split"]): r["count"] for r in got} == {
        (0, "train"): 1125, (0, "test"): 375, (1, "train"): 1125, (1, "test"): 375}


def test_codes_of_a_column_of_many_values(spark):
    """No window numbers all values of a column."""
    df = spark.range(20_000).select(F.format_string("v%06d", F.col("id") * 7).alias("wide"),
                                    F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), F.col("id") % 3)).alias("small"))
    codes = K.categorical_codes(df, {"small": "none", "wide": "none"})
    assert "row_number(" not in codes._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["_c"], r["_v"], r["_code"]) for r in codes.collect()) == [
        (0, "none", 0), (0, "s1", 1), (0, "s2", 2)] + [(1, f"v{i * 7:06d}", i) for i in range(20_000)]


def test_global_rank_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 7.0), (4, None), (5, 1.0), (6, None)], "id long, v double")
    assert rows(global_rank(df, "v", "r"), ["id", "r"]) == [(1, 2), (2, 2), (3, 1), (4, 5), (5, 4), (6, 5)]


def test_target_months_follow_the_sales(spark):
    stores = spark.createDataFrame([(1,), (2,)], "store_id long")
    txn = spark.createDataFrame([(1, "1999-11-30", 10), (2, "2003-02-01", 20)],
                                "store_id long, d string, revenue int").select(
        "store_id", F.col("d").cast("date").alias("transaction_date"), F.col("revenue").cast("decimal(12,2)").alias("revenue"))
    rule = lambda store, month: F.lit(1000)
    spine = LG.target_spine(stores, txn, rule=rule)
    assert spine.count() == 2 * 40
    assert {r[0] for r in spine.agg(F.min("month"), F.max("month")).select("min(month)").collect()} == {"1999-11"}
    assert LG.target_spine(stores, txn, rule=rule, months=3).count() == 6
    assert LG.target_spine(stores, txn.filter("false"), rule=rule).count() == 0


def test_defaults_are_filled_on_load(spark):
    df = spark.createDataFrame([(None,), (3,)], "quantity int")
    filled = SC.fill_defaults(df, "fact_transactions").collect()
    assert [(r["quantity"], float(r["discount_pct"])) for r in filled] == [(1, 0.0), (3, 0.0)]


def test_date_consistency_dedup(spark):
    t = spark.createDataFrame([("a", "2000-01-10"), ("a", "2000-01-10")], "transaction_id string, d string").select(
        "transaction_id", F.col("d").cast("date").alias("transaction_date"))
    r = spark.createDataFrame([("r", "a", "2000-01-01")], "return_id string, transaction_id string, d string").select(
        "return_id", "transaction_id", F.col("d").cast("date").alias("return_date"))
    assert (A.date_consistency(r, t).count(), A.date_consistency(r, t, dedup=True).count()) == (2, 1)


def test_tree_metrics_agree_with_ml_evaluators(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    q = E.queries()
    pred = q["return_risk_tree"](spark, SF_SMALL).cache()
    report = {r["class_label"]: r for r in q["tree_classification_report"](spark, SF_SMALL).collect()}
    casted = pred.select(F.col("prediction").cast("double"), F.col("is_returned").cast("double").alias("label"))
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(casted)
    assert abs(report["accuracy"]["f1_score"] - accuracy) < 1e-4
    curve = q["tree_pr_curve"](spark, SF_SMALL).collect()
    assert max(r["recall"] for r in curve) == 1.0
    table = q["tree_threshold_table"](spark, SF_SMALL).collect()
    for r in table:
        assert r["flagged"] == pred.filter(F.col("score") >= r["threshold"]).count()
