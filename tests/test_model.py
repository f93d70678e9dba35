"""Model jobs: AUC agrees with pyspark.ml's evaluator; the tree is a sane classifier."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL

import __spark_entry__ as E
from tillpoint import catalog
from tillpoint.plans import risk as K


def test_auc_matches_binary_classification_evaluator(spark, wh):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    scored = catalog.rule_scored_test(wh)
    ours = K.roc_auc(scored).collect()[0].roc_auc
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderROC",
                                       numBins=0)
    theirs = ev.evaluate(scored.select(F.col("score"), F.col("is_returned").cast("double").alias("label")))
    assert ours == pytest.approx(theirs, abs=1e-9)


def test_tree_is_a_sane_classifier(spark, wh):
    auc = E.queries()["tree_roc_auc"](spark, SF_SMALL).collect()[0].roc_auc
    assert 0.5 < auc < 0.9
    imp = E.queries()["feature_importance"](spark, SF_SMALL).collect()
    assert 1 <= len(imp) <= 6 and abs(sum(r.importance for r in imp)) <= 1.0 + 1e-9
    assert [r.importance for r in imp] == sorted((r.importance for r in imp), reverse=True)


def test_split_is_stratified_and_exact(spark, wh):
    s = E.queries()["stratified_split"](spark, SF_SMALL)
    g = {(r.is_returned, r.split): r.n for r in s.groupBy("is_returned", "split").agg(F.count("*").alias("n")).collect()}
    for label in (0, 1):
        n = g.get((label, "train"), 0) + g.get((label, "test"), 0)
        assert g.get((label, "train"), 0) == int(0.75 * n + 0.5)
