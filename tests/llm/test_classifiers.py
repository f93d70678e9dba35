import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillpoint.llm import ordinal_quality, toxicity
from tillpoint.llm.features import BUCKETS, shapes, terms
from tillpoint.llm.linear import Sample, fit_ordinal
from tillpoint.llm.queries import ratings

from .conftest import awkward_rows

SF = "/root/testdata/sf0.01"


def auc(label, score):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_features():
    assert {"hello", "hell*", "hello*", "a"} <= terms("Hello, a HELLO")
    assert terms("") == set() and shapes("") == {}
    assert shapes("Aa bb bb XX!! 12") == {"Aa": 0.2, "a": 0.2, "=a": 0.2, "A!!": 0.2, "0": 0.2}


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels


def test_toxicity_holds_out_and_ranks(trained):
    docs, labels = trained
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id", "left").toPandas()
    assert len(rows) == docs.count()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    held = rows[rows.held_out & rows.toxic.notna()]
    assert auc(held.toxic.to_numpy(), held.score.to_numpy()) > 0.75
    assert rows[(rows.toxic == 0)].predicted.mean() < 0.05
    assert ((model.labels.accuracy >= 0) & (model.labels.accuracy <= 1)).all()


def test_labels_of_held_out_rows_are_not_read(trained):
    docs, labels = trained
    held = toxicity.remainder(F.col("doc_id")) == toxicity.HELD_OUT
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a.intercept == pytest.approx(b.intercept)
    assert np.allclose(a.weights.dense(BUCKETS), b.weights.dense(BUCKETS), atol=1e-5)


def test_label_model_weighs_voters():
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.2).astype(float)
    def voter(hit, miss):
        return np.where(rng.random(4000) < np.where(y == 1, hit, miss), 1, -1)
    good, weak = voter(0.7, 0.01), voter(0.3, 0.15)
    clean = np.where(rng.random(4000) < np.where(y == 0, 0.9, 0.1), 0, -1)
    votes = np.column_stack([good, good, weak, clean]).astype(np.int8)
    rated = np.where(rng.random(4000) < 0.97, y, 1 - y)
    model, q = toxicity.fit_label_model(votes, 0.2, rated)
    assert model.accuracy[0] > model.accuracy[2] and model.repeats[0] > 1.9 > model.repeats[2]
    assert auc(y, q) > 0.97 and auc(y, model.posterior(votes)) > 0.9


def test_label_model_learns_rates_from_agreement():
    """Without any rating, voters that agree are believed and a random one is not."""
    rng = np.random.default_rng(5)
    y = (rng.random(6000) < 0.2).astype(float)
    def voter(hit, miss):
        return np.where(rng.random(6000) < np.where(y == 1, hit, miss), 1, -1)
    votes = np.column_stack([voter(0.8, 0.02), voter(0.7, 0.02), voter(0.6, 0.02), voter(0.2, 0.2),
                             np.where(rng.random(6000) < np.where(y == 0, 0.9, 0.1), 0, -1)]).astype(np.int8)
    model, q = toxicity.fit_label_model(votes, 0.2)
    assert model.accuracy[:3].min() > 0.7 and model.accuracy[3] < 0.4 and auc(y, q) > 0.97
    # missing votes are no evidence, so the rates are low, but in the true order
    assert (np.diff(model.rates[:3, 1]) < 0).all() and (model.rates[:3, 1] > 10 * model.rates[:3, 0]).all()
    unrated, _ = toxicity.fit_label_model(votes, 0.2, np.full(6000, np.nan))
    assert np.allclose(unrated.rates, model.rates)


def test_unlabelled_rows_are_learnt_from_and_held_out_texts_are_not(trained, spark):
    docs, labels = trained
    rows, share = toxicity.training_sample(docs, labels, 50, 100, "doc_id", "text", "toxic")
    toxic = rows["toxic"].to_numpy(float, na_value=np.nan)
    assert np.isnan(toxic).sum() == 100 and (toxic == 0).sum() == 50 and 0 < (toxic == 1).sum() <= 50
    held = toxicity.remainder(F.col("doc_id")) == toxicity.HELD_OUT
    blank = docs.withColumn("text", F.when(held, F.lit("idiot")).otherwise(F.col("text")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(blank, labels)
    assert np.allclose(a.weights.dense(BUCKETS), b.weights.dense(BUCKETS), atol=1e-5)
    # an id that a third of all rows share is one row of the sample
    hot = docs.unionByName(spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x").alias("text")),
                           allowMissingColumns=True)
    again, _ = toxicity.training_sample(hot, labels, 50, 100, "doc_id", "text", "toxic")
    assert len(again) == len(rows)


def test_quality_rejects_junk_and_keeps_the_clean(trained):
    docs, labels = trained
    model = ordinal_quality.fit(docs, ratings(labels), grades=3)
    assert (np.diff(model.thresholds) > 0).all()
    rows = ordinal_quality.score(docs, model).join(labels, "doc_id", "left").toPandas()
    assert len(rows) == docs.count() and rows.expected_grade.between(0, 2).all()
    assert rows[rows.quality == 1].kept.mean() > 0.99 and rows[rows.quality == 0].kept.mean() < 0.1
    stay = ordinal_quality.select(docs, model)
    assert stay.columns == docs.columns
    assert {r["doc_id"] for r in stay.select("doc_id").collect()} == set(rows[rows.kept].doc_id)


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(1)
    grade = rng.integers(0, 4, 800)
    ids = [[int(g)] + ([9] if rng.random() < 0.5 else []) for g in grade]
    learnt, thresholds = fit_ordinal(Sample.of(ids), grade, np.ones(800), np.ones(5), 4)
    weights = learnt.dense(16)
    assert (np.diff(weights[:4]) > 0).all() and abs(weights[9]) < 0.5 and (np.diff(thresholds) > 0).all()


def test_classifiers_on_awkward_rows(awkward, empty, spark):
    labels = spark.createDataFrame([(1, 1, 1), (7, 1, 0), (8, 0, 0), (None, 1, 1), (3, None, None), (1, 1, 0), (99, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    n = len(awkward_rows())
    for docs, count in ((awkward, n), (empty, 0)):
        scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert len(scored) == count and all(0 <= r["score"] <= 1 for r in scored)
        assert len(ordinal_quality.score(docs, ordinal_quality.fit(docs, ratings(labels), 3)).collect()) == count
    kept = toxicity.drop_toxic(awkward, toxicity.fit(awkward, labels.filter("false")))
    assert kept.count() == n and kept.columns == awkward.columns
    assert ordinal_quality.select(awkward, ordinal_quality.fit(awkward, ratings(labels.filter("false")), 3)).count() == n


def test_texts_are_filtered_few_rows_at_a_time(spark):
    from tillpoint.llm.common import filter_texts
    docs = spark.range(2500).selectExpr("id AS doc_id", "IF(id % 3 = 0, NULL, concat('text ', id)) AS text").coalesce(1)

    def keep():
        def mask(texts):
            assert len(texts) <= 1000
            return np.array([t != "" for t in texts])
        return mask

    assert sorted(r["doc_id"] for r in filter_texts(docs, "text", keep).collect()) == [i for i in range(2500) if i % 3]
