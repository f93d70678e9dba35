"""Quality by ordinal regression on graded ratings.

A cumulative-link model, ``P(grade <= k) = sigmoid(threshold_k - score)``: one weight
for each hashed text feature, shared by all grades, and ordered thresholds. It gives
each document its expected grade and the tail probability of a selection grade, by
which documents are kept.

Features are the terms of the whole text (present or not) and its token shapes
(shares). The fit uses at most ``max_per_grade`` rated rows of each grade (a bounded
sample, the first by a hash of the id), weighted back to the grades' shares.

Edge cases: null and empty texts have no features: their score is that of the
thresholds alone; null ratings are ignored, the lowest counts of several for one
document; without two rated grades every document is kept (expected grade 0, tail
probability 1); an empty table gives an empty result; repeated rows score alike;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import filter_texts, id_text
from tillpoint.llm.features import BUCKETS, Hasher, shapes, terms
from tillpoint.llm.linear import Sample, Weights, fit_ordinal, focus, sigmoid

SHAPE_WEIGHT = 8.0  # a shape that all tokens have counts as much as this many terms


def features(text: str, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashed ids and values of a text."""
    words = np.unique(hasher(terms(text)))
    found = shapes(text)
    ids = np.concatenate([words, hasher([f"shape {s}" for s in found])])
    return ids, np.concatenate([np.ones(len(words)), np.fromiter(found.values(), float, len(found)) * SHAPE_WEIGHT])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        rows = [features(t, hasher) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("grade"), pa.array([r[0] for r in rows], pa.list_(pa.int32())),
             pa.array([r[1] for r in rows], pa.list_(pa.float32()))], names=["grade", "ids", "features"])


@dataclass
class OrdinalModel:
    weights: Weights  # of hashed features
    thresholds: np.ndarray  # ordered, one fewer than grades; empty if nothing could be learnt


def rated_sample(df: DataFrame, ratings: DataFrame, grades: int, max_per_grade: int, id_col: str,
                 text_col: str) -> tuple[pd.DataFrame, np.ndarray]:
    """At most ``max_per_grade`` rows of each grade with their features, and how many rated
    documents each grade has."""
    known = (ratings.select(F.col(id_col).cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"))
             .filter(F.col("doc_id").isNotNull() & F.col("grade").between(0, grades - 1))
             .groupBy("doc_id").agg(F.min("grade").alias("grade")))
    known = known.join(id_text(df, id_col, text_col).select("doc_id").distinct(), "doc_id", "left_semi")
    counts = np.zeros(grades, np.int64)
    for row in known.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["grade"]] = row["n"]
    order = [F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), F.col("doc_id")]
    chosen = known.filter("false")
    for g in range(grades):
        chosen = chosen.unionByName(known.filter(F.col("grade") == g).orderBy(*order).limit(max_per_grade))
    # At most grades x max_per_grade rows: the bound of the broadcast.
    rows = id_text(df, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    return rows.mapInArrow(_extract, "grade int, ids array<int>, features array<float>").toArrow().to_pandas(), counts


def fit_rows(rows: pd.DataFrame, counts: np.ndarray) -> OrdinalModel:
    grade = rows["grade"].to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
    if len(np.unique(grade)) < 2:
        return OrdinalModel(Weights(np.zeros(0, np.int32), np.zeros(0, np.float32)), np.zeros(0))
    sample = Sample.of(list(rows["ids"]), list(rows["features"]))
    drawn = np.bincount(grade, minlength=len(counts))
    weight = (counts / np.maximum(1, drawn))[grade]
    weight = weight / weight.mean()
    scale = np.max([focus(sample, (grade > g).astype(float), weight) for g in range(len(counts) - 1)], axis=0)
    weights, thresholds = fit_ordinal(sample, grade, weight, scale, len(counts))
    return OrdinalModel(weights, thresholds)


def fit(df: DataFrame, ratings: DataFrame, grades: int, max_per_grade: int = 1500, id_col: str = "doc_id",
        text_col: str = "text") -> OrdinalModel:
    """Fit on ``ratings`` (id, grade 0..grades-1) of documents in ``df``."""
    return fit_rows(*rated_sample(df, ratings, grades, max_per_grade, id_col, text_col))


def _grader(model: OrdinalModel, select_grade: int):
    """Per task: a function from texts to (expected grades, tail probabilities)."""
    thresholds, learnt = model.thresholds, model.weights

    def start():
        weights = learnt.dense(BUCKETS)
        hasher = Hasher()

        def grade(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            if not len(thresholds):
                return np.zeros(len(texts)), np.ones(len(texts))
            z = np.zeros(len(texts))
            for i, t in enumerate(texts):
                ids, values = features(t, hasher)
                z[i] = weights[ids] @ values
            above = 1 - sigmoid(thresholds[None, :] - z[:, None])
            return above.sum(axis=1), above[:, select_grade - 1]

        return grade

    return start


def score(df: DataFrame, model: OrdinalModel, select_grade: int = 1, min_tail: float = 0.5,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_grade, tail_probability (of ``select_grade`` or better), kept (tail
    probability at least ``min_tail``) of every row; the text is read once, no shuffle."""
    start = _grader(model, select_grade)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grade = start()
        for batch in batches:
            expected, tail = grade(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(expected), pa.array(tail)],
                                             names=["doc_id", "expected_grade", "tail_probability"])

    scored = id_text(df, id_col, text_col).mapInArrow(
        run, "doc_id long, expected_grade double, tail_probability double")
    return scored.withColumn("kept", F.col("tail_probability") >= min_tail)


def select(df: DataFrame, model: OrdinalModel, select_grade: int = 1, min_tail: float = 0.5,
           text_col: str = "text") -> DataFrame:
    """Rows of ``df`` whose tail probability suffices, with all columns."""
    start = _grader(model, select_grade)

    def keep():
        grade = start()
        return lambda texts: grade(texts)[1] >= min_tail

    return filter_texts(df, text_col, keep)
