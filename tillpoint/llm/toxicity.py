"""Toxicity by weak supervision.

1. *Voters.* Many weak voters look at a document: lexicon voters (one for each term
   of a public seed list and of terms mined from labelled training rows, words and
   word beginnings), pattern voters (shouting, exclamation runs, repeated terms) and
   clean voters (no lexicon term at all). A voter says toxic, clean, or abstains.
2. *Label model.* A generative model of the votes on labelled and unlabelled rows,
   fitted by EM: each voter's rate under either class, for a given class balance. Rates
   come from the voters' agreement and, on labelled rows, from the rating, a voter of
   fixed accuracy that takes part in this estimate alone. The votes' correlation inside
   the classes is estimated too, and a voter's evidence is divided by how much of it
   other voters repeat. A row's posterior comes from its votes, never from its rating.
3. *Classifier.* A logistic model over hashed words and word beginnings learns the
   label model's posteriors of all drawn rows and scores every document.

Labels are read only of rows whose crc32(doc_id as text) mod 4 is not 2, to mine
lexicon terms, set the class balance and calibrate the voters' rates. At most
``max_per_class`` rows of each label and ``max_unlabelled`` rows without one are used (a
bounded sample, the first by a hash of the id; held-out rows are not drawn). Language,
source and id are never inputs of a score.

Edge cases: null and empty texts have no features and get the intercept's score;
labels that are null are ignored, a document labelled twice counts as toxic if one
label says so; of rows with equal ids the smallest text is learnt from, rows without an
id are only scored; without labelled rows every document scores 0; an empty table gives
an empty result; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import filter_texts, id_text
from tillpoint.llm.features import BUCKETS, Hasher, bucket, shapes, terms
from tillpoint.llm.linear import Sample, Weights, fit_logistic, focus, sigmoid

# A public seed list of insults.
SEED_TERMS = """
idiot moron stupid dumb fool loser scum trash garbage worthless pathetic disgusting
clown imbecile jerk bastard
""".split()
PATTERNS = ("shouting", "exclaiming", "repeating")
HELD_OUT = 2  # remainder of crc32(doc_id as text) mod 4 that is never learnt from
MINED = 96


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4


def _patterns(text: str) -> list[float]:
    found = shapes(text)
    return [sum(v for s, v in found.items() if s.lstrip("=").startswith("A") and not s.lstrip("=").startswith("Aa")),
            sum(v for s, v in found.items() if s.endswith("!")),
            sum(v for s, v in found.items() if s.startswith("="))]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, text) -> (toxic, hashed terms, pattern shares)."""
    hasher = Hasher()
    for batch in batches:
        texts = batch.column("text").to_pylist()
        ids = [np.unique(hasher(terms(t))).tolist() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("toxic"), pa.array(ids, pa.list_(pa.int32())),
             pa.array([_patterns(t) for t in texts], pa.list_(pa.float64()))], names=["toxic", "terms", "patterns"])


def training_sample(df: DataFrame, labels: DataFrame, max_per_class: int, max_unlabelled: int, id_col: str,
                    text_col: str, label_col: str) -> tuple[pd.DataFrame, float]:
    """At most ``max_per_class`` rows of each label and ``max_unlabelled`` rows without one, with
    their features, on the driver, and the share of toxic rows among all labelled ones."""
    texts = id_text(df, id_col, text_col)
    ids = texts.select("doc_id").filter(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != HELD_OUT))
    known = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
             .filter(F.col("toxic").isin(0, 1) & (remainder(F.col("doc_id")) != HELD_OUT))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    known = known.join(ids.distinct(), "doc_id", "left_semi")
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    order = [F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.col("doc_id")]
    unlabelled = ids.distinct().join(known, "doc_id", "left_anti").withColumn("toxic", F.lit(None).cast("int"))
    chosen = unlabelled.orderBy(*order).limit(max_unlabelled)
    for label in (1, 0):
        chosen = chosen.unionByName(known.filter(F.col("toxic") == label).orderBy(*order).limit(max_per_class))
    # At most 2 x max_per_class + max_unlabelled rows: the bound of the broadcast.
    rows = (texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id")
            .agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")))
    found = rows.mapInArrow(_extract, "toxic int, terms array<int>, patterns array<double>").toArrow()
    return found.to_pandas(), share


def mine_terms(sample: Sample, toxic: np.ndarray, known: np.ndarray, ratio: float,
               count: int = MINED) -> np.ndarray:
    """Hashed ids of the terms that stand out most in toxic rows (G-test) among those with
    ``known`` labels, found in at least three and 2 % of them and at least ``ratio`` times as
    often as in clean rows."""
    is_toxic, is_clean = (known & (toxic == 1)).astype(float), (known & (toxic == 0)).astype(float)
    n1, n0 = max(1, is_toxic.sum()), max(1, is_clean.sum())
    hit1, hit0 = sample.sums(is_toxic), sample.sums(is_clean)
    rate1, rate0 = (hit1 + 0.1) / n1, (hit0 + 0.1) / n0
    mean = (hit1 + hit0 + 0.2) / (n1 + n0)
    gain = hit1 * np.log(rate1 / mean) + hit0 * np.log(rate0 / mean)
    gain[(hit1 < np.maximum(3, 0.02 * n1)) | (rate1 < ratio * rate0)] = 0
    best = np.argsort(-gain, kind="stable")[:count]
    return sample.columns[best[gain[best] > 0]]


def votes_of(sample: Sample, patterns: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """rows x voters: 1 toxic, 0 clean, -1 abstains. ``lexicon``: hashed ids, ascending."""
    hit = np.zeros((sample.size, len(lexicon)), bool)
    ids = sample.columns[sample.at]
    at = np.minimum(np.searchsorted(lexicon, ids), len(lexicon) - 1)
    found = lexicon[at] == ids
    hit[sample.row[found], at[found]] = True
    lexical = np.where(hit, 1, -1)
    shown = np.where(patterns > np.array([0.3, 0.3, 0.3]), 1, -1)
    clean = np.where(hit.any(axis=1), -1, 0)[:, None]
    calm = np.where(hit.any(axis=1) | (patterns > 0.1).any(axis=1), -1, 0)[:, None]
    return np.concatenate([lexical, shown, clean, calm], axis=1).astype(np.int8)


@dataclass
class LabelModel:
    """``balance``: share of toxic rows; ``rates[v, y]``: how often voter v votes, given
    class y; ``evidence``: log odds of a vote; ``repeats``: how many voters' worth of
    evidence say the same; ``accuracy`` per voter; ``correlation``: of the votes inside
    the classes."""
    balance: float
    rates: np.ndarray
    evidence: np.ndarray
    repeats: np.ndarray
    accuracy: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return sigmoid(np.log(self.balance / (1 - self.balance))
                       + joint_evidence((votes >= 0).astype(float), self.evidence, self.repeats))


def joint_evidence(voted: np.ndarray, evidence: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """Log odds of each row's votes. On either side the discounted evidence adds up, but
    dependent voters together never say less than the strongest of them alone."""
    total = np.zeros(len(voted))
    for own in (np.maximum(evidence, 0), np.minimum(evidence, 0)):
        summed, alone = voted @ (own / repeats), voted * own
        strongest = alone.max(axis=1) if own.max(initial=0) > 0 else alone.min(axis=1)
        total += np.where(np.abs(summed) >= np.abs(strongest), summed, strongest)
    return total


def fit_label_model(votes: np.ndarray, balance: float, rated: np.ndarray | None = None, rater: float = 0.97,
                    rounds: int = 15, weight: np.ndarray | None = None) -> tuple[LabelModel, np.ndarray]:
    """EM over the votes of weighted rows for a given class balance; returns the model and
    the rows' posteriors. Voters' rates come from their agreement: the first posteriors
    count the votes on either side. With ``rated`` (0 or 1; NaN: none), a rating is one more
    voter, of fixed accuracy ``rater``. Rates are smoothed, and a voter stays on the side it
    was built for (its vote is evidence for its own class, or none)."""
    voted = (votes >= 0).astype(float)
    weight = np.ones(len(votes)) if weight is None else weight
    side = np.where((votes == 1).any(axis=0), 1, 0)
    toward = np.where(side == 1, 1.0, -1.0)
    balance = float(np.clip(balance, 0.01, 0.99))
    prior = np.full(len(votes), np.log(balance / (1 - balance)))
    if rated is not None:
        prior = prior + np.nan_to_num(2 * rated - 1) * np.log(rater / (1 - rater))
    q = sigmoid(prior + 2 * (voted @ toward))
    rates = evidence = repeats = accuracy = correlation = None
    for _ in range(rounds):
        w1, w0 = weight * q, weight * (1 - q)
        rates = np.column_stack([(w0 @ voted + 0.5) / (w0.sum() + 1), (w1 @ voted + 0.5) / (w1.sum() + 1)])
        residual = voted - (np.outer(1 - q, rates[:, 0]) + np.outer(q, rates[:, 1]))
        spread = np.sqrt(weight @ residual ** 2 / weight.sum()) + 1e-6
        correlation = (residual / spread * weight[:, None]).T @ (residual / spread) / weight.sum()
        np.fill_diagonal(correlation, 0.0)
        same = side[:, None] == side[None, :]
        repeats = 1 + np.where(same, np.maximum(correlation, 0), 0).sum(axis=1)
        evidence = np.log(rates[:, 1] / rates[:, 0])
        evidence = np.where(toward * evidence > 0, evidence, 0.0)
        agree = np.where(side == 1, rates[:, 1] * balance, rates[:, 0] * (1 - balance))
        accuracy = agree / (rates[:, 1] * balance + rates[:, 0] * (1 - balance))
        q = sigmoid(prior + joint_evidence(voted, evidence, repeats))
    return LabelModel(balance, rates, evidence, repeats, accuracy, correlation), q


@dataclass
class ToxicityModel:
    weights: Weights  # of hashed terms
    intercept: float
    labels: LabelModel | None


def fit(df: DataFrame, labels: DataFrame, max_per_class: int = 2000, max_unlabelled: int = 4000,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Voters, label model and classifier from a bounded sample of labelled and unlabelled rows."""
    return fit_rows(*training_sample(df, labels, max_per_class, max_unlabelled, id_col, text_col, label_col))


def fit_rows(rows: pd.DataFrame, share: float, rater: float | None = 0.97,
             min_precision: float = 0.8) -> ToxicityModel:
    """``rows``: toxic (missing: a row without a label), terms, patterns. A mined term must, at
    the class balance, be right in ``min_precision`` of the rows where it stands. Without a
    ``rater``, the voters' rates come from their agreement alone."""
    toxic = rows["toxic"].to_numpy(float, na_value=np.nan) if len(rows) else np.zeros(0)
    known = ~np.isnan(toxic)
    if toxic[known].sum() == 0:
        return ToxicityModel(Weights(np.zeros(0, np.int32), np.zeros(0, np.float32)), -40.0, None)
    sample = Sample.of(list(rows["terms"]))
    patterns = np.stack([np.asarray(p, float) for p in rows["patterns"]])
    mined = mine_terms(sample, toxic, known, min_precision / (1 - min_precision) * (1 - share) / share)
    lexicon = np.unique(np.concatenate([mined, [bucket(t) for t in SEED_TERMS]]).astype(np.int64))
    votes = votes_of(sample, patterns, lexicon)
    mean = toxic[known].mean()  # labelled rows are drawn by label: weigh them back to the share
    weight = np.where(toxic == 1, share / mean, np.where(toxic == 0, (1 - share) / max(1e-9, 1 - mean), 1.0))
    model, _ = fit_label_model(votes, share, None if rater is None else toxic, rater or 0.5, weight=weight)
    posterior = model.posterior(votes)
    weights, intercept = fit_logistic(sample, posterior, weight, focus(sample, posterior, weight))
    return ToxicityModel(weights, intercept, model)


def _scores(model: ToxicityModel):
    """Per task: a function from texts to scores."""
    weights, intercept = model.weights, model.intercept

    def start():
        dense = weights.dense(BUCKETS)
        hasher = Hasher()
        return lambda texts: sigmoid(np.array(
            [float(dense[np.unique(hasher(terms(t)))].sum(dtype=np.float64)) + intercept for t in texts], float))

    return start


def score(df: DataFrame, model: ToxicityModel, threshold: float = 0.3, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; the text is read once, no shuffle."""
    start = _scores(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores(batch.column("text").to_pylist()))], names=["doc_id", "score"])

    scored = id_text(df, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(df: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Rows of ``df`` that score below the threshold, with all columns."""
    start = _scores(model)

    def keep():
        scores = start()
        return lambda texts: scores(texts) < threshold

    return filter_texts(df, text_col, keep)
