"""Fitting of linear scores on a bounded sample of hashed features (driver, numpy)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Sample:
    """Rows of hashed features. Only features of at least ``min_rows`` rows are kept:
    entry e says that row ``row[e]`` has feature ``columns[at[e]]`` with ``value[e]``."""
    columns: np.ndarray  # hashed ids, ascending
    at: np.ndarray
    value: np.ndarray
    row: np.ndarray
    size: int

    @classmethod
    def of(cls, ids: list, values: list | None = None, min_rows: int = 3) -> "Sample":
        sizes = [len(i) for i in ids]
        flat = np.concatenate([np.asarray(i, np.int32) for i in ids]) if sum(sizes) else np.zeros(0, np.int32)
        row = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        columns, hits = np.unique(flat, return_counts=True)
        columns = columns[hits >= min_rows]
        at = np.searchsorted(columns, flat).astype(np.int32)
        kept = np.zeros(0, bool) if not len(columns) else columns[np.minimum(at, len(columns) - 1)] == flat
        if not len(kept):
            kept = np.zeros(len(flat), bool)
        value = (np.ones(int(kept.sum()), np.float32) if values is None or not len(flat)
                 else np.concatenate([np.asarray(v, np.float32) for v in values])[kept])
        return cls(columns, at[kept], value, row[kept], len(ids))

    def sums(self, per_row: np.ndarray) -> np.ndarray:
        """Sum of ``per_row`` over the rows that have each feature."""
        return np.bincount(self.at, weights=per_row[self.row], minlength=len(self.columns))


def focus(sample: Sample, target: np.ndarray, weight: np.ndarray, min_gain: float = 6.0) -> np.ndarray:
    """How far a feature's presence shifts the odds of a 0..1 ``target``: |log ratio| of
    smoothed rates; 0 for features whose G-test gain (half the G statistic, on row
    counts) is below ``min_gain``."""
    hit1, hit0 = sample.sums(target), sample.sums(1 - target)
    n1, n0 = max(1e-9, target.sum()), max(1e-9, (1 - target).sum())
    mean = (hit1 + hit0 + 2e-9) / (n1 + n0)
    gain = hit1 * np.log((hit1 + 1e-9) / n1 / mean) + hit0 * np.log((hit0 + 1e-9) / n0 / mean)
    hit1, hit0 = sample.sums(weight * target), sample.sums(weight * (1 - target))
    n1, n0 = (weight * target).sum(), (weight * (1 - target)).sum()
    ratio = np.log((hit1 + 1) / (n1 + 2)) - np.log((hit0 + 1) / (n0 + 2))
    return np.where(gain >= min_gain, np.abs(ratio), 0.0)


def adam(gradient, start: np.ndarray, steps: int, rate: float = 0.1) -> np.ndarray:
    """Minimise with Adam; ``gradient(x)`` over the whole sample."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Weights:
    """Weights of the hashed ids in ``columns`` (ascending); all other ids weigh 0."""
    columns: np.ndarray
    values: np.ndarray

    def dense(self, buckets: int) -> np.ndarray:
        full = np.zeros(buckets, np.float32)
        full[self.columns] = self.values
        return full


class Scorer:
    """Design of the features that matter: ``score = rows x (scale * weight)``."""

    def __init__(self, sample: Sample, scale: np.ndarray):
        matters = scale > 0
        place = np.cumsum(matters) - 1
        used = matters[sample.at]
        self.columns, self.scale = sample.columns[matters], scale[matters]
        self.at = place[sample.at[used]].astype(np.int32)
        self.value = sample.value[used] * self.scale[self.at]
        self.row, self.n = sample.row[used], sample.size

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.at], minlength=self.n)

    def pull(self, error: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=self.value * error[self.row], minlength=len(self.columns))

    def weights(self, w: np.ndarray) -> Weights:
        return Weights(self.columns, (w * self.scale).astype(np.float32))


def fit_logistic(sample: Sample, target: np.ndarray, weight: np.ndarray, scale: np.ndarray,
                 l2: float = 1e-3, steps: int = 150) -> tuple[Weights, float]:
    """Weights and intercept for soft 0..1 targets."""
    design = Scorer(sample, scale)
    k = len(design.columns)
    total = max(1e-9, weight.sum())

    def gradient(x):
        error = weight * (sigmoid(design.scores(x[:k]) + x[k]) - target) / total
        return np.append(design.pull(error) + l2 * x[:k], error.sum())

    prior = np.clip((weight * target).sum() / total, 1e-4, 1 - 1e-4)
    x = adam(gradient, np.append(np.zeros(k), np.log(prior / (1 - prior))), steps)
    return design.weights(x[:k]), float(x[k])


def fit_ordinal(sample: Sample, grade: np.ndarray, weight: np.ndarray, scale: np.ndarray, grades: int,
                l2: float = 1e-3, steps: int = 200) -> tuple[Weights, np.ndarray]:
    """Cumulative-link model ``P(grade <= k) = sigmoid(threshold_k - score)``: shared weights,
    and ordered thresholds (first one free, positive steps after it)."""
    design = Scorer(sample, scale)
    k, cuts = len(design.columns), grades - 1
    total = max(1e-9, weight.sum())

    def thresholds(t):
        return np.concatenate([t[:1], t[0] + np.cumsum(np.exp(t[1:]))])

    def gradient(x):
        theta = thresholds(x[k:])
        below = sigmoid(theta[None, :] - design.scores(x[:k])[:, None])  # P(grade <= cut)
        full = np.concatenate([np.zeros((len(grade), 1)), below, np.ones((len(grade), 1))], axis=1)
        upper, lower = full[np.arange(len(grade)), grade + 1], full[np.arange(len(grade)), grade]
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        push = weight / total
        d_score = push * (du - dl)  # derivative of -log p in the score
        d_theta = np.bincount(np.minimum(grade, cuts - 1), weights=-push * du * (grade < cuts), minlength=cuts)
        d_theta += np.bincount(np.maximum(grade - 1, 0), weights=push * dl * (grade > 0), minlength=cuts)
        tail = np.cumsum(d_theta[::-1])[::-1]  # each threshold moves those after it
        d_t = np.append(tail[:1], tail[1:] * np.exp(x[k + 1:]))
        return np.concatenate([design.pull(d_score) + l2 * x[:k], d_t])

    start = np.zeros(k + cuts)
    share = np.cumsum(np.bincount(grade, weights=weight, minlength=grades))[:-1] / total
    first = np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1))
    start[k:] = np.append(first[:1], np.log(np.maximum(np.diff(first), 0.1)))
    x = adam(gradient, start, steps)
    return design.weights(x[:k]), thresholds(x[k:])
