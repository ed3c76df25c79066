"""Non-negative positive-unlabelled learning of linear models in numpy, and the bounded samples they learn from."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def sample_ids(df: DataFrame, most: int | None, seed: int) -> DataFrame:
    """At most ``most`` ids of ``df`` (doc_id, ...), those of the smallest seeded hash: a bounded top-k, the same on every run. ``None``: all."""
    if most is None:
        return df
    return df.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(most)


@dataclass(frozen=True)
class SparseRows:
    """A matrix by the cells that are not zero, sorted by row: a cell costs 12 bytes, whatever the number of columns."""

    row_off: np.ndarray
    col: np.ndarray
    value: np.ndarray
    width: int

    def __len__(self) -> int:
        return len(self.row_off) - 1

    def take(self, rows: np.ndarray) -> SparseRows:
        many = np.diff(self.row_off)[rows]
        ends = np.concatenate([[0], np.cumsum(many)])
        at = np.arange(ends[-1]) + np.repeat(self.row_off[:-1][rows] - ends[:-1], many)
        return SparseRows(ends, self.col[at], self.value[at], self.width)

    def dot(self, weight: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.value * weight[self.col])])
        return total[self.row_off[1:]] - total[self.row_off[:-1]]

    def back(self, by_row: np.ndarray) -> np.ndarray:
        """The sum of the rows, each times its number."""
        return np.bincount(self.col, self.value * np.repeat(by_row, np.diff(self.row_off)), self.width)


@dataclass(frozen=True)
class DenseRows:
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.value)

    @property
    def width(self) -> int:
        return self.value.shape[1]

    def take(self, rows: np.ndarray) -> DenseRows:
        return DenseRows(self.value[rows])

    def dot(self, weight: np.ndarray) -> np.ndarray:
        return (self.value @ weight.astype(self.value.dtype)).astype(np.float64)

    def back(self, by_row: np.ndarray) -> np.ndarray:
        return (by_row.astype(self.value.dtype) @ self.value).astype(np.float64)


@dataclass(frozen=True)
class LinearPU:
    weight: np.ndarray
    bias: float

    def margin(self, x) -> np.ndarray:
        return x.dot(self.weight) + self.bias


def fit_nnpu(x_pos, x_unl, prior: float, *, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> LinearPU:
    """Minimise the non-negative unbiased risk  pi R+(P) + max(0, R-(U) - pi R-(P))  with the logistic loss, by Adam.

    Where the corrected negative risk falls below zero, the step ascends it instead of descending the whole
    (the published correction against overfitting). Full batches of sparse or dense rows.
    """
    d = x_pos.width
    w, b = np.zeros(d), 0.0
    m, v, mb, vb = np.zeros(d), np.zeros(d), 0.0, 0.0
    n_p, n_u = max(len(x_pos), 1), max(len(x_unl), 1)
    for t in range(1, steps + 1):
        zp, zu = x_pos.dot(w) + b, x_unl.dot(w) + b
        neg_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        gp_neg, gu_neg = prior * sigmoid(zp) / n_p, sigmoid(zu) / n_u
        if neg_risk < 0:
            gw, gb = -(x_unl.back(gu_neg) - x_pos.back(gp_neg)), -(gu_neg.sum() - gp_neg.sum())
        else:
            gp = -prior * (1 - sigmoid(zp)) / n_p - gp_neg
            gw, gb = x_pos.back(gp) + x_unl.back(gu_neg), gp.sum() + gu_neg.sum()
        gw = gw + l2 * w
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        step = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w = w - step * m / (np.sqrt(v) + 1e-8)
        b = b - step * mb / (np.sqrt(vb) + 1e-8)
    return LinearPU(w, float(b))


def estimate_prior(pos: np.ndarray, unl: np.ndarray, confidence: float = 0.1) -> float:
    """The share of positives among unlabelled margins: least ratio of the two shares above a bound.

    Above any bound the unlabelled texts hold at least their prior's share of the positives there, so each ratio bounds the prior from above;
    a margin of ``confidence`` for the sampling error (after Hoeffding) makes the least one lie where few negatives are left.
    """
    if not len(pos) or not len(unl):
        return 0.5
    bounds = np.unique(np.concatenate([pos, unl]))
    p = 1 - np.searchsorted(np.sort(pos), bounds) / len(pos)
    u = 1 - np.searchsorted(np.sort(unl), bounds) / len(unl)
    slack = np.sqrt(np.log(4 / confidence) / (2 * len(pos))) + np.sqrt(np.log(4 / confidence) / (2 * len(unl)))
    some = p > 0
    best = int(np.argmin((u[some] + slack) / p[some]))
    return float(np.clip(u[some][best] / p[some][best], 0.0, 1.0))


def fit_pu(x_pos, x_unl, **how) -> tuple[LinearPU, float]:
    """(model, class prior): the prior is estimated from margins of one half of the rows, by a model of the other half."""
    half = [[x.take(np.arange(k, len(x), 2)) for k in (0, 1)] for x in (x_pos, x_unl)]
    first = fit_nnpu(half[0][0], half[1][0], 0.5, **{**how, "steps": 150})
    prior = estimate_prior(first.margin(half[0][1]), first.margin(half[1][1]))
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    return fit_nnpu(x_pos, x_unl, prior, **how), prior


def calibrate(margin: np.ndarray, label: np.ndarray, steps: int = 200, prior: float | None = None) -> tuple[float, float]:
    """Platt scaling (a, b): P(1) = sigmoid(a margin + b), a > 0, by Newton steps with smoothed targets.

    ``prior``: the share of label 1 that the result should assume where the rows have another one.
    """
    n1, n0 = label.sum(), (1 - label).sum()
    if not n1 or not n0:
        return 1.0, 0.0
    t = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 0.5 * (1 + np.tanh(0.5 * (a * margin + b)))
        r = p - t
        s = p * (1 - p) + 1e-9
        g = np.array([(r * margin).sum(), r.sum()])
        hess = np.array([[(s * margin**2).sum() + 1e-6, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    shift = 0.0 if prior is None else float(np.log(prior / (1 - prior)) - np.log(n1 / n0))
    return max(float(a), 1e-3), float(b) + shift


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def auc(score: np.ndarray, label: np.ndarray) -> float:
    """Area under the ROC curve by mid-ranks."""
    _, inv, cnt = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(cnt) - (cnt - 1) / 2)[inv]
    n1, n0 = (label > 0).sum(), (label <= 0).sum()
    return float((rank[label > 0].sum() - n1 * (n1 + 1) / 2) / max(n1 * n0, 1))
