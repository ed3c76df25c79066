"""Quality rules: gradient-boosted trees over document statistics.

Trees of fixed depth are fitted on histograms of quantile bins in numpy and flattened into arrays (feature, threshold,
leaf value by node), so a batch of documents is scored level by level without a loop over rows. Chosen statistics are
monotone: a split is refused if its children's values would run against the sign, and the bounds hold in the subtrees.

Defined cases: null and empty texts have no words and fail the base rules; repeated rows agree; rows without id are
dropped; without labels of both classes the trees are empty and only the base rules decide; further columns are
ignored. At most ``max_labelled`` labelled rows (smallest seeded hash) are learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .doc_stats import BASE, FEATURES, column_stats
from .pu_learning import fold, sample_ids, sigmoid
from .quality_classifier import feature_rows
from .spark_util import map_arrow, with_id

HELD_OUT = (3, 1)
MAX_LABELLED = 12000
DEPTH, TREES, BINS, RATE, MIN_LEAF = 3, 60, 32, 0.2, 5
#: Sign of each monotone statistic: more of it never raises the score.
MONOTONE = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "bang_rate": -1, "adjacent_same_rate": -1, "upper_rate": -1}
#: Base rules: fewest words, and the most percent of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


@dataclass(frozen=True)
class Forest:
    """Complete trees: inner node i has the children 2i+1 and 2i+2; ``x <= threshold`` goes left."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if self.feature.size else 0
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner and at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            z += leaf[at - inner]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def fit_forest(x: np.ndarray, y: np.ndarray, sign: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, reg: float = 1.0) -> Forest:
    """Second-order boosting of the logistic loss on binned columns."""
    n, d = x.shape
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if n else 0.5
    bias = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    if not n or y.min() == y.max():
        return Forest(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), bias)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)  # <= cut k: code <= k
    z = np.full(n, bias)
    feat, thr, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = sigmoid(z)
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        at = np.zeros(n, np.int64)
        value = np.zeros(2 * inner + 1)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            local = at - first
            best = [(1e-6, None)] * many
            for j in range(d):
                width = len(cuts[j]) + 1
                cell = local * width + code[:, j]
                gs = np.bincount(cell, g, many * width).reshape(many, width).cumsum(axis=1)
                hs = np.bincount(cell, h, many * width).reshape(many, width).cumsum(axis=1)
                cs = np.bincount(cell, minlength=many * width).reshape(many, width).cumsum(axis=1)
                gl, hl, cl = gs[:, :-1], hs[:, :-1], cs[:, :-1]
                gr, hr, cr = gs[:, -1:] - gl, hs[:, -1:] - hl, cs[:, -1:] - cl
                if not gl.shape[1]:
                    continue
                lo, hi = low[first : first + many, None], high[first : first + many, None]
                vl, vr = np.clip(-gl / (hl + reg), lo, hi), np.clip(-gr / (hr + reg), lo, hi)
                gain = -(gl * vl + 0.5 * (hl + reg) * vl**2) - (gr * vr + 0.5 * (hr + reg) * vr**2)
                g0, h0 = gs[:, -1:], hs[:, -1:]
                v0 = np.clip(-g0 / (h0 + reg), lo, hi)
                gain += g0 * v0 + 0.5 * (h0 + reg) * v0**2
                gain[(cl < MIN_LEAF) | (cr < MIN_LEAF) | (sign[j] * (vr - vl) < 0)] = -1
                for node in range(many):
                    k = int(gain[node].argmax())
                    if gain[node, k] > best[node][0]:
                        best[node] = (gain[node, k], (j, k, vl[node, k], vr[node, k]))
            for node, (_, split) in enumerate(best):
                i = first + node
                kids = 2 * i + 1, 2 * i + 2
                for kid in kids:
                    low[kid], high[kid] = low[i], high[i]
                if split is None:
                    value[kids[0]] = value[kids[1]] = value[i]
                    continue
                j, k, vl, vr = split
                feat[t, i], thr[t, i] = j, cuts[j][k]
                value[kids[0]], value[kids[1]] = vl, vr
                if sign[j]:
                    mid = (vl + vr) / 2
                    if sign[j] > 0:
                        high[kids[0]], low[kids[1]] = min(high[kids[0]], mid), max(low[kids[1]], mid)
                    else:
                        low[kids[0]], high[kids[1]] = max(low[kids[0]], mid), min(high[kids[1]], mid)
            at = 2 * at + 1 + (x[np.arange(n), feat[t, at]] > thr[t, at])
        leaf[t] = rate * value[inner:]
        z += leaf[t][at - inner]
    return Forest(feat, thr, leaf, bias)


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: tuple[int, int] | None = HELD_OUT, max_labelled: int = MAX_LABELLED) -> Forest:
    learn = with_id(labels, "doc_id").where(F.col(label).isNotNull())
    if folds:
        learn = learn.where(fold("doc_id", folds[0]) != folds[1])
    ids = sample_ids(learn.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")), max_labelled, 41)
    rows = feature_rows(docs, ids)
    x = np.stack(rows["feats"]) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit_forest(x, rows["y"].to_numpy(np.float64), np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def apply_rules(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed``, ``score`` and ``kept`` of every row; no shuffle."""
    known = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for b in batches:
            base, feats = column_stats(b.column(1))
            score = known.value.score(feats)
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(base[:, j]) for j in range(len(BASE))), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], names=["doc_id", *BASE, "base_failed", "score", "kept"])

    return map_arrow(with_id(docs, "doc_id").select("doc_id", "text"), run, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, score double, kept boolean")
