"""Quality classifier by positive-unlabelled learning over document statistics.

Trusted positives are the documents labelled good; a sample of all texts is unlabelled web text; the class prior is
estimated from the two, without negative labels. The model is additive: each statistic is cut at quantiles
of the unlabelled sample, each bin has a weight, and the weights minimise the non-negative unbiased risk. The margin, whose order
this fixes, is then scaled to a probability on the labelled rows of the learning folds: here alone labels of poor documents count.

Defined cases: null and empty texts score as a text of no words; repeated rows score alike; a row without id is
dropped; without labels of both classes every score is the prior (0.5 without any label); further columns of the
input are ignored. Samples for the fit are bounded by ``max_labelled`` and ``max_unlabelled`` rows (smallest seeded hash); ``None``
takes every row, whose statistics (8 bytes each) then gather on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .doc_stats import FEATURES, column_stats
from .pu_learning import DenseRows, LinearPU, calibrate, fit_pu, fold, sample_ids, sigmoid
from .spark_util import bounded_join, map_arrow, with_id

HELD_OUT = (3, 1)
MAX_LABELLED = 8000
MAX_UNLABELLED = 8000
BINS = 24


@dataclass(frozen=True)
class QualityModel:
    cuts: tuple[np.ndarray, ...]
    linear: LinearPU | None
    scale: tuple[float, float]
    prior: float

    def one_hot(self, feats: np.ndarray) -> np.ndarray:
        return np.concatenate([np.eye(len(c) + 1, dtype=np.float32)[np.searchsorted(c, feats[:, j], "right")] for j, c in enumerate(self.cuts)], axis=1)

    def score(self, feats: np.ndarray) -> np.ndarray:
        if self.linear is None:
            return np.full(len(feats), self.prior)
        z = np.full(len(feats), self.linear.bias)
        at = 0
        for j, c in enumerate(self.cuts):
            z += self.linear.weight[at : at + len(c) + 1][np.searchsorted(c, feats[:, j], "right")]
            at += len(c) + 1
        return sigmoid(self.scale[0] * z + self.scale[1])


def feature_rows(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Statistics of the documents of a bounded id sample, with the other columns of ``ids``: a bounded matrix on the driver."""
    extra = [c for c in ids.columns if c != "doc_id"]
    picked = bounded_join(docs.select("doc_id", "text"), ids, ["doc_id"], "inner", 32).select("doc_id", "text", *extra)

    def run(batches):
        for b in batches:
            _, feats = column_stats(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(feats), pa.list_(pa.float64())), *b.columns[2:]], names=["doc_id", "feats", *extra])

    return map_arrow(picked, run, "doc_id long, feats array<double>" + "".join(f", {c} int" for c in extra)).toPandas().sort_values("doc_id")


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", folds: tuple[int, int] | None = HELD_OUT, max_labelled: int | None = MAX_LABELLED, max_unlabelled: int | None = MAX_UNLABELLED) -> QualityModel:
    """Fit on labelled rows whose fold is not the held-out one, and on unlabelled documents of any fold."""
    learn = with_id(labels, "doc_id").where(F.col(label).isNotNull())
    if folds:
        learn = learn.where(fold("doc_id", folds[0]) != folds[1])
    learn = sample_ids(learn.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y")), max_labelled, 11)
    known = feature_rows(docs, learn)
    others = sample_ids(with_id(docs.select("doc_id"), "doc_id"), max_unlabelled, 12).distinct()
    unl = feature_rows(docs, others)
    y = known["y"].to_numpy(np.float64)
    x, u = (np.stack(d["feats"]) if len(d) else np.zeros((0, len(FEATURES))) for d in (known, unl))
    share = float(y.mean()) if len(y) else 0.5
    if not len(u) or not 0 < share < 1:
        return QualityModel((), None, (1.0, 0.0), share)
    cuts = tuple(np.unique(np.quantile(u[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(u.shape[1]))
    model = QualityModel(cuts, None, (1.0, 0.0), share)
    labelled = DenseRows(model.one_hot(x))
    linear, prior = fit_pu(labelled.take(np.flatnonzero(y > 0)), DenseRows(model.one_hot(u)))
    return QualityModel(cuts, linear, calibrate(linear.margin(labelled), y), prior)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score`` of every row, from its whole text."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            _, feats = column_stats(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(known.value.score(feats), pa.float64())], names=["doc_id", "score"])

    return map_arrow(with_id(docs, "doc_id").select("doc_id", "text"), run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose text scores ``threshold`` or more, with all their columns; no shuffle."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            _, feats = column_stats(b.column(at))
            yield b.filter(pa.array(known.value.score(feats) >= threshold))

    return map_arrow(docs, run, docs.schema)
