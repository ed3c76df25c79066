"""Toxicity by non-negative positive-unlabelled learning over word and word-beginning features.

Confirmed toxic documents of the learning folds are the positives, a sample of all texts is unlabelled, the class prior that
corrects the risk is the toxic share among labelled rows of those folds. Features are hashed lower-case words and word beginnings whose
document frequency is clearly higher or lower among positives than among unlabelled texts, by z-score and by effect size, all of them; a text's value is
log(1 + count), with rates beside it, so a single word in a long text still counts. Learning rows are kept by their cells that are
not zero, so memory grows with the words of the samples, not with the number of features.

Defined cases: null and empty texts have no features and score by the bias alone; a row without id is dropped; repeated
rows score alike; without toxic labels every score is the prior (0 without any label); further columns are ignored.
The samples are bounded by ``max_positive``, ``max_labelled`` and ``max_unlabelled`` rows (smallest seeded hash); ``None`` takes every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pu_learning import LinearPU, SparseRows, calibrate, fit_nnpu, fold, sample_ids, sigmoid
from .spark_util import bounded_join, map_arrow, materialize, with_id
from .text_kernels import ALNUM_ANY, blocks, buffers, distinct, hashes, words

HELD_OUT = (4, 2)
MAX_POSITIVE = 3000
MAX_LABELLED = 3000
MAX_UNLABELLED = 5000
#: Least z-score of a feature, and least difference of its frequencies in standard deviations: of large samples weak words pass the first too.
MIN_Z, MIN_EFFECT = 4.5, 0.3
#: Bytes of word beginnings that are features too, and the bits of all hashes.
PREFIXES = (5, 7)
HASH_BITS = 22


def hashed_words(buf: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per view (whole words, then each prefix length) the hash of every word, and each document's first word."""
    start, end, w_off = words(buf, off, ALNUM_ANY)
    ids, known = distinct(buf, start, end, lower=True)
    shift = np.uint64(64 - HASH_BITS)
    out = [(hashes(known) >> shift)[ids]]
    for n in PREFIXES:
        out.append(((hashes(pc.binary_slice(known, 0, n)) ^ np.uint64(n * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> shift)[ids])
    return out, w_off


@dataclass(frozen=True)
class ToxicModel:
    keys: np.ndarray
    linear: LinearPU | None
    scale: tuple[float, float]
    prior: float

    def rows(self, col: pa.Array) -> Iterator[SparseRows]:
        """Blocks of documents x (2 x keys) by cells: log counts and rates."""
        buf, off = buffers(col)
        k = len(self.keys)
        for _, _, b, o in blocks(buf, off):
            views, w_off = hashed_words(b, o)
            n = len(o) - 1
            doc = np.repeat(np.arange(n), np.diff(w_off))
            hits = []
            for h in views:
                at = self.where(h)
                hits.append(doc[at >= 0] * k + at[at >= 0])
            cell, count = np.unique(np.concatenate(hits), return_counts=True)
            d, f = cell // max(k, 1), cell % max(k, 1)
            d, f = np.concatenate([d, d]), np.concatenate([f, f + k])
            value = np.concatenate([np.log1p(count), 10 * count / np.maximum(np.diff(w_off), 20)[d[: len(count)]]])
            order = np.lexsort((f, d))
            yield SparseRows(np.searchsorted(d[order], np.arange(n + 1)), f[order].astype(np.int32), value[order], 2 * k)

    def where(self, h: np.ndarray) -> np.ndarray:
        table = getattr(self, "_table", None)
        if table is None:
            table = np.full(1 << HASH_BITS, -1, np.int32)
            table[self.keys.astype(np.int64)] = np.arange(len(self.keys))
            object.__setattr__(self, "_table", table)
        return table[h.astype(np.int64)]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    def score(self, col: pa.Array) -> np.ndarray:
        if self.linear is None:
            return np.full(len(col), self.prior)
        z = [self.linear.margin(x) for x in self.rows(col)]
        return sigmoid(self.scale[0] * (np.concatenate(z) if z else np.zeros(0)) + self.scale[1])


def document_frequencies(sample: DataFrame) -> DataFrame:
    """``key, n1, nu``: in how many positives and unlabelled texts of the sample each hash stands; summed a batch at a time."""

    def run(batches):
        for b in batches:
            y = b.column(0).to_numpy()
            buf, off = buffers(b.column(1))
            for i, _, bb, oo in blocks(buf, off):
                views, w_off = hashed_words(bb, oo)
                sets = {1: [], -1: []}
                for d in range(len(oo) - 1):
                    if y[i + d] != 0:
                        sets[int(y[i + d])].append(np.unique(np.concatenate([h[w_off[d] : w_off[d + 1]] for h in views])))
                keys, counts = [], []
                for x in (1, -1):
                    k, c = np.unique(np.concatenate(sets[x]) if sets[x] else np.zeros(0, np.uint64), return_counts=True)
                    keys.append(k.astype(np.int64))
                    counts.append(c)
                n1 = np.concatenate([counts[0], np.zeros(len(keys[1]), np.int64)])
                nu = np.concatenate([np.zeros(len(keys[0]), np.int64), counts[1]])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(n1), pa.array(nu)], names=["key", "n1", "nu"])

    parts = map_arrow(sample.select("y", "text"), run, "key long, n1 long, nu long")
    return parts.groupBy("key").agg(F.sum("n1").alias("n1"), F.sum("nu").alias("nu"))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", folds: tuple[int, int] | None = HELD_OUT, max_positive: int | None = MAX_POSITIVE, max_labelled: int | None = MAX_LABELLED, max_unlabelled: int | None = MAX_UNLABELLED) -> ToxicModel:
    learn = with_id(labels, "doc_id").where(F.col(label).isNotNull())
    if folds:
        learn = learn.where(fold("doc_id", folds[0]) != folds[1])
    learn = learn.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    share = learn.agg(F.avg("y")).first()[0]
    if not share or share >= 1:
        return ToxicModel(np.zeros(0, np.uint64), None, (1.0, 0.0), float(share or 0))
    prior = float(share)
    pos = sample_ids(learn.where("y = 1"), max_positive, 21)
    neg = sample_ids(learn.where("y = 0"), max_labelled, 22)
    unl = sample_ids(with_id(docs.select("doc_id"), "doc_id"), max_unlabelled, 23).distinct().withColumn("y", F.lit(-1))
    ids = pos.unionByName(neg).unionByName(unl)
    sample = materialize(bounded_join(docs.select("doc_id", "text"), ids, ["doc_id"], "inner", 32).select("doc_id", "y", "text"), "toxic-sample")
    # two-sample z-score of each hash's document frequency among positives and unlabelled texts
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, nu = max(sizes.get(1, 0), 1), max(sizes.get(-1, 0), 1)
    p = (F.col("n1") + F.col("nu")) / (n1 + nu)
    effect = F.abs(F.col("n1") / n1 - F.col("nu") / nu) / F.sqrt(p * (1 - p) + F.lit(1e-12))
    least = max(MIN_EFFECT, MIN_Z * (1 / n1 + 1 / nu) ** 0.5)
    best = document_frequencies(sample).where("n1 + nu >= 5").where(effect > least)
    keys = np.sort(best.select("key").toArrow()["key"].to_numpy()).astype(np.uint64)
    if not len(keys):
        return ToxicModel(keys, None, (1.0, 0.0), prior)
    blank = docs.sparkSession.sparkContext.broadcast(ToxicModel(keys, None, (1.0, 0.0), prior))

    def run(batches):
        for b in batches:
            at = 0
            for x in blank.value.rows(b.column(2)):
                cells = pa.array(x.row_off, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(x)), b.column(1).slice(at, len(x)), pa.ListArray.from_arrays(cells, pa.array(x.col)), pa.ListArray.from_arrays(cells, pa.array(x.value))], names=["doc_id", "y", "col", "value"])
                at += len(x)

    table = map_arrow(sample, run, "doc_id long, y int, col array<int>, value array<double>").toArrow().combine_chunks()
    y = table["y"].to_numpy()
    order = np.lexsort([table["doc_id"].to_numpy(), y])
    col, value = (table[c].combine_chunks() for c in ("col", "value"))
    rows = SparseRows(np.concatenate([[0], np.cumsum(pc.list_value_length(col).to_numpy())]), col.flatten().to_numpy(), value.flatten().to_numpy(), 2 * len(keys))
    of = lambda which: rows.take(order[which[order]])
    linear = fit_nnpu(of(y == 1), of(y == -1), prior, steps=250, rate=0.05, l2=1e-3)
    margin, lab = linear.margin(of(y >= 0)), np.sort(y[y >= 0]).astype(np.float64)
    return ToxicModel(keys, linear, calibrate(margin, lab, prior=prior), prior)


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``doc_id, score`` of every row, from its whole text."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(known.value.score(b.column(1)), pa.float64())], names=["doc_id", "score"])

    return map_arrow(with_id(docs, "doc_id").select("doc_id", "text"), run, "doc_id long, score double")
