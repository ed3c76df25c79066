"""Language identification by nearest centroid.

Texts are byte n-gram vectors (lengths 1 to 3 over letters, ASCII case folded, other bytes one separator), TF-IDF
weighted, normalised. Each language has several spherical k-means centroids; a text gets the language of the centroid
with the highest cosine. A cosine below the distance of nearly all learning texts of that centroid is marked rejected.

Defined cases: null, empty and letterless texts are ``und`` with score 0; without learning texts all are ``und``; ties go
to the language that sorts first; rows without id are dropped, repeated rows agree; further columns are ignored. The fit
takes at most ``max_per_lang`` texts a language (smallest seeded hash), each language in a task of its own; only centroids reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pu_learning import fold
from .spark_util import bounded_join, map_arrow, materialize, with_id
from .text_kernels import BLOCK_BYTES, blocks, buffers

HELD_OUT = (5, 0)
MAX_PER_LANG = 1500
CLUSTERS = 4
DIM_BITS = 12
REJECT_QUANTILE = 0.005
UNKNOWN = "und"

#: Letters keep a code of their own: ASCII letters folded, every byte of non-ASCII text; all else is 0.
_CODE = np.zeros(256, np.uint32)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[0x80:] = np.arange(27, 27 + 128)


def term_counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Documents x dimensions: how often each hashed n-gram of 1 to 3 bytes stands in each document."""
    n, dim = len(off) - 1, 1 << DIM_BITS
    c = _CODE[buf]
    grams = [c, c[:-1] * np.uint32(197) + c[1:] + np.uint32(1 << 16), (c[:-2] * np.uint32(197) + c[1:-1]) * np.uint32(197) + c[2:] + np.uint32(1 << 24)]
    out = np.zeros((n, dim), np.float32)
    for k, g in enumerate(grams):
        g = (g * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIM_BITS)
        for d in range(n):
            part = g[off[d] : max(off[d], off[d + 1] - k)]
            if len(part):
                out[d] += np.bincount(part, minlength=dim)
    return out


def has_letter(col: pa.Array) -> np.ndarray:
    """Whether each text holds a letter in Unicode's sense; null holds none."""
    found = pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False)
    return found.to_numpy(zero_copy_only=False)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray
    lang_of: np.ndarray
    radius: np.ndarray

    def predict(self, col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        lang, score, far = [], [], []
        buf, off = buffers(col)
        ok = has_letter(col)
        for i, _, b, o in blocks(buf, off, BLOCK_BYTES // 4):
            if not len(self.langs):
                n = len(o) - 1
                lang, score, far = lang + [UNKNOWN] * n, [*score, np.zeros(n)], [*far, np.zeros(n, bool)]
                continue
            for a in range(0, len(o) - 1, 512):  # the dense rows stay few
                oo = o[a : a + 513]
                cos = weighted(term_counts(b[oo[0] : oo[-1]], oo - oo[0]), self.idf) @ self.centroids.T
                best = cos.argmax(axis=1)
                top = np.clip(cos[np.arange(len(best)), best], 0, 1)
                here = ok[i + a : i + a + len(best)]
                lang += [self.langs[self.lang_of[k]] if y else UNKNOWN for k, y in zip(best, here, strict=True)]
                score.append(np.where(here, top, 0.0))
                far.append(here & (top < self.radius[best]))
        return lang, np.concatenate(score) if score else np.zeros(0), np.concatenate(far) if far else np.zeros(0, bool)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids and each row's cosine to its own; seeds are rows far from each other."""
    seeds = [0]
    near = x @ x[0]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        cos = x @ c.T
        at = cos.argmax(axis=1)
        new = np.stack([x[at == j].sum(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
        c = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9)
    cos = x @ c.T
    return c, np.stack([cos.argmax(axis=1), cos.max(axis=1)])


def train(docs: DataFrame, *, folds: tuple[int, int] | None = HELD_OUT, max_per_lang: int = MAX_PER_LANG, clusters: int = CLUSTERS) -> LanguageModel:
    learn = with_id(docs, "doc_id").where("text is not null and lang is not null").select("doc_id", "lang")
    if folds:
        learn = learn.where(fold("doc_id", folds[0]) != folds[1])
    # the window sees about twice the rows wanted of a language, however many there are: those of the least hashes
    learn = learn.withColumn("h", F.xxhash64(F.lit(31), "doc_id"))
    sizes = learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    least = bounded_join(learn, sizes, ["lang"], "inner", 64).where((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("n") < 2 * max_per_lang)
    first = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = least.withColumn("r", F.row_number().over(first)).where(F.col("r") <= max_per_lang).select("doc_id", "lang").distinct()
    picked = bounded_join(docs.select("doc_id", "text"), materialize(ids, "language-ids"), ["doc_id"], "inner", 48).select("doc_id", "lang", "text")

    def run(batches):
        for b in batches:
            buf, off = buffers(b.column(2))
            ok = has_letter(b.column(2))
            for i, j, bb, oo in blocks(buf, off, BLOCK_BYTES // 4):
                counts = term_counts(bb, oo)
                some = np.flatnonzero(ok[i:j])
                at = [np.flatnonzero(counts[d]).astype(np.int32) for d in some]
                rows = pa.array(i + some)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(at, pa.list_(pa.int32())), pa.array([counts[d][x] for d, x in zip(some, at, strict=True)], pa.list_(pa.float32()))], names=["doc_id", "lang", "at", "n"])

    rows = materialize(map_arrow(picked, run, "doc_id long, lang string, at array<int>, n array<float>"), "language-sample")
    dim = 1 << DIM_BITS
    total = rows.count()
    # document frequencies of the fixed number of dimensions; one task then clusters the bounded sample of one language
    df = rows.select(F.explode("at").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n")).toArrow()
    held = np.zeros(dim)
    held[df["at"].to_numpy()] = df["n"].to_numpy()
    idf = (np.log((1 + total) / (1 + held)) + 1).astype(np.float32)

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id").combine_chunks()
        at, n = table["at"].combine_chunks(), table["n"].combine_chunks()
        counts = np.zeros((len(table), dim), np.float32)
        counts[np.repeat(np.arange(len(table)), pc.list_value_length(at).to_numpy()), at.flatten().to_numpy()] = n.flatten().to_numpy()
        c, (own, cos) = spherical_kmeans(weighted(counts, idf), clusters)
        radius = [float(np.quantile(cos[own == k], REJECT_QUANTILE)) if (own == k).any() else 0.0 for k in range(len(c))]
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(c)), "k": pa.array(range(len(c)), pa.int32()), "centroid": pa.array(list(c.astype(np.float32)), pa.list_(pa.float32())), "radius": pa.array(radius, pa.float64())})

    found = rows.groupBy("lang").applyInArrow(fit, "lang string, k int, centroid array<float>, radius double").toArrow().sort_by([("lang", "ascending"), ("k", "ascending")])
    langs = sorted(set(found["lang"].to_pylist()))
    cents = found["centroid"].combine_chunks().flatten().to_numpy().reshape(-1, dim) if langs else np.zeros((0, dim), np.float32)
    return LanguageModel(tuple(langs), idf, cents, np.searchsorted(langs, found["lang"].to_pylist()) if langs else np.zeros(0, int), found["radius"].to_numpy())


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of every row, from its whole text."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            lang, score, far = known.value.predict(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return map_arrow(with_id(docs, "doc_id").select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, rejected boolean")

