"""The learned operators: scores made again in plain Python from the model, decisions against thresholds, held-out errors."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import language_id, pu_learning, quality_classifier, quality_rules, toxicity
from palimpsest.llm import queries as q
from palimpsest.llm.doc_stats import column_stats
from palimpsest.llm.queries import table


@pytest.fixture(scope="module")
def sample(duck):
    return duck.execute("select doc_id, text from documents order by doc_id limit 150").fetchall()


def logistic(z):
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def held_out_errors(rows, want, parts, part):
    """Share of held-out rows of either label whose ``predicted`` is wrong; ``predicted`` must follow the threshold."""
    out = {}
    for label in (0, 1):
        mine = [r for r in rows if r.held_out and want.get(r.doc_id) == label]
        assert all((zlib.crc32(str(r.doc_id).encode()) % parts == part) for r in mine)
        out[label] = sum(r.predicted != label for r in mine) / max(len(mine), 1)
    return out


@pytest.fixture(scope="module")
def wide(spark):
    import duckdb

    path = "/root/testdata/sf0.1"
    return path, {d: (a, b) for d, a, b in duckdb.execute(f"select doc_id, quality, toxic from '{path}/labels.parquet'").fetchall()}


def test_quality(spark, sf, sample, wide):
    model = quality_classifier.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    _, feats = column_stats(pa.array([t for _, t in sample]))
    got = model.score(feats)
    for x, score in zip(feats, got, strict=True):
        z, at = model.linear.bias, 0
        for value, cuts in zip(x, model.cuts, strict=True):
            z += model.linear.weight[at + sum(value >= c for c in cuts)]
            at += len(cuts) + 1
        assert score == pytest.approx(logistic(model.scale[0] * z + model.scale[1]))
    path, labels = wide
    rows = q.op4_quality_classifier(spark, path).collect()
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    wrong = held_out_errors(rows, {d: x[0] for d, x in labels.items()}, 3, 1)
    assert wrong[1] < 0.01 and wrong[0] < 0.05


def test_toxicity(spark, sf, sample, wide):
    model = toxicity.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    column = pa.array([t for _, t in sample] + [None, ""])
    got = model.score(column)
    buf = [(t or "").encode() for t in column.to_pylist()]
    place = {int(k): i for i, k in enumerate(model.keys)}
    for data, score in zip(buf, got, strict=True):
        views, w_off = toxicity.hashed_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        count = {}
        for view in views:
            for h in view.tolist():
                if h in place:
                    count[place[h]] = count.get(place[h], 0) + 1
        k, n = len(model.keys), max(int(w_off[1]), 20)
        z = model.linear.bias + sum(math.log1p(c) * model.linear.weight[f] + 10 * c / n * model.linear.weight[k + f] for f, c in count.items())
        assert score == pytest.approx(logistic(model.scale[0] * z + model.scale[1]))
    path, labels = wide
    rows = q.op7_toxicity(spark, path).collect()
    assert all(r.predicted == (r.score >= 0.3) for r in rows)
    wrong = held_out_errors(rows, {d: x[1] for d, x in labels.items()}, 4, 2)
    assert wrong[1] < 0.15 and wrong[0] < 0.01


def test_rules(spark, sf, sample):
    forest = quality_rules.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    _, feats = column_stats(pa.array([t for _, t in sample]))
    for x, score in zip(feats, forest.score(feats), strict=True):
        z = forest.bias
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if x[f[node]] > t[node] else 1)
            z += leaf[node - len(f)]
        assert score == pytest.approx(logistic(z))
    ids = [d for d, _ in sample]
    kept = {r.doc_id: r for r in q.op6_quality_rules(spark, sf).collect()}
    assert all(kept[d].kept == (not kept[d].base_failed and s >= 0.5) for d, s in zip(ids, forest.score(feats), strict=True))


def test_all_rows(spark, sf):
    """Without bounds every row is learned from; the bounded fit is the same where the bounds don't bind."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    one = quality_classifier.train(docs, labels)
    two = quality_classifier.train(docs, labels, max_labelled=None, max_unlabelled=None)
    assert np.allclose(one.linear.weight, two.linear.weight) and one.prior == two.prior
    one, two = toxicity.train(docs, labels), toxicity.train(docs, labels, max_positive=None, max_labelled=None, max_unlabelled=None)
    assert (one.keys == two.keys).all() and np.allclose(one.linear.weight, two.linear.weight)


def test_prior():
    rng = np.random.default_rng(3)
    pos, neg = rng.normal(2, 1, 6000), rng.normal(-2, 1, 6000)
    for share in (0.2, 0.5, 0.9):
        unl = np.concatenate([pos[: int(5000 * share)], neg[: 5000 - int(5000 * share)]])
        assert pu_learning.estimate_prior(rng.normal(2, 1, 4000), unl) == pytest.approx(share, abs=0.05)
    assert pu_learning.estimate_prior(np.zeros(0), neg) == 0.5


def test_sparse_rows():
    rng = np.random.default_rng(5)
    full = rng.random((40, 12)) * (rng.random((40, 12)) < 0.2)
    row, col = np.nonzero(full)
    sparse = pu_learning.SparseRows(np.searchsorted(row, np.arange(41)), col, full[row, col], 12)
    w, g, some = rng.random(12), rng.random(40), np.array([3, 3, 0, 39])
    assert np.allclose(sparse.dot(w), full @ w) and np.allclose(sparse.back(g), g @ full)
    assert np.allclose(sparse.take(some).dot(w), full[some] @ w)
    assert np.allclose(pu_learning.fit_nnpu(sparse.take(np.arange(20)), sparse, 0.4).weight, pu_learning.fit_nnpu(pu_learning.DenseRows(full[:20]), pu_learning.DenseRows(full), 0.4).weight, atol=1e-6)


def test_language(spark):
    """Two kinds of text in one language get centroids of their own; strange text is rejected; ties go to the first language."""
    rng = np.random.default_rng(1)

    def text(letters, n=40):
        return " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))

    rows = [(i, text("abcde" if i % 2 else "vwxyz"), "aa") for i in range(80)] + [(100 + i, text("klmno"), "bb") for i in range(80)]
    rows += [(200 + i, rows[80][1], "cc") for i in range(5)] + [(300 + i, rows[80][1], "cb") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs, folds=None, clusters=2)
    assert model.langs == ("aa", "bb", "cb", "cc") and (model.lang_of == 0).sum() == 2
    mine = model.centroids[model.lang_of == 0]
    assert mine[0] @ mine[1] < 0.3
    asked = spark.createDataFrame([(1, text("abcde"), "x"), (2, text("vwxyz"), "x"), (3, text("klmno"), "x"), (4, text("qrst"), "x"), (5, rows[80][1], "x"), (6, "12 34", "x")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(asked, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 5, 6)] == ["aa", "aa", "bb", "cb", "und"]
    assert got[4].rejected and not got[1].rejected and not got[5].rejected
    # the nearest centroid, found by one cosine at a time
    x = language_id.weighted(language_id.term_counts(np.frombuffer(rows[3][1].encode(), np.uint8), np.array([0, len(rows[3][1])])), model.idf)[0]
    cos = [float(x @ c) for c in model.centroids]
    assert got[1].score <= 1 and model.langs[model.lang_of[int(np.argmax(cos))]] == "aa"
