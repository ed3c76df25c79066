"""The corpus pipeline, stage by stage, against brute force over each stage's own input."""

import base64
import hashlib

import pytest

import corpus_pipeline
from palimpsest.llm import line_dedup, quality_classifier
from palimpsest.llm import queries as q
from palimpsest.llm.spark_util import materialize

from .test_queries import brute_components


@pytest.fixture(scope="module")
def stages(spark, sf):
    """(name, rows before, rows after) of every stage."""
    docs, out = q.table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, sf), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return out


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_order_and_columns(spark, sf, stages):
    assert [name for name, _, _ in stages] == ["quality", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    names = q.table(spark, sf, "documents").columns
    assert all(after.columns == names for _, _, after in stages[:-1])
    assert stages[-1][2].columns == [*names, "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, stages[-1][2].select("doc_id", "ids_sha256").collect()))


def test_quality(spark, sf, stages):
    _, before, after = stages[0]
    model = quality_classifier.train(before, q.table(spark, sf, "labels"))
    good = {r.doc_id for r in quality_classifier.score(before, model).collect() if r.score >= 0.5}
    assert {r.doc_id for r in after.collect()} == good and 0 < len(good) < before.count()


def test_lines(stages):
    _, before, after = stages[1]
    pages, count = {}, {}
    rows, got = rows_of(before), rows_of(after)
    for r in rows.values():
        pages[r.source] = pages.get(r.source, 0) + 1
        for line in {x.strip(" ") for x in (r.text or "").split("\n")} - {""}:
            count[r.source, line] = count.get((r.source, line), 0) + 1
    bad = {k for k, n in count.items() if n >= line_dedup.MIN_PAGES and n > pages[k[0]] * line_dedup.MAX_RATIO}
    assert bad and set(got) == set(rows)
    for d, r in rows.items():
        want = None if r.text is None else "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" ")) not in bad)
        assert got[d].text == want and got[d].n_chars == (None if want is None else len(want))


def test_near(stages):
    _, before, after = stages[2]
    want = brute_components({r.doc_id: r.text for r in before.collect()}, 5, 80)
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, (_, c) in want.items() if d == c) and after.count() < before.count()


def test_decontaminated(duck, stages):
    import re

    _, before, after = stages[3]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    windows = set()
    for (text,) in duck.execute("select text from benchmark").fetchall():
        w = word.findall((text or "").translate(lower))
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1 if n else 0)}
    sizes = {len(x) for x in windows}

    def clean(text):
        w = word.findall((text or "").translate(lower))
        return not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if clean(r.text)) and after.count() < before.count()


def test_tokens(stages):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(q.RANKS), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    _, before, after = stages[4]
    rows = rows_of(before)
    for d, r in rows_of(after).items():
        text = rows.pop(d).text
        assert r.text == text and r.ids == enc.encode_ordinary(text or "") and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert not rows


def test_odd_rows(spark, sf, tmp_path):
    """Nulls, empty texts, repeats, rows without id, an empty table, and columns named like those the stages make."""
    long = "some words of a long text. " * 3000
    rows = [(1, None, "en", None), (2, "", None, "a"), (3, long, "en", "a"), (3, long, "en", "a"), (4, long + "x", "en", "a"), (None, "lost", "en", "a"), (5, "one", "de", "b")]
    schema = "doc_id long, text string, lang string, source string"
    for data in (rows, []):
        docs = spark.createDataFrame([(*r, 7, "h", 3) for r in data], schema + ", ids int, _host string, component_id long")
        for name, stage in corpus_pipeline.STAGES:
            after = materialize(stage(spark, docs, sf), f"odd-{name}")
            assert after.count() <= docs.count() and set(schema.replace(",", "").split()[::2]) <= set(after.columns)
            docs = after
