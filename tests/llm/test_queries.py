"""The registered queries against DuckDB or brute force over whole tables."""

import base64
import hashlib
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from palimpsest.llm import queries as q
from palimpsest.llm.pu_learning import auc


@pytest.fixture(scope="module")
def docs(duck):
    return {d: (t, lang) for d, t, lang in duck.execute("select doc_id, text, lang from documents").fetchall()}


def rows_of(df):
    return {r[0]: r for r in df.collect()}


def crc(x):
    import zlib

    return zlib.crc32(str(x).encode())


def test_op1(spark, sf, duck):
    want = {}
    rows = duck.execute("select conv_id, turn, role, text from conversations order by conv_id, turn").fetchall()
    rows += [(-7, 0, "user", q.CONTROL_TEXT), (-7, 1, "assistant", q.CONTROL_TEXT)]
    for c, _, role, text in rows:
        want.setdefault(c, []).append((role, text or ""))
    got = rows_of(q.op1_chat_format(spark, sf).drop("formatted_chars"))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert tuple(got[c]) == (c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.mark.parametrize("name", ["op1_chat_format", "op2_warc", "op3_line_dedup", "op8_benchmark_decontamination"])
def test_sql(spark, sf, duck, name):
    df = q.queries()[name](spark, sf)
    rel = duck.execute(q.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    want = rel.fetchall()
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect()), key=str) == sorted(want, key=str)


def test_op4_op7(spark, sf, duck):
    labels = {d: (a, b) for d, a, b in duck.execute("select doc_id, quality, toxic from labels").fetchall()}
    for f, k, n, part, least in ((q.op4_quality_classifier, 0, 3, 1, 0.95), (q.op7_toxicity, 1, 4, 2, 0.8)):
        got = f(spark, sf).collect()
        assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out == (crc(r.doc_id) % n == part) for r in got)
        held = [(r.score, labels[r.doc_id][k]) for r in got if r.held_out and r.doc_id in labels]
        assert auc(*map(np.array, zip(*held))) > least


def test_op5(spark, sf, docs):
    got = q.op5_language_id(spark, sf).collect()
    assert len(got) == len(docs)
    held = [r.lang_pred == docs[r.doc_id][1] for r in got if r.held_out]
    assert np.mean(held) > 0.95


def base_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            cover.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_op6(spark, sf, docs, duck):
    got = q.op6_quality_rules(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        want = base_stats(docs[r.doc_id][0])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    good = {d: y for d, y in duck.execute("select doc_id, quality from labels").fetchall()}
    held = [(r.score, good[r.doc_id]) for r in got if r.doc_id in good and crc(r.doc_id) % 3 == 1]
    assert auc(*map(np.array, zip(*held))) > 0.95


def test_op8(spark, sf, docs, duck):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    windows = {}
    for item, text in duck.execute("select item_id, text from benchmark").fetchall():
        w = word.findall((text or "").translate(lower))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(k) for k in windows}
    got = rows_of(q.op8_benchmark_decontamination(spark, sf))
    assert len(got) == len(docs)
    hits = 0
    for d, (text, _) in docs.items():
        w = word.findall((text or "").translate(lower))
        cover, items = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    cover.update(range(i, i + n))
                    items |= found
        hits += bool(cover)
        want = (d, len(w), len(cover), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(cover))
        assert tuple(got[d]) == want
    assert hits


def brute_components(docs, k, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for d, text in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(docs), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
            i = len(x & y)
            if 100 * i >= percent * (len(x) + len(y) - i):
                p, r = find(a), find(b)
                root[max(p, r)] = min(p, r)
    return {d: (len(sets[d]), find(d)) for d in docs}


def test_op9(spark, sf, docs):
    want = brute_components({d: t for d, (t, _) in docs.items()}, 2, 80)
    got = rows_of(q.op9_minhash_near_dedup(spark, sf))
    assert {d: tuple(r) for d, r in got.items()} == {d: (d, n, c, d == c) for d, (n, c) in want.items()}


def test_op10(spark, sf, docs):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(q.RANKS), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows_of(q.op10_byte_bpe(spark, sf))
    for d, (text, _) in docs.items():
        ids = enc.encode_ordinary(text or "")
        assert tuple(got[d]) == (d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
