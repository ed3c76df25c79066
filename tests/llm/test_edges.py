"""Nulls in any column, empty and very long texts, ties, repeats, empty tables and clashing column names."""

import hashlib

import numpy as np
import pytest

from palimpsest.llm import chat_format, decontamination, language_id, line_dedup, near_dup, prefix_bpe, quality_classifier, quality_rules, toxicity, warc
from palimpsest.llm.queries import rank_bytes
from palimpsest.llm.spark_util import components, scratch_path, shared_dir

LONG = "many words of a very long text " * 20000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _host string, score double, rep long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, "  \n\t", None, "a"), (4, LONG, "en", "a"), (5, "one", "de", "b"), (5, "one", "de", "b"), (None, "lost", "en", "a"), (6, "one", "de", None), (7, "\u00e9t\u00e9 \U0001f600 x", "fr", "b"), (8, "4 5 !", "en", "b")]
    return spark.createDataFrame([(d, t, lang, s, None, "h", 0.5, 9) for d, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("doc_id < -1")


def labels(spark, rows=((1, 1, 0), (2, None, None), (None, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def test_learned(spark, odd, none):
    few = labels(spark)
    for mod in (quality_classifier, toxicity):
        model = mod.train(odd, few)
        got = mod.score(odd, model).collect()
        assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
        assert mod.score(none, mod.train(none, few.where("false"))).count() == 0
    both = labels(spark, [(4, 1, 1), (5, 0, 0), (6, 0, 0), (7, 1, 0), (8, 0, 1)])
    for mod in (quality_classifier, toxicity):
        assert mod.score(odd, mod.train(odd, both, folds=None)).count() == 9
    rules = quality_rules.apply_rules(odd, quality_rules.train(odd, both, folds=None)).collect()
    assert len(rules) == 9 and all(r.base_failed and not r.kept for r in rules if r.doc_id in (1, 2, 3, 5, 8))
    assert quality_rules.apply_rules(none, quality_rules.train(none, few)).count() == 0
    kept = quality_classifier.keep_good(odd, quality_classifier.train(odd, both, folds=None))
    assert kept.columns == odd.columns and kept.count() <= 10


def test_language(spark, odd, none):
    got = {(r.doc_id, r.lang_pred) for r in language_id.predict(odd, language_id.train(odd, folds=None)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (8, "und")} <= got
    assert language_id.predict(odd, language_id.train(none)).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(none, language_id.train(odd)).count() == 0


def test_monotone():
    rng = np.random.default_rng(1)
    x = rng.random((400, 2))
    y = (x[:, 0] + rng.normal(0, 0.2, 400) > 0.5).astype(float)
    forest = quality_rules.fit_forest(x, y, np.array([1, 0]))
    line = np.stack([np.linspace(0, 1, 50), np.full(50, 0.3)], axis=1)
    assert (np.diff(forest.margin(line)) >= -1e-12).all()
    assert ((forest.score(x) > 0.5) == y).mean() > 0.8


def test_line_dedup(spark, odd, none):
    out = line_dedup.drop_boilerplate(odd, counts=True)
    assert {r.text for r in out.where("doc_id = 1").collect()} == {None} and out.count() == 10
    assert line_dedup.drop_boilerplate(none).count() == 0
    pages = spark.createDataFrame([(i, f"menu\nown line {i}\n menu ", "h") for i in range(20)] + [(99, "menu", "other")], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(pages, counts=True).collect()}
    assert all(got[i].text == f"own line {i}" and got[i].n_dropped == 2 for i in range(20)) and got[99].text == "menu"


def test_line_dedup_hosts(spark, monkeypatch):
    """A null host is a host of its own; beyond the broadcast bound the salted joins give the same rows."""
    rows = [(i, f"menu\nown {i}", None) for i in range(12)] + [(100 + i, "menu" if i < 12 else f"x {i}", "") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = {r.doc_id: r.text for r in line_dedup.drop_boilerplate(df).collect()}
    assert all(plain[i] == f"own {i}" for i in range(12)) and plain[100] == "menu"
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(line_dedup, "fits_broadcast", lambda *a: False)
    assert {r.doc_id: r.text for r in line_dedup.drop_boilerplate(df).collect()} == plain
    urls = spark.createDataFrame([("https://User@Example.COM:80/a?b",), ("no url",), (None,)], "url string")
    assert [r[0] for r in urls.select(line_dedup.host_of(urls.url)).collect()] == ["example.com", None, None]


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 2, "assistant", "\\</turn>\n### a\\"), (1, 2, "assistant", "\\</turn>\n### a\\"), (1, None, "user\n", "\U0001f600"), (None, 1, "user", "lost"), (2, 5, "assistant", "")]
    rows += [(3, i, "assistant", "### " * (i % 7)) for i in range(500)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    assert set(got) == {1, 2, 3}
    for c in got:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars) == (len(mine), hashlib.sha256(text.encode()).hexdigest(), len(loss))
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.read_back(chat_format.format_conversations(df.where("conv_id = 77"))).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/\nx", "same"), (3, None, None), (4, "u", ""), (5, "u", LONG), (5, "u", LONG), (None, "u", "lost"), (6, "u", "a\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    path = scratch_path(spark, "t")
    warc.write_archives(df, path)
    got = {r.metadata.page_id: r for r in warc.assemble(warc.read_records(spark, path)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert {p: r.main.type for p, r in got.items()} == {1: "response", 2: "revisit", 3: "response", 4: "revisit", 5: "response", 6: "response"}
    assert got[2].main.refers_to == got[1].main.record_id and got[2].main.payload_bytes == 4
    assert bytes(got[5].main.payload) == LONG.encode() and bytes(got[6].main.payload) == b"a\r\n\r\nWARC/1.1\r\n" and got[6].request is not None
    path = scratch_path(spark, "t")
    warc.write_archives(df, path, min_revisit_bytes=1)
    assert {r.main.type for r in warc.assemble(warc.read_records(spark, path)).where("metadata.page_id in (3, 4)").collect()} == {"response"}
    # small files, a gzip member a record, each readable alone
    path = scratch_path(spark, "t")
    warc.write_archives(df.coalesce(1), path, file_bytes=1500)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").collect()]
    assert len(files) > 2
    for content in files:
        all_ = list(warc.records(content))
        at = [offset for offset, _ in warc.members(content)]
        assert len(at) == len(all_) and [warc.record_at(content, x) for x in at] == all_
    with pytest.raises(ValueError):
        list(warc.records(files[0][:-9]))
    big = warc.member(bytes(17 << 20))
    assert big[-1] == 0 and b"".join(warc.unpacked(big)) == bytes(17 << 20)
    path = scratch_path(spark, "t")
    warc.write_archives(df.where("page_id > 100"), path)
    assert warc.assemble(warc.read_records(spark, path)).count() == 0


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "many words of"), (2, None), (3, ""), (4, "One"), (5, "one"), (None, "many"), (6, "a very long text many words of a very LONG text many")], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.annotate(odd, items).collect()}
    assert set(got[4].item_ids) == {1, 6} and got[4].n_hit == got[4].n_words == 140000
    assert set(got[5].item_ids) == {4, 5} and got[1].n_words == got[2].n_words == 0 and got[8].n_hit == 0
    assert decontamination.annotate(none, items).count() == 0
    assert decontamination.annotate(odd, items.where("item_id > 99")).where("n_hit > 0").count() == 0
    assert {r.doc_id for r in decontamination.remove_contaminated(odd, items).collect()} == {1, 2, 3, 7, 8, None}
    blocks = list(decontamination.test_sets(items, block_bytes=8))
    assert sum(len(b.item_ids) for b in blocks) == 6 and len(blocks) > 1


def test_near_dup(spark, odd, none):
    conf = near_dup.NearDup(shingle=2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.classes(odd, conf).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (7, 4), 5: (1, 5), 6: (1, 5), 7: (2, 7), 8: (2, 8)}
    assert near_dup.classes(none, conf).count() == 0
    assert near_dup.keep_one(odd, conf).columns == odd.columns


def test_near_dup_large_cluster(spark):
    """A cluster beyond one block: a chain in which only neighbours are alike, and copies of its middle."""
    words = [f"w{i}" for i in range(1400)]
    rows = [(i, " ".join(words[i * 2 : i * 2 + 60])) for i in range(600)]
    got = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string"), near_dup.NearDup(shingle=2)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 600


def test_near_dup_repeated_ids(spark):
    """Of an id's texts the one with most distinct shingles counts, and only that one links."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(20))
    rows = [(5, a), (5, b), (5, b), (9, b), (3, a + " more"), (4, "short one"), (4, None), (8, "Short  ONE")]
    got = {r.doc_id: r.component_id for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string"), near_dup.NearDup(shingle=5)).collect()}
    assert got == {5: 3, 9: 9, 3: 3, 4: 4, 8: 4}


@pytest.mark.parametrize("job_bytes", [8 << 20, 2000])
def test_near_dup_templates(spark, job_bytes):
    """Pages of one template, none alike, with planted copies: one cluster, in one job and beyond one."""
    rng = np.random.default_rng(6)
    page = [f"w{i}" for i in range(80)]
    own = [[f"u{x}" for x in rng.integers(0, 10**9, 20)] for _ in range(400)]
    rows = [(i, " ".join(page + w)) for i, w in enumerate(own)]
    rows += [(1000 + i, " ".join(page + own[i][:-1] + ["edited"])) for i in range(0, 400, 10)]
    got = {r.doc_id: r.component_id for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string"), near_dup.NearDup(shingle=2, job_bytes=job_bytes)).collect()}
    assert got == {d: d % 1000 for d, _ in rows}


def test_links_compare_few(monkeypatch):
    """The sets compared grow with the documents, not with their square; and no link is lost against all pairs."""
    import pyarrow as pa

    rng, tried = np.random.default_rng(8), []
    plain = near_dup.ShingleSets.alike
    monkeypatch.setattr(near_dup.ShingleSets, "alike", lambda self, one, others, percent: (tried.append(len(others)), plain(self, one, others, percent))[1])
    page = [f"w{i}" for i in range(80)]
    for n in (500, 2000):
        tried.clear()
        texts = pa.array([" ".join(page + [f"u{x}" for x in rng.integers(0, 10**9, 20)]) for _ in range(n)])
        assert not near_dup.links(np.arange(n), texts, near_dup.NearDup(shingle=2))
        assert sum(tried) <= near_dup.PIVOTS * n
    # pairs around the bound, of differing lengths
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        w = list(base[: rng.integers(60, 120)])
        for at in rng.integers(0, len(w), rng.integers(0, 8)):
            w[at] = f"x{rng.integers(0, 50)}"
        texts.append(" ".join(w))
    sets = [set(zip(t.split(), t.split()[1:])) for t in texts]
    root = list(range(150))
    for a in range(150):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    mine = list(range(150))
    for a, b in near_dup.links(np.arange(150), pa.array(texts), near_dup.NearDup(shingle=2)):
        x, y = mine[a], mine[b]
        mine = [min(x, y) if r in (x, y) else r for r in mine]
    assert mine == root


def test_scratch_is_removed(spark):
    """What near-dedup writes on the way is gone when it returns; its result stays."""
    import os

    folder = shared_dir(spark).removeprefix("file://")
    was = set(os.listdir(folder))
    out = near_dup.classes(spark.createDataFrame([(1, "a b c"), (2, "a b c d")], "doc_id long, text string"), near_dup.NearDup(shingle=2))
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - was] == ["near"] and out.count() == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {i: 0 for i in range(201)} | {i: 1000 for i in range(1000, 1400)}


def test_bpe(spark, odd, none):
    data = rank_bytes()
    got = {r.doc_id: r for r in prefix_bpe.encode_texts(odd, data, keep_ids=True).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and got[4].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert prefix_bpe.encode_texts(none, data).count() == 0
    bpe = prefix_bpe.from_ranks(data)
    table = prefix_bpe.PrefixTable(bpe, b"unbelievable")
    table.append(b" things")
    assert bpe.decode(table.ids()) == b"unbelievable things"
    table.replace(2, 4, b"XY")
    assert table.data == b"unXYlievable things" and table.last == prefix_bpe.PrefixTable(bpe, table.data).last
    assert all(bpe.decode(table.ids(i)) == table.data[:i] for i in range(len(table.data) + 1))


def test_edit_keeps_the_rest():
    """Entries far behind an edit are taken over, not made again."""
    bpe = prefix_bpe.from_ranks(rank_bytes())
    data = ("unbelievable things happen " * 400).replace(" ", "_").encode()
    rng = np.random.default_rng(2)
    for at, size, new in ((0, 0, b"x"), (5, 3, b""), (5000, 7, b"abcdefghij"), (len(data), 0, b"end"), (len(data) - 2, 2, b""), (300, 5000, b"_")):
        table, asked = prefix_bpe.PrefixTable(bpe, data), []
        plain = bpe.last_tokens
        bpe.last_tokens = lambda d, t, upto=None: (asked.append((upto or len(d)) - len(t)), plain(d, t, upto))[1]
        table.replace(at, at + size, new)
        bpe.last_tokens = plain
        assert table.last == bpe.last_tokens(data[:at] + new + data[at + size :])
        assert sum(asked) < 8 * bpe.longest + len(new)
    data = bytes(rng.integers(97, 100, 600).astype(np.uint8))
    for _ in range(40):
        at, size = sorted(rng.integers(0, len(data), 2))
        table = prefix_bpe.PrefixTable(bpe, data)
        table.replace(int(at), int(size), b"cab")
        assert table.last == bpe.last_tokens(table.data)


def test_bad_bytes(spark):
    """A string column may hold bytes that are not UTF-8."""
    df = spark.sql("select 1L doc_id, cast(x'61ff62' as string) text union all select 2L, 'ok'")
    got = {r.doc_id: r for r in prefix_bpe.encode_texts(df, rank_bytes()).collect()}
    assert got[1].decoded_sha256 == hashlib.sha256("a\ufffdb".encode()).hexdigest() and got[2].decoded_sha256 == hashlib.sha256(b"ok").hexdigest()
    turns = spark.sql("select 1L conv_id, 0L turn, cast(x'ff' as string) role, cast(x'61ff62' as string) text")
    assert chat_format.read_back(chat_format.format_conversations(turns)).first().turns_sha256 == hashlib.sha256("\ufffd\na\ufffdb\n".encode()).hexdigest()


def test_carried_columns(odd):
    out = prefix_bpe.encode_texts(odd.withColumnRenamed("rep", "ids"), rank_bytes(), keep_ids=True, keep=("doc_id", "text", "lang", "ids"))
    assert out.columns == ["doc_id", "text", "lang", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert all(len(r.ids) == r.n_tokens and hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256 for r in out.collect())


def longest_matches(words, items, window):
    """(document, item, first word, length) by trying every place."""
    out = []
    for d, w in words.items():
        for i, t in items.items():
            m = min(window, len(t))
            for p in range(len(w)):
                for q in range(len(t) - m + 1) if m else ():
                    n = 0
                    while p + n < len(w) and q + n < len(t) and w[p + n] == t[q + n]:
                        n += 1
                    if n >= m:
                        out.append((d, i, p, n))
    return sorted(out)


@pytest.mark.parametrize("window", [1, 3, 7, 10])
def test_matches_brute_force(spark, window):
    rng = np.random.default_rng(window)
    items = {i: [f"w{x}" for x in rng.integers(0, 3, rng.integers(0, 14))] for i in range(12)}
    words = {d: [f"w{x}" for x in rng.integers(0, 4, rng.integers(0, 60))] for d in range(15)}
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in words.items()], "doc_id long, text string")
    test = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    want = longest_matches(words, items, window)
    assert sorted(map(tuple, decontamination.find_matches(docs, test, window).select("doc_id", "item_id", "word", "n_words").collect())) == want
    for block_bytes in (1 << 20, 30):  # one and several blocks of test items
        got = {r.doc_id: r for r in decontamination.annotate(docs, test, window, block_bytes).collect()}
        for d, w in words.items():
            mine = [x for x in want if x[0] == d]
            assert got[d].n_words == len(w) and got[d].item_ids == sorted({x[1] for x in mine})
            assert got[d].n_hit == len({k for x in mine for k in range(x[2], x[2] + x[3])})


def test_large_test_set(spark):
    """A hundred times the items cost little more a shard: the work is a few sorted lookups, not one search an item."""
    import time

    rng = np.random.default_rng(4)
    word = np.array([f"w{i}" for i in range(20000)])
    import pyarrow as pa

    text = " ".join(word[rng.integers(0, 20000, 400_000)]).encode()
    took = []
    for n in (400, 40_000):
        items = pa.array([" ".join(word[rng.integers(0, 20000, 60)]) for _ in range(n)])
        test = decontamination.TestSet.build(np.arange(n), items, 10)
        buf = np.frombuffer(text, np.uint8)
        began = time.process_time()
        for _ in range(3):
            shard = decontamination.Shard.of(test, buf, np.array([0, len(buf)]))
            shard.hit_words(), shard.items(test)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0]


def test_suffix_array():
    items = ["b a b a c", "a b a b b"]
    import pyarrow as pa

    test = decontamination.TestSet.build(np.array([7, 8]), pa.array(items), 3)
    buf = np.frombuffer(b"x b a b a c y a b b a b a b b", np.uint8)
    (sa, at, lo, hi, size), = decontamination.Shard.of(test, buf, np.array([0, len(buf)])).found
    words = "x b a b a c y a b b a b a b b".split()
    keys = [tuple(words[p : p + size]) for p in sa]
    assert size == 3 and keys == sorted(keys) and len(sa) == 8
    test_words = "b a b a c a b a b b".split()
    assert all(tuple(test_words[q : q + 3]) == keys[k] for q, a, b in zip(at, lo, hi, strict=True) for k in range(a, b))
