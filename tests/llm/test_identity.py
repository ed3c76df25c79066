"""Words, lines and pieces are told apart by their bytes: polynomial hashes modulo 2**64 can't tell these two words apart."""

import base64
import hashlib

import numpy as np
import pytest
import tiktoken

from palimpsest.llm import decontamination, near_dup, prefix_bpe, quality_rules
from palimpsest.llm.doc_stats import column_stats
from palimpsest.llm.queries import RANKS, rank_bytes


@pytest.fixture(scope="module")
def twins():
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_pieces(spark, twins):
    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(RANKS), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*twins, " ".join(twins), " ".join(reversed(twins))]
    got = {r.doc_id: r for r in prefix_bpe.encode_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), rank_bytes(), keep_ids=True).collect()}
    for d, text in enumerate(texts):
        assert got[d].ids == enc.encode_ordinary(text) and got[d].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_lines_and_windows(twins):
    import pyarrow as pa

    one, two = twins
    eight = [f"w{i}" for i in range(7)]
    base, _ = column_stats(pa.array([f"{one}\n{two}", f"{one}\n{one}", " ".join([*eight, one, *eight, two]), " ".join([*eight, one, *eight, one])]))
    assert base[:, 3].tolist() == [0, 1, 0, 0] and base[:, 4].tolist() == [0, 0, 0, 16]
    assert quality_rules.BASE[3:] == ("n_dup_lines", "n_repeat_words")


def test_test_words(spark, twins):
    one, two = twins
    items = spark.createDataFrame([(1, one)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {one.upper()} y"), (2, f"x {two} y")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id: (r.n_hit, r.item_ids) for r in decontamination.annotate(docs, items).collect()} == {1: (1, [1]), 2: (0, [])}


@pytest.mark.parametrize("shingle", [1, 2, 5])
def test_links(spark, twins, shingle):
    one, two = twins
    rows = [(1, f"{one} {one}"), (2, f"{two} {two}"), (3, f"{one} {one} {one}"), (4, " ".join([one] * 6)), (5, " ".join([two] * 6)), (6, " ".join([one] * 7))]
    got = {r.doc_id: r.component_id for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), near_dup.NearDup(shingle=shingle)).collect()}
    want = {1: {1: 1, 2: 2, 3: 1, 4: 1, 5: 2, 6: 1}, 2: {1: 1, 2: 2, 3: 1, 4: 1, 5: 2, 6: 1}, 5: {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 4}}
    assert got == want[shingle]
    small = near_dup.NearDup(shingle=shingle, job_bytes=1000)
    assert {r.doc_id: r.component_id for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string"), small).collect()} == got
