"""Benchmark decontamination with suffix arrays of the training text.

Every block of documents is a shard. Its words get the ids that the test set's dictionary gives them, and the runs of 1, 2, 4 and 8
words from a place the ranks of prefix doubling: ranks are looked up in the sorted tables that the test set was
doubled into once, so they are exact, mean the same in every shard, and follow the order of the words. A place whose run
is in no table can't begin a hit and leaves the array. The places left, sorted by rank, are the shard's suffix array down to the window's
depth; every suffix of every test item that holds a window (``window`` words, or the whole item where that is shorter) is
binary-searched in it, all at once. Where one stands, the two texts are followed word by word to the longest verbatim match.

A shard of n words and a test set of m words cost n log m comparisons to rank and m log n to search, in whole columns. Words
are told apart by their bytes, never by hashes. The test set is read once, measured, and sent to the workers in blocks of at
most ``ITEM_BYTES``; a larger one means further passes over the training text, never a larger broadcast.

Defined cases: null and empty texts have no words and no hits; items without words never match; repeated items each count;
items or documents without id are dropped; an empty test set finds nothing; further columns are ignored or, in
``remove_contaminated``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import map_arrow, with_id
from .text_kernels import ALNUM_ANY, blocks, buffers, distinct, words

WINDOW = 10
#: Largest block of test texts that is broadcast.
ITEM_BYTES = 16 << 20


class Doubling:
    """Ranks of the runs of words of the test set, by length: rank 0 is a run that does not occur in it."""

    def __init__(self, sizes: list[int]):
        #: Lengths to rank, each made of two that stand before it; ``sizes`` are the windows that are searched.
        self.steps: list[tuple[int, int, int]] = []
        have = {1}
        for size in sizes:
            whole, part = 0, 1 << max(size.bit_length() - 1, 0)
            while part:
                if size & part:
                    for d in (1 << i for i in range(1, part.bit_length())):
                        if d not in have:
                            self.steps.append((d, d // 2, d // 2))
                            have.add(d)
                    if whole and whole + part not in have:
                        self.steps.append((whole + part, whole, part))
                        have.add(whole + part)
                    whole += part
                part >>= 1
        self.tables: dict[int, np.ndarray] = {}

    def ranks(self, ids: np.ndarray, left: np.ndarray, learn: bool = False) -> dict[int, np.ndarray]:
        """Rank of the run from each place by length; ``left``: words to the end of the text. ``learn`` makes the tables."""
        out = {1: ids}
        for size, one, two in self.steps:
            a, b = out[one], out[two]
            at = np.flatnonzero((a[: len(left)] > 0) & (left >= size))
            at = at[b[at + one] > 0]
            code = a[at] << 32 | b[at + one]
            if learn:
                self.tables[size] = np.unique(code)
            table = self.tables[size]
            rank = np.zeros(len(ids) + 1, np.int64)
            if len(table) and len(at):
                place = np.minimum(np.searchsorted(table, code), len(table) - 1)
                rank[at] = np.where(table[place] == code, place + 1, 0)
            out[size] = rank
        return out


def words_left(off: np.ndarray) -> np.ndarray:
    """Words from each place to the end of its text."""
    return np.repeat(off[1:], np.diff(off)) - np.arange(off[-1])


@dataclass(frozen=True)
class TestSet:
    """Word ids of all items, one after the other (from 1, in the order of the words' bytes), and their doubling ranks."""

    vocabulary: pa.Array
    ids: np.ndarray
    off: np.ndarray
    item_ids: np.ndarray
    need: np.ndarray
    doubling: Doubling
    #: By window length: the sorted ranks of the test suffixes that hold a window of this length, and their places.
    suffixes: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def build(item_ids: np.ndarray, texts: pa.Array, window: int) -> TestSet:
        buf, off = buffers(texts)
        start, end, w_off = words(buf, off, ALNUM_ANY)
        w_off = w_off.astype(np.int64)
        ids, known = distinct(buf, start, end, lower=True)
        order = pc.array_sort_indices(known).to_numpy()
        place = np.empty(len(known), np.int64)
        place[order] = np.arange(1, len(known) + 1)
        ids = np.append(place[ids], 0)
        need = np.minimum(np.diff(w_off), window)
        sizes = sorted({int(n) for n in need if n})
        doubling = Doubling(sizes)
        left = words_left(w_off)
        rank = doubling.ranks(ids, left, learn=True) if len(left) else {1: ids}
        suffixes = {}
        wanted = np.repeat(need, np.diff(w_off))
        for size in sizes:
            at = np.flatnonzero((wanted == size) & (left >= size))
            at = at[np.argsort(rank[size][at], kind="stable")]
            suffixes[size] = (rank[size][at], at)
        return TestSet(known.take(pa.array(order)), ids, w_off, item_ids, need, doubling, suffixes)

    def encode(self, known: pa.Array) -> np.ndarray:
        """Ids of distinct words; 0 for words of no item."""
        return pc.fill_null(pc.add(pc.index_in(known, value_set=self.vocabulary), 1), 0).to_numpy().astype(np.int64)


def suffix_array(rank: np.ndarray) -> np.ndarray:
    """The places whose run is known, sorted by its words (ranks follow their order)."""
    at = np.flatnonzero(rank)
    return at[np.argsort(rank[at], kind="stable")]


@dataclass(frozen=True)
class Shard:
    """A block of documents in the words of a test set; ``found``: (place, test place, window), every pair of equal windows."""

    ids: np.ndarray
    off: np.ndarray
    left: np.ndarray
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]

    @staticmethod
    def of(test: TestSet, buf: np.ndarray, off: np.ndarray) -> Shard:
        start, end, w_off = words(buf, off, ALNUM_ANY)
        w_off = w_off.astype(np.int64)
        ids, known = distinct(buf, start, end, lower=True)
        ids = np.append(test.encode(known)[ids] if len(known) else ids, 0)
        left = words_left(w_off)
        found = []
        if len(left) and test.suffixes:
            ranks = test.doubling.ranks(ids, left)
            for size, (query, at) in test.suffixes.items():
                sa = suffix_array(ranks[size][: len(left)])
                if len(sa):
                    here = ranks[size][sa]
                    lo, hi = np.searchsorted(here, query), np.searchsorted(here, query, "right")
                    some = hi > lo
                    if some.any():
                        found.append((sa, at[some], lo[some], hi[some], size))
        return Shard(ids, w_off, left, found)

    def places(self) -> Iterator[tuple[np.ndarray, int]]:
        """Places where a window stands, and its length."""
        for sa, _, lo, hi, size in self.found:
            cover = np.zeros(len(sa) + 1, np.int64)
            np.add.at(cover, lo, 1)
            np.subtract.at(cover, hi, 1)
            yield sa[np.cumsum(cover[:-1]) > 0], size

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, place, "right") - 1

    def hit_words(self) -> np.ndarray:
        """Whether each word lies in a window that is found."""
        cover = np.zeros(len(self.left) + 1, np.int64)
        for place, size in self.places():
            cover[place] += 1
            np.subtract.at(cover, place + size, 1)
        return np.cumsum(cover[:-1]) > 0

    def items(self, test: TestSet) -> np.ndarray:
        """Distinct (document, item) pairs with a window in common, a row each: one window of a document is looked at once."""
        out = [np.zeros((0, 2), np.int64)]
        for sa, at, lo, hi, _ in self.found:
            item = np.searchsorted(test.off, at, "right") - 1
            pairs = np.unique(np.stack([lo, hi, item], axis=1), axis=0)  # suffixes of one rank have one range
            for a, b, i in _grouped(pairs):
                docs = np.unique(self.document(sa[a:b]))
                out.append(np.stack([np.repeat(docs, len(i)), np.tile(i, len(docs))], axis=1))
        return np.unique(np.concatenate(out), axis=0)

    def matches(self, test: TestSet) -> Iterator[np.ndarray]:
        """(document, first word, words, item) of the longest match from every place where a test suffix's window stands."""
        left = np.append(words_left(test.off), 0)
        for sa, at, lo, hi, size in self.found:
            for j in range(0, len(at), 4096):  # pairs leave in slices
                many = (hi - lo)[j : j + 4096]
                q = np.repeat(at[j : j + 4096], many)
                ends = np.cumsum(many)
                p = sa[np.arange(ends[-1]) + np.repeat(lo[j : j + 4096] - ends + many, many)]
                n = np.full(len(p), size)
                open_ = np.arange(len(p))
                while len(open_):
                    x, y = p[open_] + n[open_], q[open_] + n[open_]
                    more = (self.left[p[open_]] > n[open_]) & (left[q[open_]] > n[open_])
                    more &= self.ids[np.minimum(x, len(self.ids) - 1)] == test.ids[np.minimum(y, len(test.ids) - 1)]
                    open_ = open_[more]
                    n[open_] += 1
                doc = self.document(p)
                yield np.stack([doc, p - self.off[doc], n, np.searchsorted(test.off, q, "right") - 1], axis=1)


def _grouped(pairs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(lo, hi, items) of each range of sorted rows (lo, hi, item)."""
    cuts = np.flatnonzero((pairs[1:, :2] != pairs[:-1, :2]).any(axis=1)) + 1
    for part in np.split(pairs, cuts):
        if len(part):
            yield int(part[0, 0]), int(part[0, 1]), part[:, 2]


def test_sets(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = ITEM_BYTES) -> Iterator[TestSet]:
    """The items in blocks of bounded size, in order of id; each is read alone."""
    items = with_id(benchmark, "item_id").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // block_bytes))
    for k in range(parts):
        block = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        rows = block.toArrow().sort_by("item_id")
        yield TestSet.build(rows["item_id"].to_numpy(), rows["text"].combine_chunks(), window)


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Longest verbatim matches: ``doc_id, item_id, word, n_words`` (first word and length in the document)."""
    out = None
    for test in test_sets(benchmark, window):
        known = docs.sparkSession.sparkContext.broadcast(test)

        def run(batches, known=known):
            for b in batches:
                buf, off = buffers(b.column(1))
                for i, _, bb, oo in blocks(buf, off):
                    for f in Shard.of(known.value, bb, oo).matches(known.value):
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i + f[:, 0])), pa.array(known.value.item_ids[f[:, 3]]), pa.array(f[:, 1]), pa.array(f[:, 2])], names=["doc_id", "item_id", "word", "n_words"])

        part = map_arrow(with_id(docs, "doc_id").select("doc_id", "text"), run, "doc_id long, item_id long, word long, n_words long")
        out = part if out is None else out.unionByName(part)
    return out


def _document_rows(test: TestSet, col: pa.Array) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """(n_words, hit words, item ids) of every text of a column."""
    buf, off = buffers(col)
    for _, _, bb, oo in blocks(buf, off):
        shard = Shard.of(test, bb, oo)
        hit, pairs = shard.hit_words(), shard.items(test)
        items = np.split(pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(1, len(oo) - 1)))
        for d in range(len(oo) - 1):
            lo, hi = shard.off[d], shard.off[d + 1]
            yield int(hi - lo), hit[lo:hi], sorted(set(test.item_ids[items[d]].tolist()))


def _spans(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of hit words."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = ITEM_BYTES) -> DataFrame:
    """``doc_id, n_words, n_hit, item_ids`` of every row; one pass over the training text for each block of test items.

    With several blocks the passes of a document are united by its id: rows that repeat one count once then.
    """
    out, passes = None, 0
    for test in test_sets(benchmark, window, block_bytes):
        known = docs.sparkSession.sparkContext.broadcast(test)
        passes += 1

        def run(batches, known=known):
            for b in batches:
                rows = list(_document_rows(known.value, b.column(1)))
                spans = [_spans(r[1]) for r in rows]
                starts, ends = (pa.array([s[k] for s in spans], pa.list_(pa.int64())) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([int(r[1].sum()) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), starts, ends], names=["doc_id", "n_words", "n_hit", "item_ids", "starts", "ends"])

        part = map_arrow(with_id(docs, "doc_id").select("doc_id", "text"), run, "doc_id long, n_words long, n_hit long, item_ids array<long>, starts array<long>, ends array<long>")
        out = part if out is None else out.unionByName(part)
    if passes == 1:
        return out.select("doc_id", "n_words", "n_hit", "item_ids")
    # unite the hit words of each document's passes
    words_hit = F.flatten(F.transform(F.arrays_zip("starts", "ends"), lambda s: F.sequence(s["starts"], s["ends"] - 1)))
    by = out.withColumn("w", words_hit).groupBy("doc_id")
    return by.agg(F.max("n_words").alias("n_words"), F.size(F.array_distinct(F.flatten(F.collect_list("w")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` without any hit, with all their columns; no shuffle."""
    at = docs.columns.index("text")
    out = docs
    for test in test_sets(benchmark, window):
        known = docs.sparkSession.sparkContext.broadcast(test)

        def run(batches, known=known):
            for b in batches:
                yield b.filter(pa.array([not hit.any() for _, hit, _ in _document_rows(known.value, b.column(at))], pa.bool_()))

        out = map_arrow(out, run, docs.schema)
    return out
