"""Near-duplicate classes by MinHash with tensored banding and verification on full shingle sets.

Two small collections of ``groups`` band hashes each (``rows`` min-hashes a band) are computed; a table key is a pair of
one band of either collection, so ``groups**2`` tables of ``2 * rows`` min-hashes cost only ``2 * groups * rows`` min-hashes.
At similarity s a pair shares a key with probability (1 - (1 - s**rows)**groups)**2: 0.9996 at 0.8 with the defaults.

1. One pass counts each text's distinct shingles and makes its min-hashes and the SHA-256 of its words. Texts of equal words
   are one class; its smallest id represents it.
2. Representatives are dealt by (key, id) ranges, so a key of any number of rows is spread over tasks; in each run of a key
   the others are paired with its first. Pairs whose min-hashes agree on fewer than ``AGREE`` of the places are dropped. In runs
   whose documents the others don't connect, all are tried against each other; a run of more than ``RUN_DOCS`` is dealt into
   blocks for that and every pair of blocks is tried, so that no group holds more than about two blocks of a run.
3. The pairs' components are clusters: they propose which texts may be alike. Within a cluster links are verified on the
   words themselves, never on hashes. A cluster of at most ``job_bytes`` of text is one job; its sets meet first with a few pivots and then,
   where they are not in the largest class yet, through an index of each set's rarest shingles (two sets that are alike
   share one of them), so a template that all pages of a cluster share pairs none of them. Larger clusters go the same
   two steps by joins: salted pivots, then an equi-join on rare shingles, then verification of the pairs from both texts.
4. Components of the verified links are the near-duplicate classes.

A link can be missed only if the two share no key, or their min-hashes agree on less than ``AGREE`` (five standard errors
below 0.8) and nothing else connects their clusters. Every pair of one cluster is covered exactly. Nothing is capped.

Defined cases: null, empty and blank texts have the empty set and stay alone; texts of fewer words than the shingle have one
shingle, all their words, and are alike if these are equal; of repeated rows of an id with different texts the one of most distinct shingles
counts, then the greatest digest; rows without id are dropped; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import bounded_join, components, discarding, map_arrow, materialize, with_id
from .text_kernels import LOWER, NOT_SPACE, blocks, buffers, distinct, hashes, mix, shingle_hashes, shingles, splitmix, words

#: Least share of min-hashes on which a pair of candidates must agree to be clustered.
AGREE = 0.55
#: About how many documents of a run are tried against each other at once; larger runs are tried in pairs of blocks of this size.
RUN_DOCS = 4096
#: Rounds of pivots that a set meets before the index is asked.
PIVOTS = 3
#: Buckets of the shingle counts by which clusters beyond one job order shingles; any order is exact, a good one is fast.
BUCKETS = 1 << 18
_U = np.uint64
_DIGEST = ["d1", "d2", "d3", "d4"]


@dataclass(frozen=True)
class NearDup:
    shingle: int = 5
    percent: int = 80
    rows: int = 3
    groups: int = 12
    job_bytes: int = 8 << 20

    @property
    def hashes(self) -> int:
        return 2 * self.rows * self.groups


def word_digests(buf: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray, w_off: np.ndarray) -> list[bytes]:
    """SHA-256 of each document's lower-case words, joined by one space (which no word holds)."""
    data, keep = LOWER[buf], NOT_SPACE[buf]
    last = np.zeros(len(start), bool)
    last[w_off[1:][np.diff(w_off) > 0] - 1] = True
    gap = end[~last]
    data[gap], keep[gap] = 32, True
    text, at = data[keep].tobytes(), np.concatenate([[0], np.cumsum(keep)])[off].tolist()
    return [hashlib.sha256(text[a:b]).digest() for a, b in zip(at[:-1], at[1:], strict=True)]


def signatures(h: np.ndarray, s_off: np.ndarray, conf: NearDup) -> np.ndarray:
    """Min-hashes (32 bits) of the shingle hashes of every document; zeros where there are none."""
    out = np.zeros((len(s_off) - 1, conf.hashes), np.uint32)
    full = np.flatnonzero(np.diff(s_off))
    if not len(full):
        return out
    first = s_off[:-1][full]
    a, b = splitmix(conf.hashes, 101) | _U(1), splitmix(conf.hashes, 202)
    for j in range(conf.hashes):
        out[full, j] = np.minimum.reduceat((h ^ b[j]) * a[j], first) >> _U(32)
    return out


def band_hashes(sig: np.ndarray, conf: NearDup) -> np.ndarray:
    """Documents x (2 x groups): one hash for each band of both collections."""
    parts = sig.reshape(len(sig), 2 * conf.groups, conf.rows).astype(_U)
    h = np.full((len(sig), 2 * conf.groups), 0x243F6A8885A308D3, _U)
    for r in range(conf.rows):
        h = mix(h ^ (parts[:, :, r] + _U(r << 40)))
    return h


def profile(docs: DataFrame, conf: NearDup) -> DataFrame:
    """``doc_id, n_shingles, d1..d4`` (digest of the words), ``sig`` (a byte a min-hash) and ``bands`` of every row.

    The last two are null where a text has fewer words than a shingle.
    """
    k = conf.shingle

    def run(batches):
        for b in batches:
            buf, off = buffers(b.column(1))
            many, digest, sig, bands = [], [], [], []
            for _, _, bb, oo in blocks(buf, off):
                start, end, w_off = words(bb, oo, NOT_SPACE)
                ids, known = distinct(bb, start, end, lower=True)
                code, s_off = shingles(ids, w_off, k)
                for d in range(len(oo) - 1):
                    mine = np.sort(code[s_off[d] : s_off[d + 1]])
                    many.append(int(np.count_nonzero(mine[1:] != mine[:-1])) + 1 if len(mine) else int(w_off[d + 1] > w_off[d]))
                digest += word_digests(bb, oo, start, end, w_off)
                s = signatures(shingle_hashes(hashes(known)[ids], w_off, k), s_off, conf)
                some = np.diff(s_off) > 0
                sig += [x.tobytes() if ok else None for x, ok in zip((s & np.uint32(255)).astype(np.uint8), some, strict=True)]
                bands += [x.tobytes() if ok else None for x, ok in zip(band_hashes(s, conf), some, strict=True)]
            d = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(many, pa.int64()), *(pa.array(d[:, i]) for i in range(4)), pa.array(sig, pa.binary()), pa.array(bands, pa.binary())], names=["doc_id", "n_shingles", *_DIGEST, "sig", "bands"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, d1 long, d2 long, d3 long, d4 long, sig binary, bands binary")


def _runs_of_keys(batches, keep):
    """Rows (later, first, key) of each run of equal keys in a sorted partition; also the first row of the partition's first and last run."""
    key, first = None, None
    edge_first, edge_last = None, None
    for b in batches:
        k, d = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(k):
            continue
        new = np.ones(len(k), bool)
        new[1:] = k[1:] != k[:-1]
        if key is not None and k[0] == key:
            new[0] = False
        lead = np.where(new, np.arange(len(k)), -1)
        lead = np.maximum.accumulate(lead)
        head = np.where(lead >= 0, d[np.maximum(lead, 0)], first if first is not None else d[0])
        later = ~new
        pairs = np.stack([np.maximum(d[later], head[later]), np.minimum(d[later], head[later]), k[later]])
        pairs = pairs[:, pairs[0] != pairs[1]]
        key, first = k[-1], head[-1]
        if edge_first is None:
            edge_first = (k[0], d[0])
        edge_last = (key, first)
        yield from keep(pairs)
    if edge_first is not None:
        yield from keep(None, [edge_first, edge_last])


def pairs_of_runs(rows: DataFrame, partitions: int) -> DataFrame:
    """``a, b, key``: documents ``a > b`` of ``rows`` (key, doc) that meet in a key, each with its run's first document."""
    dealt = rows.repartitionByRange(partitions, "key", "doc").sortWithinPartitions("key", "doc")

    def run(batches):
        def keep(pairs, edges=None):
            if pairs is not None and pairs.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(pairs[2]), pa.array(np.zeros(pairs.shape[1], bool))], names=["a", "b", "key", "edge"])
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([d for _, d in edges]), pa.array([d for _, d in edges]), pa.array([k for k, _ in edges]), pa.array([True] * len(edges))], names=["a", "b", "key", "edge"])

        yield from _runs_of_keys(batches, keep)

    found = materialize(map_arrow(dealt, run, "a long, b long, key long, edge boolean"), "pairs")
    # a key whose run crosses partitions has a first document in each: link them (two rows a partition)
    border = found.where("edge").select("key", F.col("a").alias("d")).distinct()
    heads = border.groupBy("key").agg(F.min("d").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    across = border.join(heads, "key").where("d <> m").select(F.col("d").alias("a"), F.col("m").alias("b"), "key")
    return found.where("not edge").select("a", "b", "key").unionByName(across)


def candidate_pairs(reps: DataFrame, conf: NearDup, partitions: int) -> DataFrame:
    """``a, b, key``: representatives ``a > b`` that meet in some table, each with its run's first document."""
    g = conf.groups

    def keys(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            bands = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64).view(_U).reshape(n, 2 * g)
            left, right = bands[:, :g], bands[:, g:]
            table = splitmix(g * g, 303).reshape(g, g)
            key = mix(left[:, :, None] * _U(0x9E3779B97F4A7C15) + right[:, None, :] + table[None]).reshape(n, g * g)
            doc = np.repeat(b.column(0).to_numpy(), g * g)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(doc)], names=["key", "doc"])

    return pairs_of_runs(map_arrow(reps.select("doc_id", "bands"), keys, "key long, doc long"), partitions)


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Documents of ``x`` by documents of ``y``: whether their min-hashes agree on AGREE of the places or more."""
    same = np.zeros((len(x), len(y)), np.uint8)  # at most 255 places
    for p, q in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), strict=True):
        same += p[:, None] == q[None, :]
    return same >= int(np.ceil(AGREE * x.shape[1] - 1e-9))


def run_forest(docs: np.ndarray, sig: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the documents of one run, two being linked if their min-hashes agree on AGREE of the places or more.

    Breadth first: documents reached are tried against those not reached yet, in slices of bounded memory.
    """
    out, left = [], np.arange(len(docs))
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            at, front = front[:64], front[64:]
            reached = []
            for lo in range(0, len(left), 4096):
                part = left[lo : lo + 4096]
                ok = agreement(sig[at], sig[part])
                hit = ok.any(axis=0)
                reached.append(hit)
                out += zip(docs[part[hit]].tolist(), docs[at[ok.argmax(axis=0)[hit]]].tolist(), strict=True)
            hit = np.concatenate(reached)
            front, left = np.concatenate([front, left[hit]]), left[~hit]
    return out


def cross_links(docs: np.ndarray, sig: np.ndarray, cls: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links between the two sides of a pair of blocks that connect, with the classes ``cls`` of before, all that agree across.

    Documents of the commonest class aren't tried against each other: they are connected already.
    """
    names, cls, many = np.unique(cls, return_inverse=True, return_counts=True)
    root, main = np.arange(len(names)), many.argmax()
    out: list[tuple[int, int]] = []
    left, right = np.flatnonzero(~side), np.flatnonzero(side)
    for rows, cols in ((left[cls[left] == main], right[cls[right] != main]), (left[cls[left] != main], right)):
        for i in range(0, len(rows), 64):
            for j in range(0, len(cols), 4096):
                at, part = rows[i : i + 64], cols[j : j + 4096]
                x, y = np.nonzero(agreement(sig[at], sig[part]) & (root[cls[at]][:, None] != root[cls[part]][None, :]))
                for d, e in zip(at[x].tolist(), part[y].tolist(), strict=True):
                    a, b = root[cls[d]], root[cls[e]]
                    if a != b:
                        out.append((docs[d], docs[e]))
                        root[root == b] = a
    return out


def _groups(batches, n_keys: int):
    """(key, columns) of each group of equal leading columns of sorted batches; signatures, the column behind the keys and the document, as rows."""
    now, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns) if i != n_keys + 1]
        sig = np.frombuffer(b"".join(b.column(n_keys + 1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
        keys, rest = cols[:n_keys], cols[n_keys:]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            key = tuple(k[lo] for k in keys)
            if held and key != now:
                yield now, [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            now = key
            held.append([rest[0][lo:hi], sig[lo:hi], *(r[lo:hi] for r in rest[1:])])
    if held:
        yield now, [np.concatenate(c) for c in zip(*held, strict=True)]


def _linked(found: list[tuple[int, int]]):
    if found:
        f = np.array(found, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(f.max(axis=1)), pa.array(f.min(axis=1))], names=["a", "b"])


def within_runs(members: DataFrame, sig: DataFrame, partitions: int) -> DataFrame:
    """``a, b``: the forests of the blocks of ``members`` (key, part, doc_id); the caller deals larger runs into blocks and tries them by ``across_parts`` too."""
    dealt = members.join(sig, "doc_id").select("key", "part", "doc_id", "sig").repartition(partitions, "key", "part").sortWithinPartitions("key", "part", "doc_id")

    def run(batches):
        for _, (docs, sigs) in _groups(batches, 2):
            yield from _linked(run_forest(docs, sigs))

    return map_arrow(dealt, run, "a long, b long")


def across_parts(members: DataFrame, sig: DataFrame, so_far: DataFrame, partitions: int) -> DataFrame:
    """``a, b``: links between any two blocks of a run of ``members`` (key, part, parts, doc_id): each pair of blocks is one task's group.

    ``so_far``: ``node, component`` of what is connected already. Runs of one class have nothing to try.
    """
    known = members.join(so_far.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("cls", F.coalesce("component", "doc_id")).drop("component")
    open_ = known.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("key")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    sides = known.join(open_, "key", "left_semi").join(sig, "doc_id").withColumn("other", other).where("other <> part")
    sides = sides.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "doc_id", "sig", "cls", (F.col("part") > F.col("other")).alias("side"))
    dealt = sides.repartition(partitions, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches):
        for _, (docs, sigs, cls, side) in _groups(batches, 3):
            yield from _linked(cross_links(docs, sigs, cls, side.astype(bool)))

    return map_arrow(dealt, run, "a long, b long")


def agreeing(pairs: DataFrame, reps: DataFrame, run_docs: int = RUN_DOCS) -> DataFrame:
    """Pairs that connect all documents of a run whose min-hashes agree on AGREE of the places or more.

    Documents that agree with their run's first are paired with it. Runs in which any is not connected with it by then are gone through
    in full: those of at most ``run_docs`` documents by one task, larger ones in blocks of about that size, each within itself and then
    every pair of blocks.
    """
    partitions = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sig = reps.select("doc_id", "sig")
    once = pairs.select("a", "b").distinct()
    both = once.join(sig.withColumnRenamed("sig", "sa").withColumnRenamed("doc_id", "a"), "a").join(sig.withColumnRenamed("sig", "sb").withColumnRenamed("doc_id", "b"), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((x == y).mean(axis=1) >= AGREE)], names=["a", "b", "ok"])

    tried = materialize(map_arrow(both, run, "a long, b long, ok boolean"), "tried")
    # what agrees is connected already; a run is open only if its first and another document are not
    so_far = materialize(components(tried.where("ok").select("a", "b"), "so-far"), "so-far")
    good = so_far.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    label = lambda x: so_far.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    failed = tried.where("not ok").join(label("a"), "a", "left").join(label("b"), "b", "left")
    failed = materialize(failed.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "open")
    if not failed.limit(1).count():
        return good
    mixed = pairs.join(failed, ["a", "b"], "left_semi").select("key").distinct()
    rows = materialize(pairs.join(mixed, "key", "left_semi"), "open-runs")
    members = rows.select("key", F.col("a").alias("doc_id")).unionByName(rows.select("key", F.col("b").alias("doc_id"))).distinct()
    # runs of two have nothing left to try
    many = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    parts = F.ceil(F.col("n") / run_docs)
    members = materialize(members.join(many, "key").select("key", "doc_id", parts.alias("parts"), F.pmod(F.xxhash64("doc_id"), parts).alias("part")), "members")
    good = materialize(good.unionByName(within_runs(members.select("key", "part", "doc_id"), sig, partitions)).distinct(), "within")
    large = members.where("parts > 1")
    if large.limit(1).count():
        good = good.unionByName(across_parts(large, sig, components(good, "blocks"), partitions)).distinct()
    return good


@dataclass(frozen=True)
class ShingleSets:
    """The distinct shingles of some texts, told apart by their words; ``token`` by text, the shingles of fewest texts first."""

    token: np.ndarray
    off: np.ndarray

    @staticmethod
    def of(texts: pa.Array, k: int) -> ShingleSets:
        buf, off = buffers(texts)
        start, end, w_off = words(buf, off, NOT_SPACE)
        ids, _ = distinct(buf, start, end, lower=True)
        code, s_off = shingles(ids, w_off, k)
        known, code = np.unique(code, return_inverse=True)
        n, base = len(off) - 1, max(len(known), 1)
        cell = np.unique(np.repeat(np.arange(n), np.diff(s_off)) * base + code)
        doc, code = cell // base, cell % base
        order = np.empty(len(known), np.int64)
        order[np.argsort(np.bincount(code, minlength=len(known)), kind="stable")] = np.arange(len(known))
        cell = np.sort(doc * base + order[code])
        return ShingleSets(cell % base, np.searchsorted(cell // base, np.arange(n + 1)))

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.off)

    def alike(self, one: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Which of ``others`` have  100 |A & B| >= percent |A | B|  with the set ``one``."""
        size = self.sizes
        if not size[one] or not len(others):
            return np.zeros(len(others), bool)
        mark = np.zeros(int(self.token.max()) + 1, bool)
        mark[self.token[self.off[one] : self.off[one + 1]]] = True
        many = size[others]
        ends = np.concatenate([[0], np.cumsum(many)])
        at = np.arange(ends[-1]) + np.repeat(self.off[:-1][others] - ends[:-1], many)
        both = np.concatenate([[0], np.cumsum(mark[self.token[at]])])
        both = both[ends[1:]] - both[ends[:-1]]
        return (both > 0) & (100 * both >= percent * (size[one] + many - both))


def prefixes(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(short, long): how many of a set's first shingles, in any order common to all sets, must be looked at.

    Of two alike sets of n <= m shingles at least ``percent * (n + m) / (100 + percent)`` are common, which is no less than
    ``2 * percent * n / (100 + percent)`` and ``percent * m / 100``: the short prefix of the smaller and the long one of the larger share one.
    """
    return n - (2 * percent * n + 99 + percent) // (100 + percent) + 1, n - (percent * n + 99) // 100 + 1


def links(ids: np.ndarray, texts: pa.Array, conf: NearDup) -> list[tuple[int, int]]:
    """A spanning forest of all links between the given texts."""
    sets = ShingleSets.of(texts, conf.shingle)
    n, size = len(ids), sets.sizes
    root = np.arange(n)
    out: list[tuple[int, int]] = []

    def join(one: int, found: np.ndarray) -> None:
        for x in found:
            if root[x] != root[one]:
                out.append((int(ids[one]), int(ids[x])))
                root[root == root[x]] = root[one]

    everyone = np.arange(n)
    tried = np.zeros(n, bool)
    for _ in range(PIVOTS):
        names, many = np.unique(root, return_counts=True)
        main = names[many.argmax()]
        left = np.flatnonzero(~tried & ((root != main) if many.max() > 1 else True) & (size > 0))
        if not len(left):
            return out
        one = left[0]
        tried[one] = True
        others = everyone[(root != root[one]) & ~tried]
        join(one, others[sets.alike(one, others, conf.percent)])
    names, many = np.unique(root, return_counts=True)
    main = names[many.argmax()]
    todo = np.flatnonzero((root != main) & ~tried & (size > 0))
    if not len(todo):
        return out
    # the index: documents by each shingle of their short and of their long prefixes
    few = [np.where(size > 0, x, 0) for x in prefixes(size, conf.percent)]
    index = []
    for many in few:
        ends = np.concatenate([[0], np.cumsum(many)])
        token = sets.token[np.arange(ends[-1]) + np.repeat(sets.off[:-1] - ends[:-1], many)]
        order = np.argsort(token, kind="stable")
        index.append((np.searchsorted(token[order], np.arange(int(sets.token.max()) + 2)), np.repeat(everyone, many)[order]))
    for one in todo:
        tried[one] = True
        found = [np.zeros(0, np.int64)]
        for many, (at, holder), larger in ((few[0], index[1], True), (few[1], index[0], False)):
            mine = sets.token[sets.off[one] : sets.off[one] + many[one]]
            mine = mine[at[mine + 1] > at[mine]]
            if len(mine):
                x = np.concatenate([holder[at[t] : at[t + 1]] for t in mine])
                found.append(x[size[x] >= size[one] if larger else size[x] <= size[one]])
        found = np.unique(np.concatenate(found))
        found = found[(root[found] != root[one]) & ~tried[found] & (100 * np.minimum(size[found], size[one]) >= conf.percent * np.maximum(size[found], size[one]))]
        join(one, found[sets.alike(one, found, conf.percent)])
    return out


def link_jobs(members: DataFrame, conf: NearDup, partitions: int) -> DataFrame:
    """Verified links ``a, b`` within each ``job`` of ``members`` (job, doc_id, text); a job's texts are held by one task."""
    dealt = members.select("job", "doc_id", "text").repartition(partitions, "job").sortWithinPartitions("job", "doc_id")

    def run(batches):
        now, docs, texts = None, [], []

        def close():
            found = links(np.array(docs), pa.array(texts, pa.large_binary()), conf) if len(docs) > 1 else []
            if found:
                f = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1])], names=["a", "b"])

        for b in batches:
            for job, d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if job != now and docs:
                    yield from close()
                    docs, texts = [], []
                now = job
                if not docs or docs[-1] != d:
                    docs.append(d)
                    texts.append(text)
        if docs:
            yield from close()

    return map_arrow(dealt, run, "a long, b long")


def link_pairs(pairs: DataFrame, conf: NearDup) -> DataFrame:
    """The rows ``a, b`` of ``pairs`` (a, text_a, b, text_b) that are links."""

    def run(batches):
        for b in batches:
            left, right = (b.column(i).cast(pa.binary()) for i in (1, 3))
            ok = [bool(ShingleSets.of(pa.array([x.as_py(), y.as_py()], pa.large_binary()), conf.shingle).alike(0, np.array([1]), conf.percent)[0]) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return map_arrow(pairs.select("a", "text_a", "b", "text_b"), run, "a long, b long")


def shingle_counts(texts: DataFrame, conf: NearDup) -> np.ndarray:
    """In how many of ``texts`` the shingles of each of BUCKETS hash buckets stand: a table of fixed size."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for _, h, _ in _hash_sets(batches, conf.shingle):
            total += np.bincount((h % _U(BUCKETS)).astype(np.int64), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    table = map_arrow(texts.select("doc_id", "text"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return out


def _hash_sets(batches, k: int):
    """(ids, hashes of all distinct shingles, offsets) a batch of (doc_id, text)."""
    for b in batches:
        buf, off = buffers(b.column(1))
        for i, j, bb, oo in blocks(buf, off):
            start, end, w_off = words(bb, oo, NOT_SPACE)
            ids, known = distinct(bb, start, end, lower=True)
            h = shingle_hashes(hashes(known)[ids], w_off, k)
            s_off = np.concatenate([[0], np.cumsum(np.maximum(np.diff(w_off) - k + 1, 0))])
            sets = [np.unique(h[s_off[d] : s_off[d + 1]]) for d in range(j - i)]
            yield b.column(0).slice(i, j - i).to_numpy(), np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])


def rare_shingles(texts: DataFrame, counts: np.ndarray, conf: NearDup) -> DataFrame:
    """``doc_id, n, token, short``: each text's long prefix of shingles, by bucket counts and then by hash, and whether they stand in its short one."""
    known = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        for ids, h, off in _hash_sets(batches, conf.shingle):
            for d in range(len(ids)):
                mine = h[off[d] : off[d + 1]]
                n = len(mine)
                if n:
                    # one more than needed, in case two shingles of the text share a hash
                    short, long_ = (int(x) + 1 for x in prefixes(np.array(n), conf.percent))
                    first = mine[np.lexsort((mine, known.value[(mine % _U(BUCKETS)).astype(np.int64)]))][:long_]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), ids[d])), pa.array(np.full(len(first), n)), pa.array(first.view(np.int64)), pa.array(np.arange(len(first)) < short)], names=["doc_id", "n", "token", "short"])

    return map_arrow(texts.select("doc_id", "text"), run, "doc_id long, n long, token long, short boolean")


def link_large(texts: DataFrame, conf: NearDup) -> DataFrame:
    """Verified links of clusters beyond one job: ``texts`` has (job, doc_id, text, salts), every text at most once a job.

    ``salts`` is the number of parts over which a cluster's texts are dealt where they meet their pivot.
    """
    texts = texts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")))
    found, cls = None, texts.select("job", "doc_id", F.col("doc_id").alias("cls"), F.lit(False).alias("tried"))
    for _ in range(PIVOTS):
        per = cls.groupBy("job", "cls").agg(F.count(F.lit(1)).alias("m"), F.min(F.when(~F.col("tried"), F.col("doc_id"))).alias("first"))
        main = per.groupBy("job").agg(F.max(F.struct("m", "cls")).alias("main"))
        # the smallest id outside the cluster's largest class, or of all where no class has formed
        one = per.join(main, "job").where("first is not null and (cls <> main.cls or main.m = 1)").groupBy("job").agg(F.min("first").alias("doc_id"))
        pivots = texts.join(one, ["job", "doc_id"], "left_semi").select("job", F.col("doc_id").alias("b"), F.col("text").alias("text_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        pairs = texts.join(pivots, ["job", "salt"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"), "b", "text_b")
        new = materialize(link_pairs(pairs, conf), "pivot-links")
        found = new if found is None else found.unionByName(new)
        tried = cls.where("tried").select("doc_id").unionByName(one.select("doc_id")).distinct().withColumn("t", F.lit(True))
        classes_ = components(found, "pivot-classes").withColumnRenamed("node", "doc_id").withColumnRenamed("component", "c")
        cls = materialize(texts.select("job", "doc_id").join(classes_, "doc_id", "left").join(tried, "doc_id", "left").select("job", "doc_id", F.coalesce("c", "doc_id").alias("cls"), F.coalesce("t", F.lit(False)).alias("tried")), "pivot-state")
    per = cls.groupBy("job", "cls").agg(F.count(F.lit(1)).alias("m"))
    main = per.groupBy("job").agg(F.max(F.struct("m", "cls")).alias("main")).select("job", F.col("main.cls").alias("main"))
    state = cls.join(main, "job")
    tokens = materialize(rare_shingles(texts, shingle_counts(texts, conf), conf).join(state, "doc_id"), "rare-shingles")
    left = tokens.where("cls <> main and not tried").select("job", "token", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("cls").alias("ca"), F.col("short").alias("sa"))
    right = tokens.where("not tried").select("job", "token", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("cls").alias("cb"), F.col("short").alias("sb"))
    # the shingles' hashes may count two as one: a margin of one keeps the conditions on lengths exact
    near = (100 * (F.least("na", "nb") + 1) >= conf.percent * F.greatest("na", "nb")) & (F.col("ca") != F.col("cb"))
    met = [left.where("sa").join(right, ["job", "token"]).where(near & F.expr("na <= nb + 1")), left.join(right.where("sb"), ["job", "token"]).where(near & F.expr("nb <= na + 1"))]
    pairs = met[0].unionByName(met[1]).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    side = texts.select("doc_id", "text")
    full = pairs.join(side.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(side.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return found.unionByName(materialize(link_pairs(full, conf), "links"))


def one_text_each(prof: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, n_shingles, d1..d4`` of every id, ``prof`` without the rows that don't count)."""
    least, most = [F.min(c).alias(f"lo_{c}") for c in _DIGEST], [F.max(c).alias(c) for c in _DIGEST]
    ids = materialize(prof.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), *most, *least), "ids")
    differs = ids.where(" or ".join(f"{c} <> lo_{c}" for c in _DIGEST)).select("doc_id")
    ids = ids.select("doc_id", "n_shingles", *_DIGEST)
    if not differs.limit(1).count():
        return ids, prof
    rows = prof.join(differs, "doc_id", "left_semi")
    chosen = materialize(rows.groupBy("doc_id").agg(F.max(F.struct("n_shingles", *_DIGEST)).alias("x")).select("doc_id", "x.*"), "chosen")
    rest = prof.join(differs, "doc_id", "left_anti").unionByName(rows.join(chosen, ["doc_id", "n_shingles", *_DIGEST], "left_semi"))
    return ids.join(differs, "doc_id", "left_anti").unionByName(chosen), rest


def classes(docs: DataFrame, conf: NearDup = NearDup()) -> DataFrame:
    """``doc_id, n_shingles, component_id``: every document with the smallest id of its near-duplicate class."""
    with discarding() as keep:
        partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        one = with_id(docs, "doc_id").select("doc_id", "text")
        ids, prof = one_text_each(materialize(profile(one, conf), "profile"))
        same = prof.where("n_shingles > 0").groupBy(*_DIGEST).agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        reps = materialize(same, "reps")
        full = reps.where("sig is not null")
        cluster = components(agreeing(candidate_pairs(full, conf, partitions), full), "clusters")
        wanted = materialize(cluster.select(F.col("node").alias("doc_id"), F.col("component").alias("job")).join(reps.select("doc_id", *_DIGEST), "doc_id"), "wanted")
        held = materialize(_texts_of(one, wanted), "texts")
        sizes = held.groupBy("job").agg(F.sum(F.octet_length("text")).alias("bytes"))
        large = materialize(sizes.where(F.col("bytes") > conf.job_bytes).select("job", F.ceil(F.col("bytes") / conf.job_bytes).alias("salts")), "large")
        edges = materialize(link_jobs(bounded_join(held, large, ["job"], "left_anti", 24), conf, partitions), "links")
        if large.limit(1).count():
            edges = edges.unionByName(link_large(bounded_join(held, large, ["job"], "inner", 24).dropDuplicates(["job", "doc_id"]), conf))
        final = components(edges, "classes")
        # every document by its digest to its representative, then to the representative's class
        top = materialize(reps.select(*_DIGEST, F.col("doc_id").alias("rep")).join(final.withColumnRenamed("node", "rep"), "rep", "left").select(*_DIGEST, F.coalesce("component", "rep").alias("component_id")), "top")
        named = bounded_join(ids, top, _DIGEST, "left", 80)
        return keep(materialize(named.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), "near-dup"))


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``job, doc_id, text`` of the ``wanted`` documents (doc_id, job, d1..d4): the text whose words have the digest, where an id has several."""
    joined = bounded_join(docs, wanted, ["doc_id"], "inner", 64)

    def run(batches):
        for b in batches:
            buf, off = buffers(b.column(2))
            digest = []
            for _, _, bb, oo in blocks(buf, off):
                start, end, w_off = words(bb, oo, NOT_SPACE)
                digest += word_digests(bb, oo, start, end, w_off)
            d = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 4)
            ok = (d == np.stack([b.column(i).to_numpy() for i in range(3, 7)], axis=1)).all(axis=1)
            yield pa.RecordBatch.from_arrays(b.columns[:3], names=["job", "doc_id", "text"]).filter(pa.array(ok))

    return map_arrow(joined.select("job", "doc_id", "text", *_DIGEST), run, "job long, doc_id long, text string")


def keep_one(docs: DataFrame, conf: NearDup = NearDup()) -> DataFrame:
    """Rows of ``docs`` that stay: the smallest id of each class; rows without id stay as they are."""
    gone = materialize(classes(docs, conf).where("doc_id <> component_id").select("doc_id"), "gone")
    return bounded_join(docs, gone, ["doc_id"], "left_anti", 16)
