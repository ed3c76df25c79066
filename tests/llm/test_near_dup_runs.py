"""Runs of a key whose first document is an unrelated one."""

import numpy as np

from palimpsest.llm import near_dup


def reps_of(spark, conf, sigs, runs):
    """Representatives with the given min-hashes; those of one run share all their bands."""
    rng = np.random.default_rng(5)
    bands = {r: rng.integers(0, 2**62, 2 * conf.groups).tobytes() for r in set(runs)}
    rows = [(d, bytearray(s.tobytes()), bytearray(bands[r])) for d, (s, r) in enumerate(zip(sigs, runs, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, sig binary, bands binary")


def test_unrelated_first(spark):
    conf, rng = near_dup.NearDup(), np.random.default_rng(3)
    lone = [rng.integers(0, 256, conf.hashes).astype(np.uint8) for _ in range(3)]
    near = lone[1].copy()
    near[:10] ^= 1
    far = lone[2].copy()
    far[:10] ^= 1
    # run 0: a stranger, then two pairs of copies; run 1: a pair alone; run 2: two strangers
    sigs = [lone[0], lone[1], lone[2], near, far, lone[1], near, lone[0], lone[2]]
    reps = reps_of(spark, conf, sigs, [0, 0, 0, 0, 0, 1, 1, 2, 2])
    for partitions in (1, 7):
        got = {tuple(r) for r in near_dup.agreeing(near_dup.candidate_pairs(reps, conf, partitions), reps).select("a", "b").collect()}
        assert got == {(3, 1), (4, 2), (6, 5)}


def test_split_runs(spark):
    """Runs beyond the bound are split by further min-hashes; what agrees well stays connected."""
    conf, rng = near_dup.NearDup(), np.random.default_rng(9)
    sigs = []
    for _ in range(30):
        base = rng.integers(0, 256, conf.hashes).astype(np.uint8)
        for _ in range(3):
            near = base.copy()
            near[rng.permutation(conf.hashes)[:6]] ^= 1
            sigs.append(near)
    reps = reps_of(spark, conf, sigs, [0] * 90)
    pairs = near_dup.candidate_pairs(reps, conf, 3)
    for run_docs in (4096, 8, 2):
        root = list(range(90))
        for a, b in near_dup.agreeing(pairs, reps, run_docs).select("a", "b").collect():
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        assert root == [3 * (i // 3) for i in range(90)]


def test_large_runs_lose_no_pair(spark):
    """Pairs that agree on just enough places stand in any two blocks of a run beyond the bound: each is found, whatever its blocks."""
    conf, rng = near_dup.NearDup(), np.random.default_rng(17)
    n, most = 200, int(np.floor((1 - near_dup.AGREE) * conf.hashes))
    first = rng.integers(0, 256, (n, conf.hashes)).astype(np.uint8)
    second = first.copy()
    for row in second:
        row[rng.permutation(conf.hashes)[:most]] ^= 1
    order = rng.permutation(2 * n)
    reps = reps_of(spark, conf, np.concatenate([first, second])[order], [0] * (2 * n))
    want = {frozenset(np.flatnonzero(order % n == i).tolist()) for i in range(n)}
    pairs = near_dup.candidate_pairs(reps, conf, 3)
    for run_docs in (4096, 50):
        assert {frozenset((r.a, r.b)) for r in near_dup.agreeing(pairs, reps, run_docs).collect()} == want
    x = rng.integers(0, 3, (50, conf.hashes)).astype(np.uint8)
    assert (near_dup.agreement(x, x[:7]) == ((x[:, None] == x[None, :7]).mean(axis=2) >= near_dup.AGREE)).all()
