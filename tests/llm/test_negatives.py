"""Hard negatives against brute force over all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalcrate.llm import negatives as N

ROWS = "id long, label int, embedding array<double>, anchor boolean"


def plain(rows, low=80, high=100):
    good = [(i, label, [math.floor(max(min(256 * x, N.LIMIT), -N.LIMIT)) for x in e], a) for i, label, e, a in rows
            if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    last = math.inf

    def ordered(found):
        return sorted(found, key=lambda f: (-f[0], last if f[1] is None else f[1]))
    out = Counter()
    for n, (i, label, v, anchor) in enumerate(good):
        if not anchor:
            continue
        scores = [(sum(x * y for x, y in zip(v, w)), j, k) for m, (j, k, w, _) in enumerate(good) if m != n]
        for p, pid, _ in ordered([s for s in scores if s[2] == label])[:5]:
            fits = ordered([s for s in scores if s[2] != label and low * p <= 100 * s[0] <= high * p])[:5]
            for rank, (s, j, _) in enumerate(fits, 1):
                out[i, pid, rank, j, p, s] += 1
    return out


def sample(seed, n=400, dim=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.4) for _ in range(dim)] for _ in range(9)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, rng.randrange(4), [x + rng.gauss(0, 0.1) for x in c], i % 9 == 0))
    return rows, rng


@pytest.mark.parametrize("leaf_rows,group", [(8192, 1024), (40, 16), (4, 5)])
def test_negatives_brute_force(spark, leaf_rows, group):
    rows, rng = sample(leaf_rows)
    rows += [(1000 + i, i % 2, rows[5][2], i % 3 == 0) for i in range(60)]       # equal vectors
    rows += [rows[9], rows[9], rows[18], rows[18], rows[18], rows[18], rows[18]]  # repeated rows, anchors among them
    rows += [(9, 3, rows[9][2], True), (9, 2, rows[0][2], True)]                  # one id, several rows
    rows += [(None, 1, rows[0][2], None), (None, 2, rows[0][2], False), (5001, None, rows[0][2], True), (5002, 1, None, True),
             (5003, 1, [0.1, None, 0.0], True), (5004, 1, [0.1, math.nan, 0.0], True),
             (5005, 1, [math.inf, 0.0], True), (5006, 1, [], True), (5007, 2, [0.5, 0.2], True),
             (5008, 1, [0.0] * 6, True)]
    df = spark.createDataFrame(rows, ROWS).withColumns({x: F.lit(7) for x in ("x", "times", "c", "g", "leaf", "v")})
    got = Counter(tuple(r) for r in N.mine_negatives(df, leaf_rows=leaf_rows, group=group).collect())
    assert got == plain(rows)


def test_large_components_and_empty(spark):
    rows = [(i, i % 2, [3e6 * (i % 5), 1e300 if i == 7 else -2e5 * i, 1.0], i % 4 == 0) for i in range(40)]
    assert Counter(tuple(r) for r in N.mine_negatives(spark.createDataFrame(rows, ROWS)).collect()) == plain(rows)
    few, _ = sample(3, 60)
    df = spark.createDataFrame(few, ROWS)
    assert Counter(tuple(r) for r in N.mine_negatives(df, low=37, high=53).collect()) == plain(few, 37, 53)
    assert N.mine_negatives(spark.createDataFrame([], ROWS)).collect() == []
    assert N.mine_negatives(spark.createDataFrame(rows[1:3], ROWS)).collect() == []


def test_tree_leaves_out_and_keeps(spark):
    """Ranges leave out whole subtrees and never one that holds a row of the annulus."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 4, (60, 3)) for c in rng.normal(0, 150, (20, 3))]).astype(np.int32)
    top = int((x.astype(np.int64) ** 2).sum(1).max())
    tree = N.Tree(3, top, 2, {})
    N._split(tree, x[::3], [4, 4])
    for k, p in tree.points.items():
        tree.low[k], tree.high[k] = np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)
    for node, _, d, child in tree.walk(x):
        if node < 0:
            leaf = child
            continue
        for i, c in ((i, c) for i in range(d.shape[1]) for c in np.unique(child)):
            tree.low[node][i, c] = min(tree.low[node][i, c], d[child == c, i].min())
            tree.high[node][i, c] = max(tree.high[node][i, c], d[child == c, i].max())
    leaves = sorted(set(leaf.tolist()))
    q = x[::50]
    own = (q.astype(np.int64) ** 2).sum(1).astype(float)
    for low, high in ((0.9, 1.0), (0.5, 0.6)):
        near, far = N._annuli(tree, q, own * high, own * low)
        met = tree.reach(q, near, far, leaves)
        s = q.astype(np.int64) @ x.astype(np.int64).T
        for col, lf in enumerate(leaves):
            inside = ((s >= (own * low)[:, None]) & (s <= (own * high)[:, None]))[:, leaf == lf].any(1)
            assert not (inside & ~met[:, col]).any()
        assert met.mean() < 0.7
