import numpy as np
import pytest

from evalcrate.operators.greedy import greedy_match_pairs


def test_greedy_blocks_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for pair in range(3):
        for vid in range(pair * 100, pair * 100 + 37):
            rows.append((pair, vid, "pred" if vid % 3 else "ref", rng.normal(size=8).astype(float).tolist()))
    df = spark.createDataFrame(rows, "pair_id int, vec_id long, side string, embedding array<double>")
    got = {r.pair_id: r for r in greedy_match_pairs(df, blocks=4).collect()}
    for pair in range(3):
        p = np.array([e for q, _, s, e in rows if q == pair and s == "pred"])
        r = np.array([e for q, _, s, e in rows if q == pair and s == "ref"])
        cos = (p / np.linalg.norm(p, axis=1, keepdims=True)) @ (r / np.linalg.norm(r, axis=1, keepdims=True)).T
        assert got[pair].precision == pytest.approx(cos.max(axis=1).mean())
        assert got[pair].recall == pytest.approx(cos.max(axis=0).mean())
