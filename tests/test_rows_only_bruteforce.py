"""Brute-force checks for the registered queries that have no SQL oracle
(ROUGE-L/Lsum), and of the bootstrap interval, on the sf0.001 fixture."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from conftest import SMALL
from evalcrate.plans.fixture_sql import FIXTURE_SQL
from pyref import rouge_l, rouge_lsum, rouge_n


@pytest.fixture(scope="module")
def pairs():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SMALL}/conversations.parquet')")
    return con.execute(FIXTURE_SQL["text_pairs"]).fetchall()


def test_rouge_l_query_brute_force(spark, pairs):
    got = E.queries()["rouge_lsum"](spark, SMALL).first()
    assert got.n == len(pairs)
    assert got.rougeL == pytest.approx(round(np.mean([rouge_l(p, r) for _, p, r in pairs]), 6), abs=1e-6)
    assert got.rougeLsum == pytest.approx(round(np.mean([rouge_lsum(p, r) for _, p, r in pairs]), 6), abs=1e-6)


def _poisson(u: float) -> int:
    w, cdf, p, k = 0, 0.0, math.exp(-1.0), 0
    while p >= 2.0 ** -52:
        cdf += p
        w += u >= cdf
        k += 1
        p /= k
    return w


def test_bootstrap_query_brute_force(spark, pairs):
    got = E.queries()["bootstrap_mean"](spark, SMALL).first()
    vals = [(i, rouge_n(p, r, 1)) for i, p, r in pairs]
    means = []
    for b in range(200):
        ws = [_poisson(int(hashlib.md5(f"{i}:{b}:11".encode()).hexdigest()[:13], 16) / float(1 << 52)) for i, _ in vals]
        tot = sum(ws)
        if tot:
            means.append(sum(w * v for w, (_, v) in zip(ws, vals)) / tot)
    low, mid, high = np.percentile(means, [2.5, 50, 97.5])
    assert got.replicates == 200
    assert (got.low, got.mid, got.high) == pytest.approx((round(low, 6), round(mid, 6), round(high, 6)), abs=1e-6)
