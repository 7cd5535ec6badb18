"""Histograms of the n-gram join: their distance never exceeds the sets' true difference."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from evalcrate.llm.ngram_join import FULL, Histograms, histogram


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2 ** 32), st.integers(1, 9000), st.integers(1, 9000), st.floats(0, 1), st.booleans())
def test_distance_is_a_lower_bound(seed, n, m, shared, narrow):
    rng = np.random.default_rng(seed)
    top = 2 ** 56 if narrow else 2 ** 64 - 1  # narrow: all hashes in one cell, which fills up
    common = rng.integers(0, top, int(min(n, m) * shared), np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, top, k - len(common), np.uint64)])) for k in (n, m)]
    hists = Histograms([histogram(s) for s in sets] + [b""])
    d = hists.distance(np.array([0]), np.array([1]))[0]
    assert d <= len(np.setxor1d(*sets))
    assert hists.distance(np.array([0, 1]), np.array([0, 1])).tolist() == [0, 0]


def test_unrelated_long_sets_are_told_apart():
    rng = np.random.default_rng(7)
    sets = [rng.integers(0, 2 ** 64 - 1, 20_000, np.uint64) for _ in range(2)]
    hists = Histograms([histogram(s) for s in sets])
    assert hists.distance(np.array([0]), np.array([1]))[0] > 2 * 20_000 * 20 / 180
    assert max(histogram(sets[0])) < FULL
