"""Exact ranks: selection, slices and the rank directory against sorted lists."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalcrate.operators import ranks as R
from evalcrate.operators.positions import row_position
from evalcrate.sources.readers import head_limit, pick_positions, sample_n, split_slice


def ordered(values):
    return sorted(values, key=lambda v: (v is not None, v if v is not None else 0))


LOW, HIGH = -(1 << 63), (1 << 63) - 1
COLUMNS = {
    "long": [LOW, LOW + 1, -5, 0, 7, HIGH - 1, HIGH, None] + random.Random(1).sample(range(-10**12, 10**12), 500),
    "int": [None] + random.Random(2).sample(range(-10**6, 10**6), 400),
    "string": [None, "", "a", "a\0", "ab", "é", "zebra" * 20, "zebra" * 20 + "x"] + [f"k{i % 7}-{i:05d}" for i in range(500)],
    "double": [None, -0.5, 0.25, -1e300, 1e300, float("inf"), -float("inf"), 1e-9, -1e-9] + [random.Random(i).gauss(0, 3) for i in range(400)],
    "date": [dt.date(1960, 1, 1) + dt.timedelta(days=i * 3) for i in range(400)],
}


@pytest.mark.parametrize("kind", list(COLUMNS))
@pytest.mark.parametrize("few", [4096, 5])
def test_keys_at(spark, kind, few):
    values = COLUMNS[kind]
    df = spark.createDataFrame([(v,) for v in random.Random(3).sample(values, len(values))], f"k {kind}")
    want = ordered(values)
    at = [0, 1, 7, len(want) // 2, len(want) - 1, len(want), 10**12]
    assert R.keys_at(df, ["k"], at, few) == [(want[r],) if r < len(want) else None for r in at]


def test_two_columns_and_equal_keys(spark):
    rows = [(i % 3 if i % 5 else None, f"n{i:03d}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b string, v int")
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for few in (4096, 3):
        assert R.keys_at(df, ["a", "b"], [0, 59, 60, 299], few) == [want[r][:2] for r in (0, 59, 60, 299)]
    assert R.keys_at(df, ["a"], [10]) is None
    for a, b in ((0, 60), (55, 130), (-20, None), (None, -7), (290, 900), (900, None), (5, 5)):
        assert Counter(map(tuple, split_slice(df, ["a", "b"], a, b).collect())) == Counter(want[slice(a, b)])
    got = split_slice(df, "a", 10, 100).collect()  # equal keys at both ends
    assert len(got) == 90 and Counter(r.a for r in got) == Counter(r[0] for r in want[10:100])


@pytest.mark.parametrize("partitions", [1, 8, 200])
def test_selection_without_shuffle(spark, partitions):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k"), F.col("id").alias("v")).repartition(partitions)
    want = sorted((i * 7919 % 20_011, i) for i in range(20_000))
    head = head_limit(df, "k", 6000)
    assert sorted(map(tuple, head.collect())) == want[:6000]
    plan = head._jdf.queryExecution().executedPlan().toString().split("repartition")[0]
    assert "Window" not in plan and "Sort" not in plan and "TakeOrdered" not in plan
    assert sorted((r.pos, r.k, r.rank) for r in pick_positions(df, "k", [15_000, 3, 9_999], rank_col="rank").collect()) == [
        (3, want[3][0], 2), (9_999, want[9_999][0], 3), (15_000, want[15_000][0], 1)]
    sample = sorted(r.v for r in sample_n(df, "v", 5000, seed=3).collect())
    import hashlib
    assert sample == sorted(sorted(range(20_000), key=lambda i: (hashlib.md5(f"{i}:3".encode()).hexdigest(), i))[:5000])


@pytest.mark.parametrize("kind", list(COLUMNS))
def test_directory_follows_the_rows(spark, kind, tmp_path):
    values = COLUMNS[kind]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"k {kind}, v int")
    directory = R.rank_directory(df, ["k"], most=20)
    assert max(directory.sizes) <= 20 and len(directory.cuts) >= len(values) / 20 and directory.total == len(values)
    directory.save(spark, str(tmp_path / "d"))
    again = R.RankDirectory.load(spark, str(tmp_path / "d"))
    assert again == directory
    got = row_position(df, "k", directory=again).collect()
    assert [r.k for r in sorted(got, key=lambda r: r.pos)] == ordered(values)
    found = R.with_bucket(df, directory).groupBy("_bucket", "_first").count().orderBy("_bucket").collect()
    assert [(r._first, r["count"]) for r in found] == list(zip(directory.firsts, directory.sizes))
    assert len(R.rank_directory(df, ["k"]).cuts) >= R.LEAST_BUCKETS


def test_equal_keys_and_empty_directory(spark):
    df = spark.createDataFrame([(5, i) for i in range(100)] + [(6, 1000), (None, 1001)], "k int, v int")
    directory = R.rank_directory(df, ["k"], most=10)
    assert sorted(directory.sizes) == [1, 1, 100]
    split = R.rank_directory(df, ["k", "v"], most=10)
    assert max(split.sizes) <= 10
    got = row_position(df, ["k", "v"]).orderBy("pos").collect()
    assert [r.v for r in got] == [1001, *range(100), 1000]
    empty = df.where("false")
    assert row_position(empty, "k").collect() == [] and head_limit(empty, "k", 5).collect() == []
    assert pick_positions(empty, "k", [0, 3]).collect() == []
