import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evalcrate.operators import prompts as P
from evalcrate.operators.accounting import message_rule
from evalcrate.operators.positions import row_position
from evalcrate.sources.readers import parse_slice, split_slice


def test_row_position_equals_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5003).alias("k"))
    got = row_position(df, "k", "pos")
    want = df.withColumn("rn", F.row_number().over(Window.orderBy("k")) - 1)
    assert got.join(want, "k").where(F.col("pos") != F.col("rn")).count() == 0
    assert got.count() == 5000


def test_slices(spark):
    df = spark.range(0, 50).withColumnRenamed("id", "k")
    assert [r.k for r in split_slice(df, "k", 10, 13).collect()] == [10, 11, 12]
    assert sorted(r.k for r in split_slice(df, "k", -3, None).collect()) == [47, 48, 49]
    assert split_slice(df, "k", 45, None).count() == 5
    assert parse_slice("train[:1000]") == ("train", None, 1000)
    assert parse_slice("test[5]") == ("test", 5, 6)


def test_merge_adjacent_roles_array(spark):
    df = spark.sql("select array(named_struct('role','user','content','a'), named_struct('role','user','content','b'),"
                   " named_struct('role','assistant','content','c'), named_struct('role','user','content','d')) m")
    r = df.select(P.merge_adjacent_roles("m").alias("x")).first().x
    assert [(m.role, m.content) for m in r] == [("user", "ab"), ("assistant", "c"), ("user", "d")]


def test_invalid_shots():
    with pytest.raises(ValueError):
        P.fewshot_prefix(None, 4)


def test_template_prints_none(spark):
    df = spark.createDataFrame([(None, "t")], "a string, b string")
    assert df.select(P.template("x{a}-{b}", a=F.col("a"), b=F.col("b")).alias("v")).first().v == "xNone-t"


def test_message_rules():
    assert message_rule("gpt-4-0613") == (3, 1)
    assert message_rule("gpt-3.5-turbo-0301") == (4, -1)
    assert message_rule("gpt-3.5-turbo-1106") == (3, 1)
    with pytest.raises(NotImplementedError):
        message_rule("llama")


def test_family_wrap_unknown_fails(spark):
    df = spark.createDataFrame([(1, "x", "nope")], "id int, t string, fam string")
    with pytest.raises(Exception, match="unknown model family"):
        P.family_wrap(df, "t", "fam").collect()


def test_segmented_running_sum_matches_window(spark):
    from evalcrate.operators.positions import segmented_running_sum
    rows = [(k, t, (k * 7 + t * 3) % 2) for k in range(3) for t in range(0, 40 if k == 0 else 7)]
    df = spark.createDataFrame(rows, "k int, t int, v int")
    got = segmented_running_sum(df, "k", "t", "v", "rs", block=3)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("ws", F.sum("v").over(w))
    j = got.join(want, ["k", "t"])
    assert j.count() == len(rows) and j.where(F.col("rs") != F.col("ws")).count() == 0


def test_merge_adjacent_roles_long(spark):
    from evalcrate.operators.chat import merge_adjacent_roles_long
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d"), (2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in merge_adjacent_roles_long(df).collect())
    assert got == [(1, 0, "user", "ab"), (1, 1, "assistant", "c"), (1, 2, "user", "d"), (2, 0, "user", "x")]


@pytest.mark.parametrize("partitions,aqe", [(1, True), (8, False), (8, True), (200, False), (200, True)])
def test_positions_do_not_depend_on_the_plan(spark, partitions, aqe):
    """Wide rows, string and composite keys: positions are exactly 0..n-1 in key order."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", aqe)
        o = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
        for keys in (["o_orderkey"], ["o_orderstatus", "o_orderkey"]):
            got = row_position(o, keys, "pos").orderBy("pos").select("pos", *keys).collect()
            want = o.select(*keys).orderBy(*keys).collect()
            assert [r.pos for r in got] == list(range(len(want)))
            assert [tuple(r)[1:] for r in got] == [tuple(r) for r in want]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_slices_and_samples_of_wide_tables(spark):
    from evalcrate.sources import readers as R
    o = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    keys = [r[0] for r in o.select("o_orderkey").orderBy("o_orderkey").collect()]
    n = len(keys)
    for a, b in ((0, 10_001), (9_000, 12_000), (None, -14_000), (-30, None), (-n - 5, 3), (n - 2, n + 9), (7, 7)):
        got = R.split_slice(o, "o_orderkey", a, b)
        assert sorted(r.o_orderkey for r in got.collect()) == keys[a:b]
    assert R.head_limit(o, "o_orderkey", 12_345).count() == 12_345
    assert R.sample_n(o, "o_orderkey", 10_001).count() == 10_001
    picked = R.pick_positions(o, "o_orderkey", [14_000, 3]).collect()
    assert sorted((r.k, r.o_orderkey) for r in picked) == [(1, keys[14_000]), (2, keys[3])]
    assert R.split_slice(o.limit(0), "o_orderkey", -3, None).count() == 0


def test_hot_conversation_pairing_and_merging(spark):
    """One conversation holding most rows: neighbour-join pairing and blocked
    island numbering give the same answer as the per-conversation definitions."""
    from evalcrate.operators.chat import merge_adjacent_roles_long, pair_turns
    roles = ["user", "user", "assistant", "user", "assistant", "assistant", "assistant"]
    rows = [(0, t, roles[t % 7], f"t{t};") for t in range(3000)] + [(1, 0, "user", "x"), (1, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert pair_turns(df, even_only=True).count() == 1500 + 1
    got = merge_adjacent_roles_long(df).where("conv_id = 0").orderBy("turn").collect()
    # expected islands by a plain Python scan
    want, prev = [], None
    for _, t, r, x in rows[:3000]:
        if r == prev:
            want[-1][1] += x
        else:
            want.append([r, x])
        prev = r
    assert [(g.role, g.text) for g in got] == [tuple(w) for w in want]
