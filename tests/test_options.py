import pytest
from pyspark.sql import functions as F

from evalcrate.functions import options as OP


def _opts(spark, q):
    r = spark.createDataFrame([(q,)], "q string").select(OP.parse_options("q").alias("o")).first()
    return [(x.key, x.value) for x in r.o]


def test_parse_options_duplicates_keep_first_position_last_value(spark):
    assert _opts(spark, "Pick one {A: x, B: y, A: z}") == [("A", "z"), ("B", "y")]
    assert _opts(spark, "no options here") == []


def test_parse_options_malformed_raises(spark):
    with pytest.raises(Exception, match="malformed option item"):
        _opts(spark, "Pick {A: x, B}")


@pytest.mark.parametrize("target,expected", [
    ("A", "A"), (" B ", "B"), ("dog", "B"), ("I pick C) today", "C"), ("maybe cat or dog", "A"),
    ("catalog", "C"), ("catalogue", "A"), ("nothing", None), ("B: dog", "B")])
def test_infer_option(spark, target, expected):
    q = "Which animal? {A: cat, B: dog, C: catalog}"
    r = spark.createDataFrame([(q, target)], "q string, t string").select(OP.infer_option("q", "t").alias("v")).first()
    assert r.v == expected


def test_match_positions_non_overlapping(spark):
    r = spark.createDataFrame([("aaaa", "aa"), ("abcab", "ab"), ("xyz", "q")], "t string, p string").select(
        OP.literal_positions("t", "p").alias("v")).collect()
    assert [list(x.v) for x in r] == [[0, 2], [0, 3], []]


def test_first_match_prefix_option_ordering(spark):
    # 'cat' is a prefix of 'catalog': equal first offsets, the longer offset list wins for min
    q = "Q {A: catalog, B: cat}"
    df = spark.createDataFrame([(q, "catalog and cat")], "q string, t string")
    r = df.select(OP.first_match("t", OP.parse_options("q"), True).alias("mn"),
                  OP.first_match("t", OP.parse_options("q"), True, op="max").alias("mx")).first()
    assert r.mn == "A" and r.mx == "B"


def test_python_regex_values(spark):
    q = "Pick {A: c.t, B: (x, C: dog}"
    df = spark.createDataFrame([(q, "my cat"), (q, "a (x here"), (q, "dog")], "q string, t string")
    py = [r.answer for r in OP.infer_option_df(df, "q", "t", value_match="python").collect()]
    lit = [r.answer for r in OP.infer_option_df(df, "q", "t", value_match="literal").collect()]
    # 'c.t' is a regex that matches 'cat'; '(x' is an invalid regex -> no match in Python mode
    assert py == ["A", None, "C"]
    assert lit == [None, "B", "C"]


def test_python_tokenizer(spark):
    from evalcrate.operators.accounting import python_tokenizer
    from evalcrate.operators.prompts import pretokenize
    df = spark.createDataFrame([("a b  c d",)], "s string")
    r = df.select(pretokenize("s", 3, tokenizer=python_tokenizer(str.split)).alias("t")).first()
    assert list(r.t) == ["a", "b", "c"]


def test_parse_options_and_positions_random(spark):
    import random
    import re
    rnd = random.Random(17)
    keys, words = ["A", "B", "C", "D", "E"], ["cat", "dog", "a.b", "x+y", "(z)", "cat dog", "ca"]
    rows = []
    for i in range(150):
        items = [f"{rnd.choice(keys)}: {rnd.choice(words)}" for _ in range(rnd.randint(1, 5))]
        q = "Q? {" + ", ".join(items) + "}"
        target = " ".join(rnd.choice(words + keys + ["A)", "B:", "C."]) for _ in range(rnd.randint(0, 6)))
        rows.append((i, q, target))
    df = spark.createDataFrame(rows, "id int, q string, t string")
    got = {r.id: r for r in df.select("id", OP.parse_options("q").alias("o"),
                                      OP.literal_positions("t", F.lit("cat")).alias("p")).collect()}
    for i, q, t in rows:
        want = dict(item.split(": ") for item in re.search(r"\{(.+?)\}$", q).group(1).split(", "))
        assert [(x.key, x.value) for x in got[i].o] == list(want.items())
        assert list(got[i].p) == [m.start() for m in re.finditer(re.escape("cat"), t)]
