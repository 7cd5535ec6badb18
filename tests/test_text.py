import pytest

from evalcrate.functions import text as T
from pyref import get_tokens, normalize_answer

EDGE = ["", "The cat!", "a's an apple", "b-c", "  lots   of\tspace\n", "café Éa the end",
        "no break", "sep\x1cchar", "An", "the.", "Hello, World... THE end", "x a y an z the",
        "ünïcödé the—a test", "Yes, the same", " em space "]


@pytest.fixture(scope="module")
def edge_df(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(EDGE)], "id int, s string")


def test_normalize_and_tokens_match_python(edge_df):
    rows = edge_df.select("id", T.normalize_answer("s").alias("n"), T.answer_tokens("s").alias("t")).collect()
    for r in rows:
        assert r.n == normalize_answer(EDGE[r.id]), EDGE[r.id]
        assert list(r.t) == get_tokens(EDGE[r.id]), EDGE[r.id]


def test_null_tokens_empty(spark):
    r = spark.sql("select cast(null as string) s").select(T.answer_tokens("s").alias("t")).first()
    assert list(r.t) == []


def test_py_strip_and_split(edge_df):
    rows = edge_df.select("id", T.py_strip("s").alias("st"), T.py_split("s").alias("sp")).collect()
    for r in rows:
        assert r.st == EDGE[r.id].strip()
        assert list(r.sp) == EDGE[r.id].split()


@pytest.mark.parametrize("text,expected", [
    ("y", 1), ("n", 0), ("Yes, the same", 1), ("The answer: n", 0), ("unsure", -1), ("", -1),
    ("no y", 1), ("yes n", 0), ("maybe no", 0)])
def test_resolve_binary(spark, text, expected):
    r = spark.createDataFrame([(text,)], "s string").select(T.resolve_binary("s", "y", "n").alias("v")).first()
    assert r.v == expected


@pytest.mark.parametrize("text,expected", [
    ("Unanswerable.</s>", "unanswerable"), ("Yes, sure", "yes"), (" no way", "no"), ("nothing", "no"),
    ("maybe<pad>", "maybe"), ("a/nb\\c", "abc"), ("Yesterday", "yes")])
def test_extract_answer(spark, text, expected):
    r = spark.createDataFrame([(text,)], "s string").select(T.extract_answer("s").alias("v")).first()
    assert r.v == expected


def test_cut_and_drop(spark):
    df = spark.createDataFrame([("ab</s>cd</s>",)], "s string")
    r = df.select(T.cut_at_suffix("s", "</s>").alias("a"), T.drop_suffix("s", "</s>").alias("b"),
                  T.cut_at_suffix("s", "").alias("c"), T.drop_stop_tokens("s", "</s>+c").alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("ab", "abcd", "ab</s>cd</s>", "abd")


def test_encode_label_oov(spark):
    df = spark.createDataFrame([("SUPPORTS",), ("REFUTES",), ("MAYBE",), (None,)], "s string")
    got = [r.v for r in df.select(T.encode_label("s", ["SUPPORTS", "REFUTES", "NOT_ENOUGH_INFO"]).alias("v")).collect()]
    assert got == [0, 1, 3, 3]


def test_format_class(spark):
    df = spark.createDataFrame([("y", 1), ("Y", 1), ("x", -1)], "c string, p int")
    got = [r.v for r in df.select(T.format_class("c", "p", "y", "n").alias("v")).collect()]
    assert got == ["CORRECT", "RESOLVABLE", "UNRESOLVABLE"]
