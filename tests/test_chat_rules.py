"""Conversation rules: dense turns, several exchanges; option values with regex characters; bounded weights."""

import pytest

from evalcrate.functions import options as OP
from evalcrate.operators import chat as H
from evalcrate.operators import runs as RU

CONV = "conv_id long, turn long, role string, text string"


def test_gaps_fail(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c")], CONV)
    with pytest.raises(Exception, match="without gaps"):
        H.pair_turns(df).collect()
    with pytest.raises(Exception, match="without gaps"):
        H.merge_adjacent_roles_long(df).collect()
    late = spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "assistant", "b")], CONV)
    with pytest.raises(Exception, match="from 0"):
        H.pair_turns(late).collect()
    assert H.pair_turns(late, even_only=False).count() == 1


def test_several_exchanges_are_numbered_in_order(spark):
    conv = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], CONV)
    new = spark.createDataFrame([(1, "second", "y", 2), (1, "first", "x", 1), (7, "new", "z", 1)],
                                "conv_id long, user_text string, assistant_text string, n int")
    got = sorted((r.conv_id, r.turn, r.text) for r in H.append_history(conv, new, order_col="n").collect())
    assert got == [(1, 0, "a"), (1, 1, "b"), (1, 2, "first"), (1, 3, "x"), (1, 4, "second"), (1, 5, "y"), (7, 0, "new"), (7, 1, "z")]
    with pytest.raises(Exception, match="order_col"):
        H.append_history(conv, new.drop("n")).collect()


def test_option_values_with_regex_characters(spark):
    rows = [(1, "Which? {A: a.c, B: x+}", "we saw abc", "A", None),      # a.c matches abc only as a pattern
            (2, "Which? {A: (ab, B: cd}", "it is (ab", None, "A"),       # an invalid pattern matches nothing
            (3, "Which? {A: x+, B: z}", "xxx", "A", None),
            (4, "Which? {A: [ab], B: q}", "only b here", "A", None)]
    df = spark.createDataFrame(rows, "id int, question string, target string, as_regex string, as_text string")
    got = {r.id: r.answer for r in OP.infer_option_df(df, "question", "target", "answer", value_match="python").collect()}
    assert got == {r[0]: r[3] for r in rows}
    text = df.select("id", OP.infer_option("question", "target").alias("answer")).collect()
    assert {r.id: r.answer for r in text} == {r[0]: r[4] for r in rows}


def test_poisson_weights_are_not_cut(spark):
    cdf = RU.poisson_cdf()
    assert len(cdf) > 15 and cdf[-1] > 1 - 2 ** -50
    assert all(a < b for a, b in zip(cdf, cdf[1:16]))


def test_examples_of_an_unknown_dataset_fail(spark):
    from evalcrate.operators import prompts as P
    table = spark.createDataFrame([("a", 1, "q", "r"), ("b", 1, "x", "y")], "dataset string, k int, question string, response string")
    assert [tuple(r) for r in P.examples_of(table, "a").collect()] == [(1, "q", "r")]
    with pytest.raises(Exception, match="no few-shot examples"):
        P.examples_of(table, "c").collect()
