"""Cuts of texts at tokens, offsets of matches and token counts, against plain Python."""

import random
import re

from pyspark.sql import functions as F

from evalcrate.functions import options as O
from evalcrate.functions import text as T
from evalcrate.functions.util import running_sums
from evalcrate.operators import accounting as A
from evalcrate.operators import overlap
from evalcrate.operators import prompts as P

TEXTS = ["", " ", "\n\n", "one", "  one\ttwo\n\nthree ", "a b c", "x\x1cy\x1fz", "tab\t", "é è\nà", "word " * 3000, "no-spaces" * 500]


def test_pieces_keep_every_character(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", T.py_pieces("t").alias("p"), T.piece_count(T.py_pieces("t")).alias("n"),
                       *[P.cut_tokens("t", k).alias(f"c{k}") for k in (1, 2, 40)]).collect():
        assert "".join(r.p) == r.t and r.n == len(r.t.split())
        for k in (1, 2, 40):
            ends = [m.end() for m in re.finditer(r"[^\s]+", r.t)]
            assert r[f"c{k}"] == (r.t[:ends[k - 1]] if len(ends) > k else r.t if len(ends) < k else r[f"c{k}"])
            assert r.t.startswith(r[f"c{k}"]) and r[f"c{k}"].split() == r.t.split()[:k]


def test_truncate_keeps_line_breaks(spark):
    df = spark.createDataFrame([("a\n\nb  c\td e f",), ("a b",), (None,)], "t string")
    got = [r[0] for r in df.select(P.truncate_keep_tail("t", " END", 5)).collect()]
    assert got == ["a\n\nb  c END", "a b END", None]


def test_strip_prompt_tokens(spark):
    df = spark.createDataFrame([("say  it:", "say it:\n the\n answer "), ("p", "p"), (None, "x y"), ("a b c", "a b")], "p string, t string")
    assert [r[0] for r in df.select(P.strip_prompt_tokens("t", "p")).collect()] == ["\n the\n answer ", "", "x y", ""]


def test_running_sums_and_offsets(spark):
    rng = random.Random(6)
    rows = [([rng.randrange(9) for _ in range(n)],) for n in (0, 1, 2, 3, 10, 99, 100, 101, 1000)]
    for r in spark.createDataFrame(rows, "v array<int>").select("v", running_sums(F.col("v")).alias("s")).collect():
        assert r.s == [sum(r.v[:i]) for i in range(len(r.v))]
    texts = ["".join(rng.choice("ab.") for _ in range(n)) for n in (0, 1, 5, 50, 4000)]
    df = spark.createDataFrame([(t, p) for t in texts for p in ("a", "ab", ".", "aa", "zz", "")], "t string, p string")
    for r in df.select("t", "p", O.literal_positions("t", "p").alias("x"), O.match_positions("t", F.lit("a+b?")).alias("y")).collect():
        if r.p:
            assert r.x == [m.start() for m in re.finditer(re.escape(r.p), r.t)], r
        assert r.y == [m.start() for m in re.finditer("a+b?", r.t)]


def test_counts_by_split(spark):
    texts = [*TEXTS, "Don't stop, it's 3.5!", "x" * 10 + "..", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", A.native_token_count("t").alias("n"), overlap.rouge_tokens("t").alias("r")).collect():
        assert r.n == len(re.findall(A.NATIVE_TOKEN_RULE, r.t or ""))
        assert r.r == re.findall(overlap.ROUGE_TOKEN, (r.t or "").lower())
