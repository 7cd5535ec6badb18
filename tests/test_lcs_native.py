"""The JVM-side LCS against the bit-parallel one, on random token lists of up to 200 tokens."""

import random

from pyspark.sql import functions as F

from evalcrate.operators import lcs as L


def test_native_lcs_equals_bit_parallel(spark):
    rng = random.Random(14)
    rows = [([rng.choice("abcdefg"[:rng.randint(1, 7)]) for _ in range(rng.choice([0, 1, 5, 40, 200]))],
             [rng.choice("abcdefgh") for _ in range(rng.choice([0, 1, 5, 40, 200]))]) for _ in range(150)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for r in df.select("a", "b", L.lcs_length_native(F.col("a"), F.col("b")).alias("n")).collect():
        assert r.n == L.lcs_length(r.a, r.b)


def test_native_scores_equal_the_udf(spark):
    rows = [(1, "The cat sat.", "the cat is sat"), (2, "", "x"), (3, None, None), (4, "a b a b", "b a b a"), (5, "same same", "same same")]
    df = spark.createDataFrame(rows, "id int, pred string, ref string")
    udf = {r.id: r.rougeL for r in L.rouge_l_scores(df).collect()}
    for r in L.rouge_l_native(df).collect():
        assert (r.precision, r.recall, r.fmeasure) == tuple(udf[r.id])
