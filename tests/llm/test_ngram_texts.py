"""The n-gram join leaves texts that no join can drop out of its shuffles and hashes only the others."""

from pyspark.sql import functions as F

from evalcrate.llm import ngram_join
from evalcrate.llm.shared import IdBits

DOC = "doc_id long, text string, _at string"


def unrelated(i):
    return " ".join(f"w{i}x{j}" for j in range(30))


def test_bitmap_holds_every_id_and_few_others(spark):
    no_id = spark.createDataFrame([(None,)], "id long")
    rows = spark.range(-9000, 21000).unionByName(no_id)
    listed = spark.range(-9000, 21000, 7).unionByName(no_id)
    for most in (26, 16):  # the second one is full: more pass, none is missing
        bits = IdBits(listed, most)
        got = {r.id for r in rows.where(bits.maybe(F.col("id"))).collect()}
        assert got >= {r.id for r in listed.collect()}
        assert len(got) < 30001 * (0.25 if most == 26 else 0.5)
    assert not rows.where(IdBits(listed.limit(0)).maybe(F.col("id"))).count()


def test_keep_one_hashes_only_rows_that_may_go(spark, monkeypatch):
    rows = [(i, unrelated(i), "a") for i in range(400)] + [(1000 + i, unrelated(i), "b") for i in range(10)]
    rows += [(None, unrelated(3), "c"), (None, unrelated(900), "d"), (2000, None, "e"), (2000, unrelated(20), "f")]
    rows += [(30, unrelated(30), "a")]  # stands twice
    hashed, whole = spark.sparkContext.accumulator(0), ngram_join._with_class

    def counted(*args):
        run = whole(*args)

        def count(batches):
            for b in run(batches):
                hashed.add(b.num_rows)
                yield b
        return count

    monkeypatch.setattr(ngram_join, "_with_class", counted)
    kept = ngram_join.keep_one(spark.createDataFrame(rows, DOC)).collect()
    want = [r for r in rows if r[2] in "ade"][:-1]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)
    assert 0 < hashed.value < 150  # rows that may stand twice are read again
