"""What the pipeline's stages leave in an executor: no second set of Python workers, no large direct buffers."""

import pytest
from pyspark import SparkContext

from evalcrate.llm.langid import keep_identified
from evalcrate.llm.mixing import mixed
from evalcrate.llm.shared import VECTORED, local_rows, plain_reads, saved


@pytest.fixture
def docs(spark):
    words = ["the cat sat on a mat", "le chat est sur la table"]
    rows = [(i, " ".join([words[i % 2]] * (1 + i % 5)), ["en", "fr"][i % 2], ["a", "b", None][i % 3]) for i in range(60)]
    rows += [(60, None, "en", "a"), (61, "", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_driver_rows_need_no_python_workers(spark, docs, monkeypatch):
    docs = saved(docs)

    def through_workers(*args, **kwargs):
        raise AssertionError("a list of the driver went through Python workers")

    monkeypatch.setattr(SparkContext, "parallelize", through_workers)
    assert keep_identified(docs).count() == 60
    assert 60 < mixed(docs).count() <= 120


def test_local_rows(spark):
    schema = "s string, n long, x double"
    rows = [("a", 1, float("inf")), (None, 2, 0.5), ("b", None, None)]
    assert [tuple(r) for r in local_rows(spark, rows, schema).collect()] == rows
    assert local_rows(spark, rows, schema).dtypes == local_rows(spark, [], schema).dtypes == [
        ("s", "string"), ("n", "bigint"), ("x", "double")]
    assert local_rows(spark, [], schema).count() == 0
    assert local_rows(spark, [(None, None, None)], schema).collect() == [(None, None, None)]


def test_column_chunks_are_read_in_pieces(spark):
    before = spark.conf.get(VECTORED, None)
    try:
        spark.conf.unset(VECTORED)
        saved(spark.range(3))
        assert spark.conf.get(VECTORED, None) == "false"
        spark.conf.set(VECTORED, "true")  # what a session asks for stays
        plain_reads(spark)
        assert spark.conf.get(VECTORED, None) == "true"
    finally:
        spark.conf.unset(VECTORED) if before is None else spark.conf.set(VECTORED, before)
