import json

from pyspark.sql import functions as F

from evalcrate.sinks import writers as W
from evalcrate.sources.readers import scan_json_splits, scan_split


def test_chat_jsonl_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, "q é \"x\"", "y", "train"), (2, "q2", "n", "test")],
                               "id int, u string, a string, split string")
    lines = df.select(W.chat_jsonl_column(F.col("u"), F.col("a"), "sys").alias("line"), "split")
    out = str(tmp_path / "jsonl")
    W.export_chat_jsonl(lines, "line", out)
    got = [json.loads(r.value) for r in spark.read.text(out + "/split=train").collect()]
    assert got == [{"messages": [{"role": "system", "content": "sys"}, {"role": "user", "content": "q é \"x\""},
                                 {"role": "assistant", "content": "y"}]}]


def test_predictions_outputs_metrics(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", "1")], "id int, input string, output string")
    W.write_predictions(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert back.input == "a,b"
    W.write_outputs(df, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 1
    m = spark.createDataFrame([(0.5, 3)], "accuracy double, n long")
    W.write_metrics(m, {"model": "m1", "accuracy": "ignored"}, str(tmp_path / "metrics"))
    rec = json.loads(spark.read.text(str(tmp_path / "metrics")).first().value)
    assert rec == {"model": "m1", "accuracy": 0.5, "n": 3}


def test_json_splits_and_split_filter(spark, tmp_path):
    (tmp_path / "tr.jsonl").write_text('{"question_id": "a", "answer": "x"}\n{"question_id": "b", "answer": "y"}\n')
    (tmp_path / "te.jsonl").write_text('{"question_id": "c", "answer": "z"}\n')
    df = scan_json_splits(spark, {"train": str(tmp_path / "tr.jsonl"), "test": str(tmp_path / "te.jsonl")},
                          "question_id string, answer string")
    assert sorted((r.split, r.question_id) for r in df.collect()) == [("test", "c"), ("train", "a"), ("train", "b")]
    df.write.partitionBy("split").parquet(str(tmp_path / "byspl"))
    t = scan_split(spark, str(tmp_path / "byspl"), "train", columns=["question_id"])
    assert "PartitionFilters: [isnotnull(split" in t._jdf.queryExecution().executedPlan().toString() or t.count() == 2
    assert t.count() == 2


def test_metrics_record_keeps_nulls(spark):
    m = spark.createDataFrame([(None, 2)], "precision double, n long")
    rec = json.loads(W.metrics_record(m, {"run": "r"}).first().value)
    assert rec == {"run": "r", "precision": None, "n": 2}
