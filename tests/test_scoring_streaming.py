import pytest



from evalcrate.operators import scoring as S
from evalcrate.streaming.scoring import stream_em_metrics, stream_score


def test_score_fn_records_errors(spark):
    def flaky(texts):
        out = []
        for t in texts:
            if "boom" in t:
                raise RuntimeError("model failed")
            out.append(t.upper())
        return out

    df = spark.createDataFrame([(1, "a"), (2, "boom"), (3, "c")], "id long, p string")
    rows = {r.id: r for r in S.score_fn(df, flaky, "id", "p").collect()}
    assert rows[1].output == "A" and rows[3].output == "C"
    assert rows[2].output is None and "model failed" in rows[2].error


def test_resume_twice_equals_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id long, p string")
    def bang(texts):
        return [t + "!" for t in texts]

    out = str(tmp_path / "out")
    a = S.resumable_score(df, bang, "id", "p", out).orderBy("id").collect()
    b = S.resumable_score(df, bang, "id", "p", out).orderBy("id").collect()
    assert a == b and len(a) == 20
    assert spark.read.parquet(out).count() == 20   # the second run appended nothing


def test_stream_score_and_metrics(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "y", "y"), (2, "n", "y")], "id long, response string, truth string") \
        .write.parquet(src + "/a")
    spark.createDataFrame([(3, "Yes", "y")], "id long, response string, truth string").write.parquet(src + "/b")
    schema = "id long, response string, truth string"
    q = stream_score(spark, src + "/*", schema, lambda ts: [t.lower() for t in ts], "id", "response",
                     str(tmp_path / "scored"), checkpoint=str(tmp_path / "ck1"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "scored"))
    assert sorted(r.output for r in out.collect()) == ["n", "y", "yes"]
    q2 = stream_em_metrics(spark, src + "/*", schema, "response", "truth", checkpoint=str(tmp_path / "ck2"),
                           query_name="em_stream_test")
    q2.awaitTermination(120)
    m = spark.sql("select * from em_stream_test").first()
    assert (m.n, m.tp, m.fn) == (3, 2, 1)


def test_stream_restart_processes_only_new_files(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "id long, response string, truth string"
    spark.createDataFrame([(1, "a", "y")], schema).write.parquet(src + "/a")
    stream_score(spark, src + "/*", schema, lambda ts: [t.upper() for t in ts], "id", "response", out,
                 checkpoint=ck).awaitTermination(120)
    spark.createDataFrame([(2, "b", "y")], schema).write.parquet(src + "/b")
    stream_score(spark, src + "/*", schema, lambda ts: [t.upper() for t in ts], "id", "response", out,
                 checkpoint=ck).awaitTermination(120)
    rows = sorted((r.id, r.output) for r in spark.read.parquet(out).collect())
    assert rows == [(1, "A"), (2, "B")]          # restart picked up only the new file


def _factory(name, folder):
    def make():
        import uuid
        from pathlib import Path
        (Path(folder) / f"{name}-{uuid.uuid4().hex}").touch()
        return lambda texts: [f"{name}:{t}" for t in texts]
    return make


def test_scorer_is_built_once_per_worker_and_key(spark, tmp_path):
    df = spark.range(0, 64).selectExpr("id", "cast(id as string) as p").repartition(16)
    for _ in range(2):
        out = S.score_fn(df, None, "id", "p", make_fn=_factory("a", str(tmp_path)), make_key="model-a").collect()
        assert all(r.output == f"a:{r.id}" for r in out)
    other = S.score_fn(df, None, "id", "p", make_fn=_factory("b", str(tmp_path)), make_key="model-b").collect()
    assert all(r.output == f"b:{r.id}" for r in other)
    workers = 4  # the test session's cores
    assert 1 <= len(list(tmp_path.glob("a-*"))) <= workers and 1 <= len(list(tmp_path.glob("b-*"))) <= workers
    with pytest.raises(ValueError, match="make_key"):
        S.score_fn(df, None, "id", "p", make_fn=_factory("a", str(tmp_path)))


def test_resumable_run_with_a_scorer_factory(spark, tmp_path):
    df = spark.range(0, 10).selectExpr("id", "cast(id as string) as p")
    out = S.resumable_score(df, None, "id", "p", str(tmp_path / "o"), make_fn=_factory("c", str(tmp_path)), make_key="model-c")
    assert sorted(r.output for r in out.collect()) == sorted(f"c:{i}" for i in range(10))


def test_unreadable_output_folder_is_not_taken_for_an_empty_one(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        S.resumable_score(spark.range(3).selectExpr("id", "'x' as p"), lambda t: t, "id", "p", str(tmp_path / "bad"))


def test_stream_needs_a_lasting_checkpoint(spark):
    from evalcrate.streaming import scoring
    if spark.sparkContext.getConf().get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError, match="checkpoint"):
            scoring._ckpt(spark, "x", None)
    assert scoring._ckpt(spark, "x", "/given") == "/given"
