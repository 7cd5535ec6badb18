"""Revisions, committed batches and positional alignment."""

import pytest
from pyspark.sql import functions as F

from evalcrate.sinks import writers as W
from evalcrate.sources import revisions as V
from evalcrate.sources.aligned import scan_positions, zip_scans


def table(spark, path, n=None, **kw):
    return sorted(r.id for r in V.read_revision(spark, str(path), n, **kw).collect())


def test_old_revisions_stay(spark, tmp_path):
    assert V.current_revision(spark, str(tmp_path / "t")) is None
    with pytest.raises(ValueError, match="no revision"):
        V.read_revision(spark, str(tmp_path / "t"))
    path = str(tmp_path / "t")
    assert V.commit(spark.range(5), path) == 0
    assert V.commit(spark.range(5, 8).repartition(3), path) == 1
    assert V.commit(spark.range(100, 102), path, "overwrite") == 2
    assert V.commit(spark.range(0).repartition(1), path, "overwrite") == 3
    assert V.commit(spark.range(1), path) == 4
    for n, want in ((0, [*range(5)]), (1, [*range(8)]), (2, [100, 101]), (3, []), (4, [0]), (None, [0])):
        assert table(spark, path, n, verify=True) == want
    with pytest.raises(ValueError, match="no revision 9"):
        V.read_revision(spark, path, 9)
    with pytest.raises(ValueError, match="mode"):
        V.commit(spark.range(1), path, "replace")


def test_uncommitted_and_killed_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    V.commit(spark.range(3), path)
    batch = V.stage_batch(spark.range(50, 60), path)

    def dies(batches):
        for n, b in enumerate(batches):
            yield b
            raise RuntimeError("killed")
    with pytest.raises(Exception, match="killed"):
        W.checkpoint_outputs(spark.range(1000).repartition(4).mapInPandas(dies, "id long"), path, committed=True)
    assert table(spark, path) == [0, 1, 2]
    V.commit_batch(spark, path, batch, spark.range(1).schema)
    assert table(spark, path, verify=True) == [0, 1, 2, *range(50, 60)]


def test_changed_files_are_noticed(spark, tmp_path):
    path = str(tmp_path / "t")
    V.commit(spark.range(10).repartition(2), path)
    V.read_revision(spark, path, verify=True)
    batch = V.history(spark, path).first().batch
    spark.range(3).write.mode("overwrite").parquet(f"{path}/data/{batch}")
    with pytest.raises(ValueError, match="differ from the manifest"):
        V.read_revision(spark, path, verify=True)


@pytest.mark.parametrize("piece", ["128m", "2k"])
def test_positions_do_not_depend_on_splits(spark, tmp_path, piece):
    left, right = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(5000).select("id", F.md5(F.col("id").cast("string")).alias("text")).orderBy("id").write.option(
        "parquet.block.size", 4096).parquet(left)
    spark.range(3000).select((F.col("id") * 2).alias("out"), F.lit("r").alias("TEXT")).orderBy(F.desc("out")).write.parquet(right)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", piece)
        rows = sorted(map(tuple, scan_positions(spark, left).select("pos", "id").collect()))
        both = zip_scans(spark, left, right).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == [(i, i) for i in range(5000)]
    assert [(r.pos, r.id, r.out, r.TEXT_right) for r in both] == [(i, i, 2 * (2999 - i), "r") for i in range(3000)]


def test_prediction_index(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a,\"x\""), (2, None)], "id int, output string")
    W.write_predictions(df, str(tmp_path / "p"), order_col="id")
    got = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "p")).orderBy("index").collect()
    assert [(r["index"], r.id, r.output) for r in got] == [("0", "1", 'a,"x"'), ("1", "2", None), ("2", "3", "c")]
