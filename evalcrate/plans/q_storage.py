"""Positions, revisions and committed batches as write and read-back queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evalcrate.plans.fixture_sql import with_fixtures
from evalcrate.plans.registry import register
from evalcrate.session import ensure_checkpoint_dir
from evalcrate.sinks import writers as W
from evalcrate.sources import fixtures as FX
from evalcrate.sources import revisions as V
from evalcrate.sources.aligned import zip_scans


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/evalcrate-io/{name}-{uuid.uuid4().hex}"


@register("write_predictions_indexed", with_fixtures("class3") + """
SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS VARCHAR) AS "index", CAST(id AS VARCHAR) AS id, gold, pred FROM class3""")
def q_write_predictions_indexed(spark, sf_dir):
    """K2: the prediction table with its positional index, as CSV."""
    path = _folder(spark, "indexed")
    W.write_predictions(FX.class3(spark, sf_dir), path, order_col="id")
    return spark.read.option("header", True).option("escape", '"').csv(path)


@register("align_by_position", with_fixtures("class3") + """,
a AS (SELECT row_number() OVER (ORDER BY id) - 1 AS pos, id, gold FROM class3),
b AS (SELECT row_number() OVER (ORDER BY id DESC) - 1 AS pos, id AS id_right, pred FROM class3 WHERE id % 3 <> 0)
SELECT pos, id, gold, id_right, pred FROM a JOIN b USING (pos)""")
def q_align_by_position(spark, sf_dir):
    """Inputs and outputs in files of their own, zipped by position and cut to the shorter set."""
    left, right = _folder(spark, "inputs"), _folder(spark, "outputs")
    rows = FX.class3(spark, sf_dir)
    rows.select("id", "gold").orderBy("id").write.parquet(left)
    rows.where("id % 3 <> 0").select("id", "pred").orderBy(F.desc("id")).write.parquet(right)
    return zip_scans(spark, left, right)


@register("scan_revision", with_fixtures("class3") + """
SELECT 'first' AS revision, id, gold FROM class3 WHERE id % 2 = 0
UNION ALL SELECT 'appended', id, gold FROM class3 UNION ALL SELECT 'overwritten', id, pred FROM class3 WHERE id % 5 = 0""")
def q_scan_revision(spark, sf_dir):
    """A table as it was at each of its revisions, after an append and an overwrite."""
    path, rows = _folder(spark, "revisions"), FX.class3(spark, sf_dir)
    numbers = [V.commit(rows.where("id % 2 = 0").select("id", "gold"), path),
               V.commit(rows.where("id % 2 <> 0").select("id", "gold"), path),
               V.commit(rows.where("id % 5 = 0").select("id", F.col("pred").alias("gold")), path, "overwrite")]
    out = None
    for name, n in zip(("first", "appended", "overwritten"), numbers):
        part = V.read_revision(spark, path, n, verify=True).select(F.lit(name).alias("revision"), "id", "gold")
        out = part if out is None else out.unionByName(part)
    return out


@register("checkpoint_committed", with_fixtures("multi_ref_pred") + "SELECT question_id, prediction FROM multi_ref_pred")
def q_checkpoint_committed(spark, sf_dir):
    """K4/K5: two committed batches; a third one is written but never committed, and no reader sees it."""
    path, rows = _folder(spark, "committed"), FX.multi_ref_pred(spark, sf_dir)
    W.checkpoint_outputs(rows.where("question_id % 2 = 0"), path, committed=True)
    W.checkpoint_outputs(rows.where("question_id % 2 <> 0"), path, committed=True)
    V.stage_batch(rows, path)
    return V.read_revision(spark, path)
