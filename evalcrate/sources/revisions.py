"""Tables that grow by committed batches and can be read as they were (S1 at a revision; K2, K4, K5 as one step).

Layout of a table folder: ``data/<batch>`` holds the files of one write, which are never changed; ``revisions/revision=N``
holds the manifest of revision N, one row per file with its size, rows and checksum.  A write first puts its files into a
new batch folder and then commits a manifest: the files of the revision before (append) or none of them (overwrite),
and its own.  The manifest is one file, moved into place by Spark's output committer; until then no reader sees the
batch, and a killed write leaves nothing but a folder that no manifest names.  Old revisions keep their files.

The manifest is as long as the list of the table's files.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "batch string, file string, size long, rows long, checksum string, columns string"


def _at(path: str, *parts: str) -> str:
    return "/".join([path.rstrip("/"), *parts])


def history(spark: SparkSession, path: str) -> DataFrame | None:
    """All manifests, ``revision`` and one row per file; None where nothing was committed."""
    try:
        return spark.read.schema(_MANIFEST + ", revision long").parquet(_at(path, "revisions"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def current_revision(spark: SparkSession, path: str) -> int | None:
    """Number of the last committed revision."""
    found = history(spark, path)
    return None if found is None else found.agg(F.max("revision")).first()[0]


def file_sums(df: DataFrame) -> DataFrame:
    """Per file of a scan: ``file, size, rows, checksum`` (a sum of row hashes, the same in any row order)."""
    names = df.columns
    rows = df.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size"),
                     F.xxhash64(F.to_json(F.struct(*names))).cast("decimal(38,0)").alias("h"))
    return rows.groupBy("file", "size").agg(F.count("*").alias("rows"), F.sum("h").cast("string").alias("checksum"))


def stage_batch(df: DataFrame, path: str) -> str:
    """Write the files of a batch that nobody sees yet; returns the batch's name."""
    batch = uuid.uuid4().hex
    df.write.parquet(_at(path, "data", batch))
    return batch


def commit_batch(spark: SparkSession, path: str, batch: str, schema, mode: str = "append") -> int:
    """Make a staged batch visible as the next revision; returns its number.  Of two writers that commit at once, one
    gets the number and the other goes on with the next."""
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    own = file_sums(spark.read.schema(schema).parquet(_at(path, "data", batch)))
    own = own.select(F.lit(batch).alias("batch"), "file", "size", "rows", "checksum", F.lit(schema.json()).alias("columns"))
    if own.isEmpty():  # a batch without rows still carries the columns
        own = spark.createDataFrame([(batch, None, 0, 0, None, schema.json())], _MANIFEST)
    while True:
        last = current_revision(spark, path)
        rows = own
        if mode == "append" and last is not None:
            rows = history(spark, path).where(F.col("revision") == last).drop("revision").unionByName(own)
        number = 0 if last is None else last + 1
        try:
            rows.coalesce(1).write.mode("errorifexists").parquet(_at(path, "revisions", f"revision={number}"))
            return number
        except AnalysisException as e:
            if e.getCondition() != "PATH_ALREADY_EXISTS":
                raise


def commit(df: DataFrame, path: str, mode: str = "append") -> int:
    """Write ``df`` as one committed batch; returns the new revision."""
    return commit_batch(df.sparkSession, path, stage_batch(df, path), df.schema, mode)


def read_revision(spark: SparkSession, path: str, revision: int | None = None, verify: bool = False) -> DataFrame:
    """The table at ``revision`` (default: the last).  ``verify`` compares the files' sizes, rows and checksums with the
    manifest and raises where one differs or is missing."""
    revision = current_revision(spark, path) if revision is None else revision
    found = history(spark, path)
    manifest = None if found is None else found.where(F.col("revision") == revision)
    listed = [] if manifest is None else manifest.select("batch", "columns").distinct().collect()
    if not listed:
        raise ValueError(f"{path} has no revision {revision}")
    from pyspark.sql.types import StructType
    import json
    schema = StructType.fromJson(json.loads(max(r.columns for r in listed)))
    df = spark.read.schema(schema).parquet(*sorted(_at(path, "data", r.batch) for r in listed))
    if verify:
        same = ["file", "size", "rows", "checksum"]
        wrong = manifest.where("file IS NOT NULL").select(*same).exceptAll(file_sums(df).select(*same))
        if not wrong.isEmpty():
            raise ValueError(f"files of {path} differ from the manifest of revision {revision}: {wrong.first().file}")
    return df
