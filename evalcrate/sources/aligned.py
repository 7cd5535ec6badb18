"""Alignment of tables by the position of their rows in their files (J3 at scan).

A row of a Parquet file has a fixed index in that file; with the rows of all files before it, in the order of the
file names, it has a position in the table.  Neither depends on how the files are cut into tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan_positions(spark: SparkSession, path: str, out_col: str = "pos") -> DataFrame:
    """Rows of Parquet files with their 0-based position in the table."""
    df = spark.read.parquet(path)
    rows = df.select(*df.columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    # one row a file; the order of files is that of their names
    files = df.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_i")).groupBy("_file").agg(
        (F.max("_i") + 1).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("_file", F.coalesce(before, F.lit(0)).alias("_first"))
    return rows.join(files, "_file").withColumn(out_col, F.col("_first") + F.col("_index")).drop("_file", "_first", "_index")


def zip_scans(spark: SparkSession, left: str, right: str, out_col: str = "pos") -> DataFrame:
    """Two sets of files side by side, row by row, as long as the shorter one; a column that both have is the left one's,
    the right one's gets the suffix ``_right``."""
    a, b = scan_positions(spark, left, out_col), scan_positions(spark, right, out_col)
    taken = {c.lower() for c in a.columns}
    b = b.withColumnsRenamed({c: f"{c}_right" for c in b.columns if c.lower() in taken and c != out_col})
    return a.join(b, out_col)
