"""Small helpers of the llm operators: durable intermediate tables and components."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalcrate.session import ensure_checkpoint_dir, ship_package

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
VECTORED = "parquet.hadoop.vectored.io.enabled"


def for_python(spark: SparkSession) -> None:
    """Make the session ready for Arrow functions over texts: workers can import the package, and a batch
    is 1,000 rows where the session still has Spark's default of 10,000 (a batch is held several times over,
    by the JVM and by Python, in every running task)."""
    ship_package(spark)
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "1000")
    plain_reads(spark)


def plain_reads(spark: SparkSession) -> None:
    """Read Parquet column chunks in pieces of 8 MB at most, where the session and its Spark settings do not say otherwise.

    Parquet's vectored reads take a whole chunk in one asynchronous read through Java's file channels, and every thread
    of their pool keeps a direct buffer as large as the largest chunk (the texts of a row group) that it has read."""
    if spark.conf.get(VECTORED, None) is None and not spark.sparkContext.getConf().contains(f"spark.hadoop.{VECTORED}"):
        spark.conf.set(VECTORED, "false")


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table, by way of Arrow.

    A list given to ``createDataFrame`` goes through Python workers of the RDD kind, whose daemon and processes
    then stay in each executor beside those of the Arrow functions."""
    fields = T.StructType.fromDDL(schema).fields
    columns = [pa.array(c) for c in zip(*rows)] or [pa.array([], pa.null())] * len(fields)
    return spark.createDataFrame(pa.table(columns, names=[f.name for f in fields]), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs at most a reread, never a recomputation.  Nothing needs the write's
    shuffle files any more, so Spark is told to remove them with it; the session's own setting is given back."""
    spark = df.sparkSession
    plain_reads(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def hidden(df: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns that clash with an operator's own ``names`` put aside, and the map to give them back
    (``df.withColumnsRenamed(back)``)."""
    own, aside = {n.lower() for n in names}, {}
    taken = {c.lower() for c in df.columns} | own
    for c in df.columns:
        if c.lower() in own:
            new = f"{c}_"
            while new.lower() in taken:
                new += "_"
            taken.add(new.lower())
            aside[c] = new
    return df.withColumnsRenamed(aside), {v: k for k, v in aside.items()}


class IdBits:
    """A bitmap of ids: ``maybe`` holds for every id of ``ids`` (one column of longs, null is an id) and for few others.

    It has 16 to 32 bits an id, at most ``1 << most`` (8 MB); beyond four million ids more others pass.  It leaves
    rows out of a shuffle that a join would drop; an exact join always follows."""

    def __init__(self, ids: DataFrame, most: int = 26):
        self.size = 1 << max(min((16 * ids.count()).bit_length(), most), 15)
        at = ids.select(self.at(ids[ids.columns[0]]).alias("at")).distinct()
        cells = (at.select(F.shiftright("at", 15).alias("cell"), (F.col("at") % 32768).alias("bit")).repartition("cell")
                 .groupBy("cell").agg(F.bitmap_construct_agg("bit").alias("bits")))
        self.bits = np.zeros(self.size // 8, np.uint8)
        for r in saved(cells, "id-bits").toLocalIterator():
            self.bits[r.cell * 4096:(r.cell + 1) * 4096] = np.frombuffer(r.bits, np.uint8)

    def at(self, ids: Column) -> Column:
        """Bit number of each id."""
        return F.pmod(F.xxhash64(ids.cast("long")), F.lit(self.size))

    def maybe(self, ids: Column) -> Column:
        test = tester(self.bits)

        def held(at: pd.Series) -> pd.Series:
            return pd.Series(test(at.to_numpy()))

        return F.pandas_udf(held, "boolean")(self.at(ids))


def tester(bits: np.ndarray):
    """Whether bits are set, by their numbers."""
    return lambda at: (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)`` (longs): ``(id, comp)``, comp = smallest id.

    Alternating large-star and small-star steps; every step groups with partial
    aggregation and its edges go to the shared folder.  Nodes without an edge to
    another node are absent."""
    e = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
              .distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low2.select("u", F.col("m").alias("v"))))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        e = saved(small, "edges")
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(
                e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
        seen = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
