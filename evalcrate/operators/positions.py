"""Distributed row numbering.

``row_number() over (order by k)`` moves the whole table into one partition.
Instead the rank directory (``operators.ranks``) cuts the key range into buckets
of bounded size with the exact number of rows before each; a row's bucket is a
plain function of its key, and ``row_number`` runs inside each bucket.  Every
step is a function of the data alone: nothing depends on how Spark partitions a
stage, so positions are the same under retries, with any partition count and
with any columns besides the key.

Heads, slices, picks and samples need no numbering: they filter between the
exact keys at their ranks (``sources.readers``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalcrate.operators.ranks import RankDirectory, rank_directory, with_bucket


def numbered(df: DataFrame, order_col: str | list[str], out_col: str, directory: RankDirectory | None = None) -> DataFrame:
    """Rows with their 0-based position; a ``directory`` of the same table saves the counting."""
    keys = [order_col] if isinstance(order_col, str) else list(order_col)
    rows = with_bucket(df, directory or rank_directory(df, keys))
    local = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    return rows.withColumn(out_col, F.col("_first") + local.cast("long") - 1).drop("_bucket", "_first")


def row_position(df: DataFrame, order_col: str | list[str], out_col: str = "pos",
                 directory: RankDirectory | None = None) -> DataFrame:
    """Add a 0-based position by ``order_col`` (which must be unique)."""
    return numbered(df, order_col, out_col, directory)


def segmented_running_sum(df: DataFrame, key_col: str, order_col: str, value_col: str, out_col: str,
                          block: int = 1024) -> DataFrame:
    """Running sum of ``value_col`` within each ``key_col`` group in ``order_col``
    order (an integer column), safe for a key that holds a large share of rows.

    The order range is cut into blocks of ``block`` values: a window sums inside
    each (key, block) — at most ``block`` rows per window group — and a carry per
    block comes from a window over the per-block totals (one row per block).
    No window group ever holds a whole hot key."""
    blk = F.floor(F.col(order_col) / F.lit(block)).cast("long")
    d = df.withColumn("_blk", blk)
    wl = Window.partitionBy(key_col, "_blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    local = d.withColumn("_local", F.sum(value_col).over(wl))
    # block totals come from the same (key, block)-partitioned rows: the
    # exchange under the local window is reused and the aggregate needs none
    totals = local.groupBy(key_col, "_blk").agg(F.sum(value_col).alias("_bt"))
    wc = Window.partitionBy(key_col).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(key_col, "_blk", F.coalesce(F.sum("_bt").over(wc), F.lit(0)).alias("_carry"))
    return (local.join(carry, [key_col, "_blk"])
            .withColumn(out_col, F.col("_carry") + F.col("_local"))
            .drop("_blk", "_carry", "_local"))
