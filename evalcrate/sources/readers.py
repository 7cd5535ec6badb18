"""Scans, splits and slices.

Positional operators never rely on file order: they take an explicit
``order_col`` (a unique key) and derive positions from it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalcrate.operators.positions import numbered
from evalcrate.operators.ranks import before, equals, keys_at, up_to


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the data directory."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scan_split(spark: SparkSession, path: str, split: str | None = None, split_col: str = "split",
               columns: Iterable[str] | None = None, fmt: str = "parquet",
               options: Mapping[str, str] | None = None) -> DataFrame:
    """Read a table and keep one named split.

    The split is a filter on ``split_col``; when the data is written
    ``partitionBy(split_col)`` Catalyst turns it into partition pruning,
    otherwise it is pushed into the parquet scan as a row-group filter.
    ``options`` pass through to the reader — e.g. a table format's
    time-travel option to read the split at a given revision.
    """
    df = spark.read.format(fmt).options(**(options or {})).load(path)
    if split is not None:
        df = df.where(F.col(split_col) == split)
    if columns is not None:
        df = df.select(*columns)
    return df


def scan_json_splits(spark: SparkSession, files: Mapping[str, str | list[str]], schema: StructType | str,
                     split_col: str = "split") -> DataFrame:
    """JSON(-lines) files per split into one DataFrame with a ``split`` column."""
    out = None
    for split, paths in files.items():
        df = spark.read.schema(schema).json(paths).withColumn(split_col, F.lit(split))
        out = df if out is None else out.unionByName(df)
    return out


_SLICE = re.compile(r"^(?P<name>\w+)(\[(?P<a>-?\d*)(?P<colon>:?)(?P<b>-?\d*)\])?$")


def parse_slice(spec: str) -> tuple[str, int | None, int | None]:
    """``'train[:1000]'`` -> ('train', None, 1000); ``'test[5]'`` -> ('test', 5, 6)."""
    m = _SLICE.match(spec.replace(" ", ""))
    if not m:
        raise ValueError(f"bad split spec {spec!r}")
    a = int(m["a"]) if m["a"] else None
    b = int(m["b"]) if m["b"] else None
    if m["a"] is not None and not m["colon"] and a is not None:
        b = a + 1
    return m["name"], a, b


def _keys(order_col: str | list[str]) -> list[str]:
    return [order_col] if isinstance(order_col, str) else list(order_col)


def split_slice(df: DataFrame, order_col: str | list[str], start: int | None = None,
                stop: int | None = None) -> DataFrame:
    """Rows ``[start:stop)`` of ``df`` ordered by the unique key ``order_col``.

    Negative bounds count from the end like Python.  The exact keys at the two
    ends are found by counting (:func:`evalcrate.operators.ranks.keys_at`), and the
    slice is a filter on the key: no sort, no shuffle of rows.  Where equal keys
    meet an end, positions decide among them."""
    keys = _keys(order_col)
    low, high = start or 0, stop
    if low < 0 or (high is not None and high < 0):
        total = df.count()
        low = max(total + low, 0) if low < 0 else low
        high = total + high if high is not None and high < 0 else high
    if high is not None and high <= low:
        return df.where(F.lit(False))
    ends = [low] if low else []
    if high is not None:
        ends.append(high - 1)
    found = keys_at(df, keys, ends)
    if found is None:
        inside = F.col("_pos") >= low if high is None else F.col("_pos").between(low, high - 1)
        return numbered(df, keys, "_pos").where(inside).drop("_pos")
    if low and found[0] is None:
        return df.where(F.lit(False))
    out = df.where(~before(df, keys, found[0])) if low else df
    return out.where(up_to(df, keys, found[-1])) if high is not None and found[-1] is not None else out


def get_dataset_slices(splits: Mapping[str, DataFrame], order_col: str, specs: Mapping[str, str]) -> dict:
    """S4 (dict form): ``{'train': 'train[:1000]', ...}`` -> dict of sliced DataFrames."""
    out = {}
    for key, spec in specs.items():
        name, a, b = parse_slice(spec)
        out[key] = split_slice(splits[name], order_col, a, b)
    return out


def head_limit(df: DataFrame, order_col: str, max_samples: int | None) -> DataFrame:
    """First ``max_samples`` rows by ``order_col``; None/0 = all (clamped)."""
    if not max_samples:
        return df
    return split_slice(df, order_col, 0, int(max_samples))


def pick_positions(df: DataFrame, order_col: str, positions: Iterable[int], pos_col: str = "pos",
                   rank_col: str = "k") -> DataFrame:
    """Rows at fixed 0-based positions, tagged with their rank ``k`` (1-based, in the
    order given).  Only those few rows survive, so the result is safe to broadcast."""
    positions, keys = list(positions), _keys(order_col)
    rank = F.array_position(F.array(*[F.lit(p) for p in positions]), F.col(pos_col)).cast("int")
    found = keys_at(df, keys, positions)
    if found is None:
        return numbered(df, keys, pos_col).where(F.col(pos_col).isin(positions)).withColumn(rank_col, rank)
    at = F.lit(None).cast("long")
    for p, values in zip(positions, found):
        if values is not None:
            at = F.when(equals(df, keys, values), F.lit(p).cast("long")).otherwise(at)
    return df.withColumn(pos_col, at).where(F.col(pos_col).isNotNull()).withColumn(rank_col, rank)


def sample_n(df: DataFrame, key_col: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows uniformly without replacement, reproducible for a seed.

    Each row gets a hash-derived priority ``md5('<key>:<seed>')`` (a portable
    hash, so any engine can reproduce the sample); the ``n`` smallest win."""
    prio = df.withColumn("_prio", F.md5(F.concat(F.col(key_col).cast("string"), F.lit(f":{seed}"))))
    return split_slice(prio, ["_prio", key_col], 0, n).drop("_prio")


def project(df: DataFrame, *cols: str) -> DataFrame:
    """Column choice (pruned down to the parquet scan)."""
    return df.select(*cols)
