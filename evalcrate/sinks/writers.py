"""Sinks (K1-K5): chat JSON lines, prediction tables, metric records, raw
outputs and append-only checkpoints.  All writes are distributed
(``DataFrameWriter``); nothing is collected to the driver."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalcrate.operators.positions import row_position
from evalcrate.operators.prompts import msg
from evalcrate.sources.revisions import commit


def chat_jsonl_column(user: Column, assistant: Column, system: str | Column) -> Column:
    """K1: ``{"messages": [system, user, assistant]}`` as one compact JSON string."""
    s = system if isinstance(system, Column) else F.lit(system)
    return F.to_json(F.struct(F.array(msg("system", s), msg("user", user), msg("assistant", assistant)).alias("messages")),
                     {"ignoreNullFields": "false"})


def export_chat_jsonl(df: DataFrame, line_col: str, path: str, split_col: str | None = "split",
                      mode: str = "overwrite") -> None:
    """K1: write one JSON object per line, one folder per split."""
    w = df.select(F.col(line_col).alias("value"), *([split_col] if split_col else [])).write.mode(mode)
    if split_col:
        w = w.partitionBy(split_col)
    w.text(path)


def write_predictions(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite",
                      order_col: str | list[str] | None = None, index_col: str = "index") -> None:
    """K2: the prediction table; with ``order_col`` it starts with the 0-based position of every row."""
    if order_col is not None:
        df = row_position(df, order_col, index_col).select(index_col, *df.columns)
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        w.format(fmt).save(path)


def metrics_record(metrics: DataFrame, config: Mapping[str, object]) -> DataFrame:
    """K3: metrics row + run config as one JSON record; metric keys win over config keys."""
    cfg = {k: v for k, v in config.items() if k not in metrics.columns}
    rec = F.struct(*[F.lit(v).alias(k) for k, v in cfg.items()], *[F.col(c) for c in metrics.columns])
    return metrics.select(F.to_json(rec, {"ignoreNullFields": "false"}).alias("value"))   # nulls kept, like json.dump


def write_metrics(metrics: DataFrame, config: Mapping[str, object], path: str, mode: str = "overwrite") -> None:
    """K3: write the merged record as JSON text."""
    metrics_record(metrics, config).write.mode(mode).text(path)


def write_outputs(df: DataFrame, path: str, mode: str = "overwrite", committed: bool = False) -> None:
    """K4: raw model outputs (parquet instead of one in-memory array file); ``committed`` writes a revision of the table
    (:mod:`evalcrate.sources.revisions`) that readers see as a whole or not at all."""
    if committed:
        commit(df, path, mode)
    else:
        df.write.mode(mode).parquet(path)


def checkpoint_outputs(batch: DataFrame, path: str, committed: bool = False) -> None:
    """K5: append one scored batch; a rerun skips ids already present (J4).  ``committed``: as for K4."""
    write_outputs(batch, path, "append", committed)
