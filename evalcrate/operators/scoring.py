"""Batch scoring with a user function (U1, U3) and resumable runs.

The user's scorer (a model call, an API client, a rule) is a Python function
``list[str] -> list[str]`` applied per Arrow batch in ``mapInPandas``.  A
failing row records its error instead of aborting the job; a rerun scores
only ids that are not yet in the output (anti-join), so restarts — of the
job or of lost executors — never redo finished work.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from evalcrate.operators.accounting import native_token_count
from evalcrate.session import ship_package


def format_with(df: DataFrame, formatting_func: Callable[[DataFrame], object], out_col: str = "text") -> DataFrame:
    """A formatting function ``DataFrame -> Column`` applied as a projection."""
    return df.withColumn(out_col, formatting_func(df))


_LOADED: dict[str, Callable[[list[str]], list[str]]] = {}


def loaded(key: str, make_fn: Callable[[], Callable[[list[str]], list[str]]]) -> Callable[[list[str]], list[str]]:
    """The scorer that ``make_fn`` builds, built once in this process for each key."""
    if key not in _LOADED:
        _LOADED[key] = make_fn()
    return _LOADED[key]


def packed(tokens: list[int], budget: int, most: int) -> list[list[int]]:
    """First-fit decreasing: positions of ``tokens`` in lists of at most ``budget`` tokens and ``most`` items."""
    left = np.zeros(len(tokens), np.int64)
    lists: list[list[int]] = []
    for i in sorted(range(len(tokens)), key=lambda i: (-tokens[i], i)):
        fits = np.flatnonzero(left[:len(lists)] >= tokens[i])
        if len(fits):
            at = int(fits[0])
        else:
            at = len(lists)
            lists.append([])
            left[at] = budget
        lists[at].append(i)
        left[at] = left[at] - tokens[i] if len(lists[at]) < most else -1  # a full list takes nothing more
    return lists


def score_fn(df: DataFrame, fn: Callable[[list[str]], list[str]] | None, id_col: str, input_col: str,
             output_col: str = "output", batch_size: int = 64,
             make_fn: Callable[[], Callable[[list[str]], list[str]]] | None = None,
             make_key: str | None = None, token_budget: int | None = None, token_count: Column | None = None) -> DataFrame:
    """``(id, output, error)`` for every input row; ``fn`` sees lists of
    at most ``batch_size`` prompts (one model call per list).  A null prompt is
    not scored; its error says so.

    With ``token_budget`` the prompts of an Arrow batch are packed first-fit
    decreasing, so that no call has more tokens together (``token_count``, by
    default the native token rule); a prompt that alone has more is an error.

    ``make_fn`` builds the scorer instead (e.g. loads a model): it runs once
    per Python worker process and is reused by every task that worker runs.
    ``make_key`` names what it builds (a model and its settings); scorers of
    different keys never mix."""
    if make_fn is not None and not make_key:
        raise ValueError("make_fn needs a make_key that names the scorer it builds")
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, {output_col} string, error string"

    def run(batches):
        nonlocal fn
        if make_fn is not None:
            from evalcrate.operators.scoring import loaded  # the worker's module, not a pickled copy of it
            fn = loaded(make_key, make_fn)
        for pdf in batches:
            empty = pdf[input_col].isna().to_numpy()
            large = (pdf["_tokens"].to_numpy() > token_budget) & ~empty if token_budget else empty & False
            if empty.any() or large.any():
                why = [f"{n} tokens, more than the budget of {token_budget}" for n in pdf["_tokens"][large]] if token_budget else []
                yield pd.DataFrame({id_col: [*pdf[id_col][empty], *pdf[id_col][large]], output_col: None,
                                    "error": ["null prompt"] * int(empty.sum()) + why}).astype({output_col: object})
            pdf = pdf[~empty & ~large]
            if token_budget:
                calls = packed(pdf["_tokens"].tolist(), token_budget, batch_size)
            else:
                calls = [range(s, min(s + batch_size, len(pdf))) for s in range(0, len(pdf), batch_size)]
            for call in calls:
                part = pdf.iloc[list(call)]
                texts = part[input_col].tolist()
                try:
                    outs, errs = list(fn(texts)), [None] * len(texts)
                    if len(outs) != len(texts):
                        raise ValueError(f"scorer returned {len(outs)} outputs for {len(texts)} inputs")
                except Exception:  # noqa: BLE001 - fall back to one call per row
                    outs, errs = [], []
                    for t in texts:
                        try:
                            outs.append(fn([t])[0])
                            errs.append(None)
                        except Exception as exc:  # noqa: BLE001
                            outs.append(None)
                            errs.append(f"{type(exc).__name__}: {exc}")
                yield pd.DataFrame({id_col: part[id_col].values, output_col: outs, "error": errs})

    ship_package(df.sparkSession)
    if token_budget:
        count = native_token_count(input_col) if token_count is None else token_count
        return df.select(id_col, input_col, count.alias("_tokens")).mapInPandas(run, schema)
    return df.select(id_col, input_col).mapInPandas(run, schema)


def resume_pending(inputs: DataFrame, done: DataFrame, id_col: str) -> DataFrame:
    """Inputs whose id has no successful output yet (left anti-join)."""
    ok = done.where(F.col("error").isNull()) if "error" in done.columns else done
    return inputs.join(ok.select(id_col), id_col, "left_anti")


def align_predictions(inputs: DataFrame, outputs: DataFrame, id_col: str) -> DataFrame:
    """Inputs, labels and outputs aligned by id (only rows already scored)."""
    return inputs.join(outputs, id_col, "inner")


def _read_done(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def resumable_score(inputs: DataFrame, fn: Callable[[list[str]], list[str]] | None, id_col: str, input_col: str,
                    out_path: str, output_col: str = "output", batch_size: int = 64,
                    make_fn: Callable[[], Callable[[list[str]], list[str]]] | None = None,
                    make_key: str | None = None) -> DataFrame:
    """U3 + J4 + K5: score what is pending, append it to ``out_path`` (shared
    storage), and return the latest successful output per id."""
    spark = inputs.sparkSession
    done = _read_done(spark, out_path)
    pending = inputs if done is None else resume_pending(inputs, done, id_col)
    scored = score_fn(pending, fn, id_col, input_col, output_col, batch_size, make_fn, make_key)
    scored.write.mode("append").parquet(out_path)     # K5: one committed batch per run
    allout = spark.read.parquet(out_path)
    best = allout.groupBy(id_col).agg(
        F.max_by(F.struct(output_col, "error"), F.col("error").isNull()).alias("_b"))
    return best.select(id_col, F.col(f"_b.{output_col}").alias(output_col), F.col("_b.error").alias("error"))
