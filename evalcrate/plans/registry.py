"""Registry of the runnable queries and their DuckDB oracle SQL.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the given tables (or tables
Spark derives from them).  Metric outputs are reported rounded to 6 places;
the library functions themselves return full precision.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column for reporting."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def load_all() -> None:
    """Import the query modules (each registers itself)."""
    from evalcrate.plans import (q_classify, q_text, q_overlap, q_qa, q_prompts,  # noqa: F401
                                 q_tokens, q_runs, q_aliases, q_tasks, q_storage, q_rules)  # noqa: F401
