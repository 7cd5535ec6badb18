"""A training-data pipeline of five stages, each one operator of ``evalcrate.llm``.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)`` and
returns the documents it keeps (the last one: the documents with their shard and
slot).  Every stage's rows are written as Parquet to the shared checkpoint folder
and read again as the next stage's input, so a lost executor repeats at most one
stage's tasks.

Every stage defines its result for null and empty texts, repeated rows, empty
tables and extra columns as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalcrate.llm.decontam import keep_clean
from evalcrate.llm.langid import keep_identified
from evalcrate.llm.mixing import mixed
from evalcrate.llm.ngram_join import keep_one
from evalcrate.llm.shards import histogram_shards
from evalcrate.llm.shared import saved, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is not rejected by language identification."""
    return keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a Jaccard similarity of 0.8."""
    return keep_one(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot, 24 shards near equal in bytes."""
    return histogram_shards(docs, shards=24)


STAGES = [("language id", identify_language), ("n-gram jaccard join", drop_near_copies),
          ("benchmark decontamination", drop_contaminated), ("source mixing", mix), ("sharding", shard)]

# language models and the mix's Newton solution have no SQL form; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
