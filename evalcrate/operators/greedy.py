"""Greedy matching score over token vectors (M17, BERTScore-style P/R/F1).

Input: ``(pair_id, vec_id, side, embedding)`` with side ``pred`` / ``ref``.
Precision = mean over prediction vectors of their best cosine against the
reference vectors of the same pair; recall symmetrically; F1 per pair, then
means over pairs.

Plan: a pair is a bounded unit, the tokens of one text and of one other text.
Each side of a pair is collected into ``blocks`` arrays (one by default; give
more where texts run to many thousand tokens), and prediction blocks are joined
to reference blocks of the same pair — rows = pred blocks x ref blocks, never
vectors x vectors.  One Arrow-batched pandas UDF turns each block pair into one
cosine matrix (numpy); its row-wise and column-wise maxima leave as one tagged
array, so each side is read once, the UDF runs once, and precision and recall
come from one aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from evalcrate.session import ship_package

_BEST = StructType([StructField("pred_best", ArrayType(DoubleType())), StructField("ref_best", ArrayType(DoubleType()))])


def _unit_rows(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms > 0, m / norms, 0.0)


@F.pandas_udf(_BEST)
def _block_best(pred_vecs: pd.Series, ref_vecs: pd.Series) -> pd.DataFrame:
    pb, rb = [], []
    for p, r in zip(pred_vecs, ref_vecs):
        cos = _unit_rows(p) @ _unit_rows(r).T
        pb.append(cos.max(axis=1).tolist())
        rb.append(cos.max(axis=0).tolist())
    return pd.DataFrame({"pred_best": pb, "ref_best": rb})


def _blocks(vectors: DataFrame, keys: list[str], side: str, blocks: int) -> DataFrame:
    e = F.sort_array(F.collect_list(F.struct("vec_id", "embedding")))
    return (vectors.where(F.col("side") == side)
            .groupBy(*keys, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("_blk")).agg(e.alias("_e"))
            .select(*keys, F.col("_e.vec_id").alias(f"{side}_ids"), F.col("_e.embedding").alias(f"{side}_vecs")))


def greedy_match_pairs(vectors: DataFrame, blocks: int = 1, group_cols: Sequence[str] = ()) -> DataFrame:
    """Per pair: precision (pred side), recall (ref side), F1."""
    ship_package(vectors.sparkSession)
    keys = [*group_cols, "pair_id"]
    j = _blocks(vectors, keys, "pred", blocks).join(_blocks(vectors, keys, "ref", blocks), keys)
    best = j.select(*keys, "pred_ids", "ref_ids", _block_best("pred_vecs", "ref_vecs").alias("b"))

    def tagged(ids: str, scores: str, side: str):
        return F.transform(F.arrays_zip(F.col(ids).alias("v"), F.col(scores).alias("s")),
                           lambda x: F.struct(F.lit(side).alias("side"), x["v"].alias("v"), x["s"].alias("s")))
    per_vec = (best.select(*keys, F.explode(F.concat(tagged("pred_ids", "b.pred_best", "pred"),
                                                     tagged("ref_ids", "b.ref_best", "ref"))).alias("x"))
               .groupBy(*keys, F.col("x.side").alias("side"), F.col("x.v").alias("v")).agg(F.max("x.s").alias("m")))
    s = per_vec.groupBy(*keys).agg(F.avg(F.when(F.col("side") == "pred", F.col("m"))).alias("precision"),
                                   F.avg(F.when(F.col("side") == "ref", F.col("m"))).alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") != 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return s.select(*keys, "precision", "recall", f1.alias("f1"))


def greedy_match_score(vectors: DataFrame, blocks: int = 1, group_cols: Sequence[str] = ()) -> DataFrame:
    """Means of per-pair precision, recall and F1."""
    s = greedy_match_pairs(vectors, blocks, group_cols)
    g = s.groupBy(*group_cols) if group_cols else s
    return g.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("precision").alias("precision"),
                 F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
