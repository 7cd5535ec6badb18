"""Run-level reporting: run matrix (M22), durations (M23), metric switches (M18),
bootstrap interval (M15)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalcrate.functions import text as T
from evalcrate.functions.util import let
from evalcrate.functions.bags import bag_overlap, f1_from_overlap, ngrams
from evalcrate.operators.greedy import greedy_match_pairs
from evalcrate.operators.overlap import TOKENIZERS, rouge_tokens
from evalcrate.session import ship_package


def run_matrix(df: DataFrame, run_cols: Sequence[str], pred_col: str = "pred", gold_col: str = "gold") -> DataFrame:
    """Binary accuracy / F1 for every run, plus per-prefix subtotals and the
    overall line (``ROLLUP``).  ``level`` is ``grouping_id`` (0 = a full run key).

    One expand + hash aggregate: rows are replicated once per rollup level
    map-side and partially aggregated before the shuffle, so the shuffle
    carries only (levels x run keys) counters."""
    p, g = F.col(pred_col), F.col(gold_col)
    agg = df.rollup(*run_cols).agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"),
        F.count_if(p == g).alias("n_equal"), F.count_if((p == 1) & (g == 1)).alias("tp"),
        F.count_if((p == 1) & (g != 1)).alias("fp"), F.count_if((p != 1) & (g == 1)).alias("fn"))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return agg.select(*run_cols, "level", "n",
                      (F.col("n_equal") / F.col("n")).alias("accuracy"),
                      F.when(den > 0, 2.0 * F.col("tp") / den).otherwise(F.lit(0.0)).alias("f1"))


def run_duration(df: DataFrame, run_cols: Sequence[str], ts_col: str = "ts") -> DataFrame:
    """Wall time per run, ``max(ts) - min(ts)`` in seconds."""
    ts = F.col(ts_col)   # TIMESTAMP or TIMESTAMP_NTZ: the difference needs no time zone
    return df.groupBy(*run_cols).agg(
        (F.timestamp_diff("MICROSECOND", F.min(ts), F.max(ts)) / 1e6).alias("duration_sec"))


def summary_metrics(df: DataFrame, pred_col: str = "pred", ref_col: str = "ref", rouge: bool = True,
                    bleu: bool = True, f1: bool = True, exact: bool = True, group_cols: Sequence[str] = (),
                    lcs: bool = False, vectors: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """The requested metrics in one scan and one aggregate; switched-off
    metrics are NULL columns (so the schema is stable).  ``lcs=True`` adds
    ROUGE-L and ROUGE-Lsum means (one pandas-UDF column in the same pass).
    ``vectors(pair_id, vec_id, side, embedding)`` adds the mean vector-match
    precision, recall and F1 (M17) of the pairs whose ``id_col`` has vectors."""
    per, aggs = [], [F.count(F.lit(1)).alias("n")]
    base = df
    if vectors is not None:
        match = greedy_match_pairs(vectors).select(F.col("pair_id").alias("_pair"), *[
            F.col(c).alias(f"_match_{c}") for c in ("precision", "recall", "f1")])
        base = base.join(match, F.col(id_col) == F.col("_pair"), "left")
        per += [f"_match_{c}" for c in ("precision", "recall", "f1")]
        aggs += [F.avg(f"_match_{c}").alias(f"match_{c}") for c in ("precision", "recall", "f1")]
    if rouge:
        base = base.withColumn("_rp", rouge_tokens(pred_col)).withColumn("_rr", rouge_tokens(ref_col))
        for n in (1, 2):
            pg, rg = ngrams("_rp", n), ngrams("_rr", n)
            per.append(f1_from_overlap(bag_overlap(pg, rg), F.size(pg), F.size(rg)).alias(f"_rouge{n}"))
    if bleu:
        tok = TOKENIZERS["13a"]
        base = base.withColumn("_bp", tok(pred_col)).withColumn("_br", tok(ref_col))
        per += [F.size("_bp").alias("_tl"), F.size("_br").alias("_rl")]
        for n in range(1, 5):
            per += [bag_overlap(ngrams("_bp", n), ngrams("_br", n)).alias(f"_m{n}"),
                    F.greatest(F.size("_bp") - n + 1, F.lit(0)).alias(f"_c{n}")]
    if f1 or exact:
        base = base.withColumn("_sp", T.answer_tokens(pred_col)).withColumn("_sr", T.answer_tokens(ref_col))
        if f1:
            ov = bag_overlap("_sp", "_sr")
            per.append(f1_from_overlap(ov, F.size("_sp"), F.size("_sr")).alias("_f1"))
        if exact:
            per.append((F.array_join("_sp", " ") == F.array_join("_sr", " ")).cast("double").alias("_em"))
    if lcs:
        from evalcrate.operators.lcs import _rouge_l_both_udf, sentence_tokens
        from evalcrate.session import ship_package
        ship_package(df.sparkSession)
        rl = _rouge_l_both_udf(sentence_tokens(pred_col), sentence_tokens(ref_col))
        per += [rl["rougeL"]["fmeasure"].alias("_rougeL"), rl["rougeLsum"]["fmeasure"].alias("_rougeLsum")]
    s = base.select(*group_cols, *per)
    if lcs:
        aggs += [F.avg("_rougeL").alias("rougeL"), F.avg("_rougeLsum").alias("rougeLsum")]
    if rouge:
        aggs += [F.avg("_rouge1").alias("rouge1"), F.avg("_rouge2").alias("rouge2")]
    if bleu:
        aggs += [F.sum("_tl").alias("_TL"), F.sum("_rl").alias("_RL")]
        aggs += [F.sum(f"_m{n}").alias(f"_M{n}") for n in range(1, 5)]
        aggs += [F.sum(f"_c{n}").alias(f"_C{n}") for n in range(1, 5)]
    if f1:
        aggs.append(F.avg("_f1").alias("token_f1"))
    if exact:
        aggs.append(F.avg("_em").alias("exact_match"))
    g = s.groupBy(*group_cols) if group_cols else s
    out = g.agg(*aggs)
    null = F.lit(None).cast("double")
    if bleu:
        precs = [F.when(F.col(f"_C{n}") > 0, F.col(f"_M{n}") / F.col(f"_C{n}")).otherwise(F.lit(0.0)) for n in range(1, 5)]
        geo = F.when(F.least(*precs) > 0, F.exp(sum(F.log(p) for p in precs) / 4)).otherwise(F.lit(0.0))
        ratio = F.try_divide(F.col("_TL").cast("double"), F.col("_RL").cast("double"))
        bp = F.when(ratio > 1.0, F.lit(1.0)).otherwise(F.exp(1 - F.try_divide(F.lit(1.0), ratio)))
        bleu_col = geo * bp
    else:
        bleu_col = null
    return out.select(*group_cols, "n",
                      F.col("rouge1") if rouge else null.alias("rouge1"),
                      F.col("rouge2") if rouge else null.alias("rouge2"),
                      bleu_col.alias("bleu"),
                      F.col("token_f1") if f1 else null.alias("token_f1"),
                      F.col("exact_match") if exact else null.alias("exact_match"),
                      *(["rougeL", "rougeLsum"] if lcs else []),
                      *([f"match_{c}" for c in ("precision", "recall", "f1")] if vectors is not None else []))


# 52 hash bits make a uniform number; below this a further Poisson weight cannot be drawn
RESOLUTION = 2.0 ** -52


def poisson_cdf() -> list[float]:
    """P(weight <= k) of Poisson(1) for k = 0, 1, ... until the next term is below the uniform's resolution."""
    out, total, term = [], 0.0, math.exp(-1.0)
    while term >= RESOLUTION:
        total += term
        out.append(total)
        term /= len(out)
    return out


def poisson_weight(key: Column, replicate: Column, seed: int = 0) -> Column:
    """Poisson(1) bootstrap weight from ``md5('<key>:<replicate>:<seed>')``: inverse CDF on a uniform
    drawn from 52 hash bits (the Poisson bootstrap for data too large to resample; a portable hash, so
    any engine can reproduce the interval)."""
    h = F.md5(F.concat_ws(":", key.cast("string"), replicate.cast("string"), F.lit(str(seed))))
    u = F.conv(F.substring(h, 1, 13), 16, 10).cast("double") * RESOLUTION
    cdf = F.array(*[F.lit(c) for c in poisson_cdf()])
    return let(u, lambda x: F.size(F.filter(cdf, lambda c: x >= c)))


def _mixed_bits(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (splitmix64's finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _weighted_sums(names: list[str], subsets: int, replicates: int):
    """Task function: per (subset, replicate) the sums of the counters under Poisson(``subsets``) weights drawn from row hashes."""
    cdf, term = [], math.exp(-subsets)
    while len(cdf) < subsets or term >= RESOLUTION:
        cdf.append((cdf[-1] if cdf else 0.0) + term)
        term *= subsets / len(cdf)
    cdf = np.array(cdf)
    steps = np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def task(frames):
        sums = np.zeros((subsets, replicates, len(names) + 1))
        for pdf in frames:
            h = pdf["_h"].to_numpy(np.int64).view(np.uint64)
            own = (h % np.uint64(subsets)).astype(np.int64)
            values = np.column_stack([np.ones(len(pdf)), *[pdf[c].to_numpy(np.float64) for c in names]])
            for s in range(0, len(pdf), 2048):
                u = (_mixed_bits(h[s:s + 2048, None] + steps[None, :]) >> np.uint64(11)) * 2.0 ** -53
                w = np.searchsorted(cdf, u, side="right").astype(np.float64)
                for k in np.unique(own[s:s + 2048]):
                    at = np.flatnonzero(own[s:s + 2048] == k)
                    sums[k] += w[at].T @ values[s:s + 2048][at]
        k, r = np.divmod(np.arange(subsets * replicates), replicates)
        yield pd.DataFrame({"subset": k, "replicate": r, **{c: sums[:, :, i].ravel() for i, c in enumerate(["weight", *names])}})
    return task


def bootstrap_interval(rows: DataFrame, key_col: str, counters: Sequence[str], estimate: Column, subsets: int | None = None,
                       replicates: int = 100, seed: int = 0, quantiles: Sequence[float] = (0.025, 0.5, 0.975)) -> DataFrame:
    """M15 as a bag of little bootstraps, for any metric that is a function of sums.

    ``estimate`` is a column over the sums of ``counters`` and over ``weight``, the number of rows.  The rows are
    dealt to disjoint subsets (by default about a third of n^0.3, at most 20); in every replicate a row weighs Poisson(subsets), so that a
    subset stands for the whole table; the quantiles of the subsets are averaged.  Weights come from row hashes
    inside the tasks: no row is copied, and a task hands on one row per subset and replicate."""
    if subsets is None:
        subsets = max(1, min(20, int(rows.count() ** 0.3 / 3)))
    ship_package(rows.sparkSession)
    names = list(counters)
    slim = rows.select(F.xxhash64(F.col(key_col), F.lit(seed)).alias("_h"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    shape = "subset int, replicate int, weight double, " + ", ".join(f"`{c}` double" for c in names)
    sums = slim.mapInPandas(_weighted_sums(names, subsets, replicates), shape).groupBy("subset", "replicate").agg(
        *[F.sum(c).alias(c) for c in ["weight", *names]])
    per = sums.select("subset", estimate.alias("_v")).groupBy("subset").agg(
        F.percentile("_v", F.array(*[F.lit(q) for q in quantiles])).alias("q"))
    labels = ["low", "mid", "high"] if len(quantiles) == 3 else [f"q{i}" for i in range(len(quantiles))]
    return per.agg(F.count(F.lit(1)).alias("subsets"), *[F.avg(F.col("q")[i]).alias(x) for i, x in enumerate(labels)])


def bootstrap_mean(scores: DataFrame, key_col: str, value_col: str, replicates: int = 1000, seed: int = 0,
                   quantiles: Sequence[float] = (0.025, 0.5, 0.975)) -> DataFrame:
    """Bootstrap interval of the mean of ``value_col``.

    Each row is expanded into ``replicates`` weighted copies inside its task
    and partially aggregated per replicate before the shuffle, so the shuffle
    carries ``replicates`` rows per partition, whatever the table size."""
    b = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b")
    e = scores.select(F.col(key_col).alias("_k"), F.col(value_col).cast("double").alias("_v"), b)
    e = e.withColumn("_w", poisson_weight(F.col("_k"), F.col("b"), seed))
    per = e.groupBy("b").agg(F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum("_w").cast("double")).alias("m"))
    qs = F.percentile(F.col("m"), F.array(*[F.lit(q) for q in quantiles]))
    out = per.agg(qs.alias("q"), F.count(F.lit(1)).alias("replicates"))
    names = ["low", "mid", "high"] if len(quantiles) == 3 else [f"q{i}" for i in range(len(quantiles))]
    return out.select("replicates", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
