"""ROUGE-L and ROUGE-Lsum (M14): longest common subsequence per pair.

LCS has no relational form, so it runs in an Arrow-batched pandas UDF, one
call per batch of pairs; the token arrays are produced JVM-side first.
ROUGE-L uses the bit-parallel LCS length (Allison-Dix / Hyyrö): one pass over
the prediction with word-size big-integer operations over the reference, i.e.
O(n * m / 64) machine operations per pair.  ROUGE-Lsum needs aligned
positions (union LCS over sentences); they are backtracked from the same bit
vectors, so no quadratic table is built.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from evalcrate.functions.util import let
from evalcrate.operators.overlap import rouge_tokens
from evalcrate.session import ship_package

SCORE = StructType([StructField("precision", DoubleType()), StructField("recall", DoubleType()),
                    StructField("fmeasure", DoubleType())])


def lcs_length(a, b) -> int:
    """Bit-parallel LCS length of two token sequences."""
    if len(a) == 0 or len(b) == 0:
        return 0
    if len(a) < len(b):
        a, b = b, a          # bits over the shorter sequence
    masks: dict = {}
    for j, t in enumerate(b):
        masks[t] = masks.get(t, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for t in a:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


def lcs_length_native(a: Column, b: Column) -> Column:
    """LCS length of two token arrays without Python (Hunt-Szymanski): the positions of every token of ``a`` in ``b``,
    last one first, are laid on patience piles; their number is the longest run of rising positions, the LCS.

    For texts of some hundred tokens: the work is tokens of ``a`` times tokens of ``b``."""
    def piles(x):
        hits = F.flatten(F.transform(x["a"], lambda t: F.reverse(F.transform(
            F.filter(x["b"], lambda w: w["t"] == t), lambda w: w["i"]))))
        return F.size(F.aggregate(hits, F.array().cast("array<int>"), lambda tops, i: F.concat(
            F.filter(tops, lambda p: p < i), F.array(i), F.slice(F.filter(tops, lambda p: p >= i), F.lit(2), F.size(tops)))))
    numbered = F.transform(b, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    return let(F.struct(a.alias("a"), numbered.alias("b")), piles)


def rouge_l_native(df: DataFrame, pred_col: str = "pred", ref_col: str = "ref") -> DataFrame:
    """M14 per pair without Python: ``lcs, precision, recall, fmeasure`` added to ``df``."""
    df = df.withColumns({"_p": rouge_tokens(pred_col), "_r": rouge_tokens(ref_col)}).withColumn("lcs", lcs_length_native(F.col("_p"), F.col("_r")))
    zero = F.lit(0.0)
    p, r = (F.coalesce(F.try_divide("lcs", F.size(c)), zero) for c in ("_p", "_r"))
    f = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero)
    return df.withColumns({"precision": p, "recall": r}).withColumn("fmeasure", f).drop("_p", "_r")


def _score(hits: int, n_pred: int, n_ref: int) -> tuple[float, float, float]:
    if n_pred == 0 or n_ref == 0:
        return 0.0, 0.0, 0.0
    p, r = hits / n_pred, hits / n_ref
    f = 2 * p * r / (p + r) if p + r > 0 else 0.0
    return p, r, f


def _lcs_positions(ref, can) -> list[int]:
    """Indices into ``ref`` of one LCS, chosen by the classic backtrack (match,
    else step left in ``can`` when that keeps a longer LCS, else step up).

    The table is never materialised: row ``i`` is the bit vector ``V_i`` of the
    bit-parallel LCS over ``can`` and ``T[i][j] = j - popcount(V_i & (2^j - 1))``,
    so the fill costs O(n * m / 64) and each backtrack step one popcount."""
    n, m = len(ref), len(can)
    if n == 0 or m == 0:
        return []
    masks: dict = {}
    for j, t in enumerate(can):
        masks[t] = masks.get(t, 0) | (1 << j)
    full = (1 << m) - 1
    rows = [full]
    v = full
    for t in ref:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)

    def cell(i, j):
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    i, j, out = n, m, []
    while i > 0 and j > 0:
        if ref[i - 1] == can[j - 1]:
            out.append(i - 1)
            i -= 1
            j -= 1
        elif cell(i, j - 1) > cell(i - 1, j):
            j -= 1
        else:
            i -= 1
    out.reverse()
    return out


def summary_lcs_hits(ref_sents, can_sents) -> tuple[int, int, int]:
    """Union-LCS hits for ROUGE-Lsum, with clipped token counts."""
    m = sum(len(s) for s in ref_sents)
    n = sum(len(s) for s in can_sents)
    if not ref_sents or not can_sents or m == 0 or n == 0:
        return 0, n, m
    cnt_r, cnt_c = Counter(), Counter()
    for s in ref_sents:
        cnt_r.update(s)
    for s in can_sents:
        cnt_c.update(s)
    hits = 0
    for r in ref_sents:
        union = sorted(set().union(*[_lcs_positions(r, c) for c in can_sents]))
        for i in union:
            tok = r[i]
            if cnt_c[tok] > 0 and cnt_r[tok] > 0:
                hits += 1
                cnt_c[tok] -= 1
                cnt_r[tok] -= 1
    return hits, n, m


@F.pandas_udf(SCORE)
def _rouge_l_udf(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    rows = [_score(lcs_length(list(p), list(r)), len(p), len(r)) for p, r in zip(pred, ref)]
    return pd.DataFrame(rows, columns=["precision", "recall", "fmeasure"])


BOTH = StructType([StructField("rougeL", SCORE), StructField("rougeLsum", SCORE)])


@F.pandas_udf(BOTH)
def _rouge_l_both_udf(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """ROUGE-L and ROUGE-Lsum from the per-line tokens in one Arrow round trip
    (the whole-text tokens are the lines' tokens concatenated: a token never
    spans a newline)."""
    l_rows, s_rows = [], []
    for p, r in zip(pred, ref):
        ps = [list(x) for x in p if len(x)]
        rs = [list(x) for x in r if len(x)]
        fp = [t for x in ps for t in x]
        fr = [t for x in rs for t in x]
        l_rows.append(dict(zip(("precision", "recall", "fmeasure"), _score(lcs_length(fp, fr), len(fp), len(fr)))))
        hits, n, m = summary_lcs_hits(rs, ps)
        s_rows.append(dict(zip(("precision", "recall", "fmeasure"), _score(hits, n, m))))
    return pd.DataFrame({"rougeL": l_rows, "rougeLsum": s_rows})


def sentence_tokens(c) -> Column:
    """Lines of the text (``split('\\n')``, empty lines dropped), each as ROUGE tokens."""
    lines = F.filter(F.split(F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit("")), "\n"),
                     lambda s: F.length(s) > 0)
    return F.transform(lines, rouge_tokens)


def rouge_l_scores(df: DataFrame, pred_col: str = "pred", ref_col: str = "ref", lsum: bool = False) -> DataFrame:
    """Per pair ROUGE-L (and optionally ROUGE-Lsum) precision/recall/F1."""
    ship_package(df.sparkSession)
    if not lsum:
        return df.withColumn("rougeL", _rouge_l_udf(rouge_tokens(pred_col), rouge_tokens(ref_col)))
    both = _rouge_l_both_udf(sentence_tokens(pred_col), sentence_tokens(ref_col))
    return (df.withColumn("_rl", both)
            .withColumn("rougeL", F.col("_rl.rougeL")).withColumn("rougeLsum", F.col("_rl.rougeLsum")).drop("_rl"))


def rouge_l(df: DataFrame, pred_col: str = "pred", ref_col: str = "ref", lsum: bool = False,
            group_cols=()) -> DataFrame:
    """Mean ROUGE-L F1 (and ROUGE-Lsum F1) over pairs."""
    s = rouge_l_scores(df, pred_col, ref_col, lsum)
    s = s.groupBy(*group_cols) if group_cols else s
    aggs = [F.count(F.lit(1)).alias("n"), F.avg("rougeL.fmeasure").alias("rougeL")]
    if lsum:
        aggs.append(F.avg("rougeLsum.fmeasure").alias("rougeLsum"))
    return s.agg(*aggs)
