"""Task-level evaluations: the evaluated scripts' end-to-end flows as one call
each, composed from the operators (clean -> score -> aggregate).

Each returns DataFrames; nothing is collected.  ``group_cols`` evaluates a
whole run matrix in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalcrate.functions import text as T
from evalcrate.operators import classify as C
from evalcrate.operators import overlap as O
from evalcrate.operators import qa as Q
from evalcrate.operators import runs as RU

FACT_LABELS = ("SUPPORTS", "REFUTES", "NOT_ENOUGH_INFO")


def clean_outputs(df: DataFrame, output_col: str, remove_suffix: str | None = None, stop_tokens=None,
                  out_col: str = "output") -> DataFrame:
    """Fact-check cleaning: cut at the suffix (C1), drop stop tokens (C3), strip (C4)."""
    x = T.py_strip(T.drop_stop_tokens(T.cut_at_suffix(output_col, remove_suffix), stop_tokens))
    return df.withColumn(out_col, x)


def evaluate_fact_checking(df: DataFrame, output_col: str, label_col: str, remove_suffix: str | None = None,
                           stop_tokens=None, vals: Sequence[str] | None = FACT_LABELS,
                           group_cols: Sequence[str] = ()) -> DataFrame:
    """Cleaned outputs -> accuracy + weighted precision/recall/F1 (M3)."""
    cleaned = clean_outputs(df, output_col, remove_suffix, stop_tokens, "_out")
    return C.weighted_prf(cleaned, label_col, "_out", vals, group_cols)


def evaluate_entity_matching(df: DataFrame, response_col: str, label_col: str, positive: str = "y",
                             negative: str = "n", remove_suffix: str | None = None, stop_tokens=None,
                             group_cols: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(metrics, predictions): M1 + M2 in one row per group, and the per-row table."""
    scored = C.clean_binary_responses(df, response_col, label_col, positive, negative, remove_suffix, stop_tokens)
    return C.em_metrics(scored, group_cols=group_cols), scored


def evaluate_toxicity(df: DataFrame, response_col: str, label_col: str, groups: Sequence[str] = ("male", "female"),
                      positive_marker: str = "Y", group_cols: Sequence[str] = ()) -> DataFrame:
    """yes/no responses -> accuracy, F1 and worst-group accuracy (M4 + M5)."""
    s = df.select(*group_cols, *groups, T.label_contains(label_col, positive_marker).cast("int").alias("label"),
                  T.yes_flag(response_col).alias("pred"))
    return C.acc_f1_worst_group(s, groups, "pred", "label", group_cols=group_cols)   # one scan, one aggregate


def evaluate_summaries(df: DataFrame, pred_col: str, ref_col: str, rouge: bool = True, bleu: bool = True,
                       f1: bool = True, exact: bool = False, group_cols: Sequence[str] = (),
                       rouge_l: bool = True, vectors: DataFrame | None = None, id_col: str = "id") -> DataFrame:
    """ROUGE-1/2/L/Lsum, corpus BLEU, token F1, exact match in one pass (M18 switches);
    ``vectors`` (token vectors by pair) adds the vector-match scores."""
    return RU.summary_metrics(df, pred_col, ref_col, rouge, bleu, f1, exact, group_cols, lcs=rouge_l and rouge,
                              vectors=vectors, id_col=id_col)


def evaluate_abstention(gold_long: DataFrame, predictions: DataFrame, pred_col: str = "prediction",
                        order_col: str | None = None, group_cols: Sequence[str] = ()) -> DataFrame:
    """Multi-reference F1 by answer type (M10) and answerability (M11), one row a run."""
    scores = Q.reference_scores(gold_long, predictions, pred_col, order_col=order_col, run_cols=group_cols)
    best = Q.best_reference(scores, [*group_cols, "question_id"])
    return (best.groupBy(*group_cols) if group_cols else best).agg(*Q.f1_by_type_aggs(), *Q.answerability_aggs())


def evaluate_abstention_texts(gold_long: DataFrame, predictions: DataFrame, pred_col: str = "prediction",
                              order_col: str | None = None, group_cols: Sequence[str] = (), rouge_l: bool = False,
                              vectors: DataFrame | None = None) -> DataFrame:
    """ROUGE, BLEU and, given ``vectors`` by question, vector match of the cleaned predictions
    against every reference, one row a run."""
    runs = list(group_cols)
    if order_col:
        predictions = Q.dedupe_predictions(predictions, [*runs, "question_id"], order_col)
    pairs = Q.join_gold(gold_long, predictions).select(
        *runs, "question_id", T.extract_answer(pred_col).alias("pred"), F.col("answer").alias("ref"))
    return RU.summary_metrics(pairs, "pred", "ref", f1=False, exact=False, group_cols=runs, lcs=rouge_l,
                              vectors=vectors, id_col="question_id")


def evaluate_qa(df: DataFrame, pred_col: str, gold_col: str, remove_suffix: str | None = None,
                group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact match (M6) and SQuAD F1 (M7) after dropping the suffix."""
    s = df.withColumn("_p", T.drop_suffix(pred_col, remove_suffix))
    scores = O.pair_token_scores(s, "_p", gold_col)
    g = scores.groupBy(*group_cols) if group_cols else scores
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("exact").cast("double")).alias("exact_match"),
                 F.avg("f1").alias("squad_f1_score"))
