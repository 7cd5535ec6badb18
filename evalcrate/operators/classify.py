"""Classification metrics (M1-M5, M24) as single-pass aggregates.

Every metric is an ``agg`` of ``count_if``/``sum`` expressions: Spark runs a
map-side partial aggregate per partition and merges a handful of counters,
so the cost is one scan and a one-row exchange no matter the table size.
Zero denominators give NULL (``try_divide``), never an exception.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalcrate.functions import text as T

# Formatting classes of the entity-matching evaluator, with the
# metric-name prefix used for each.
FORMAT_CLASSES = (("UNRESOLVABLE", "unresolvable"), ("RESOLVABLE", "resolvable"), ("CORRECT", "correct_fmt"))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_binary_responses(df: DataFrame, response_col: str, truth_col: str, positive: str = "y",
                           negative: str = "n", remove_suffix: str | None = None,
                           stop_tokens=None) -> DataFrame:
    """Entity-matching cleaning chain: C1 -> C3 -> C8 -> C7 (pred and gold) -> C8.

    Adds ``cleaned``, ``pred`` (1/0/-1), ``truth`` (1/0/-1) and ``formatting``.
    One projection; whole-stage codegen fuses it with the scan.
    """
    cleaned = T.drop_stop_tokens(T.cut_at_suffix(_c(response_col), remove_suffix), stop_tokens)
    out = df.withColumn("cleaned", cleaned)
    out = out.withColumn("pred", T.resolve_binary("cleaned", positive, negative))
    out = out.withColumn("truth", T.resolve_binary(_c(truth_col), positive, negative))
    return out.withColumn("formatting", T.format_class("cleaned", "pred", positive, negative))


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    precision = F.try_divide(tp.cast("double"), (tp + fp).cast("double"))
    recall = F.try_divide(tp.cast("double"), (tp + fn).cast("double"))
    f1 = F.try_divide(2 * precision * recall, precision + recall)  # M24
    return precision, recall, f1


def em_confusion(df: DataFrame, pred_col: str = "pred", truth_col: str = "truth",
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """M1: N, TP/FP/FN/TN, unresolved, accuracy, precision, recall, F1.

    Unresolved predictions (-1) count against accuracy but fall in no cell.
    """
    p, t = _c(pred_col), _c(truth_col)
    g = df.groupBy(*group_cols) if group_cols else df
    agg = g.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(p == t).alias("n_equal"),
        F.count_if((p == 1) & (t == 1)).alias("tp"),
        F.count_if((p == 1) & (t == 0)).alias("fp"),
        F.count_if((p == 0) & (t == 1)).alias("fn"),
        F.count_if((p == 0) & (t == 0)).alias("tn"),
        F.count_if(p == -1).alias("unresolved"),
    )
    precision, recall, f1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return agg.select(*group_cols, "n", "tp", "fp", "fn", "tn", "unresolved",
                      F.try_divide(F.col("n_equal").cast("double"), F.col("n").cast("double")).alias("accuracy"),
                      precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def em_metrics(df: DataFrame, pred_col: str = "pred", truth_col: str = "truth", format_col: str = "formatting",
               group_cols: Sequence[str] = ()) -> DataFrame:
    """M1 + M2 in a single aggregate (one scan, one row per group)."""
    p, t, f = _c(pred_col), _c(truth_col), _c(format_col)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(p == t).alias("n_equal"),
            F.count_if((p == 1) & (t == 1)).alias("tp"), F.count_if((p == 1) & (t == 0)).alias("fp"),
            F.count_if((p == 0) & (t == 1)).alias("fn"), F.count_if((p == 0) & (t == 0)).alias("tn"),
            F.count_if(p == -1).alias("unresolved")]
    for cls, name in FORMAT_CLASSES:
        aggs += [F.count_if(f == cls).alias(f"{name}_total"),
                 F.count_if((f == cls) & (t == 1)).alias(f"{name}_positives"),
                 F.count_if((f == cls) & (t == 0)).alias(f"{name}_negatives")]
    g = df.groupBy(*group_cols) if group_cols else df
    agg = g.agg(*aggs)
    precision, recall, f1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    n = F.col("n").cast("double")
    cols = [*group_cols, "n", "tp", "fp", "fn", "tn", "unresolved",
            F.try_divide(F.col("n_equal").cast("double"), n).alias("accuracy"),
            precision.alias("precision"), recall.alias("recall"), f1.alias("f1")]
    for _, name in FORMAT_CLASSES:
        cols += [f"{name}_total", f"{name}_positives", f"{name}_negatives",
                 F.try_divide(F.col(f"{name}_total").cast("double"), n).alias(f"{name}_rate")]
    return agg.select(*cols)


def em_format_rates(df: DataFrame, format_col: str = "formatting", truth_col: str = "truth",
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """M2: per formatting class its total, gold positives, gold negatives and rate.

    The class list is a fixed dimension: absent classes report 0.
    """
    f, t = _c(format_col), _c(truth_col)
    aggs = [F.count(F.lit(1)).alias("n")]
    for cls, name in FORMAT_CLASSES:
        aggs += [F.count_if(f == cls).alias(f"{name}_total"),
                 F.count_if((f == cls) & (t == 1)).alias(f"{name}_positives"),
                 F.count_if((f == cls) & (t == 0)).alias(f"{name}_negatives")]
    g = df.groupBy(*group_cols) if group_cols else df
    agg = g.agg(*aggs)
    cols = [*group_cols, "n"]
    for _, name in FORMAT_CLASSES:
        cols += [f"{name}_total", f"{name}_positives", f"{name}_negatives",
                 F.try_divide(F.col(f"{name}_total").cast("double"), F.col("n").cast("double"))
                 .alias(f"{name}_rate")]
    return agg.select(*cols)


def label_cells(df: DataFrame, gold_col: str, pred_col: str, vals: Iterable[str] | None,
                group_cols: Sequence[str] = ()) -> DataFrame:
    """Counts per (gold class, predicted class), C14 on both.  With ``vals`` empty/None the class set is the
    distinct predictions (O2); gold labels outside it fall into one OOV class.

    The rows are reduced to (gold, pred) cells first, so the known labels are
    looked up for distinct cells only and no raw row is shuffled by its label."""
    gc = list(group_cols)
    cell = [F.col(c).alias(c) for c in gc]
    if vals:
        g, p = (T.encode_label(c, vals).cast("string") for c in (gold_col, pred_col))
        return df.groupBy(*cell, g.alias("gold_class"), p.alias("pred_class")).agg(F.count(F.lit(1)).alias("cnt"))
    cells = df.groupBy(*cell, F.col(gold_col).alias("gold_class"), F.col(pred_col).alias("pred_class")).agg(
        F.count(F.lit(1)).alias("cnt"))
    # one row per label: the gold counts of a label beside the mark that some row predicts it
    sides = cells.select(*gc, "gold_class", "pred_class", "cnt", F.explode(F.array(F.lit(0), F.lit(1))).alias("as_pred"))
    marked = sides.withColumn("label", F.when(F.col("as_pred") == 1, F.col("pred_class")).otherwise(F.col("gold_class")))
    known = F.max("as_pred").over(Window.partitionBy("label"))
    return (marked.withColumn("known", known).where("as_pred = 0")
            .withColumn("gold_class", F.when(F.col("known") == 1, F.col("gold_class")).otherwise(F.lit("\u0000OOV")))
            .groupBy(*gc, "gold_class", "pred_class").agg(F.sum("cnt").alias("cnt")))


def distinct_labels(df: DataFrame, col: str) -> DataFrame:
    """O2: ``set(predictions)``."""
    return df.select(col).distinct()


def weighted_prf(df: DataFrame, gold_col: str = "gold", pred_col: str = "pred",
                 vals: Iterable[str] | None = ("SUPPORTS", "REFUTES", "NOT_ENOUGH_INFO"),
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """M3: accuracy and support-weighted precision/recall/F1 (sklearn 'weighted').

    Classes are the union of gold and predicted classes; an undefined per-class
    score is 0; weights are gold supports.  Plan: one partial/final aggregate to
    the (gold, pred) confusion cells — at most classes² rows per group — and
    tiny aggregates after that.
    """
    gc = list(group_cols)
    cells = label_cells(df, gold_col, pred_col, vals, gc)
    # each cell contributes support to its gold class and a prediction to its predicted class
    per_class = (cells.select(*gc, F.explode(F.array(
        F.struct(F.col("gold_class").alias("cls"), F.col("cnt").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("gold_class") == F.col("pred_class"), F.col("cnt")).otherwise(F.lit(0)).cast("long").alias("tp")),
        F.struct(F.col("pred_class").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("cnt").alias("predicted"),
                 F.lit(0).cast("long").alias("tp")))).alias("x"))
        .groupBy(*gc, "x.cls").agg(F.sum("x.support").alias("support"), F.sum("x.predicted").alias("predicted"),
                                   F.sum("x.tp").alias("tp")))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    scored = per_class.select(*gc, "support", "tp", prec.alias("p"), rec.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(F.lit(0.0))
    g = scored.groupBy(*gc) if gc else scored
    tot = F.sum("support").cast("double")
    return g.agg(
        F.sum("support").alias("n"),
        F.try_divide(F.sum("tp").cast("double"), tot).alias("accuracy"),
        F.try_divide(F.sum(F.col("support") * F.col("p")), tot).alias("precision"),
        F.try_divide(F.sum(F.col("support") * F.col("r")), tot).alias("recall"),
        F.try_divide(F.sum(F.col("support") * f1), tot).alias("f1"),
    )


def binary_acc_f1(df: DataFrame, pred_col: str = "pred", label_col: str = "label",
                  group_cols: Sequence[str] = ()) -> DataFrame:
    """M4: accuracy and binary F1 (positive class 1); F1 = 0 when no positives at all."""
    p, t = _c(pred_col), _c(label_col)
    g = df.groupBy(*group_cols) if group_cols else df
    agg = g.agg(F.count(F.lit(1)).alias("n"), F.count_if(p == t).alias("n_equal"),
                F.count_if((p == 1) & (t == 1)).alias("tp"), F.count_if((p == 1) & (t != 1)).alias("fp"),
                F.count_if((p != 1) & (t == 1)).alias("fn"))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return agg.select(*group_cols, "n",
                      F.try_divide(F.col("n_equal").cast("double"), F.col("n").cast("double")).alias("accuracy"),
                      F.when(den > 0, 2.0 * F.col("tp") / den).otherwise(F.lit(0.0)).alias("f1"))


def acc_f1_worst_group(df: DataFrame, groups: Sequence[str], pred_col: str = "pred", label_col: str = "label",
                       threshold: float = 0.5, group_cols: Sequence[str] = ()) -> DataFrame:
    """M4 + M5 in one scan: accuracy, binary F1 and worst-group accuracy from a
    single aggregate with one pair of counters per (group, label) cell (the
    group list is a fixed parameter, so the counters are too)."""
    p, t = _c(pred_col), _c(label_col)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(p == t).alias("n_equal"),
            F.count_if((p == 1) & (t == 1)).alias("tp"), F.count_if((p == 1) & (t != 1)).alias("fp"),
            F.count_if((p != 1) & (t == 1)).alias("fn")]
    cells = []
    for gi, g in enumerate(groups):
        for lab in (0, 1):
            member = (F.col(g) >= threshold) & (t == lab)
            aggs += [F.count_if(member).alias(f"_n{gi}_{lab}"), F.count_if(member & (p == t)).alias(f"_c{gi}_{lab}")]
            cells.append((gi, g, lab))
    a = (df.groupBy(*group_cols) if group_cols else df).agg(*aggs)
    cell_structs = [F.when(F.col(f"_n{gi}_{lab}") > 0, F.struct(
        (F.col(f"_c{gi}_{lab}") / F.col(f"_n{gi}_{lab}")).alias("accuracy"), F.lit(g).alias("group"),
        F.lit(lab).alias("label"))) for gi, g, lab in cells]
    worst = F.array_min(F.filter(F.array(*cell_structs), lambda c: c.isNotNull()))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return a.select(*group_cols, "n", F.try_divide(F.col("n_equal").cast("double"), F.col("n").cast("double")).alias("accuracy"),
                    F.when(den > 0, 2.0 * F.col("tp") / den).otherwise(F.lit(0.0)).alias("f1"),
                    worst["accuracy"].alias("wga"), worst["group"].alias("worst_group"), worst["label"].alias("worst_label"))


def group_accuracy_cells(df: DataFrame, groups: Sequence[str], pred_col: str = "pred",
                         label_col: str = "label", threshold: float = 0.5, group_cols: Sequence[str] = ()) -> DataFrame:
    """Per (group, label) accuracy over members (fraction >= threshold).

    ``unpivot`` is a map-side expand; the aggregate has |groups|·2 keys, so the
    partial aggregate leaves a few rows per partition to shuffle.
    """
    long = df.select(*group_cols, pred_col, label_col, *groups).unpivot(
        [*group_cols, pred_col, label_col], list(groups), "group", "fraction")
    return (long.where(F.col("fraction") >= threshold)  # F1 group_member
            .groupBy(*group_cols, "group", F.col(label_col).alias("label"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.avg((F.col(pred_col) == F.col(label_col)).cast("double")).alias("accuracy")))


def worst_group_accuracy(df: DataFrame, groups: Sequence[str], pred_col: str = "pred",
                         label_col: str = "label", threshold: float = 0.5, group_cols: Sequence[str] = ()) -> DataFrame:
    """M5 / T4: minimum accuracy over non-empty (group, label) cells, with the cell."""
    cells = group_accuracy_cells(df, groups, pred_col, label_col, threshold, group_cols)
    worst = F.min(F.struct("accuracy", "group", "label"))
    cells = cells.groupBy(*group_cols) if group_cols else cells
    return cells.agg(worst.alias("w")).select(
        *group_cols, F.col("w.accuracy").alias("wga"), F.col("w.group").alias("worst_group"),
        F.col("w.label").alias("worst_label"))
