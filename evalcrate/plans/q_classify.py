"""Classification-family queries: entity matching (M1, M2, C1-C3, C7, C8),
fact-check labels (C14, O2, M3), toxicity (C10, F1, F5, M4, M5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalcrate.functions import text as T
from evalcrate.operators import classify as C
from evalcrate.plans import duck as D
from evalcrate.plans.fixture_sql import with_fixtures
from evalcrate.plans.registry import register, rounded
from evalcrate.sources import fixtures as FX

FACT_LABELS = ("SUPPORTS", "REFUTES", "NOT_ENOUGH_INFO")


def em_scored(spark, sf_dir):
    """em_preds -> cleaned responses (stop token '.' dropped) with pred/truth/formatting."""
    return C.clean_binary_responses(FX.em_preds(spark, sf_dir), "response", "truth_text", "y", "n",
                                    remove_suffix=None, stop_tokens=".")


_EM_SQL = with_fixtures("em_preds", extra=f"""
c AS (SELECT id, truth_text, replace(response, '.', '') AS cleaned FROM em_preds),
r AS (SELECT *, {D.resolve_binary('cleaned', 'y', 'n')} AS pred,
                {D.resolve_binary('truth_text', 'y', 'n')} AS truth FROM c),
s AS (SELECT *, CASE WHEN cleaned IN ('y', 'n') THEN 'CORRECT'
                     WHEN pred IN (0, 1) THEN 'RESOLVABLE' ELSE 'UNRESOLVABLE' END AS formatting FROM r)""")


@register("em_confusion", _EM_SQL + f"""
SELECT n, tp, fp, fn, tn, unresolved, {D.r6('accuracy', 'accuracy')}, {D.r6('precision', 'precision')},
       {D.r6('recall', 'recall')},
       {D.r6('CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END', 'f1')}
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall
      FROM (SELECT count(*) AS n,
                   CAST(count_if(pred = 1 AND truth = 1) AS BIGINT) AS tp,
                   CAST(count_if(pred = 1 AND truth = 0) AS BIGINT) AS fp,
                   CAST(count_if(pred = 0 AND truth = 1) AS BIGINT) AS fn,
                   CAST(count_if(pred = 0 AND truth = 0) AS BIGINT) AS tn,
                   CAST(count_if(pred = -1) AS BIGINT) AS unresolved,
                   count_if(pred = truth) / count(*) AS accuracy
            FROM s) a) b""")
def q_em_confusion(spark, sf_dir):
    return rounded(C.em_confusion(em_scored(spark, sf_dir)))


def _fmt_sql():
    cols = ["count(*) AS n"]
    outer = ["n"]
    for cls, name in C.FORMAT_CLASSES:
        cols += [f"CAST(count_if(formatting = '{cls}') AS BIGINT) AS {name}_total",
                 f"CAST(count_if(formatting = '{cls}' AND truth = 1) AS BIGINT) AS {name}_positives",
                 f"CAST(count_if(formatting = '{cls}' AND truth = 0) AS BIGINT) AS {name}_negatives"]
        outer += [f"{name}_total", f"{name}_positives", f"{name}_negatives",
                  D.r6(f"{name}_total / n", f"{name}_rate")]
    return _EM_SQL + f"SELECT {', '.join(outer)} FROM (SELECT {', '.join(cols)} FROM s) a"


@register("em_format_rates", _fmt_sql())
def q_em_format_rates(spark, sf_dir):
    return rounded(C.em_format_rates(em_scored(spark, sf_dir)))


@register("resolve_binary", _EM_SQL + "SELECT id, pred, truth FROM s")
def q_resolve_binary(spark, sf_dir):
    return em_scored(spark, sf_dir).select("id", "pred", "truth")


@register("format_class", _EM_SQL + "SELECT id, cleaned, formatting FROM s")
def q_format_class(spark, sf_dir):
    return em_scored(spark, sf_dir).select("id", "cleaned", "formatting")


@register("drop_stop_tokens", with_fixtures("em_preds") +
          "SELECT id, replace(replace(replace(response, '.', ''), ',', ''), ':', '') AS cleaned FROM em_preds")
def q_drop_stop_tokens(spark, sf_dir):
    df = FX.em_preds(spark, sf_dir)
    return df.select("id", T.drop_stop_tokens("response", ".+,+:").alias("cleaned"))


# ---------------------------------------------------------------- fact checking (3 classes)

_ENC = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(FACT_LABELS))


@register("encode_label", with_fixtures("class3") + f"""
SELECT id, CAST(CASE gold {_ENC} ELSE {len(FACT_LABELS)} END AS INTEGER) AS gold_idx,
       CAST(CASE pred {_ENC} ELSE {len(FACT_LABELS)} END AS INTEGER) AS pred_idx FROM class3""")
def q_encode_label(spark, sf_dir):
    df = FX.class3(spark, sf_dir)
    return df.select("id", T.encode_label("gold", FACT_LABELS).alias("gold_idx"),
                     T.encode_label("pred", FACT_LABELS).alias("pred_idx"))


@register("distinct_labels", with_fixtures("class3") + "SELECT DISTINCT pred FROM class3")
def q_distinct_labels(spark, sf_dir):
    return C.distinct_labels(FX.class3(spark, sf_dir), "pred")


def _wprf_sql(vals_known: bool) -> str:
    if vals_known:
        enc = (f"SELECT CASE gold {_ENC} ELSE {len(FACT_LABELS)} END AS g, "
               f"CASE pred {_ENC} ELSE {len(FACT_LABELS)} END AS p FROM class3")
    else:
        enc = ("SELECT CASE WHEN gold IN (SELECT pred FROM class3) THEN gold ELSE '<oov>' END AS g, "
               "pred AS p FROM class3")
    return with_fixtures("class3", extra=f"""
e AS ({enc}),
cls AS (SELECT g AS c FROM e UNION SELECT p FROM e),
pc AS (SELECT c, (SELECT count(*) FROM e WHERE g = c) AS support,
              (SELECT count(*) FROM e WHERE p = c) AS predicted,
              (SELECT count(*) FROM e WHERE g = c AND p = c) AS tp FROM cls),
sc AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS pr,
                 CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rc FROM pc)""") + f"""
SELECT CAST(sum(support) AS BIGINT) AS n, {D.r6('sum(tp) / sum(support)', 'accuracy')},
       {D.r6('sum(support * pr) / sum(support)', 'precision')}, {D.r6('sum(support * rc) / sum(support)', 'recall')},
       {D.r6('sum(support * CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END) / sum(support)', 'f1')}
FROM sc"""


@register("weighted_prf", _wprf_sql(True))
def q_weighted_prf(spark, sf_dir):
    return rounded(C.weighted_prf(FX.class3(spark, sf_dir), "gold", "pred", FACT_LABELS))


@register("weighted_prf_open_labels", _wprf_sql(False))
def q_weighted_prf_open(spark, sf_dir):
    """M3 with an empty label list: classes are the distinct predictions."""
    return rounded(C.weighted_prf(FX.class3(spark, sf_dir), "gold", "pred", None))


# ---------------------------------------------------------------- toxicity (bias task)

def toxic_scored(spark, sf_dir):
    df = FX.toxic_groups(spark, sf_dir)
    return df.select("id", "male", "female", "response",
                     T.label_contains("label", "Y").cast("int").alias("label"),
                     T.yes_flag("response").alias("pred"))


_TOX_SQL = with_fixtures("toxic_groups", extra="""
s AS (SELECT id, male, female, response, CAST(contains(label, 'Y') AS INTEGER) AS label,
             CAST(contains(lower(response), 'yes') AS INTEGER) AS pred FROM toxic_groups)""")


@register("yes_flag", _TOX_SQL + "SELECT id, pred FROM s")
def q_yes_flag(spark, sf_dir):
    return toxic_scored(spark, sf_dir).select("id", "pred")


@register("label_contains", _TOX_SQL + "SELECT id, label FROM s")
def q_label_contains(spark, sf_dir):
    return toxic_scored(spark, sf_dir).select("id", "label")


@register("group_member", _TOX_SQL + """
SELECT g AS "group", CAST(count(*) AS BIGINT) AS members
FROM (SELECT 'male' AS g, male AS f FROM s UNION ALL SELECT 'female', female FROM s) u
WHERE f >= 0.5 GROUP BY g""")
def q_group_member(spark, sf_dir):
    df = toxic_scored(spark, sf_dir)
    long = df.unpivot(["id"], ["male", "female"], "group", "fraction")
    return long.where(F.col("fraction") >= 0.5).groupBy("group").agg(F.count(F.lit(1)).alias("members"))


@register("binary_acc_f1", _TOX_SQL + f"""
SELECT n, {D.r6('n_equal / n', 'accuracy')},
       {D.r6('CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END', 'f1')}
FROM (SELECT count(*) AS n, count_if(pred = label) AS n_equal, count_if(pred = 1 AND label = 1) AS tp,
             count_if(pred = 1 AND label <> 1) AS fp, count_if(pred <> 1 AND label = 1) AS fn FROM s) a""")
def q_binary_acc_f1(spark, sf_dir):
    return rounded(C.binary_acc_f1(toxic_scored(spark, sf_dir), "pred", "label"))


@register("worst_group_accuracy", _TOX_SQL + f"""
SELECT {D.r6('w.accuracy', 'wga')}, w."group" AS worst_group, w.label AS worst_label
FROM (SELECT min({{'accuracy': accuracy, 'group': g, 'label': label}}) AS w
      FROM (SELECT g, label, avg(CAST(pred = label AS DOUBLE)) AS accuracy
            FROM (SELECT 'male' AS g, male AS f, pred, label FROM s
                  UNION ALL SELECT 'female', female, pred, label FROM s) u
            WHERE f >= 0.5 GROUP BY g, label) c) m""")
def q_worst_group_accuracy(spark, sf_dir):
    return rounded(C.worst_group_accuracy(toxic_scored(spark, sf_dir), ["male", "female"], "pred", "label"))
