"""End-to-end task evaluations (plans/tasks.py) and sink/source round trips
(S2, K2, K4, K5) as registered queries.

Round-trip queries write to a fresh folder under the session's checkpoint
directory (the cluster's shared ``spark.checkpoint.dir``) and return what
Spark reads back, so the oracle checks the sink and the source together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evalcrate.operators import classify as C
from evalcrate.operators import scoring as S
from evalcrate.plans import duck as D
from evalcrate.plans import tasks as TK
from evalcrate.plans.fixture_sql import with_fixtures
from evalcrate.plans.q_classify import _EM_SQL, _TOX_SQL, _wprf_sql
from evalcrate.plans.registry import ORACLE, register, rounded
from evalcrate.session import ensure_checkpoint_dir
from evalcrate.sinks import writers as W
from evalcrate.sources import fixtures as FX
from evalcrate.sources.readers import scan_json_splits


def _em_all_sql() -> str:
    cols = ["count(*) AS n", "CAST(count_if(pred = 1 AND truth = 1) AS BIGINT) AS tp",
            "CAST(count_if(pred = 1 AND truth = 0) AS BIGINT) AS fp",
            "CAST(count_if(pred = 0 AND truth = 1) AS BIGINT) AS fn",
            "CAST(count_if(pred = 0 AND truth = 0) AS BIGINT) AS tn",
            "CAST(count_if(pred = -1) AS BIGINT) AS unresolved", "count_if(pred = truth) / count(*) AS accuracy"]
    outer = ["n", "tp", "fp", "fn", "tn", "unresolved", D.r6("accuracy", "accuracy"),
             D.r6("CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END", "precision"),
             D.r6("CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END", "recall"),
             D.r6("CASE WHEN tp + fp > 0 AND tp + fn > 0 AND tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END", "f1")]
    for cls, name in C.FORMAT_CLASSES:
        cols += [f"CAST(count_if(formatting = '{cls}') AS BIGINT) AS {name}_total",
                 f"CAST(count_if(formatting = '{cls}' AND truth = 1) AS BIGINT) AS {name}_positives",
                 f"CAST(count_if(formatting = '{cls}' AND truth = 0) AS BIGINT) AS {name}_negatives"]
        outer += [f"{name}_total", f"{name}_positives", f"{name}_negatives", D.r6(f"{name}_total / n", f"{name}_rate")]
    return _EM_SQL + f"SELECT {', '.join(outer)} FROM (SELECT {', '.join(cols)} FROM s) a"


@register("eval_entity_matching", _em_all_sql())
def q_eval_entity_matching(spark, sf_dir):
    metrics, _ = TK.evaluate_entity_matching(FX.em_preds(spark, sf_dir), "response", "truth_text", stop_tokens=".")
    return rounded(metrics)


@register("eval_fact_checking", _wprf_sql(True))
def q_eval_fact_checking(spark, sf_dir):
    """Raw outputs ' LABEL.</s>' -> cut at suffix, drop '.', strip -> weighted P/R/F1."""
    df = FX.class3(spark, sf_dir).withColumn("raw", F.concat(F.lit(" "), F.col("pred"), F.lit(".</s>")))
    return rounded(TK.evaluate_fact_checking(df, "raw", "gold", remove_suffix="</s>", stop_tokens="."))


@register("eval_toxicity", _TOX_SQL + f"""
, c AS (SELECT g, label, avg(CAST(pred = label AS DOUBLE)) AS accuracy
        FROM (SELECT 'male' AS g, male AS f, pred, label FROM s UNION ALL SELECT 'female', female, pred, label FROM s) u
        WHERE f >= 0.5 GROUP BY g, label),
w AS (SELECT min({{'accuracy': accuracy, 'group': g, 'label': label}}) AS w FROM c)
SELECT n, {D.r6('n_equal / n', 'accuracy')},
       {D.r6('CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END', 'f1')},
       {D.r6('(SELECT w.accuracy FROM w)', 'wga')}, (SELECT w."group" FROM w) AS worst_group,
       (SELECT w.label FROM w) AS worst_label
FROM (SELECT count(*) AS n, count_if(pred = label) AS n_equal, count_if(pred = 1 AND label = 1) AS tp,
             count_if(pred = 1 AND label <> 1) AS fp, count_if(pred <> 1 AND label = 1) AS fn FROM s) a""")
def q_eval_toxicity(spark, sf_dir):
    return rounded(TK.evaluate_toxicity(FX.toxic_groups(spark, sf_dir), "response", "label"))


def _abstention_sql() -> str:
    from evalcrate.plans import q_qa  # noqa: F401  (registers the two single-metric oracles)
    f1 = ORACLE["f1_by_type"]
    ans = ORACLE["answerability"]
    f1_cols = f1[f1.rindex("SELECT ") + len("SELECT "): f1.rindex(" FROM best")]
    ans_cols = ans[ans.rindex("SELECT ") + len("SELECT "): ans.rindex(" FROM best")]
    head = f1[: f1.rindex("SELECT ")]
    return head + f"SELECT {f1_cols}, {ans_cols} FROM best"


@register("eval_abstention", _abstention_sql())
def q_eval_abstention(spark, sf_dir):
    return rounded(TK.evaluate_abstention(FX.multi_ref_gold(spark, sf_dir), FX.multi_ref_pred_log(spark, sf_dir),
                                          order_col="written"))


# ---------------------------------------------------------------- run matrices of whole flows

_RUN = "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END"


@register("eval_toxicity_runs", _TOX_SQL + f"""
, r AS (SELECT {_RUN} AS model, * FROM s),
c AS (SELECT model, g, label, avg(CAST(pred = label AS DOUBLE)) AS accuracy
      FROM (SELECT model, 'male' AS g, male AS f, pred, label FROM r UNION ALL SELECT model, 'female', female, pred, label FROM r) u
      WHERE f >= 0.5 GROUP BY model, g, label),
w AS (SELECT model, min({{'accuracy': accuracy, 'group': g, 'label': label}}) AS w FROM c GROUP BY model),
a AS (SELECT model, count(*) AS n, count_if(pred = label) AS n_equal, count_if(pred = 1 AND label = 1) AS tp,
             count_if(pred = 1 AND label <> 1) AS fp, count_if(pred <> 1 AND label = 1) AS fn FROM r GROUP BY model)
SELECT model, n, {D.r6('n_equal / n', 'accuracy')},
       {D.r6('CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END', 'f1')},
       {D.r6('w.accuracy', 'wga')}, w."group" AS worst_group, w.label AS worst_label FROM a JOIN w USING (model)""")
def q_eval_toxicity_runs(spark, sf_dir):
    df = FX.toxic_groups(spark, sf_dir).withColumn("model", F.expr(_RUN))
    return rounded(TK.evaluate_toxicity(df, "response", "label", group_cols=["model"]))


@register("worst_group_runs", _TOX_SQL + f"""
, r AS (SELECT {_RUN} AS model, * FROM s),
c AS (SELECT model, g, label, avg(CAST(pred = label AS DOUBLE)) AS accuracy
      FROM (SELECT model, 'male' AS g, male AS f, pred, label FROM r UNION ALL SELECT model, 'female', female, pred, label FROM r) u
      WHERE f >= 0.5 GROUP BY model, g, label),
w AS (SELECT model, min({{'accuracy': accuracy, 'group': g, 'label': label}}) AS w FROM c GROUP BY model)
SELECT model, {D.r6('w.accuracy', 'wga')}, w."group" AS worst_group, w.label AS worst_label FROM w""")
def q_worst_group_runs(spark, sf_dir):
    from evalcrate.plans.q_classify import toxic_scored
    df = toxic_scored(spark, sf_dir).withColumn("model", F.expr(_RUN))
    return rounded(C.worst_group_accuracy(df, ["male", "female"], "pred", "label", group_cols=["model"]))


def _abstention_runs_sql() -> str:
    sql = _abstention_sql()
    head, _, cols = sql.rpartition("SELECT ")
    cols = cols[: cols.rindex(" FROM best")]
    run = "CASE WHEN question_id % 2 = 0 THEN 'a' ELSE 'b' END"
    return f"{head}SELECT {run} AS model, {cols} FROM best GROUP BY {run}"


@register("eval_abstention_runs", _abstention_runs_sql())
def q_eval_abstention_runs(spark, sf_dir):
    preds = FX.multi_ref_pred_log(spark, sf_dir).withColumn("model", F.expr("CASE WHEN question_id % 2 = 0 THEN 'a' ELSE 'b' END"))
    return rounded(TK.evaluate_abstention(FX.multi_ref_gold(spark, sf_dir), preds, order_col="written", group_cols=["model"]))


def _greedy_cte(*fixtures: str) -> str:
    return with_fixtures(*fixtures, "token_vectors", extra="""
v AS (SELECT pair_id, vec_id, side, CAST(embedding AS DOUBLE[]) AS e FROM token_vectors),
x AS (SELECT a.pair_id, a.vec_id AS p, b.vec_id AS r, list_cosine_similarity(a.e, b.e) AS c
      FROM v a JOIN v b ON a.pair_id = b.pair_id AND a.side = 'pred' AND b.side = 'ref'),
pp AS (SELECT pair_id, avg(m) AS precision FROM (SELECT pair_id, p, max(c) AS m FROM x GROUP BY ALL) y GROUP BY pair_id),
rr AS (SELECT pair_id, avg(m) AS recall FROM (SELECT pair_id, r, max(c) AS m FROM x GROUP BY ALL) y GROUP BY pair_id),
g AS (SELECT pair_id, precision, recall,
             CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
      FROM pp JOIN rr USING (pair_id))""")


@register("greedy_match_runs", _greedy_cte() + f"""
SELECT pair_id % 2 AS run, count(*) AS n_pairs, {D.r6('avg(precision)', 'precision')}, {D.r6('avg(recall)', 'recall')},
       {D.r6('avg(f1)', 'f1')} FROM g GROUP BY pair_id % 2""")
def q_greedy_match_runs(spark, sf_dir):
    from evalcrate.operators.greedy import greedy_match_score
    v = FX.token_vectors(spark, sf_dir).withColumn("run", F.col("pair_id") % 2)
    return rounded(greedy_match_score(v, group_cols=["run"]))


def _eval_summaries_sql() -> str:
    from evalcrate.plans import q_runs  # noqa: F401  (registers the one-pass oracle)
    inner = ORACLE["summary_metrics_all"]
    match = ", ".join(f"(SELECT round(avg({c}), 6) FROM ({_greedy_cte('text_pairs')} SELECT {c} FROM g JOIN text_pairs t ON t.id = g.pair_id) z) "
                      f"AS match_{c}" for c in ("precision", "recall", "f1"))
    return f"SELECT n, rouge1, rouge2, bleu, token_f1, exact_match, {match} FROM ({inner}) x"


@register("eval_summaries", _eval_summaries_sql())
def q_eval_summaries(spark, sf_dir):
    """The summary flow with the vector-match switch; ROUGE-L has its own query (``rouge_l``)."""
    return rounded(TK.evaluate_summaries(FX.text_pairs(spark, sf_dir), "pred", "ref", exact=True, rouge_l=False,
                                         vectors=FX.token_vectors(spark, sf_dir)))


def _abstention_texts_sql() -> str:
    from evalcrate.plans.fixture_sql import FIXTURE_SQL
    from evalcrate.plans.q_qa import _SCORES_SQL
    pairs = f"SELECT question_id AS id, answer_pred AS pred, answer AS ref FROM ({_SCORES_SQL} SELECT * FROM j) q"
    rouge, bleu = (ORACLE[k].replace(FIXTURE_SQL["text_pairs"], pairs) for k in ("rouge_n", "corpus_bleu"))
    return (f"SELECT n, rouge1, rouge2, (SELECT bleu FROM ({bleu}) b) AS bleu, CAST(NULL AS DOUBLE) AS token_f1, "
            f"CAST(NULL AS DOUBLE) AS exact_match FROM ({rouge}) r")


@register("eval_abstention_texts", _abstention_texts_sql())
def q_eval_abstention_texts(spark, sf_dir):
    """ROUGE and BLEU of the cleaned abstention answers against every reference."""
    return rounded(TK.evaluate_abstention_texts(FX.multi_ref_gold(spark, sf_dir), FX.multi_ref_pred_log(spark, sf_dir),
                                                order_col="written"))


@register("eval_qa", with_fixtures("text_pairs", extra=f"""
t AS (SELECT id, {D.tokens("replace(pred, '!', '')")} AS pt, {D.tokens('ref')} AS rt FROM text_pairs),
s AS (SELECT id, pt, rt, len(pt) AS np, len(rt) AS nr, {D.bag_overlap('pt', 'rt')} AS same FROM t)""") + f"""
SELECT count(*) AS n, {D.r6("avg(CAST(array_to_string(pt, ' ') = array_to_string(rt, ' ') AS DOUBLE))", 'exact_match')},
       {D.r6('''avg(CASE WHEN np = 0 OR nr = 0 THEN CAST(np = 0 AND nr = 0 AS DOUBLE)
                         WHEN same > 0 THEN 2.0 * same / (np + nr) ELSE 0.0 END)''', 'squad_f1_score')}
FROM s""")
def q_eval_qa(spark, sf_dir):
    return rounded(TK.evaluate_qa(FX.text_pairs(spark, sf_dir), "pred", "ref", remove_suffix="!"))


# ---------------------------------------------------------------- sink / source round trips

def _scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/evalcrate-io/{name}-{uuid.uuid4().hex}"


@register("scan_json_splits", with_fixtures("multi_ref_gold") +
          "SELECT CASE WHEN type = 'none' THEN 'test' ELSE 'train' END AS split, CAST(question_id AS VARCHAR) AS question_id, "
          "ref_pos, answer FROM multi_ref_gold")
def q_scan_json_splits(spark, sf_dir):
    """Gold rows written as JSON lines per split, read back by a split map."""
    g = FX.multi_ref_gold(spark, sf_dir).withColumn(
        "split", F.when(F.col("type") == "none", F.lit("test")).otherwise(F.lit("train")))
    base = _scratch(spark, "json")
    for split in ("train", "test"):
        g.where(F.col("split") == split).select(F.col("question_id").cast("string"), "ref_pos", "answer") \
            .write.mode("overwrite").json(f"{base}/{split}")
    back = scan_json_splits(spark, {"train": f"{base}/train", "test": f"{base}/test"},
                            "question_id string, ref_pos long, answer string")
    return back.select("split", "question_id", "ref_pos", "answer")


@register("write_predictions", _EM_SQL + "SELECT CAST(s.id AS VARCHAR) AS id, 'Toxic? Comment ' || CAST(s.id AS VARCHAR) AS input, "
          "s.truth_text AS label, CAST(s.pred AS VARCHAR) AS output, e.response AS full_response, s.formatting "
          "FROM s JOIN em_preds e ON s.id = e.id")
def q_write_predictions(spark, sf_dir):
    """K2: the entity-matching prediction table through CSV and back."""
    from evalcrate.plans.q_classify import em_scored
    key = F.col("id").cast("string")
    t = em_scored(spark, sf_dir).select(key.alias("id"), F.concat(F.lit("Toxic? Comment "), key).alias("input"),
                                        F.col("truth_text").alias("label"), F.col("pred").cast("string").alias("output"),
                                        F.col("response").alias("full_response"), "formatting")
    path = _scratch(spark, "csv")
    W.write_predictions(t, path)
    return spark.read.option("header", True).schema(
        "id string, input string, label string, output string, full_response string, formatting string").csv(path)


@register("write_outputs", with_fixtures("multi_ref_pred") + "SELECT question_id, prediction FROM multi_ref_pred")
def q_write_outputs(spark, sf_dir):
    """K4: raw outputs to parquet and back."""
    path = _scratch(spark, "outputs")
    W.write_outputs(FX.multi_ref_pred(spark, sf_dir), path)
    return spark.read.parquet(path)


@register("checkpoint_outputs", with_fixtures("dialogues") + """
SELECT id, CASE WHEN length(dialogue) % 2 = 0 THEN 'yes' ELSE 'no' END AS output, CAST(NULL AS VARCHAR) AS error
FROM dialogues""")
def q_checkpoint_outputs(spark, sf_dir):
    """K5 + J4: two resumable runs (the second finds nothing pending) over one output folder."""
    from evalcrate.plans.q_runs import parity_scorer
    d = FX.dialogues(spark, sf_dir).select("id", "dialogue")
    path = _scratch(spark, "ckpt")
    S.resumable_score(d, parity_scorer, "id", "dialogue", path)
    return S.resumable_score(d, parity_scorer, "id", "dialogue", path)
