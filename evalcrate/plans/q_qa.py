"""Abstention-QA queries: nested gold (M12, J6), cleaning (C9), joins (J1, J2),
best reference (M9, W1), F1 by type (M10), answerability (M11)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evalcrate.functions import text as T
from evalcrate.operators import qa as Q
from evalcrate.plans import duck as D
from evalcrate.plans.fixture_sql import with_fixtures
from evalcrate.plans.registry import register, rounded
from evalcrate.session import ensure_checkpoint_dir
from evalcrate.sources import fixtures as FX


def _papers(spark, sf_dir):
    lines = FX.nested_qa_json(spark, sf_dir)
    m = lines.select(F.from_json("value", Q.NESTED_QA_SCHEMA).alias("m"))
    return m.select(F.explode("m").alias("paper_id", "paper"))


_NESTED_GOLD_SQL = """
WITH a AS (SELECT conv_id, turn, text, turn % 4 AS t FROM conversations WHERE role = 'assistant')
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS question_id, CAST(0 AS BIGINT) AS ref_pos,
       CASE t WHEN 3 THEN 'Unanswerable' WHEN 0 THEN replace(text, chr(10), ', ') WHEN 1 THEN text
              ELSE CASE WHEN length(text) % 2 = 0 THEN 'Yes' ELSE 'No' END END AS answer,
       CASE t WHEN 3 THEN 'none' WHEN 0 THEN 'extractive' WHEN 1 THEN 'abstractive' ELSE 'boolean' END AS type
FROM a
UNION ALL
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), CAST(1 AS BIGINT),
       'Summary: ' || text, 'abstractive'
FROM a"""


@register("qasper_gold", _NESTED_GOLD_SQL)
def q_qasper_gold(spark, sf_dir):
    return Q.resolve_references(_papers(spark, sf_dir))


@register("scan_nested_qa", _NESTED_GOLD_SQL)
def q_scan_nested_qa(spark, sf_dir):
    """S3: the nested gold as JSON-lines files, read by the file reader and resolved."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/evalcrate-io/nested-{uuid.uuid4().hex}"
    FX.nested_qa_json(spark, sf_dir).write.text(path)
    return Q.resolve_references(Q.scan_nested_qa(spark, path))


@register("scan_nested_document", _NESTED_GOLD_SQL)
def q_scan_nested_document(spark, sf_dir):
    """S3: the nested gold as documents of many papers, read in byte ranges and resolved."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/evalcrate-io/document-{uuid.uuid4().hex}"
    lines = FX.nested_qa_json(spark, sf_dir)
    entry = F.substring("value", 2, 1 << 30)  # a line without its outer braces
    part = F.pmod(F.xxhash64("value"), F.greatest(F.ceil(lines.agg(F.count("*")).scalar() / 1000), F.lit(1)))  # some 1,000 papers
    documents = lines.groupBy(part.alias("d")).agg(F.array_join(F.transform(
        F.collect_list(entry), lambda e: F.left(e, F.length(e) - 1)), ",\n").alias("e"))
    documents.select(F.concat(F.lit("{"), "e", F.lit("}")).alias("value")).write.text(path)
    return Q.resolve_references(Q.scan_nested_qa(spark, path, whole_file=True))


@register("expand_references", """
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS question_id, CAST(p AS BIGINT) AS ref_pos,
       CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || '-' || CAST(p AS VARCHAR) AS annotation_id
FROM conversations, (SELECT unnest([0, 1]) AS p) x WHERE role = 'assistant'""")
def q_expand_references(spark, sf_dir):
    qas = _papers(spark, sf_dir).select(F.explode("paper.qas").alias("qa"))
    nested = qas.select(F.col("qa.question_id").alias("question_id"), F.col("qa.answers").alias("references"))
    out = Q.expand_references(nested, "references")
    return out.select("question_id", F.col("ref_pos").cast("long").alias("ref_pos"),
                      F.col("ref.annotation_id").alias("annotation_id"))


def _duck_extract(x: str) -> str:
    e = x
    for s in T.EXTRACT_DROPS:
        e = f"replace({e}, '{s}', '')"
    return (f"(CASE WHEN contains(lower({e}), 'unanswerable') THEN 'unanswerable' "
            f"WHEN starts_with(lower({e}), 'yes') OR starts_with(lower({e}), ' yes') THEN 'yes' "
            f"WHEN starts_with(lower({e}), 'no') OR starts_with(lower({e}), ' no') THEN 'no' ELSE {e} END)")


@register("extract_answer", with_fixtures("multi_ref_pred") +
          f"SELECT question_id, {_duck_extract('prediction')} AS answer_pred FROM multi_ref_pred")
def q_extract_answer(spark, sf_dir):
    p = FX.multi_ref_pred(spark, sf_dir)
    return p.select("question_id", T.extract_answer("prediction").alias("answer_pred"))


_SCORES_SQL = with_fixtures("multi_ref_gold", "multi_ref_pred", extra=f"""
p AS (SELECT question_id, {_duck_extract('prediction')} AS answer_pred FROM multi_ref_pred),
j AS (SELECT g.question_id, g.ref_pos, g.answer, g.type, p.answer_pred FROM multi_ref_gold g JOIN p USING (question_id)),
tk AS (SELECT *, {D.tokens('answer_pred')} AS pt, {D.tokens('answer')} AS rt FROM j),
sc AS (SELECT question_id, ref_pos, type, answer_pred,
              CASE WHEN {D.bag_overlap('pt', 'rt')} > 0 THEN 2.0 * {D.bag_overlap('pt', 'rt')} / (len(pt) + len(rt))
                   ELSE 0.0 END AS f1,
              CAST(contains(lower(answer_pred), 'unanswerable') AS DOUBLE) AS abstained FROM tk),
b AS (SELECT question_id, max({{'f1': f1, 'neg_pos': -ref_pos, 'type': type, 'abstained': abstained}}) AS m
      FROM sc GROUP BY question_id),
best AS (SELECT question_id, m.f1 AS best_f1, m.type AS type, -m.neg_pos AS ref_pos, m.abstained AS abstained FROM b)""")


def _scores(spark, sf_dir):
    # the oracle scores the last prediction of each question only
    return Q.reference_scores(FX.multi_ref_gold(spark, sf_dir), FX.multi_ref_pred_log(spark, sf_dir), order_col="written")


@register("join_gold", _SCORES_SQL + "SELECT question_id, ref_pos, type, answer_pred FROM j")
def q_join_gold(spark, sf_dir):
    p = FX.multi_ref_pred(spark, sf_dir).select("question_id", T.extract_answer("prediction").alias("answer_pred"))
    return Q.join_gold(FX.multi_ref_gold(spark, sf_dir), p).select("question_id", "ref_pos", "type", "answer_pred")


@register("missing_predictions", with_fixtures("multi_ref_gold", "multi_ref_pred") + """
SELECT CAST(count_if(p.question_id IS NULL) AS BIGINT) AS missing, CAST(count_if(p.question_id IS NOT NULL) AS BIGINT) AS scored
FROM (SELECT DISTINCT question_id FROM multi_ref_gold) g
LEFT JOIN (SELECT DISTINCT question_id FROM multi_ref_pred) p USING (question_id)""")
def q_missing_predictions(spark, sf_dir):
    return Q.missing_predictions(FX.multi_ref_gold(spark, sf_dir), FX.multi_ref_pred(spark, sf_dir))


@register("best_reference_f1", _SCORES_SQL +
          f"SELECT question_id, {D.r6('best_f1', 'best_f1')}, type, ref_pos FROM best")
def q_best_reference_f1(spark, sf_dir):
    return rounded(Q.best_reference(_scores(spark, sf_dir)).select("question_id", "best_f1", "type", "ref_pos"))


@register("best_reference_row", _SCORES_SQL + f"""
SELECT question_id, ref_pos, type, {D.r6('f1', 'f1')} FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY f1 DESC, ref_pos) AS rn FROM sc) x
WHERE rn = 1""")
def q_best_reference_row(spark, sf_dir):
    return rounded(Q.best_reference_row(_scores(spark, sf_dir)).select("question_id", "ref_pos", "type", "f1"))


def _by_type_sql():
    cols = ["count(*) AS n", D.r6("coalesce(avg(best_f1), 0.0)", "answer_f1")]
    for t in Q.ANSWER_TYPES:
        cols += [f"CAST(count_if(type = '{t}') AS BIGINT) AS n_{t}",
                 D.r6(f"coalesce(avg(best_f1) FILTER (WHERE type = '{t}'), 0.0)", f"answer_f1_{t}")]
    return _SCORES_SQL + f"SELECT {', '.join(cols)} FROM best"


@register("f1_by_type", _by_type_sql())
def q_f1_by_type(spark, sf_dir):
    return rounded(Q.f1_by_type(Q.best_reference(_scores(spark, sf_dir))))


def _answerability_sql():
    cols = [D.r6("coalesce(avg(abstained), 0.0)", "answerability_all"),
            D.r6("coalesce(avg(abstained) FILTER (WHERE type <> 'none'), 0.0)", "answerability_has")]
    for t in Q.ANSWER_TYPES:
        cols.append(D.r6(f"coalesce(avg(abstained) FILTER (WHERE type = '{t}'), 0.0)", f"noans_{t}"))
    return _SCORES_SQL + f"SELECT {', '.join(cols)} FROM best"


@register("answerability", _answerability_sql())
def q_answerability(spark, sf_dir):
    return rounded(Q.answerability(Q.best_reference(_scores(spark, sf_dir))))
