"""Multi-reference QA scoring (abstention task): M12 gold resolution, J1/J2/J6
joins, M9/W1/T1 best reference, M10 F1 by type, M11 answerability.

Plan shape: predictions are cleaned (C9) in a projection, joined to the long
gold table on ``question_id`` (sort-merge or AQE broadcast), scored per
(question, reference) row, and reduced per question with ``max(struct)``.
The aggregate keys on the join key, so the join's hash partitioning is reused
and the only shuffle is the join's.  Type buckets are a fixed dimension folded
into one conditional aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalcrate.functions import text as T
from evalcrate.functions.bags import bag_overlap, f1_from_overlap
from evalcrate.sources.json_document import scan_json_document

# Answer types of the multi-reference gold data, in report order.
ANSWER_TYPES = ("extractive", "abstractive", "boolean", "none")

NESTED_QA_SCHEMA = (
    "map<string, struct<qas: array<struct<question_id: string, answers: array<struct<"
    "annotation_id: string, answer: struct<unanswerable: boolean, extractive_spans: array<string>, "
    "free_form_answer: string, yes_no: boolean>>>>>>>")


def scan_nested_qa(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """S3: read nested QA gold JSON as ``(paper_id, paper)`` rows.

    JSON-lines input (one map of papers per line) is split across tasks like
    any text file.  ``whole_file=True`` reads one JSON document per file, however
    large: its byte ranges are read by many tasks
    (:func:`evalcrate.sources.json_document.scan_json_document`)."""
    if whole_file:
        paper = NESTED_QA_SCHEMA.removeprefix("map<string, ").removesuffix(">")
        return scan_json_document(spark, path, paper).toDF("paper_id", "paper")
    raw = spark.read.text(path)
    parsed = raw.select(F.from_json("value", NESTED_QA_SCHEMA).alias("m"))
    return parsed.select(F.explode("m").alias("paper_id", "paper"))


def resolve_references(papers: DataFrame) -> DataFrame:
    """``(question_id, ref_pos, answer, type)``, one row per annotation.

    unanswerable -> ('Unanswerable', none); non-empty spans joined with ', '
    -> extractive; non-empty free text -> abstractive; yes_no true/false ->
    Yes/No boolean; nothing -> the job fails with the annotation id."""
    q = papers.select(F.explode("paper.qas").alias("qa"))
    a = q.select(F.col("qa.question_id").alias("question_id"),
                 F.posexplode("qa.answers").alias("ref_pos", "ann"))
    ans = F.col("ann.answer")
    spans = F.coalesce(ans["extractive_spans"], F.array().cast("array<string>"))
    free = ans["free_form_answer"]
    yn = ans["yes_no"]
    err = F.raise_error(F.concat(F.lit("no answer of any type in annotation "),
                                 F.coalesce(F.col("ann.annotation_id"), F.lit("?"))))
    answer = (F.when(F.coalesce(ans["unanswerable"], F.lit(False)), F.lit("Unanswerable"))
              .when(F.size(spans) > 0, F.array_join(spans, ", "))
              .when(F.coalesce(free, F.lit("")) != "", free)
              .when(yn, F.lit("Yes"))
              .when(yn.isNotNull(), F.lit("No"))
              .otherwise(err.cast("string")))
    typ = (F.when(F.coalesce(ans["unanswerable"], F.lit(False)), F.lit("none"))
           .when(F.size(spans) > 0, F.lit("extractive"))
           .when(F.coalesce(free, F.lit("")) != "", F.lit("abstractive"))
           .otherwise(F.lit("boolean")))
    return a.select("question_id", F.col("ref_pos").cast("long").alias("ref_pos"),
                    answer.alias("answer"), typ.alias("type"))


def dedupe_predictions(preds: DataFrame, key: str | list[str] = "question_id", order_col: str = "written") -> DataFrame:
    """Keep one prediction per key: the last by ``order_col`` (dict semantics: last write wins)."""
    keys = [key] if isinstance(key, str) else list(key)
    cols = [c for c in preds.columns if c not in keys]
    best = F.max_by(F.struct(*cols), F.col(order_col))
    return preds.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def join_gold(gold: DataFrame, preds: DataFrame, key: str = "question_id") -> DataFrame:
    """Gold references with a prediction (inner equi-join)."""
    return gold.join(preds, key, "inner")


def missing_predictions(gold: DataFrame, preds: DataFrame, key: str = "question_id") -> DataFrame:
    """Gold questions without a prediction, counted, next to the scored count."""
    qs = gold.select(key).distinct()
    has = preds.select(key).distinct().withColumn("_has", F.lit(True))
    j = qs.join(has, key, "left")  # anti and semi halves in one pass
    return j.agg(F.count_if(F.col("_has").isNull()).alias("missing"),
                 F.count_if(F.col("_has")).alias("scored"))


def expand_references(gold_nested: DataFrame, refs_col: str = "references") -> DataFrame:
    """Question x its reference answers (lateral explode of an array column)."""
    return gold_nested.select("*", F.posexplode(refs_col).alias("ref_pos", "ref")).drop(refs_col)


def reference_scores(gold: DataFrame, preds: DataFrame, pred_col: str = "prediction",
                     key: str = "question_id", order_col: str | None = None, run_cols: Sequence[str] = ()) -> DataFrame:
    """Per (question, reference): cleaned answer, strict token F1, abstention flag.

    Of several predictions for one question (and run) the last by ``order_col``
    counts; without an order column a second prediction fails.  Extra prediction
    columns (run keys such as model or shots) are carried through, so
    ``best_reference(scores, [run keys.., key])`` scores a run matrix."""
    runs = list(run_cols) or [c for c in preds.columns if c not in (pred_col, key, order_col)]
    if order_col:
        preds = dedupe_predictions(preds, [*runs, key], order_col).drop(order_col)
    else:
        others = [F.first(c).alias(c) for c in preds.columns if c not in (*runs, key)]
        say = F.raise_error(F.lit(f"several predictions for one {key} need an order_col"))
        preds = (preds.groupBy(*runs, key).agg(*others, F.count(F.lit(1)).alias("_n"))
                 .where(F.when(F.col("_n") > 1, say.cast("boolean")).otherwise(F.lit(True))).drop("_n"))
    p = preds.select(*[c for c in preds.columns if c != pred_col], T.extract_answer(pred_col).alias("answer_pred"))
    # the prediction is cleaned and tokenized once, before it meets its references
    p = p.withColumn("_pt", T.answer_tokens("answer_pred"))
    j = join_gold(gold, p, key)
    s = j.withColumn("_rt", T.answer_tokens("answer"))
    f1 = f1_from_overlap(bag_overlap("_pt", "_rt"), F.size("_pt"), F.size("_rt"))
    s = s.select(*[c for c in j.columns if c != "_pt"], f1.alias("f1"))
    return s.withColumn("abstained", F.lower("answer_pred").contains("unanswerable").cast("double"))


def best_reference(scores: DataFrame, key: str | list[str] = "question_id") -> DataFrame:
    """Max F1 per question and the type of that reference (first on ties).

    ``max(struct(f1, -ref_pos, ...))`` is a plain hash aggregate (partial
    aggregation map-side) — no sort, no window."""
    keys = [key] if isinstance(key, str) else list(key)
    best = F.max(F.struct(F.col("f1"), (-F.col("ref_pos")).alias("neg_pos"), F.col("type"), F.col("abstained")))
    return scores.groupBy(*keys).agg(best.alias("b")).select(
        *keys, F.col("b.f1").alias("best_f1"), F.col("b.type").alias("type"),
        (-F.col("b.neg_pos")).alias("ref_pos"), F.col("b.abstained").alias("abstained"))


def best_reference_row(scores: DataFrame, key: str = "question_id") -> DataFrame:
    """The same choice through ``row_number()`` over a per-question window."""
    from pyspark.sql import Window
    w = Window.partitionBy(key).orderBy(F.col("f1").desc(), F.col("ref_pos").asc())
    return scores.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def _mean_or_zero(c: Column, cond: Column | None = None) -> Column:
    v = F.avg(F.when(cond, c)) if cond is not None else F.avg(c)
    return F.coalesce(v, F.lit(0.0))


def f1_by_type_aggs(types=ANSWER_TYPES) -> list[Column]:
    cols = [F.count(F.lit(1)).alias("n"), _mean_or_zero(F.col("best_f1")).alias("answer_f1")]
    for t in types:
        cols += [F.count_if(F.col("type") == t).alias(f"n_{t}"),
                 _mean_or_zero(F.col("best_f1"), F.col("type") == t).alias(f"answer_f1_{t}")]
    return cols


def answerability_aggs(types=ANSWER_TYPES) -> list[Column]:
    cols = [_mean_or_zero(F.col("abstained")).alias("answerability_all"),
            _mean_or_zero(F.col("abstained"), F.col("type") != "none").alias("answerability_has")]
    for t in types:
        cols.append(_mean_or_zero(F.col("abstained"), F.col("type") == t).alias(f"noans_{t}"))
    return cols


def f1_by_type(best: DataFrame, types=ANSWER_TYPES, group_cols=()) -> DataFrame:
    """Mean best F1 overall and per type; an empty bucket is 0.0."""
    g = best.groupBy(*group_cols) if group_cols else best
    return g.agg(*f1_by_type_aggs(types))


def answerability(best: DataFrame, types=ANSWER_TYPES, group_cols=()) -> DataFrame:
    """Abstention rate overall, excluding 'none', and per best-reference type."""
    g = best.groupBy(*group_cols) if group_cols else best
    return g.agg(*answerability_aggs(types))
