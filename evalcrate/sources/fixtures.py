"""Evaluation tables derived from the given parquet tables (FIXTURES.md part B).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame whose size grows
with the input tables.  They stand in for the prediction / gold tables a user
would bring (model outputs joined to labels).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalcrate.sources.readers import read_table


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pred, ref): consecutive conversation turns as prediction/reference."""
    from evalcrate.operators.chat import pair_turns
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    q = pair_turns(c, even_only=False).withColumnRenamed("next_text", "nxt")  # skew-safe neighbour join
    m = F.col("conv_id") % 10
    pred = (F.when(m == 0, F.concat(F.lit("The "), F.col("nxt"), F.lit("!")))
            .when(m == 1, F.lit("the.")).when(m == 2, F.lit("An")).otherwise(F.col("text")))
    ref = F.when(m == 2, F.lit("!")).otherwise(F.col("nxt"))
    return q.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), pred.alias("pred"), ref.alias("ref"))


def em_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, truth_text, response): entity-matching style raw responses."""
    lab = read_table(spark, sf_dir, "labels")
    truth = F.when(F.col("toxic") == 1, F.lit("y")).otherwise(F.lit("n"))
    m = F.col("doc_id") % 7
    resp = (F.when(m == 0, F.lit("y")).when(m == 1, F.lit("n")).when(m == 2, F.lit("Y."))
            .when(m == 3, F.lit("The answer: n")).when(m == 4, F.lit("Yes, the same"))
            .when(m == 5, F.lit("unsure")).otherwise(truth))
    return lab.select(F.col("doc_id").alias("id"), truth.alias("truth_text"), resp.alias("response"))


def _status_label(c):
    return (F.when(c == "F", F.lit("SUPPORTS")).when(c == "O", F.lit("REFUTES"))
            .otherwise(F.lit("NOT_ENOUGH_INFO")))


def class3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, gold, pred): three-class labels with an out-of-vocabulary prediction."""
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    gold = _status_label(F.col("o_orderstatus"))
    pred = (F.when(k % 11 == 0, F.lit("MAYBE")).when(k % 5 == 0, F.lit("SUPPORTS"))
            .when(k % 7 == 0, F.lit("REFUTES")).otherwise(gold))
    return o.select(k.alias("id"), gold.alias("gold"), pred.alias("pred"))


def toxic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, response, male, female): toxicity rows with group fractions."""
    lab = read_table(spark, sf_dir, "labels")
    d = F.col("doc_id")
    label = F.when(F.col("toxic") == 1, F.lit("Y")).otherwise(F.lit("N"))
    resp = (F.when(d % 3 == 0, F.lit("Yes, it is")).when(d % 3 == 1, F.lit("no"))
            .otherwise(F.lit("I would say yes")))
    return lab.select(d.alias("id"), label.alias("label"), resp.alias("response"),
                      ((d % 10).cast("double") / 10).alias("male"),
                      ((d % 7).cast("double") / 7).alias("female"))


def multi_ref_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, ref_pos, answer, type): several typed references per question."""
    c = read_table(spark, sf_dir, "conversations")
    t = F.col("turn") % 4
    typ = (F.when(t == 0, F.lit("extractive")).when(t == 1, F.lit("abstractive"))
           .when(t == 2, F.lit("boolean")).otherwise(F.lit("none")))
    return (c.where(F.col("role") == "assistant")
            .select(F.col("conv_id").alias("question_id"), F.col("turn").alias("ref_pos"),
                    F.col("text").alias("answer"), typ.alias("type")))


def multi_ref_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, prediction): raw predictions; some questions have none."""
    c = read_table(spark, sf_dir, "conversations")
    q = F.col("conv_id")
    pred = (F.when(q % 5 == 0, F.lit("Unanswerable.</s>")).when(q % 5 == 1, F.lit("Yes, sure"))
            .otherwise(F.col("text")))
    return (c.where((F.col("turn") == 0) & (q % 9 != 0))
            .select(q.alias("question_id"), pred.alias("prediction")))


def multi_ref_pred_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, prediction, written): every prediction of ``multi_ref_pred`` as the last write, with an
    earlier one, often the better answer, before a third of them."""
    last = multi_ref_pred(spark, sf_dir).withColumn("written", F.lit(2))
    c = read_table(spark, sf_dir, "conversations")
    q = F.col("conv_id")
    early = c.where((F.col("turn") == 1) & (q % 3 == 0) & (q % 9 != 0)).select(
        q.alias("question_id"), F.col("text").alias("prediction"), F.lit(1).alias("written"))
    return last.unionByName(early)


def record_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring customers as an entity-matching record pair (NULL prints as NA)."""
    a = read_table(spark, sf_dir, "customer").alias("a")
    b = read_table(spark, sf_dir, "customer").alias("b")
    j = a.join(b, F.col("a.c_custkey") + 1 == F.col("b.c_custkey"))
    return j.select(
        F.col("a.c_custkey").alias("id"), F.col("a.c_name").alias("left_name"),
        F.col("b.c_name").alias("right_name"), F.col("a.c_mktsegment").alias("left_segment"),
        F.when(F.col("b.c_custkey") % 3 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("b.c_mktsegment")).alias("right_segment"),
        F.when(F.col("a.c_nationkey") == F.col("b.c_nationkey"), F.lit("y")).otherwise(F.lit("n"))
        .alias("overall_label"))


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, shots, id, ts, gold, pred): one row per run and item."""
    e = read_table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(F.col("event_type").alias("model"), (F.col("user_id") % 4).alias("shots"),
                    i.alias("id"), "ts",
                    F.when(i % 3 == 0, F.lit(1)).otherwise(F.lit(0)).alias("gold"),
                    F.when(i % 5 < 2, F.lit(1)).otherwise(F.lit(0)).alias("pred"))


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, vec_id, side, embedding): token vectors of prediction/reference texts.

    A pair is a label within a range of 128 ids, so its size is bounded at every scale."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select((F.floor(F.col("vec_id") / 128) * 1000 + F.col("label")).alias("pair_id"), "vec_id",
                    F.when(F.col("vec_id") % 2 == 0, F.lit("pred")).otherwise(F.lit("ref")).alias("side"),
                    "embedding")


def nested_qa_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested QA gold as JSON lines ``{paper_id: {"qas": [...]}}`` built from assistant turns.

    One line per assistant turn (bounded size, no grouping): the question has
    two annotations — one typed by ``turn % 4`` (spans / free text / yes-no /
    unanswerable) and one free-text summary."""
    c = read_table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    t = F.col("turn") % 4
    no_spans = F.array().cast("array<string>")
    null_bool = F.lit(None).cast("boolean")
    ann_id = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))

    def ann(suffix, unans, spans, free, yn):
        return F.struct(F.concat(ann_id, F.lit(suffix)).alias("annotation_id"),
                        F.struct(unans.alias("unanswerable"), spans.alias("extractive_spans"),
                                 free.alias("free_form_answer"), yn.alias("yes_no")).alias("answer"))

    a0 = ann("-0", t == 3, F.when(t == 0, F.split(F.col("text"), "\n")).otherwise(no_spans),
             F.when(t == 1, F.col("text")).otherwise(F.lit("")),
             F.when(t == 2, F.length("text") % 2 == 0).otherwise(null_bool))
    a1 = ann("-1", F.lit(False), no_spans,
             F.concat(F.lit("Summary: "), F.col("text")), null_bool)
    qa = F.struct(ann_id.alias("question_id"), F.array(a0, a1).alias("answers"))
    paper = F.struct(F.array(qa).alias("qas"))
    return c.select(F.to_json(F.create_map(F.col("conv_id").cast("string"), paper)).alias("value"))


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, dialogue, section_header, section_text): a user turn and the reply that follows."""
    from evalcrate.operators.chat import pair_turns
    c = read_table(spark, sf_dir, "conversations")
    p = pair_turns(c, even_only=False).where(F.col("role") == "user")
    return p.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("text").alias("dialogue"),
                    F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("section_header"),
                    F.col("next_text").alias("section_text"))


def mc_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, question, target): multiple-choice questions built from parts, with
    answers naming a key, a padded key, an exact value, a key mention, a value
    mention, or nothing."""
    p = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    q = F.concat(F.lit("Which description fits "), F.col("p_name"), F.lit("? {A: "), F.col("p_brand"),
                 F.lit(", B: "), F.col("p_type"), F.lit(", C: size "), F.col("p_size").cast("string"),
                 F.lit(", D: "), F.col("p_name"), F.lit("}"))
    m = k % 6
    tgt = (F.when(m == 0, F.lit("A")).when(m == 1, F.lit(" B ")).when(m == 2, F.col("p_type"))
           .when(m == 3, F.lit("I think C) is right"))
           .when(m == 4, F.concat(F.lit("maybe "), F.col("p_name"), F.lit(" or so")))
           .otherwise(F.lit("none of these")))
    return p.select(k.alias("id"), q.alias("question"), tgt.alias("target"))
