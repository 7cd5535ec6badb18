import json

import pytest

from evalcrate.operators import qa as Q

DOC = {
    "p1": {"qas": [
        {"question_id": "q1", "answers": [
            {"annotation_id": "a1", "answer": {"unanswerable": True, "extractive_spans": [], "free_form_answer": "", "yes_no": None}},
            {"annotation_id": "a2", "answer": {"unanswerable": False, "extractive_spans": ["x", "y"], "free_form_answer": "", "yes_no": None}},
            {"annotation_id": "a3", "answer": {"unanswerable": False, "extractive_spans": [], "free_form_answer": "free text", "yes_no": None}}]},
        {"question_id": "q2", "answers": [
            {"annotation_id": "a4", "answer": {"unanswerable": False, "extractive_spans": [], "free_form_answer": "", "yes_no": True}},
            {"annotation_id": "a5", "answer": {"unanswerable": False, "extractive_spans": [], "free_form_answer": "", "yes_no": False}}]}]},
}
BAD = {"p9": {"qas": [{"question_id": "q9", "answers": [
    {"annotation_id": "bad", "answer": {"unanswerable": False, "extractive_spans": [], "free_form_answer": "", "yes_no": None}}]}]}}


def test_nested_gold_all_branches(spark, tmp_path):
    path = tmp_path / "gold.json"
    path.write_text(json.dumps(DOC, indent=2))
    refs = Q.resolve_references(Q.scan_nested_qa(spark, str(path), whole_file=True))
    got = sorted((r.question_id, r.ref_pos, r.answer, r.type) for r in refs.collect())
    assert got == [("q1", 0, "Unanswerable", "none"), ("q1", 1, "x, y", "extractive"),
                   ("q1", 2, "free text", "abstractive"), ("q2", 0, "Yes", "boolean"), ("q2", 1, "No", "boolean")]


def test_nested_gold_json_lines(spark, tmp_path):
    path = tmp_path / "gold.jsonl"
    path.write_text(json.dumps(DOC) + "\n" + json.dumps({"p2": DOC["p1"]}) + "\n")
    assert Q.resolve_references(Q.scan_nested_qa(spark, str(path))).count() == 10


def test_nested_gold_without_answer_fails(spark, tmp_path):
    path = tmp_path / "bad.json"
    path.write_text(json.dumps(BAD))
    with pytest.raises(Exception, match="no answer of any type"):
        Q.resolve_references(Q.scan_nested_qa(spark, str(path))).collect()


def test_best_reference_first_on_ties_and_buckets(spark):
    gold = spark.createDataFrame([("q1", 0, "red apple", "extractive"), ("q1", 1, "red apple", "abstractive"),
                                  ("q2", 0, "Unanswerable", "none"), ("q3", 0, "blue", "boolean")],
                                 "question_id string, ref_pos long, answer string, type string")
    pred = spark.createDataFrame([("q1", "Red apple</s>"), ("q2", "unanswerable")], "question_id string, prediction string")
    best = Q.best_reference(Q.reference_scores(gold, pred))
    rows = {r.question_id: r for r in best.collect()}
    assert rows["q1"].type == "extractive" and rows["q1"].best_f1 == 1.0
    m = Q.f1_by_type(best).first()
    assert m.n == 2 and m.answer_f1_boolean == 0.0          # empty bucket -> 0.0
    a = Q.answerability(best).first()
    assert a.answerability_all == 0.5 and a.noans_none == 1.0 and a.answerability_has == 0.0
    miss = Q.missing_predictions(gold, pred).first()
    assert (miss.missing, miss.scored) == (1, 2)


def test_best_reference_per_run(spark):
    gold = spark.createDataFrame([("q1", 0, "red", "extractive"), ("q1", 1, "blue", "boolean")],
                                 "question_id string, ref_pos long, answer string, type string")
    pred = spark.createDataFrame([("r1", "q1", "red"), ("r2", "q1", "blue")], "run string, question_id string, prediction string")
    sc = Q.reference_scores(gold, pred)
    best = Q.best_reference(sc, ["run", "question_id"])
    m = {r.run: r for r in Q.f1_by_type(best, group_cols=["run"]).collect()}
    assert m["r1"].answer_f1_extractive == 1.0 and m["r2"].answer_f1_boolean == 1.0


def test_dedupe_predictions_last_write_wins(spark):
    preds = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 3), ("q1", "c", 2), ("q2", "z", 1)],
                                  "question_id string, prediction string, seq int")
    got = {r.question_id: r.prediction for r in Q.dedupe_predictions(preds, "question_id", "seq").collect()}
    assert got == {"q1": "b", "q2": "z"}
