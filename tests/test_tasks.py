import pytest

from evalcrate.plans import tasks as TK


def test_entity_matching_by_run(spark):
    rows = [("m1", "y", "y"), ("m1", "n", "y"), ("m2", "Yes.", "y"), ("m2", "???", "n")]
    df = spark.createDataFrame(rows, "model string, response string, label string")
    metrics, preds = TK.evaluate_entity_matching(df, "response", "label", stop_tokens=".", group_cols=["model"])
    m = {r.model: r for r in metrics.collect()}
    assert (m["m1"].tp, m["m1"].fn, m["m1"].correct_fmt_total) == (1, 1, 2)
    assert (m["m2"].tp, m["m2"].unresolved, m["m2"].resolvable_total, m["m2"].unresolvable_total) == (1, 1, 1, 1)
    assert preds.count() == 4


def test_fact_checking_cleaning(spark):
    df = spark.createDataFrame([(" SUPPORTS.</s>junk", "SUPPORTS"), ("REFUTES", "REFUTES"), ("maybe", "REFUTES")],
                               "out string, gold string")
    r = TK.evaluate_fact_checking(df, "out", "gold", remove_suffix="</s>", stop_tokens=".").first()
    assert r.accuracy == pytest.approx(2 / 3)


def test_toxicity_and_qa(spark):
    df = spark.createDataFrame([("yes", "Y", 0.9, 0.0), ("no", "Y", 0.9, 0.9), ("no", "N", 0.0, 0.9)],
                               "response string, label string, male double, female double")
    r = TK.evaluate_toxicity(df, "response", "label").first()
    assert r.accuracy == pytest.approx(2 / 3) and r.wga == 0.0 and (r.worst_group, r.worst_label) == ("female", 1)
    qa = spark.createDataFrame([("The Cat</s>", "cat"), ("dog", "a cat")], "p string, g string")
    q = TK.evaluate_qa(qa, "p", "g", remove_suffix="</s>").first()
    assert q.exact_match == 0.5 and q.squad_f1_score == pytest.approx(0.5)


def test_evaluate_summaries_with_rouge_l(spark):
    import pytest
    from pyref import rouge_l, rouge_n
    rows = [("the cat sat on the mat", "the cat lay on a mat"), ("a b\nc d", "c d\na b"), ("", "x")]
    df = spark.createDataFrame(rows, "pred string, ref string")
    r = TK.evaluate_summaries(df, "pred", "ref").first()
    assert r.rougeL == pytest.approx(sum(rouge_l(p, g) for p, g in rows) / 3)
    assert r.rouge1 == pytest.approx(sum(rouge_n(p, g, 1) for p, g in rows) / 3)
    assert r.bleu is not None and r.exact_match is None
