import pytest

from evalcrate.operators import classify as C


def test_all_unresolved_gives_null_scores(spark):
    df = spark.createDataFrame([(i, "maybe", "y") for i in range(5)], "id int, response string, truth string")
    m = C.em_confusion(C.clean_binary_responses(df, "response", "truth")).first()
    assert (m.n, m.tp, m.fp, m.unresolved) == (5, 0, 0, 5)
    assert m.accuracy == 0.0 and m.precision is None and m.recall is None and m.f1 is None


def test_format_rates_fixed_dimension(spark):
    df = spark.createDataFrame([(1, "y", "y"), (2, "n", "y")], "id int, response string, truth string")
    r = C.em_format_rates(C.clean_binary_responses(df, "response", "truth")).first()
    assert r.correct_fmt_total == 2 and r.unresolvable_total == 0 and r.resolvable_rate == 0.0


def _weighted_py(gold, pred):
    classes = sorted(set(gold) | set(pred))
    n = len(gold)
    p = r = f = 0.0
    for c in classes:
        tp = sum(1 for g, q in zip(gold, pred) if g == q == c)
        sup = sum(1 for g in gold if g == c)
        prd = sum(1 for q in pred if q == c)
        pc = tp / prd if prd else 0.0
        rc = tp / sup if sup else 0.0
        fc = 2 * pc * rc / (pc + rc) if pc + rc else 0.0
        p, r, f = p + sup * pc, r + sup * rc, f + sup * fc
    return p / n, r / n, f / n


def test_weighted_prf_matches_definition(spark):
    gold = ["A", "A", "B", "C", "C", "C", "B", "A"]
    pred = ["A", "B", "B", "C", "X", "C", "A", "A"]
    df = spark.createDataFrame(list(zip(range(8), gold, pred)), "id int, gold string, pred string")
    r = C.weighted_prf(df, "gold", "pred", ["A", "B", "C"]).first()
    enc = lambda v: {"A": 0, "B": 1, "C": 2}.get(v, 3)
    p, rc, f = _weighted_py([enc(g) for g in gold], [enc(q) for q in pred])
    assert (r.precision, r.recall, r.f1) == pytest.approx((p, rc, f))
    assert r.accuracy == pytest.approx(rc)


def test_worst_group_ignores_empty_cell(spark):
    rows = [(1, 1, 1, 0.9, 0.0), (2, 0, 1, 0.9, 0.0), (3, 0, 0, 0.1, 0.8)]
    df = spark.createDataFrame(rows, "id int, pred int, label int, male double, female double")
    cells = {(r.group, r.label): r.accuracy for r in C.group_accuracy_cells(df, ["male", "female"]).collect()}
    assert ("female", 1) not in cells
    w = C.worst_group_accuracy(df, ["male", "female"]).first()
    assert w.wga == 0.5 and (w.worst_group, w.worst_label) == ("male", 1)


def test_binary_f1_zero_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "pred int, label int")
    r = C.binary_acc_f1(df).first()
    assert r.accuracy == 1.0 and r.f1 == 0.0


def test_confusion_counts_bounded(spark):
    import random
    rnd = random.Random(8)
    words = ["y", "n", "yes", "no", "maybe", "Y.", "the n", ""]
    rows = [(i, rnd.choice(words), rnd.choice(["y", "n", "x"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, response string, truth string")
    m = C.em_metrics(C.clean_binary_responses(df, "response", "truth")).first()
    assert m.tp + m.fp + m.fn + m.tn <= m.n
    assert m.unresolvable_total + m.resolvable_total + m.correct_fmt_total == m.n
