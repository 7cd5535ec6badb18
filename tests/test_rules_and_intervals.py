"""Role rules, packing of calls, null prompts, and the bag of little bootstraps."""

import random

import pytest
from pyspark.sql import functions as F

from evalcrate.operators import overlap as O
from evalcrate.operators import prompts as P
from evalcrate.operators import runs as RU
from evalcrate.operators import scoring as S

CHAT = "id int, messages array<struct<role: string, content: string>>"


def plain_fault(messages, system=True):
    if not messages:
        return "no messages"
    want = "user"
    for i, (role, content) in enumerate(messages):
        if role == "system" and i == 0 and system:
            if content is None:
                return f"message {i}: no content"
            continue
        if role == "system":
            return f"message {i}: " + ("system message not at the start" if system else "system message")
        if role not in ("user", "assistant"):
            return f"message {i}: unknown role {role if role is not None else 'null'}"
        if role != want:
            return f"message {i}: {role} where {want} is expected"
        if content is None:
            return f"message {i}: no content"
        want = "assistant" if want == "user" else "user"
    return None


def test_role_faults(spark):
    rng = random.Random(10)
    rows = [(i, [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(["x", "y", None, ""]) if rng.random() < 0.3 else "x")
                 for _ in range(rng.randrange(5))]) for i in range(300)]
    rows += [(1000 + n, [("system", "s")] * (n % 2) + [(("user", "assistant")[i % 2], "t") for i in range(n)]) for n in range(1, 30)] + [(2000, None)]
    df = spark.createDataFrame(rows, CHAT)
    by = dict(rows)
    for system in (True, False):
        for r in P.checked_render(df, "messages", system=system).collect():
            assert r.fault == plain_fault(by[r.id], system)
            assert (r.text is None) == (r.fault is not None)


def test_packing():
    rng = random.Random(11)
    for _ in range(50):
        tokens = [rng.randrange(0, 60) for _ in range(rng.randrange(200))]
        lists = S.packed(tokens, 100, 16)
        assert sorted(i for x in lists for i in x) == list(range(len(tokens)))
        assert all(sum(tokens[i] for i in x) <= 100 and len(x) <= 16 for x in lists)
    sizes = [60] * 10 + [40] * 10
    assert len(S.packed(sizes, 100, 64)) == 10


def test_budget_and_null_prompts(spark, tmp_path):
    rows = [(i, " ".join(["w"] * (i % 50 + 1))) for i in range(400)] + [(1000, None), (1001, "w " * 500), (1002, "")]

    def fn(texts):
        total = sum(len(t.split()) for t in texts)
        if total > 100:
            raise ValueError(f"call of {total} tokens")
        return [f"{len(texts)}:{t}" for t in texts]
    df = spark.createDataFrame(rows, "id long, p string").coalesce(1)
    got = {r.id: r for r in S.score_fn(df, fn, "id", "p", token_budget=100).collect()}
    assert len(got) == len(rows)
    assert (got[1000].output, got[1000].error) == (None, "null prompt")
    assert got[1001].output is None and got[1001].error == "500 tokens, more than the budget of 100"
    for i, p in rows[:400]:
        assert got[i].error is None and got[i].output.split(":", 1)[1] == p
    plain = {r.id: r for r in S.score_fn(df.where("id >= 1000"), lambda ts: ts, "id", "p").collect()}
    assert plain[1000].error == "null prompt" and plain[1001].output.startswith("w")


def test_bag_of_little_bootstraps(spark):
    rng = random.Random(15)
    rows = [(i, min(1.0, max(0.0, rng.gauss(0.4, 0.2)))) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, v double")
    wide = RU.bootstrap_mean(df, "id", "v", replicates=300, seed=5).first()
    ratio = F.col("v") / F.col("weight")
    got = RU.bootstrap_interval(df, "id", ["v"], ratio, seed=5, replicates=200).first()
    assert got.subsets == 4
    assert abs(got.mid - wide.mid) < 0.002
    assert got.high - got.low == pytest.approx(wide.high - wide.low, rel=0.2)
    for a, b in ((got.low, wide.low), (got.high, wide.high)):
        assert a == pytest.approx(b, rel=0.05)
    again = RU.bootstrap_interval(df.repartition(7), "id", ["v"], ratio, seed=5, replicates=200).first()
    assert (again.low, again.high) == pytest.approx((got.low, got.high), abs=1e-12)


def test_bleu_of_sums_is_corpus_bleu(spark):
    rows = [(i, f"the cat number {i} sat on the mat" + " x" * (i % 5), f"the cat {i} sat on the mat today") for i in range(80)]
    df = spark.createDataFrame(rows, "id int, pred string, ref string")
    sums = O.bleu_counters(df, keep=["id"]).agg(*[F.sum(c).alias(c) for c in ("tl", "rl", *[f"{x}{n}" for n in range(1, 5) for x in "mc"])])
    whole = O.corpus_bleu(df).first().bleu
    assert sums.select(O.bleu_of_sums()).first()[0] == pytest.approx(whole)
    names = ["tl", "rl", *[f"{x}{n}" for n in range(1, 5) for x in "mc"]]
    r = RU.bootstrap_interval(O.bleu_counters(df, keep=["id"]), "id", names, O.bleu_of_sums(), seed=1).first()
    assert r.low <= whole <= r.high and r.low < r.high
