"""Seeded random strings: Spark normalisation and token F1 equal the Python definitions."""

import random

import pytest

from evalcrate.functions import text as T
from evalcrate.operators import overlap as O
from pyref import f1_agree, get_tokens, normalize_answer

ALPHABET = (list("abcdefghijklmnopqrstuvwxyzABCXYZ0123456789") + list(" \t\n") + list(".,;:!?'\"-()[]_/")
            + ["the", "a", "an", "The", "An", "é", "ü", "ß", "ç", " ", " ", "\x1c", "—", "«", "»", "¿"])


def _rand_text(rnd):
    return "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40)))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(2024)
    return [(i, _rand_text(rnd), _rand_text(rnd)) for i in range(400)]


def test_normalize_random(spark, texts):
    df = spark.createDataFrame(texts, "id int, a string, b string")
    got = {r.id: (r.n, list(r.t)) for r in df.select("id", T.normalize_answer("a").alias("n"),
                                                     T.answer_tokens("a").alias("t")).collect()}
    bad = [(a, got[i]) for i, a, _ in texts if got[i] != (normalize_answer(a), get_tokens(a))]
    assert not bad, bad[:3]


def test_token_f1_random(spark, texts):
    df = spark.createDataFrame(texts, "id int, pred string, ref string")
    got = {r.id: r.f1 for r in O.pair_token_scores(df).collect()}
    bad = [(p, r) for i, p, r in texts if got[i] != pytest.approx(f1_agree(r, p))]
    assert not bad, bad[:3]
