import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalcrate.functions.bags import bag_overlap
from evalcrate.operators import overlap as O
from evalcrate.operators.lcs import lcs_length, rouge_l_scores, summary_lcs_hits
from pyref import corpus_bleu, f1_agree, f1_zero, lcs_dp, rouge_n

PAIRS = [("The cat sat", "the cat sat"), ("", ""), ("", "x"), ("a an the", ""), ("b b b a", "b a a"),
         ("Paris, France", "paris"), ("one two three four five", "two three four"),
         ("café au lait", "Café noir"), ("x y z", "p q r"), ("Yes", "yes!")]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(PAIRS)], "id int, pred string, ref string")


def _lcs_positions_table(ref, can) -> list[int]:
    """Reference form of :func:`_lcs_positions` with the full table (tests)."""
    n, m = len(ref), len(can)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        ri, row, prev = ref[i - 1], t[i], t[i - 1]
        for j in range(1, m + 1):
            row[j] = prev[j - 1] + 1 if ri == can[j - 1] else (row[j - 1] if row[j - 1] > prev[j] else prev[j])
    i, j, out = n, m, []
    while i > 0 and j > 0:
        if ref[i - 1] == can[j - 1]:
            out.append(i - 1)
            i -= 1
            j -= 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    out.reverse()
    return out


def test_bag_overlap_matches_counter(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(200):
        a = [rnd.choice("abcde") for _ in range(rnd.randint(0, 12))]
        b = [rnd.choice("abcdef") for _ in range(rnd.randint(0, 12))]
        rows.append((i, a, b, sum((Counter(a) & Counter(b)).values())))
    df = spark.createDataFrame(rows, "id int, a array<string>, b array<string>, want long")
    bad = df.where(bag_overlap("a", "b") != F.col("want")).count()
    assert bad == 0


def test_token_f1_policies(pairs):
    s = O.pair_token_scores(pairs).collect()
    for r in s:
        p, g = PAIRS[r.id]
        assert r.f1 == pytest.approx(f1_agree(g, p))
        assert r.f1_strict == pytest.approx(f1_zero(p, g))
        assert 0.0 <= r.f1 <= 1.0


def test_f1_symmetric(spark, pairs):
    sw = pairs.select("id", F.col("ref").alias("pred"), F.col("pred").alias("ref"))
    a = {r.id: r.f1 for r in O.pair_token_scores(pairs).collect()}
    b = {r.id: r.f1 for r in O.pair_token_scores(sw).collect()}
    assert a == pytest.approx(b)


def test_rouge_n_and_self(pairs):
    s = O.rouge_n_scores(pairs, orders=(1, 2)).collect()
    for r in s:
        p, g = PAIRS[r.id]
        assert r.rouge1 == pytest.approx(rouge_n(p, g, 1))
        assert r.rouge2 == pytest.approx(rouge_n(p, g, 2))
    same = pairs.select("id", F.col("ref").alias("pred"), "ref").where(F.length("ref") > 0)
    assert all(r.rouge1 == pytest.approx(1.0) for r in O.rouge_n_scores(same, orders=(1,)).collect()
               if r.rouge1 is not None and any(c.isalnum() for c in PAIRS[r.id][1]))


def test_bleu_whitespace_matches_python(pairs):
    got = O.corpus_bleu(pairs, tokenizer="whitespace").first()
    want = corpus_bleu([p.split() for p, _ in PAIRS], [r.split() for _, r in PAIRS])
    assert got.bleu == pytest.approx(want)


def test_bleu_13a_tokenizer(spark):
    df = spark.createDataFrame([("Hello, world. It costs 3.50-4 dollars & more!",)], "s string")
    toks = list(df.select(O.bleu_13a_tokens("s").alias("t")).first().t)
    assert toks == ["Hello", ",", "world", ".", "It", "costs", "3.50", "-", "4", "dollars", "&", "more", "!"]


def test_lcs_bitparallel_matches_dp():
    rnd = random.Random(5)
    for _ in range(300):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
        b = [rnd.choice("abcde") for _ in range(rnd.randint(0, 30))]
        assert lcs_length(a, b) == lcs_dp(a, b)


def test_rouge_lsum_known_value():
    # one reference sentence against two candidate sentences: union LCS covers a, b, c
    hits, n, m = summary_lcs_hits([["a", "b", "c", "d"]], [["a", "b"], ["c", "x"]])
    assert (hits, n, m) == (3, 4, 4)


def test_rouge_l_udf(pairs):
    rows = rouge_l_scores(pairs).collect()
    for r in rows:
        p, g = PAIRS[r.id]
        from pyref import rouge_tokens
        pt, gt = rouge_tokens(p), rouge_tokens(g)
        lcs = lcs_dp(pt, gt)
        if not pt or not gt or lcs == 0:
            assert r.rougeL.fmeasure == 0.0
        else:
            pr, rc = lcs / len(pt), lcs / len(gt)
            assert r.rougeL.fmeasure == pytest.approx(2 * pr * rc / (pr + rc))


def test_lcs_positions_bitvector_equals_table():
    from evalcrate.operators.lcs import _lcs_positions
    rnd = random.Random(9)
    for _ in range(400):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 25))]
        b = [rnd.choice("abcde") for _ in range(rnd.randint(0, 25))]
        assert _lcs_positions(a, b) == _lcs_positions_table(a, b)


def test_intersect_all_equals_sum_of_least(spark):
    rnd = random.Random(11)
    rows_a, rows_b, want = [], [], {}
    for i in range(60):
        a = [rnd.choice("xyzw") for _ in range(rnd.randint(0, 9))]
        b = [rnd.choice("xyzv") for _ in range(rnd.randint(0, 9))]
        rows_a += [(i, t) for t in a]
        rows_b += [(i, t) for t in b]
        s = sum((Counter(a) & Counter(b)).values())
        if s:
            want[i] = s
    da = spark.createDataFrame(rows_a, "id int, token string")
    db = spark.createDataFrame(rows_b, "id int, token string")
    got = {r.id: r.overlap for r in O.token_overlap_intersect_all(da, db, "id", "token").collect()}
    assert got == want


def _py_13a(line):
    import re
    line = line.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        line = line.replace(a, b)
    line = f" {line} "
    for pat, rep in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
                     (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        line = re.sub(pat, rep, line)
    return line.split()


def test_bleu_13a_random_parity(spark):
    rnd = random.Random(21)
    alphabet = list("ab1 2.,-!?&;:/\"'()[]{}~`@#$%^*+=<>\n") + ["&amp;", "&lt;", "<skipped>", "-\n", "3.5", "é"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    got = {r.id: list(r.t) for r in df.select("id", O.bleu_13a_tokens("s").alias("t")).collect()}
    bad = [t for i, t in enumerate(texts) if got[i] != _py_13a(t)]
    assert not bad, bad[:3]


def test_rouge_tokens_random_parity(spark):
    from pyref import rouge_tokens as py_rouge_tokens
    rnd = random.Random(23)
    alphabet = list("aZ9 ,.-_\n\t") + ["É", "é", "ß", "İ", "Ω", "ﬁ", "Ǆ", "²", "Ⅻ"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    got = {r.id: list(r.t) for r in df.select("id", O.rouge_tokens("s").alias("t")).collect()}
    bad = [t for i, t in enumerate(texts) if got[i] != py_rouge_tokens(t)]
    assert not bad, bad[:3]
