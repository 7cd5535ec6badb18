"""Overlap-family queries over ``text_pairs`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalcrate.functions import text as T
from evalcrate.functions.bags import bag_overlap
from evalcrate.operators import overlap as O
from evalcrate.plans import duck as D
from evalcrate.plans.fixture_sql import with_fixtures
from evalcrate.plans.registry import register, rounded
from evalcrate.sources import fixtures as FX
from evalcrate.sources.readers import read_table

_PAIR_SQL = with_fixtures("text_pairs", extra=f"""
t AS (SELECT id, {D.tokens('pred')} AS pt, {D.tokens('ref')} AS rt FROM text_pairs),
s AS (SELECT id, pt, rt, len(pt) AS np, len(rt) AS nr, {D.bag_overlap('pt', 'rt')} AS same FROM t)""")


@register("normalize_answer", f"SELECT doc_id, {D.normalize('text')} AS norm FROM documents")
def q_normalize_answer(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.normalize_answer("text").alias("norm"))


@register("get_tokens", f"SELECT doc_id, CAST(len({D.tokens('text')}) AS INTEGER) AS n_tokens FROM documents")
def q_get_tokens(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(T.answer_tokens("text")).alias("n_tokens"))


@register("token_overlap", _PAIR_SQL + "SELECT id, CAST(same AS BIGINT) AS overlap FROM s")
def q_token_overlap(spark, sf_dir):
    df = FX.text_pairs(spark, sf_dir)
    return df.select("id", bag_overlap(T.answer_tokens("pred"), T.answer_tokens("ref")).alias("overlap"))


@register("intersect_all", with_fixtures("text_pairs") + f"""
SELECT id, count(*) AS overlap FROM (
  SELECT id, unnest({D.tokens('pred')}) AS token FROM text_pairs
  INTERSECT ALL
  SELECT id, unnest({D.tokens('ref')}) AS token FROM text_pairs) x
GROUP BY id""")
def q_intersect_all(spark, sf_dir):
    df = FX.text_pairs(spark, sf_dir)
    a = df.select("id", F.explode(T.answer_tokens("pred")).alias("token"))
    b = df.select("id", F.explode(T.answer_tokens("ref")).alias("token"))
    return O.token_overlap_intersect_all(a, b, "id", "token")


@register("exact_match", _PAIR_SQL + f"""
SELECT count(*) AS n, {D.r6("avg(CAST(array_to_string(pt, ' ') = array_to_string(rt, ' ') AS DOUBLE))", 'exact_match')}
FROM s""")
def q_exact_match(spark, sf_dir):
    return rounded(O.exact_match(FX.text_pairs(spark, sf_dir)))


@register("token_f1", _PAIR_SQL + f"""
SELECT count(*) AS n, {D.r6('''avg(CASE WHEN np = 0 OR nr = 0 THEN CAST(np = 0 AND nr = 0 AS DOUBLE)
                                         WHEN same > 0 THEN 2.0 * same / (np + nr) ELSE 0.0 END)''', 'token_f1')}
FROM s""")
def q_token_f1(spark, sf_dir):
    return rounded(O.token_f1(FX.text_pairs(spark, sf_dir), empty_policy="agree"))


@register("token_f1_strict", _PAIR_SQL + f"""
SELECT count(*) AS n, {D.r6('avg(CASE WHEN same > 0 THEN 2.0 * same / (np + nr) ELSE 0.0 END)', 'token_f1')}
FROM s""")
def q_token_f1_strict(spark, sf_dir):
    return rounded(O.token_f1(FX.text_pairs(spark, sf_dir), empty_policy="zero"))


def _duck_ngrams(t: str, n: int) -> str:
    if n == 1:
        return t
    return f"list_transform(range(1, len({t}) - {n - 2}), lambda i: array_to_string({t}[i:i + {n - 1}], ' '))"


_ROUGE_SQL = with_fixtures("text_pairs", extra=f"""
t AS (SELECT id, regexp_extract_all(lower(pred), '{O.ROUGE_TOKEN}') AS pt,
             regexp_extract_all(lower(ref), '{O.ROUGE_TOKEN}') AS rt FROM text_pairs),
g AS (SELECT id, pt AS p1, rt AS r1, {_duck_ngrams('pt', 2)} AS p2, {_duck_ngrams('rt', 2)} AS r2 FROM t),
s AS (SELECT id, {D.bag_overlap('p1', 'r1')} AS o1, len(p1) AS np1, len(r1) AS nr1,
             {D.bag_overlap('p2', 'r2')} AS o2, len(p2) AS np2, len(r2) AS nr2 FROM g)""")


@register("rouge_n", _ROUGE_SQL + f"""
SELECT count(*) AS n,
       {D.r6('avg(CASE WHEN o1 > 0 THEN 2.0 * o1 / (np1 + nr1) ELSE 0.0 END)', 'rouge1')},
       {D.r6('avg(CASE WHEN o2 > 0 THEN 2.0 * o2 / (np2 + nr2) ELSE 0.0 END)', 'rouge2')}
FROM s""")
def q_rouge_n(spark, sf_dir):
    return rounded(O.rouge_n(FX.text_pairs(spark, sf_dir), orders=(1, 2)))


def _duck_13a(x: str) -> str:
    e = f"coalesce({x}, '')"
    for a, b in O.BLEU_13A_REPLACE:
        a_sql = a.replace("'", "''").replace("\n", "' || chr(10) || '")
        b_sql = b.replace("'", "''").replace("\n", "' || chr(10) || '")
        e = f"replace({e}, '{a_sql}', '{b_sql}')"
    e = f"(' ' || {e} || ' ')"
    for pat, rep in O.BLEU_13A_REGEX:
        e = f"regexp_replace({e}, '{pat}', '{rep.replace('$', chr(92))}', 'g')"
    return f"list_filter(regexp_split_to_array({e}, '{D.WS_RE}+'), lambda w: w <> '')"


def _duck_ws(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{D.WS_RE}+'), lambda w: w <> '')"


def _bleu_sql(tok) -> str:
    per = ", ".join(
        f"{D.bag_overlap(_duck_ngrams('pt', n), _duck_ngrams('rt', n))} AS m{n}, greatest(len(pt) - {n - 1}, 0) AS c{n}"
        for n in range(1, 5))
    sums = ", ".join(f"CAST(sum(m{n}) AS BIGINT) AS matches_{n}, CAST(sum(c{n}) AS BIGINT) AS possible_{n}"
                     for n in range(1, 5))
    precs = ", ".join(f"CASE WHEN possible_{n} > 0 THEN matches_{n} / possible_{n} ELSE 0.0 END AS precision_{n}"
                      for n in range(1, 5))
    pl = ", ".join(f"precision_{n}" for n in range(1, 5))
    geo = (f"CASE WHEN least({pl}) > 0 THEN exp((ln(precision_1) + ln(precision_2) + ln(precision_3) "
           f"+ ln(precision_4)) / 4) ELSE 0.0 END")
    ratio = "translation_length / reference_length"
    bp = f"CASE WHEN {ratio} > 1.0 THEN 1.0 ELSE exp(1 - 1.0 / ({ratio})) END"
    return with_fixtures("text_pairs", extra=f"""
t AS (SELECT id, {tok('pred')} AS pt, {tok('ref')} AS rt FROM text_pairs),
s AS (SELECT len(pt) AS tl, len(rt) AS rl, {per} FROM t),
a AS (SELECT CAST(sum(tl) AS BIGINT) AS translation_length, CAST(sum(rl) AS BIGINT) AS reference_length, {sums} FROM s),
p AS (SELECT *, {precs} FROM a)""") + f"""
SELECT {D.r6(f'({geo}) * ({bp})', 'bleu')}, {', '.join(D.r6(f'precision_{n}', f'precision_{n}') for n in range(1, 5))},
       {D.r6(bp, 'brevity_penalty')}, {D.r6(ratio, 'length_ratio')}, translation_length, reference_length,
       {', '.join(f'matches_{n}' for n in range(1, 5))}, {', '.join(f'possible_{n}' for n in range(1, 5))}
FROM p"""


@register("corpus_bleu", _bleu_sql(_duck_13a))
def q_corpus_bleu(spark, sf_dir):
    return rounded(O.corpus_bleu(FX.text_pairs(spark, sf_dir), tokenizer="13a"))


@register("corpus_bleu_whitespace", _bleu_sql(_duck_ws))
def q_corpus_bleu_ws(spark, sf_dir):
    return rounded(O.corpus_bleu(FX.text_pairs(spark, sf_dir), tokenizer="whitespace"))
