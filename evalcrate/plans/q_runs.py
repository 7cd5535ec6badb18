"""Run-level, heavy per-pair and scoring queries: M14, M15, M17, M18, M22, M23,
U1, U3, J3, J4, K3."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evalcrate.operators import lcs as L
from evalcrate.operators import greedy as G
from evalcrate.operators import prompts as P
from evalcrate.operators import runs as RU
from evalcrate.operators import scoring as S
from evalcrate.operators.classify import em_confusion
from evalcrate.operators.overlap import rouge_n_scores
from evalcrate.plans import duck as D
from evalcrate.plans.fixture_sql import with_fixtures
from evalcrate.plans.q_classify import em_scored
from evalcrate.plans.q_overlap import _ROUGE_SQL  # noqa: F401  (also registers the overlap oracles)
from evalcrate.plans.registry import register, rounded
from evalcrate.session import ensure_checkpoint_dir
from evalcrate.sinks.writers import write_metrics
from evalcrate.sources import fixtures as FX
from evalcrate.sources.readers import read_table


@register("run_matrix", with_fixtures("run_events") + f"""
SELECT model, shots, CAST(GROUPING(model, shots) AS INTEGER) AS level, count(*) AS n,
       {D.r6('count_if(pred = gold) / count(*)', 'accuracy')},
       {D.r6('''CASE WHEN 2 * count_if(pred = 1 AND gold = 1) + count_if(pred = 1 AND gold <> 1) + count_if(pred <> 1 AND gold = 1) > 0
                 THEN 2.0 * count_if(pred = 1 AND gold = 1) / (2 * count_if(pred = 1 AND gold = 1)
                      + count_if(pred = 1 AND gold <> 1) + count_if(pred <> 1 AND gold = 1)) ELSE 0.0 END''', 'f1')}
FROM run_events GROUP BY ROLLUP (model, shots)""")
def q_run_matrix(spark, sf_dir):
    return rounded(RU.run_matrix(FX.run_events(spark, sf_dir), ["model", "shots"]))


@register("run_duration", with_fixtures("run_events") + f"""
SELECT model, {D.r6('(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6', 'duration_sec')} FROM run_events GROUP BY model""")
def q_run_duration(spark, sf_dir):
    return rounded(RU.run_duration(FX.run_events(spark, sf_dir), ["model"]))


@register("metric_switches",
          _ROUGE_SQL + f""",
f AS (SELECT id, {D.tokens('pred')} AS pt, {D.tokens('ref')} AS rt FROM text_pairs),
ff AS (SELECT id, CASE WHEN {D.bag_overlap('pt', 'rt')} > 0 THEN 2.0 * {D.bag_overlap('pt', 'rt')} / (len(pt) + len(rt)) ELSE 0.0 END AS f1 FROM f)
SELECT count(*) AS n,
       {D.r6('avg(CASE WHEN o1 > 0 THEN 2.0 * o1 / (np1 + nr1) ELSE 0.0 END)', 'rouge1')},
       {D.r6('avg(CASE WHEN o2 > 0 THEN 2.0 * o2 / (np2 + nr2) ELSE 0.0 END)', 'rouge2')},
       CAST(NULL AS DOUBLE) AS bleu, {D.r6('avg(ff.f1)', 'token_f1')}, CAST(NULL AS DOUBLE) AS exact_match
FROM s JOIN ff USING (id)""")
def q_metric_switches(spark, sf_dir):
    return rounded(RU.summary_metrics(FX.text_pairs(spark, sf_dir), rouge=True, bleu=False, f1=True, exact=False))


def _summary_all_sql() -> str:
    from evalcrate.plans.registry import ORACLE
    parts = {"n": "rouge_n", "rouge1": "rouge_n", "rouge2": "rouge_n", "bleu": "corpus_bleu",
             "token_f1": "token_f1_strict", "exact_match": "exact_match"}
    cols = [f"(SELECT {c} FROM ({ORACLE[k]}) x) AS {c}" for c, k in parts.items()]
    return "SELECT " + ",\n       ".join(cols)


@register("summary_metrics_all", _summary_all_sql())  # one pass; oracle = the single-metric oracles
def q_summary_metrics_all(spark, sf_dir):
    return rounded(RU.summary_metrics(FX.text_pairs(spark, sf_dir)))


def _bootstrap_sql() -> str:
    cdf = ", ".join(repr(c) for c in RU.poisson_cdf())
    return _ROUGE_SQL + f""",
v AS (SELECT id, CASE WHEN o1 > 0 THEN 2.0 * o1 / (np1 + nr1) ELSE 0.0 END AS v FROM s),
u AS (SELECT b, v, CAST('0x' || substr(md5(id || ':' || b || ':11'), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
      FROM v, (SELECT unnest(range(0, 200)) AS b) x),
w AS (SELECT b, v, len(list_filter([{cdf}], lambda c: u >= c)) AS w FROM u),
m AS (SELECT b, sum(w * v) / sum(w) AS m FROM w GROUP BY b)
SELECT count(*) AS replicates, {D.r6('quantile_cont(m, 0.025)', 'low')}, {D.r6('quantile_cont(m, 0.5)', 'mid')},
       {D.r6('quantile_cont(m, 0.975)', 'high')} FROM m"""


@register("bootstrap_mean", _bootstrap_sql())
def q_bootstrap_mean(spark, sf_dir):
    s = rouge_n_scores(FX.text_pairs(spark, sf_dir), orders=(1,))
    return rounded(RU.bootstrap_mean(s, "id", "rouge1", replicates=200, seed=11))


# LCS by patience piles over the match positions of every token, last position first
_LCS_SQL = """
k AS (SELECT id, regexp_extract_all(lower(coalesce(pred, '')), '[a-z0-9]+') AS p, regexp_extract_all(lower(coalesce(ref, '')), '[a-z0-9]+') AS r FROM text_pairs),
h AS (SELECT id, len(p) AS np, len(r) AS nr, flatten(list_transform(p, lambda t: list_reverse(list_filter(
      list_transform(range(1, len(r) + 1), lambda i: CASE WHEN r[i] = t THEN i END), lambda i: i IS NOT NULL)))) AS hits FROM k),
l AS (SELECT id, np, nr, CAST(len(list_reduce(list_transform(hits, lambda x: [x]), lambda tops, x: list_concat(list_concat(
      list_filter(tops, lambda t: t < x[1]), x), list_filter(tops, lambda t: t >= x[1])[2:]), CAST([] AS BIGINT[]))) AS INTEGER) AS lcs FROM h),
f AS (SELECT id, lcs, CASE WHEN np > 0 THEN lcs / np ELSE 0 END AS precision, CASE WHEN nr > 0 THEN lcs / nr ELSE 0 END AS recall FROM l)"""


@register("rouge_l", with_fixtures("text_pairs", extra=_LCS_SQL) + """
SELECT count(*) AS n, round(avg(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END), 6) AS "rougeL" FROM f""")
def q_rouge_l(spark, sf_dir):
    return rounded(L.rouge_l(FX.text_pairs(spark, sf_dir)))


@register("rouge_l_native", with_fixtures("text_pairs", extra=_LCS_SQL) + """
SELECT id, lcs, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS fmeasure FROM f""")
def q_rouge_l_native(spark, sf_dir):
    return rounded(L.rouge_l_native(FX.text_pairs(spark, sf_dir)).select("id", "lcs", "precision", "recall", "fmeasure"))


@register("rouge_lsum")  # union LCS over lines: checked against a plain-Python version in tests
def q_rouge_lsum(spark, sf_dir):
    return rounded(L.rouge_l(FX.text_pairs(spark, sf_dir), lsum=True))


@register("greedy_match_score", with_fixtures("token_vectors", extra="""
v AS (SELECT pair_id, vec_id, side, CAST(embedding AS DOUBLE[]) AS e FROM token_vectors),
pr AS (SELECT a.pair_id, a.vec_id, max(list_cosine_similarity(a.e, b.e)) AS best
       FROM v a JOIN v b ON a.pair_id = b.pair_id AND a.side = 'pred' AND b.side = 'ref' GROUP BY a.pair_id, a.vec_id),
rc AS (SELECT a.pair_id, a.vec_id, max(list_cosine_similarity(a.e, b.e)) AS best
       FROM v a JOIN v b ON a.pair_id = b.pair_id AND a.side = 'ref' AND b.side = 'pred' GROUP BY a.pair_id, a.vec_id),
pp AS (SELECT pair_id, avg(best) AS precision FROM pr GROUP BY pair_id),
rr AS (SELECT pair_id, avg(best) AS recall FROM rc GROUP BY pair_id),
j AS (SELECT pair_id, precision, recall,
             CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
      FROM pp JOIN rr USING (pair_id))""") + f"""
SELECT count(*) AS n_pairs, {D.r6('avg(precision)', 'precision')}, {D.r6('avg(recall)', 'recall')}, {D.r6('avg(f1)', 'f1')}
FROM j""")
def q_greedy_match_score(spark, sf_dir):
    return rounded(G.greedy_match_score(FX.token_vectors(spark, sf_dir)))


def parity_scorer(texts: list[str]) -> list[str]:
    """Deterministic stand-in for a model call: 'yes' for even-length prompts."""
    return ["yes" if len(t) % 2 == 0 else "no" for t in texts]


_TQ = P.TASK_TEMPLATES["dialogue"]


def _prompt_sql() -> str:
    from evalcrate.plans.q_prompts import _test_question
    return _test_question()


@register("score_fn", with_fixtures("dialogues") + f"""
SELECT id, CASE WHEN length({_prompt_sql()}) % 2 = 0 THEN 'yes' ELSE 'no' END AS output, CAST(NULL AS VARCHAR) AS error
FROM dialogues""")
def q_score_fn(spark, sf_dir):
    d = FX.dialogues(spark, sf_dir)
    prompts = d.select("id", P.template(_TQ, dialogue=F.col("dialogue"), section_header=F.col("section_header")).alias("prompt"))
    return S.score_fn(prompts, parity_scorer, "id", "prompt")


@register("format_fn", with_fixtures("dialogues") +
          "SELECT id, '### Input: ' || dialogue || ' ### Target: ' || section_text AS text FROM dialogues")
def q_format_fn(spark, sf_dir):
    d = FX.dialogues(spark, sf_dir)
    fmt = lambda df: P.instruction_text("dialogue", "section_text", "### Input: ", " ### Target: ")
    return S.format_with(d, fmt).select("id", "text")


@register("resume_pending", "SELECT d.doc_id FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id")
def q_resume_pending(spark, sf_dir):
    """Documents without a label yet are the pending work."""
    docs = read_table(spark, sf_dir, "documents")
    done = read_table(spark, sf_dir, "labels").select("doc_id")
    return S.resume_pending(docs, done, "doc_id").select("doc_id")


@register("align_predictions", with_fixtures("class3") + """
SELECT o.o_orderkey AS id, o.o_orderstatus, c.gold, c.pred FROM orders o JOIN class3 c ON o.o_orderkey = c.id""")
def q_align_predictions(spark, sf_dir):
    inputs = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return S.align_predictions(inputs, FX.class3(spark, sf_dir), "id").select("id", "o_orderstatus", "gold", "pred")


def _write_metrics_sql() -> str:
    from evalcrate.plans.q_classify import q_em_confusion  # noqa: F401  (registers em_confusion first)
    from evalcrate.plans.registry import ORACLE
    inner = ORACLE["em_confusion"]
    head, _, select = inner.rpartition("SELECT n, tp")
    return (head.rstrip() + ",\nm AS (SELECT n, tp" + select + ")\n"
            "SELECT to_json({'model': 'parity-stub', 'shots': 0, 'n': n, 'tp': tp, 'fp': fp, 'fn': fn, 'tn': tn, "
            "'unresolved': unresolved, 'accuracy': accuracy, 'precision': precision, 'recall': recall, 'f1': f1})::VARCHAR "
            "AS value FROM m")


@register("write_metrics", _write_metrics_sql())
def q_write_metrics(spark, sf_dir):
    """K3: the metrics record written as JSON text and read back."""
    m = em_confusion(em_scored(spark, sf_dir))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/evalcrate-io/metrics-{uuid.uuid4().hex}"
    write_metrics(rounded(m), {"model": "parity-stub", "shots": 0, "accuracy": "config value loses"}, path)
    return spark.read.text(path)
