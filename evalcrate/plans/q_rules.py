"""Role rules of chats, scoring by token budget, and bootstrap intervals without copied rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalcrate.operators import accounting as A
from evalcrate.operators import overlap as O
from evalcrate.operators import prompts as P
from evalcrate.operators import runs as RU
from evalcrate.operators import scoring as S
from evalcrate.plans.fixture_sql import with_fixtures
from evalcrate.plans.registry import register, rounded
from evalcrate.sources import fixtures as FX

_CASES = (("user", "assistant"), ("system", "user", "assistant"), ("assistant", "user"), ("user", "user"), ("user", "system"), ("tool",))
_FAULTS = ("NULL", "NULL", "'message 0: assistant where user is expected'", "'message 1: user where assistant is expected'",
           "'message 1: system message not at the start'", "'message 0: unknown role tool'")
_FAULT_SQL = "CASE id % 6 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_FAULTS)) + " END"


def _chats(spark, sf_dir):
    d = FX.dialogues(spark, sf_dir)
    chat = None
    for i, roles in enumerate(_CASES):
        messages = F.array(*[P.msg(r, F.col("dialogue") if n % 2 == 0 else F.col("section_text")) for n, r in enumerate(roles)])
        chat = F.when(F.col("id") % 6 == i, messages) if chat is None else chat.when(F.col("id") % 6 == i, messages)
    return d.select("id", chat.alias("messages"))


@register("chat_role_faults", with_fixtures("dialogues") + f"""
SELECT id, {_FAULT_SQL} AS fault, CASE id % 6
  WHEN 0 THEN '<|im_start|>user' || chr(10) || dialogue || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || section_text || '<|im_end|>' || chr(10)
  WHEN 1 THEN '<|im_start|>system' || chr(10) || dialogue || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || section_text
    || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || dialogue || '<|im_end|>' || chr(10) END AS text FROM dialogues""")
def q_chat_role_faults(spark, sf_dir):
    """Good chats rendered, bad ones named."""
    return P.checked_render(_chats(spark, sf_dir), "messages", add_generation_prompt=False).select("id", "fault", "text")


def _answer(texts):
    return [f"{len(t)} characters: {t}" for t in texts]


_COUNT = f"len(regexp_extract_all(prompt, '{A.NATIVE_TOKEN_RULE}'))"


@register("score_fn_budget", with_fixtures("dialogues") + f""",
p AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE dialogue END AS prompt FROM dialogues)
SELECT id, CASE WHEN {_COUNT} <= 400 THEN length(prompt) || ' characters: ' || prompt END AS output,
  CASE WHEN prompt IS NULL THEN 'null prompt' WHEN {_COUNT} > 400 THEN {_COUNT} || ' tokens, more than the budget of 400' END AS error FROM p""")
def q_score_fn_budget(spark, sf_dir):
    """Calls of at most 400 tokens; null prompts and longer ones are named, not scored."""
    d = FX.dialogues(spark, sf_dir).select("id", F.when(F.col("id") % 7 != 0, F.col("dialogue")).alias("prompt"))
    return S.score_fn(d, _answer, "id", "prompt", token_budget=400)


@register("bootstrap_intervals")  # weights from row hashes in numpy: compared with the exploded bootstrap in tests
def q_bootstrap_intervals(spark, sf_dir):
    """Intervals of ROUGE-1, token F1 and corpus BLEU over all text pairs."""
    pairs = FX.text_pairs(spark, sf_dir)
    ratio = F.try_divide(F.col("v"), F.col("weight"))
    rouge = O.rouge_n_scores(pairs, orders=(1,)).select("id", F.col("rouge1").alias("v"))
    parts = [("rouge1", RU.bootstrap_interval(rouge, "id", ["v"], ratio, seed=11)),
             ("token_f1", RU.bootstrap_interval(O.pair_token_scores(pairs).select("id", F.col("f1").alias("v")), "id", ["v"], ratio, seed=11)),
             ("bleu", RU.bootstrap_interval(O.bleu_counters(pairs, keep=["id"]), "id", ["tl", "rl", *[f"{x}{n}" for n in range(1, 5) for x in "mc"]],
                                            O.bleu_of_sums(), seed=11))]
    out = None
    for name, df in parts:
        df = df.select(F.lit(name).alias("metric"), "*")
        out = df if out is None else out.unionByName(df)
    return rounded(out)
