"""Text, conversation and multiple-choice queries: C1, C2, C4, C15, F2 (cleaning),
W2, W3, H1, H2, H4 (conversations), C11-C13, T2, F4, U4 (options)."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalcrate.functions import options as OP
from evalcrate.functions import text as T
from evalcrate.operators import chat as H
from evalcrate.plans import duck as D
from evalcrate.plans.fixture_sql import with_fixtures
from evalcrate.plans.registry import register
from evalcrate.sources import fixtures as FX
from evalcrate.sources.readers import read_table


def _conv(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations")


# ---------------------------------------------------------------- cleaning

@register("cut_at_suffix", "SELECT conv_id, turn, split_part(text, '. ', 1) AS cut FROM conversations")
def q_cut_at_suffix(spark, sf_dir):
    return _conv(spark, sf_dir).select("conv_id", "turn", T.cut_at_suffix("text", ". ").alias("cut"))


@register("drop_suffix", with_fixtures("multi_ref_pred") +
          "SELECT question_id, replace(prediction, '</s>', '') AS cleaned FROM multi_ref_pred")
def q_drop_suffix(spark, sf_dir):
    p = FX.multi_ref_pred(spark, sf_dir)
    return p.select("question_id", T.drop_suffix("prediction", "</s>").alias("cleaned"))


@register("strip", f"SELECT conv_id, turn, {D.py_strip(chr(39) + ' ' + chr(39) + ' || text || chr(10)')} AS stripped FROM conversations")
def q_strip(spark, sf_dir):
    c = _conv(spark, sf_dir)
    return c.select("conv_id", "turn", T.py_strip(F.concat(F.lit(" "), "text", F.lit("\n"))).alias("stripped"))


@register("first_line", f"SELECT conv_id, turn, {D.py_strip(f'split_part({D.py_strip(chr(39) + chr(10) + chr(39) + ' || text')}, chr(10), 1)')} AS line FROM conversations")
def q_first_line(spark, sf_dir):
    c = _conv(spark, sf_dir)
    return c.select("conv_id", "turn", T.first_line(F.concat(F.lit("\n"), "text")).alias("line"))


@register("token_in_set", with_fixtures("em_preds") + f"""
SELECT id, array_to_string(list_filter({D.tokens('response')}, lambda t: t IN ('y', 'n', 'yes', 'no')), ' ') AS kept
FROM em_preds""")
def q_token_in_set(spark, sf_dir):
    df = FX.em_preds(spark, sf_dir)
    kept = F.filter(T.answer_tokens("response"), lambda t: t.isin("y", "n", "yes", "no"))
    return df.select("id", F.array_join(kept, " ").alias("kept"))


# ---------------------------------------------------------------- conversations

@register("pair_turns", """
SELECT a.conv_id, a.turn, a.text, b.text AS next_text
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
WHERE a.turn % 2 = 0""")
def q_pair_turns(spark, sf_dir):
    return H.pair_turns(_conv(spark, sf_dir), even_only=True).select("conv_id", "turn", "text", "next_text")


@register("merge_adjacent_roles", """
WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'user' ELSE role END AS role, text FROM conversations),
f AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS st FROM c),
i AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f)
SELECT conv_id, CAST(island - 1 AS BIGINT) AS turn, first(role) AS role, string_agg(text, '' ORDER BY turn) AS text
FROM i GROUP BY conv_id, island""")
def q_merge_adjacent_roles(spark, sf_dir):
    c = _conv(spark, sf_dir).select(
        "conv_id", "turn", F.when(F.col("role") == "system", F.lit("user")).otherwise(F.col("role")).alias("role"), "text")
    out = H.merge_adjacent_roles_long(c)
    return out.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")


_SYS = "You are a helpful assistant."


_NEXT = "Please go on."


@register("build_request", f"""
SELECT conv_id, 0 AS pos, 'system' AS role, '{_SYS}' AS content FROM conversations GROUP BY conv_id
UNION ALL SELECT conv_id, CAST(turn + 1 AS INTEGER), role, text FROM conversations
UNION ALL SELECT conv_id, CAST(max(turn) + 2 AS INTEGER), 'user', '{_NEXT}' FROM conversations GROUP BY conv_id""")
def q_build_request(spark, sf_dir):
    """H1: one request per conversation, system + the whole history + the new turn (a request is one row)."""
    history = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))),
                          lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    c = _conv(spark, sf_dir).groupBy("conv_id").agg(history.alias("history"))
    req = c.select("conv_id", H.build_request(_SYS, F.col("history"), F.lit(_NEXT)).alias("messages"))
    return H.to_long(req, "conv_id")


@register("append_history", """
SELECT conv_id, turn, role, text FROM conversations
UNION ALL SELECT conv_id, max(turn) + 1, 'user', 'Thanks, that helps.' FROM conversations GROUP BY conv_id
UNION ALL SELECT conv_id, max(turn) + 2, 'assistant', 'Glad to help.' FROM conversations GROUP BY conv_id
UNION ALL SELECT conv_id, max(turn) + 3, 'user', 'Bye.' FROM conversations GROUP BY conv_id
UNION ALL SELECT conv_id, max(turn) + 4, 'assistant', 'Goodbye.' FROM conversations GROUP BY conv_id""")
def q_append_history(spark, sf_dir):
    c = _conv(spark, sf_dir)
    says = F.array(F.struct(F.lit(1).alias("n"), F.lit("Thanks, that helps.").alias("user_text"), F.lit("Glad to help.").alias("assistant_text")),
                   F.struct(F.lit(2).alias("n"), F.lit("Bye.").alias("user_text"), F.lit("Goodbye.").alias("assistant_text")))
    new = c.select("conv_id").distinct().select("conv_id", F.explode(says).alias("x")).select("conv_id", "x.*")
    return H.append_history(c, new, order_col="n")


@register("set_system_prompt", f"""
SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'
UNION ALL SELECT DISTINCT conv_id, -1, 'system', '{_SYS}' FROM conversations""")
def q_set_system_prompt(spark, sf_dir):
    return H.set_system_prompt(_conv(spark, sf_dir), _SYS)


# ---------------------------------------------------------------- multiple choice

def _duck_opts(q: str) -> str:
    return (f"list_transform(string_split(regexp_extract({q}, '{OP.OPTIONS_TAIL}', 1), ', '), "
            "lambda it: {'key': string_split(it, ': ')[1], 'value': string_split(it, ': ')[2]})")


def _duck_lit_pos(t: str, p: str) -> str:
    return f"list_filter(range(0, length({t})), lambda i: substr({t}, i + 1, length({p})) = {p})"


def _duck_key_pos(t: str, k: str) -> str:
    return (f"list_filter(range(0, length({t})), lambda i: substr({t}, i + 1, length({k})) = {k} "
            f"AND substr({t}, i + 1 + length({k}), 1) IN (')', ':', '.', ',', ' '))")


def _duck_first(t: str, opts: str, values: bool, op: str = "min") -> str:
    pos = _duck_lit_pos(t, "o.value") if values else _duck_key_pos(t, "o.key")
    idx = "i" if op == "min" else "-i"
    c = f"list_filter(list_transform({opts}, lambda o, i: {{'pos': {pos}, 'idx': {idx}, 'key': o.key}}), lambda c: len(c.pos) > 0)"
    pick = f"list_sort({c})[1]" if op == "min" else f"list_sort({c}, 'DESC')[1]"
    return f"{pick}.key"


_MC_SQL = with_fixtures("mc_questions", extra=f"o AS (SELECT id, question, target, {_duck_opts('question')} AS opts FROM mc_questions)")


@register("parse_options", _MC_SQL + """
SELECT id, CAST(len(opts) AS INTEGER) AS n_options, array_to_string(list_transform(opts, lambda x: x.key), '|') AS keys,
       array_to_string(list_transform(opts, lambda x: x.value), '|') AS vals FROM o""")
def q_parse_options(spark, sf_dir):
    df = FX.mc_questions(spark, sf_dir).select("id", OP.parse_options("question").alias("opts"))
    return df.select("id", F.size("opts").alias("n_options"),
                     F.array_join(F.transform("opts", lambda x: x["key"]), "|").alias("keys"),
                     F.array_join(F.transform("opts", lambda x: x["value"]), "|").alias("vals"))


@register("match_positions", with_fixtures("mc_questions") + f"""
SELECT id, array_to_string({_duck_lit_pos('question', "split_part(split_part(question, 'D: ', 2), '}', 1)")}, ',') AS positions
FROM mc_questions""")
def q_match_positions(spark, sf_dir):
    df = FX.mc_questions(spark, sf_dir)
    name = F.substring_index(F.substring_index("question", "D: ", -1), "}", 1)
    return df.select("id", F.array_join(OP.literal_positions("question", name), ",").alias("positions"))


@register("infer_option", _MC_SQL + f"""
SELECT id, CASE WHEN len(opts) = 0 THEN NULL ELSE coalesce(
         CASE WHEN list_contains(list_transform(opts, lambda x: x.key), {D.py_strip('target')}) THEN {D.py_strip('target')} END,
         list_filter(opts, lambda x: {D.py_strip('x.value')} = {D.py_strip('target')})[1].key,
         {_duck_first('target', 'opts', False)},
         {_duck_first('target', 'opts', True)}) END AS answer FROM o""")
def q_infer_option(spark, sf_dir):
    df = FX.mc_questions(spark, sf_dir)
    return df.select("id", OP.infer_option("question", "target").alias("answer"))


def _infer_sql() -> str:
    from evalcrate.plans.registry import ORACLE
    return ORACLE["infer_option"]


@register("infer_option_regex", _infer_sql())
def q_infer_option_regex(spark, sf_dir):
    """C12 with option values matched as Python regular expressions."""
    df = FX.mc_questions(spark, sf_dir)
    return OP.infer_option_df(df, "question", "target", "answer", value_match="python").select("id", "answer")


@register("earliest_match", _MC_SQL + f"SELECT id, {_duck_first('target', 'opts', True)} AS key FROM o")
def q_earliest_match(spark, sf_dir):
    df = FX.mc_questions(spark, sf_dir)
    return df.select("id", OP.first_match("target", OP.parse_options("question"), True).alias("key"))


@register("first_match_op", _MC_SQL + f"SELECT id, {_duck_first('question', 'opts', True, 'max')} AS key FROM o")
def q_first_match_op(spark, sf_dir):
    """U4: ``op=max`` over the option values found in the question text itself."""
    df = FX.mc_questions(spark, sf_dir)
    return df.select("id", OP.first_match("question", OP.parse_options("question"), True, op="max").alias("key"))


@register("non_empty_matches", _MC_SQL + f"""
SELECT id, CAST(len(list_filter(opts, lambda o: len({_duck_lit_pos('question', 'o.value')}) > 0)) AS INTEGER) AS n_matching
FROM o""")
def q_non_empty_matches(spark, sf_dir):
    df = FX.mc_questions(spark, sf_dir).select("id", "question", OP.parse_options("question").alias("opts"))
    n = F.size(F.filter("opts", lambda o: F.size(OP.literal_positions(F.col("question"), o["value"])) > 0))
    return df.select("id", n.alias("n_matching"))
