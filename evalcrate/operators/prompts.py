"""Prompt and dataset construction.

Prompts are column expressions (``concat`` / ``format`` pieces) evaluated in
one projection.  Few-shot material is a *bounded* table — at most three
examples, checked in Python before planning — reduced to one row and attached
to every input row as an uncorrelated scalar subquery (``DataFrame.scalar()``):
computed once, shipped as a value, no join at all.
"""

from __future__ import annotations

import string
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalcrate.functions import text as T
from evalcrate.functions.util import let

# ---------------------------------------------------------------------------
# Fixed values (must equal the evaluated scripts' constants)
# ---------------------------------------------------------------------------
# Per model family: chat start token, end prompt, output suffix (fact checking).
FAMILY_PROMPTS = (
    ("openai", "", " What is the correct label?", ""),
    ("mistral", "<s>[INST] ", " What is the correct label? [/INST]", "</s>"),
    ("llama-2", "<s>[INST] <<SYS>>\nYou are a helpful assistant.\n<</SYS>>\n\n", " What is the correct label? [/INST]", "</s>"),
    ("falcon", "A helpful assistant.\nUser: ", " What is the correct label?\nAssistant:", "<|endoftext|>"),
    ("opt-finetune", "", " What is the correct label?", "</s>"),
)
# Default summarisation (start, end) prompts per model.
SUMMARY_PROMPTS = (
    ("llama-2-base", "### Summarize: ", "### Begin summary:"),
    ("llama-2-chat", "<s>[INST] <<SYS>> \nYou are a helpful assistant.\n<</SYS>>\n\nSummarize the following: ", " [/INST]"),
    ("gpt2", "### Summarize: ", "### Begin summary:"),
    ("mistral-base", "### Summarize: ", "### Begin summary:"),
    ("mistral-instruct", "<s>[INST] Summarize the following: ", " [/INST]"),
    ("opt", "### Summarize: ", "### Begin summary:"),
    ("openai", "Summarize the following: ", "\n Begin summary:"),
)
# Task templates (Python format strings).
TASK_TEMPLATES = {
    "dialogue": "\n\n## Content:\n{dialogue}\n\n## Topic:\n{section_header}\n\n## Summary:",
    "comment": "\n\n## Comment:\n{text}\n\n## Response:",
    "question": "\n\n## Question:\n{question}\n\n## Answer:",
    "question_documents": "\n\n## Documents:\n{context}\n\n## Question:\n{question}\n\n## Answer:",
    "qa": "Question: {question}\nAnswer:",
}
# Numbered few-shot example blocks.
EXAMPLE_TEMPLATES = {
    "dialogue": "\n\nExample {k}:\n\n## Content:\n{dialogue}\n\n## Topic:\n{section_header}\n\n## Summary:",
    "question_documents": "\n\nExample {k}:\n\n## Documents:\n{context}\n\n## Question:\n{question}\n\n## Answer:\n{answer}\n\n",
    "question": "\n\nExample {k}:\n\n## Question:\n{question}\n\n## Answer:\n{answer}\n\n",
    "comment": "\n\nExample {k}:\n\n## Comment:\n{text}\n\n## Response:",
}
# Literal role rewrites for models without chat roles, applied in order.
ROLE_REWRITES = (("user", "User:"), ("assistant", "Assistant:"), ("Assistant:!", "assistant!"),
                 ("Assistant:,", "assistant,"), ("<|im_start|>", ""), ("<|im_end|>", ""))
# Entity-matching system / closing texts by dataset (person records, generic entities).
EM_SYSTEM = (
    ("person_match",
     "You are a helpful assistant, and your task is to compare pairs of names \n    and addresses from two records to determine if they match. \n"),
    ("entity_match",
     "Your task is to compare records from two datasets, to determine if they refer to the same \nentity. The records may have different columns and formats, or may all been in the same format. Columns may also \nbe spelled differently in one dataset than in the other. Any missing values are represented with the text \"NA\".\n\n"),
)
EM_TRANSACTION = (
    ("person_match",
     "\n\nDo these records refer to the same person? Output only one token.\n\nOutput 'y' if they do\nOutput 'n' if they do not\n  \n"),
    ("entity_match",
     "Do these records refer to the same entity? Output only one token.\n\nOutput 'y' if they do\nOutput 'n' if they do not\n  \n"),
)
# ---------------------------------------------------------------------------

def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fstr(c) -> Column:
    """A value as a Python f-string prints it (NULL -> 'None')."""
    return F.coalesce(_c(c).cast("string"), F.lit("None"))


def template(fmt: str, **fields) -> Column:
    """Render a ``str.format`` template whose fields are columns or literals."""
    parts = []
    for lit_text, field, _spec, _conv in string.Formatter().parse(fmt):
        if lit_text:
            parts.append(F.lit(lit_text))
        if field is not None:
            v = fields[field]
            parts.append(fstr(v) if isinstance(v, Column) else F.lit(str(v)))
    return F.concat(*parts) if parts else F.lit("")


def concat_flagged(c1, c2, flag1: str = "Claim: ", flag2: str = "Evidence: ") -> Column:
    """``f'{flag1}{col1} {flag2}{col2}'``."""
    return F.concat(F.lit(flag1), fstr(c1), F.lit(" "), F.lit(flag2), fstr(c2))


def wrap_prompt(c, start: str | Column, end: str | Column) -> Column:
    """``start + text + end``."""
    s = start if isinstance(start, Column) else F.lit(start)
    e = end if isinstance(end, Column) else F.lit(end)
    return F.concat(s, _c(c), e)


def family_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FAMILY_PROMPTS), "family string, chat_start string, end_prompt string, suffix string")


def family_wrap(df: DataFrame, text_col: str, family_col: str, start_prompt: str = "") -> DataFrame:
    """Per-row model family -> chat start + start prompt + text + end prompt, plus suffix.

    The family table is a literal of five rows (a fixed size bound), so it is
    broadcast; an unknown family fails the job rather than yielding NULL."""
    fam = F.broadcast(family_table(df.sparkSession))
    j = df.join(fam, df[family_col] == fam["family"], "left")
    known = F.col("chat_start").isNotNull()
    err = F.raise_error(F.concat(F.lit("unknown model family "), fstr(df[family_col]))).cast("string")
    prompt = F.when(known, F.concat(F.col("chat_start"), F.lit(start_prompt), _c(text_col), F.col("end_prompt"))).otherwise(err)
    return j.select(*[df[c] for c in df.columns], prompt.alias("prompt"), F.col("suffix").alias("remove_suffix"))


FACT_CHECK_SHOTS = 3  # the fact-check builder takes up to three examples; the others any number


def check_shots(shots: int, most: int | None = None) -> None:
    if shots < 0 or (most is not None and shots > most):
        raise ValueError(f"Invalid number of shots: {shots}")


def fewshot_prefix(examples: DataFrame, shots: int, start_prompt: str = "", transition: str = "",
                   k_col: str = "k", text_col: str = "shot", max_shots: int | None = FACT_CHECK_SHOTS) -> DataFrame:
    """One row ``prefix = start_prompt + shot_1 + .. + shot_k + transition`` (k in 0..``max_shots``).

    ``examples`` holds (k, shot); only k <= shots rows are aggregated, in k order."""
    check_shots(shots, max_shots)
    ex = examples.where(F.col(k_col) <= shots).select(F.struct(k_col, text_col).alias("e"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e[text_col]), "")
    if shots == 0:
        body = F.lit("")
    return ex.agg(F.concat(F.lit(start_prompt), body, F.lit(transition)).alias("prefix"))


def attach_scalar(df: DataFrame, one_row: DataFrame, col: str, alias: str | None = None) -> DataFrame:
    """Attach the single value of a one-row DataFrame to every row (scalar subquery)."""
    return df.withColumn(alias or col, one_row.select(col).scalar())


def msg(role: str | Column, content) -> Column:
    r = role if isinstance(role, Column) else F.lit(role)
    return F.struct(r.alias("role"), _c(content).alias("content"))


def examples_of(table: DataFrame, dataset: str, dataset_col: str = "dataset") -> DataFrame:
    """The few-shot examples of one dataset from a user's ``(dataset, k, question, response)`` table;
    a dataset without examples fails when its prompts are built, instead of building them without."""
    own = table.where(F.col(dataset_col) == dataset).select("k", "question", "response")
    some = table.agg(F.count_if(F.col(dataset_col) == dataset).alias("n")).select("n").scalar()
    say = F.raise_error(F.lit(f"no few-shot examples for dataset {dataset}"))
    one = table.sparkSession.range(1).where(F.when(some == 0, say.cast("boolean")).otherwise(F.lit(False))).select(
        F.lit(None).cast(own.schema["k"].dataType).alias("k"), F.lit("").alias("question"), F.lit("").alias("response"))
    return own.unionByName(one)


def example_turns(examples: DataFrame, shots: int, first_prefix: str = "", k_col: str = "k",
                  q_col: str = "question", r_col: str = "response") -> DataFrame:
    """One row holding the few-shot chat prefix ``[user q1, assistant r1, ...]`` (k <= shots).

    ``first_prefix`` is prepended to the first question (system text given as user turn)."""
    check_shots(shots)
    ex = examples.where(F.col(k_col) <= shots).select(F.struct(k_col, q_col, r_col).alias("e"))
    srt = F.sort_array(F.collect_list("e"))
    turns = F.flatten(F.transform(srt, lambda e, i: F.array(
        msg("user", F.when(i == 0, F.concat(F.lit(first_prefix), e[q_col])).otherwise(e[q_col])),
        msg("assistant", e[r_col]))))
    return ex.agg(F.coalesce(turns, F.array().cast("array<struct<role:string,content:string>>")).alias("turns"))


def fewshot_chat(df: DataFrame, question: Column, examples: DataFrame, shots: int, system: str = "",
                 transaction: str = "", out_col: str = "messages") -> DataFrame:
    """P5: ``[user system+q1, assistant r1, ..., user transaction+question]``; zero shots
    gives one user turn ``system + transaction + question``."""
    prefix = example_turns(examples, shots, system)
    last_text = F.concat(F.lit(transaction), question)
    if shots == 0:
        return df.withColumn(out_col, F.array(msg("user", F.concat(F.lit(system), last_text))))
    return df.withColumn(out_col, F.concat(prefix.select("turns").scalar(), F.array(msg("user", last_text))))


def fewshot_chat_text(df: DataFrame, question: Column, examples: DataFrame, shots: int, start_prompt: str = "",
                      user_tag: str = "User: ", assistant_tag: str = "Assistant:", out_col: str = "prompt") -> DataFrame:
    """P5 (text form, for models without chat roles): lines
    ``start_prompt``, ``User: q_k``, ``Assistant: r_k`` ..., ``User: <question>``,
    ``Assistant:`` joined by newlines.  The example lines are built once (scalar)."""
    check_shots(shots)
    ex = examples.where(F.col("k") <= shots).select(F.struct("k", "question", "response").alias("e"))
    lines = F.flatten(F.transform(F.sort_array(F.collect_list("e")), lambda e: F.array(
        F.concat(F.lit(user_tag), e["question"]), F.concat(F.lit(assistant_tag + " "), e["response"]))))
    prefix = ex.agg(F.array_join(F.concat(F.array(F.lit(start_prompt)),
                                          F.coalesce(lines, F.array().cast("array<string>"))), "\n").alias("p"))
    return df.withColumn(out_col, F.concat(prefix.select("p").scalar(), F.lit("\n" + user_tag), question,
                                           F.lit("\n" + assistant_tag)))


def merge_adjacent_roles(messages) -> Column:
    """W3 (array form): concatenate neighbouring messages of the same role."""
    empty = F.array().cast("array<struct<role:string,content:string>>")

    def step(acc, x):
        n = F.size(acc)
        last = F.try_element_at(acc, F.greatest(n, F.lit(1)))
        merged = F.concat(F.filter(acc, lambda _m, i: i < n - 1),
                          F.array(msg(x["role"], F.concat(last["content"], x["content"]))))
        return F.when((n > 0) & (last["role"] == x["role"]), merged).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(_c(messages), empty, step)


def fewshot_chat_merged(df: DataFrame, question: Column, examples: DataFrame, shots: int, system: str = "",
                        transaction: str = "", out_col: str = "messages") -> DataFrame:
    """System text as a user turn, shots, then ``question + transaction``; adjacent
    user texts are merged (so the system text joins the first question).

    The merge runs once on the one-row prefix side; with shots the prefix ends
    with an assistant turn, so the row's own turn is simply appended."""
    last = F.concat(question, F.lit(transaction))
    if shots == 0:
        return df.withColumn(out_col, F.array(msg("user", F.concat(F.lit(system), last))))
    ex = example_turns(examples, shots)
    prefix = ex.select(merge_adjacent_roles(F.concat(F.array(msg("user", F.lit(system))), F.col("turns"))).alias("p"))
    return df.withColumn(out_col, F.concat(prefix.select("p").scalar(), F.array(msg("user", last))))


def flat_fewshot(*parts) -> Column:
    """Plain concatenation (families without chat turns)."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def rewrite_roles(c, rewrites: Sequence[tuple[str, str]] = ROLE_REWRITES) -> Column:
    """Ordered literal replacements (rewrites words inside the data as well)."""
    x = _c(c)
    for a, b in rewrites:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def example_rows(picked: DataFrame, q_template: str, r_field: str | None, k_col: str = "k",
                 **fields: str) -> DataFrame:
    """P10: (k, question, response) from picked rows; ``{k}`` numbers the block."""
    cols = {name: F.col(src) for name, src in fields.items()}
    q = template(q_template, k=F.col(k_col).cast("string"), **cols)
    r = fstr(F.col(r_field)) if r_field else F.lit("")
    return picked.select(F.col(k_col).alias("k"), q.alias("question"), r.alias("response"))


def example_block(rows: DataFrame, with_response: bool = False, shots: int | None = None) -> DataFrame:
    """P10: one row, the example blocks with ``k <= shots`` (None: all picked ones) concatenated in k order."""
    if shots is not None:
        rows = rows.where(F.col("k") <= shots)
    e = F.struct("k", "question", "response")
    body = F.transform(F.sort_array(F.collect_list(e)),
                       lambda x: F.concat(x["question"], x["response"]) if with_response else x["question"])
    return rows.agg(F.array_join(body, "").alias("examples"))


def instruction_text(input_col, target_col, start_prompt: str, end_prompt: str, suffix: str = "") -> Column:
    """``start + input + end + target + suffix`` (training text)."""
    return F.concat(F.lit(start_prompt), _c(input_col), F.lit(end_prompt), _c(target_col), F.lit(suffix))


def instruction_chat(user_content: Column, target) -> Column:
    """``[user, assistant]`` training chat."""
    return F.array(msg("user", user_content), msg("assistant", _c(target)))


# A role-templated chat rendering (ChatML-style markers); any table of
# (role, before, after) plus a generation prompt can be passed instead.
CHATML = {"turn": (("system", "<|im_start|>system\n", "<|im_end|>\n"),
                   ("user", "<|im_start|>user\n", "<|im_end|>\n"),
                   ("assistant", "<|im_start|>assistant\n", "<|im_end|>\n")),
          "generation": "<|im_start|>assistant\n"}


def render_chat(messages, chat_template: Mapping = CHATML, add_generation_prompt: bool = True) -> Column:
    """Chat array -> one string with per-role markers."""
    pre = F.create_map(*[x for r, b, _a in chat_template["turn"] for x in (F.lit(r), F.lit(b))])
    post = F.create_map(*[x for r, _b, a in chat_template["turn"] for x in (F.lit(r), F.lit(a))])
    body = F.array_join(F.transform(_c(messages), lambda m: F.concat(
        F.coalesce(F.element_at(pre, m["role"]), F.lit("")), m["content"],
        F.coalesce(F.element_at(post, m["role"]), F.lit("")))), "")
    return F.concat(body, F.lit(chat_template["generation"])) if add_generation_prompt else body


def role_fault(messages, system: bool = True) -> Column:
    """What breaks a chat template's rules, or null: a system message only as the first one (not at all with
    ``system=False``), then user and assistant in turn, beginning with the user; no other roles, no null content.

    One fold over the messages; the first fault is named with its 0-based place."""
    def step(state, x):
        want = F.when(state["last"] == "user", F.lit("assistant")).otherwise(F.lit("user"))
        role = F.coalesce(x["m"]["role"], F.lit("null"))
        fault = (F.when((role == "system") & (x["i"] == 0) & F.lit(system), F.when(x["m"]["content"].isNull(), F.lit("no content")))
                 .when(role == "system", F.lit("system message") if not system else F.lit("system message not at the start"))
                 .when(~role.isin("user", "assistant"), F.concat(F.lit("unknown role "), role))
                 .when(role != want, F.concat(role, F.lit(" where "), want, F.lit(" is expected")))
                 .when(x["m"]["content"].isNull(), F.lit("no content")))
        named = F.concat(F.lit("message "), x["i"].cast("string"), F.lit(": "), fault)
        return F.struct(role.alias("last"), F.coalesce(state["fault"], named).alias("fault"))
    start = F.struct(F.lit("").alias("last"), F.lit(None).cast("string").alias("fault"))
    places = F.transform(_c(messages), lambda m, i: F.struct(m.alias("m"), i.alias("i")))
    return F.when(F.size(_c(messages)) > 0, F.aggregate(places, start, step)["fault"]).otherwise(F.lit("no messages"))


def checked_render(df: DataFrame, messages_col: str, out_col: str = "text", fault_col: str = "fault", chat_template: Mapping = CHATML,
                   add_generation_prompt: bool = True, system: bool = True) -> DataFrame:
    """P12/P13 with the template's role rules: good chats are rendered, bad ones have null text and their fault."""
    fault = role_fault(messages_col, system)
    return df.withColumn(fault_col, fault).withColumn(
        out_col, F.when(F.col(fault_col).isNull(), render_chat(messages_col, chat_template, add_generation_prompt)))


def ws_tokens(c) -> Column:
    return T.py_split(F.coalesce(_c(c), F.lit("")))


def truncate_keep_tail(prompt_body, end_prompt: str, max_tokens: int, tokenizer=None) -> Column:
    """If ``body + end`` has more than ``max_tokens`` tokens keep the first
    ``max_tokens - len(tok(end)) - 1`` tokens and re-append the end prompt.

    Whitespace tokens by default: the cut is a prefix of the text, all its white space kept.  Another
    ``tokenizer`` (a column function that gives tokens) has them joined with spaces."""
    full = F.concat(_c(prompt_body), F.lit(end_prompt))
    if tokenizer is None:
        n_end = T.piece_count(T.py_pieces(F.lit(end_prompt)))
        keep = F.greatest(F.lit(max_tokens) - n_end - 1, F.lit(0))
        return let(F.struct(T.py_pieces(full).alias("p"), full.alias("t"), keep.alias("k")), lambda x: F.when(
            T.piece_count(x["p"]) > max_tokens, F.concat(F.array_join(F.slice(x["p"], 1, x["k"]), ""), F.lit(end_prompt))).otherwise(x["t"]))
    toks = tokenizer(full)
    n_end = F.size(tokenizer(F.lit(end_prompt)))
    keep = F.greatest(F.lit(max_tokens) - n_end - 1, F.lit(0))
    cut = F.concat(F.array_join(F.slice(toks, 1, keep), " "), F.lit(end_prompt))
    return F.when(F.size(toks) > max_tokens, cut).otherwise(full)


def pretokenize(c, max_length: int | None, tokenizer=ws_tokens) -> Column:
    """Token array, truncated to ``max_length``."""
    toks = tokenizer(c)
    return F.slice(toks, 1, max_length) if max_length else toks


def cut_tokens(c, max_tokens: int) -> Column:
    """P15 (text form): the text up to the end of its ``max_tokens``-th whitespace token, character for character."""
    return F.array_join(F.slice(T.py_pieces(F.coalesce(_c(c), F.lit(""))), 1, max_tokens), "")


def strip_prompt_tokens(text, prompt) -> Column:
    """P16 (token form): the output behind as many whitespace tokens as the prompt has, character for character."""
    n = T.piece_count(T.py_pieces(F.coalesce(_c(prompt), F.lit(""))))
    pieces = T.py_pieces(F.coalesce(_c(text), F.lit("")))
    return let(F.struct(pieces.alias("p"), n.alias("n")), lambda x: F.array_join(F.slice(x["p"], x["n"] + 1, F.greatest(F.size(x["p"]), F.lit(1))), ""))


def serialize_pair(df: DataFrame, columns: Sequence[str], left_prefix: str = "left_",
                   right_prefix: str = "right_") -> Column:
    """``LEFT col: v`` / ``RIGHT col: v`` blocks per column, missing -> ``NA``."""
    blocks = [F.concat(F.lit(f"LEFT {c}: "), F.coalesce(F.col(left_prefix + c).cast("string"), F.lit("NA")),
                       F.lit(f"\nRIGHT {c}: "), F.coalesce(F.col(right_prefix + c).cast("string"), F.lit("NA")))
              for c in columns]
    return F.concat_ws("\n\n", *blocks)


def literal_column(df: DataFrame, key_col: str, table: Sequence[tuple[str, str]], out_col: str) -> DataFrame:
    """Constant text chosen by a dataset key (a literal map lookup; no join needed)."""
    m = F.create_map(*[x for k, v in table for x in (F.lit(k), F.lit(v))])
    return df.withColumn(out_col, F.element_at(m, F.col(key_col)))
