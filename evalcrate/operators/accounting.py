"""Token accounting for chat requests.

Per request: sum over messages of (per_message + tokens of every value, the
role text included, + per_name when a name is set) + 3.  Counting is a
column expression per message row followed by a partial/final aggregate per
request, so no request's messages are ever gathered into one array.

Default tokenizer: a native regex rule (word runs or single non-space
characters) — JVM-side and reproducible in SQL, but it is *not* a BPE
encoder.  A real encoder plugs in through :func:`python_token_counter` (U2).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

# ---------------------------------------------------------------------------
# Per-model message overheads (tokens_per_message, tokens_per_name).
# Exact names with the 3/1 rule:
RULE_3_1_MODELS = ("gpt-3.5-turbo-0613", "gpt-3.5-turbo-16k-0613", "gpt-4-0314", "gpt-4-32k-0314",
                   "gpt-4-0613", "gpt-4-32k-0613")
# Exact name with the 4/-1 rule:
RULE_4_M1_MODEL = "gpt-3.5-turbo-0301"
# Names containing these fall back to the 3/1 rule, tested in this order:
RULE_FALLBACK_SUBSTRINGS = ("gpt-3.5-turbo", "gpt-4")
# Tokens added once to each request.
REPLY_PRIMING = 3
# ---------------------------------------------------------------------------

# word runs or single non-space characters (ASCII classes, spelled out so that
# Java regex and RE2 agree on vertical tab)
NATIVE_TOKEN_RULE = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0B\f\r]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def native_token_count(c) -> Column:
    """Token count of a string under the native rule (NULL counts 0)."""
    marked = F.regexp_replace(F.coalesce(_c(c), F.lit("")), NATIVE_TOKEN_RULE, "x")  # one mark a token, then only marks
    return F.length(F.regexp_replace(marked, r"[ \t\n\x0B\f\r]+", "")).cast("long")


def python_token_counter(encode: Callable[[str], list]) -> Callable[[Column], Column]:
    """Wrap a Python tokenizer (e.g. a BPE encoder's ``encode``) as an
    Arrow-batched pandas UDF returning token counts."""
    @F.pandas_udf(LongType())
    def _count(s):
        return s.fillna("").map(lambda x: len(encode(x))).astype("int64")

    return lambda c: _count(_c(c))


def python_tokenizer(encode: Callable[[str], list], ids: bool = False) -> Callable[[Column], Column]:
    """A Python tokenizer as an Arrow-batched pandas UDF returning the
    token list (strings, or integer ids with ``ids=True``)."""
    out_type = ArrayType(LongType()) if ids else ArrayType(StringType())

    @F.pandas_udf(out_type)
    def _tok(s):
        import pandas as pd
        return pd.Series([list(encode(x)) for x in s.fillna("")])

    return lambda c: _tok(_c(c))


def message_rule(model: str) -> tuple[int, int]:
    """(tokens_per_message, tokens_per_name) for a model name; unknown -> error."""
    if model in RULE_3_1_MODELS:
        return 3, 1
    if model == RULE_4_M1_MODEL:
        return 4, -1
    for sub in RULE_FALLBACK_SUBSTRINGS:
        if sub in model:
            return 3, 1
    raise NotImplementedError(f"token rule not implemented for model {model}")


def message_tokens(messages: DataFrame, request_cols, model: str, role_col: str = "role",
                   content_col: str = "content", name_col: str | None = None,
                   count: Callable[[Column], Column] = native_token_count) -> DataFrame:
    """Tokens per request from long-form messages ``(request keys.., role, content[, name])``."""
    per_msg, per_name = message_rule(model)
    keys = [request_cols] if isinstance(request_cols, str) else list(request_cols)
    t = F.lit(per_msg) + count(role_col) + count(content_col)
    if name_col:
        t = t + F.when(F.col(name_col).isNotNull(), count(name_col) + per_name).otherwise(0)
    return (messages.groupBy(*keys).agg((F.sum(t) + REPLY_PRIMING).alias("n_tokens")))


def _msg_tokens(role: str, content: Column, per_msg: int, count) -> Column:
    return F.lit(per_msg) + count(F.lit(role)) + count(content)


def tokens_single_turn(df: DataFrame, input_col: str, model: str, system_prompt: str | None,
                       start_prompt: str = "", end_prompt: str = "", history_tokens: Column | None = None,
                       count: Callable[[Column], Column] = native_token_count) -> DataFrame:
    """Per row ``system + history + user(start + text + end)``; returns per-row
    ``n_tokens`` (sum it for the run total)."""
    per_msg, _ = message_rule(model)
    user = F.concat(F.lit(start_prompt), F.coalesce(_c(input_col), F.lit("")), F.lit(end_prompt))
    total = _msg_tokens("user", user, per_msg, count) + REPLY_PRIMING
    if system_prompt is not None:
        total = total + _msg_tokens("system", F.lit(system_prompt), per_msg, count)
    if history_tokens is not None:
        total = total + history_tokens
    return df.withColumn("n_tokens", total.cast("long"))


def prefix_tokens(prefix_messages: DataFrame, model: str, role_col: str = "role", content_col: str = "content",
                  count: Callable[[Column], Column] = native_token_count) -> DataFrame:
    """One row: total tokens of a fixed chat prefix (computed once, not per row)."""
    per_msg, _ = message_rule(model)
    return prefix_messages.agg(
        F.coalesce(F.sum(F.lit(per_msg) + count(role_col) + count(content_col)), F.lit(0)).cast("long").alias("prefix_tokens"))


def tokens_multi_turn(df: DataFrame, input_col: str, model: str, system_prompt: str | None,
                      prefix_messages: DataFrame, count: Callable[[Column], Column] = native_token_count) -> DataFrame:
    """Per row ``system + fixed chat prefix + user(text)``; the prefix total is a
    scalar subquery evaluated once."""
    pre = prefix_tokens(prefix_messages, model, count=count).select("prefix_tokens").scalar()
    return tokens_single_turn(df, input_col, model, system_prompt, history_tokens=pre, count=count)


def run_total(per_row: DataFrame, group_cols=()) -> DataFrame:
    """Sum of per-request tokens (per run when ``group_cols`` are given)."""
    g = per_row.groupBy(*group_cols) if group_cols else per_row
    return g.agg(F.count(F.lit(1)).alias("n_requests"), F.sum("n_tokens").alias("total_tokens"))
