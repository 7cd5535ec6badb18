"""Token-accounting queries (M19-M21) over conversations, documents and dialogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalcrate.operators import accounting as A
from evalcrate.operators import prompts as P
from evalcrate.plans.fixture_sql import with_fixtures
from evalcrate.plans.q_prompts import _PICK_SQL, _examples, sq
from evalcrate.plans.registry import register
from evalcrate.sources import fixtures as FX
from evalcrate.sources.readers import read_table

MODEL = "gpt-3.5-turbo"  # falls back to the 3/1 rule
SYS = "You are a helpful assistant."
START, END = "Summarize the following: ", "\n Begin summary:"


def tok(x: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), '{A.NATIVE_TOKEN_RULE}'))"


@register("message_tokens", f"""
SELECT conv_id, CAST(sum(3 + {tok('role')} + {tok('text')}) + 3 AS BIGINT) AS n_tokens
FROM conversations GROUP BY conv_id""")
def q_message_tokens(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    return A.message_tokens(c, "conv_id", MODEL, "role", "text")


@register("message_tokens_total", f"""
SELECT CAST(count(DISTINCT conv_id) AS BIGINT) AS n_requests,
       CAST(sum(3 + {tok('role')} + {tok('text')}) + 3 * count(DISTINCT conv_id) AS BIGINT) AS total_tokens
FROM conversations""")
def q_message_tokens_total(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    return A.run_total(A.message_tokens(c, "conv_id", MODEL, "role", "text"))


@register("tokens_single_turn", f"""
SELECT CAST(count(*) AS BIGINT) AS n_requests,
       CAST(sum(3 + {tok("'user'")} + {tok(sq(START) + ' || text || ' + sq(END))} + 3
                + 3 + {tok("'system'")} + {tok(sq(SYS))}) AS BIGINT) AS total_tokens
FROM documents""")
def q_tokens_single_turn(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return A.run_total(A.tokens_single_turn(docs, "text", MODEL, SYS, START, END))


@register("tokens_multi_turn", with_fixtures("dialogues", extra=_PICK_SQL + f""",
pre AS (SELECT sum(3 + {tok("'user'")} + {tok('question')} + 3 + {tok("'assistant'")} + {tok('response')}) AS t
        FROM ex WHERE k <= 2)""") + f"""
SELECT CAST(count(*) AS BIGINT) AS n_requests,
       CAST(sum(3 + {tok("'user'")} + {tok('dialogue')} + 3 + (SELECT t FROM pre)
                + 3 + {tok("'system'")} + {tok(sq(SYS))}) AS BIGINT) AS total_tokens
FROM dialogues""")
def q_tokens_multi_turn(spark, sf_dir):
    ex = _examples(spark, sf_dir).where(F.col("k") <= 2)
    prefix = ex.select(F.explode(F.array(P.msg("user", F.col("question")), P.msg("assistant", F.col("response")))).alias("m")
                       ).select("m.role", "m.content")
    d = FX.dialogues(spark, sf_dir)
    return A.run_total(A.tokens_multi_turn(d, "dialogue", MODEL, SYS, prefix))
