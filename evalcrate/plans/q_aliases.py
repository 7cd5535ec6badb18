"""
another operator).  They run the same plan as the operator they point to;
``has_prediction`` and ``tokenize_fn`` are small queries of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalcrate.operators.accounting import python_token_counter
from evalcrate.plans.fixture_sql import with_fixtures
from evalcrate.plans.registry import ORACLE, QUERIES, register
from evalcrate.session import ship_package
from evalcrate.sources import fixtures as FX
from evalcrate.sources.readers import read_table

ALIASES = {
    "top1_by_key": "best_reference_f1",        # T1
    "limit_n": "head_limit",                   # T3
    "min_over_groups": "worst_group_accuracy",  # T4
    "union_lists": "answerability",            # O3
    "score_scalar_f1": "em_confusion",         # M24
}

for _alias, _target in ALIASES.items():
    if _target in QUERIES and _alias not in QUERIES:   # (worker processes import without the registry)
        register(_alias, ORACLE.get(_target))(QUERIES[_target])


@register("has_prediction", with_fixtures("multi_ref_gold", "multi_ref_pred") + """
SELECT DISTINCT g.question_id FROM multi_ref_gold g SEMI JOIN multi_ref_pred p ON g.question_id = p.question_id""")
def q_has_prediction(spark, sf_dir):
    """gold questions that have a prediction (semi join)."""
    gold = FX.multi_ref_gold(spark, sf_dir).select("question_id").distinct()
    return gold.join(FX.multi_ref_pred(spark, sf_dir), "question_id", "left_semi")


_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@register("tokenize_fn", f"""
SELECT conv_id, turn, CAST(len(list_filter(regexp_split_to_array(text, '{_WS}'), lambda w: w <> '')) AS BIGINT) AS n_tokens
FROM conversations""")
def q_tokenize_fn(spark, sf_dir):
    """A user-supplied Python tokenizer (here ``str.split``) in an Arrow-batched UDF."""
    ship_package(spark)
    count = python_token_counter(str.split)
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", count(F.col("text")).alias("n_tokens"))
