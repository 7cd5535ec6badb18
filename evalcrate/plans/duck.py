"""DuckDB spellings used by the oracle SQL (test oracle, not used by Spark jobs).

DuckDB's RE2 has ASCII-only ``\\b`` and ``\\s``; these helpers spell the
Python rules out explicitly so the oracle means the same thing as the Spark
column functions.
"""

from __future__ import annotations

from evalcrate.functions.text import PUNCTUATION

PUNCT_SQL = "'" + PUNCTUATION.replace("'", "''") + "'"
# Python str.split() whitespace, spelled out for RE2
WS_RE = (r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
         r"\x{202f}\x{205f}\x{3000}]")


def tokens(expr: str) -> str:
    """SQuAD tokens (articles dropped as whole tokens)."""
    return (f"list_filter(regexp_split_to_array(translate(lower(coalesce({expr}, '')), {PUNCT_SQL}, ''), "
            f"'{WS_RE}+'), lambda t: t <> '' AND t NOT IN ('a', 'an', 'the'))")


def normalize(expr: str) -> str:
    return f"array_to_string({tokens(expr)}, ' ')"


def py_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS_RE}+|{WS_RE}+$', '', 'g')"


def bag_overlap(a: str, b: str) -> str:
    """Multiset intersection size of two lists (quadratic; fine for the oracle)."""
    return (f"coalesce(list_sum(list_transform(list_distinct({a}), lambda u: "
            f"least(len(list_filter({a}, lambda v: v = u)), len(list_filter({b}, lambda v: v = u))))), 0)")


def resolve_binary(expr: str, pos: str, neg: str) -> str:
    toks = tokens(expr)
    first_pn = f"list_filter({toks}, lambda t: t IN ('{pos}', '{neg}'))[1]"
    first_yn = f"list_filter({toks}, lambda t: t IN ('yes', 'no'))[1]"
    resp = f"coalesce({first_pn}, CASE {first_yn} WHEN 'yes' THEN '{pos}' WHEN 'no' THEN '{neg}' END)"
    return f"(CASE {resp} WHEN '{pos}' THEN 1 WHEN '{neg}' THEN 0 ELSE -1 END)"


def r6(expr: str, alias: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {alias}"
