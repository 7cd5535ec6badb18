"""Multiple-choice option parsing and answer inference.

Everything is a higher-order-function expression over the row's own option
list (a handful of items), so it runs map-side with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from evalcrate.functions.util import let, running_sums

# The options tail pattern and the characters that may follow
# an option key when the answer names it ("A)", "A:", "A.", "A,", "A ").
OPTIONS_TAIL = r"\{(.+?)\}$"
KEY_FOLLOWERS = r"(\)|:|\.|,| )"

OPTION_ARRAY = "array<struct<key:string,value:string>>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_options(question) -> Column:
    """C11: ``{A: x, B: y}`` tail -> ordered ``array<struct<key, value>>``.

    Items split on ``', '`` then ``': '``; an item without exactly one ``': '``
    fails the job (Python raises); a repeated key keeps its first position and
    its last value (Python dict semantics).  No tail -> empty array."""
    inner = F.regexp_extract(_c(question), OPTIONS_TAIL, 1)
    items = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ", "))
    err = F.raise_error(F.lit("malformed option item")).cast("string")

    def to_pair(it):
        parts = F.split(it, ": ")
        ok = F.size(parts) == 2
        return F.struct(F.when(ok, F.element_at(parts, 1)).otherwise(err).alias("key"),
                        F.when(ok, F.element_at(parts, 2)).otherwise(err).alias("value"))

    def dedupe(pairs):
        tagged = F.transform(pairs, lambda p, i: F.struct(
            p["key"].alias("key"),
            F.element_at(F.filter(pairs, lambda q: q["key"] == p["key"]), -1)["value"].alias("value"),
            i.alias("i")))
        firsts = F.filter(tagged, lambda x: ~F.exists(F.slice(pairs, 1, x["i"]), lambda q: q["key"] == x["key"]))
        return F.transform(firsts, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))

    return let(F.transform(items, to_pair), dedupe)


def _quote(lit_text: Column) -> Column:
    """Java-regex literal quoting ``\\Q...\\E`` that survives an embedded ``\\E``."""
    return F.concat(F.lit("\\Q"), F.replace(lit_text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def match_positions(target, pattern) -> Column:
    """0-based start offsets of the non-overlapping matches of ``pattern``
    (a Java regex column) in ``target``, like ``[m.start() for m in re.finditer]``."""
    t, p = _c(target), _c(pattern)

    def positions(mp):
        matches, pieces = mp["m"], mp["p"]
        # a match starts behind all pieces and matches before it: its own piece is the last of them
        lengths = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda x, m: F.length(x) + F.length(m))
        return F.zip_with(running_sums(lengths), F.slice(pieces, 1, F.size(matches)), lambda s, x: s + F.length(x))

    return let(F.struct(F.regexp_extract_all(t, p, 0).alias("m"), F.split(t, p).alias("p")), positions)


def literal_positions(target, text) -> Column:
    """Offsets of the literal ``text`` (quoted, so regex metacharacters are plain)."""
    return _fixed_positions(_c(target), _quote(_c(text)), F.length(_c(text)))


def _fixed_positions(target: Column, pattern: Column, length: Column) -> Column:
    """``match_positions`` of a pattern whose matches all have ``length`` characters: the text is split once and no match
    is extracted (Java copies the whole text for every match result)."""
    def positions(x):
        ends = F.slice(x["p"], 1, F.size(x["p"]) - 1)
        lengths = F.transform(ends, lambda y: F.length(y) + x["n"])
        return F.zip_with(running_sums(lengths), ends, lambda s, y: s + F.length(y))
    split = let(F.struct(F.split(target, pattern).alias("p"), length.alias("n")), positions)
    return F.when(length > 0, split).otherwise(match_positions(target, pattern))


def first_match(target, options, use_values: bool, op: str = "min") -> Column:
    """The option whose offset list is smallest (``op='min'``) or largest,
    list compared element-wise then by length; ties -> earlier option.  Options
    without any match are dropped first (F4).  Keys must be followed by one of
    ``) : . , space``; values are matched as literal text (the evaluated script
    passes them to ``re`` unescaped — literal matching is the deliberate,
    documented difference)."""
    t = _c(target)

    def cand(o, i):
        name = o["value"] if use_values else o["key"]
        pat = _quote(name) if use_values else F.concat(_quote(name), F.lit(KEY_FOLLOWERS))
        found = _fixed_positions(t, pat, F.length(name) + F.lit(0 if use_values else 1))
        return F.struct(found.alias("pos"), i.alias("idx"), o["key"].alias("key"))

    cands = F.filter(F.transform(_c(options), cand), lambda c: F.size(c["pos"]) > 0)
    pick = F.array_min(cands) if op == "min" else F.array_max(
        F.transform(cands, lambda c: F.struct(c["pos"].alias("pos"), (-c["idx"]).alias("idx"), c["key"].alias("key"))))
    return pick["key"]


def infer_option(question, target) -> Column:
    """Exact key; exact (stripped) value; earliest key mention; earliest value
    mention; else NULL.  Questions without options give NULL."""
    from evalcrate.functions.text import py_strip

    def pick(x):
        opts, tgt, raw = x["opts"], x["tgt"], x["raw"]
        exact_key = F.when(F.exists(opts, lambda o: o["key"] == tgt), tgt)
        exact_val = F.try_element_at(F.filter(opts, lambda o: py_strip(o["value"]) == tgt), F.lit(1))["key"]
        return F.when(F.size(opts) > 0, F.coalesce(exact_key, exact_val, first_match(raw, opts, False),
                                                   first_match(raw, opts, True)))

    return let(F.struct(parse_options(question).alias("opts"), py_strip(target).alias("tgt"),
                        _c(target).alias("raw")), pick)


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def _py_regex_positions(target, patterns):
    """Start offsets of ``re.finditer(p, target)`` for every pattern of the row;
    an invalid pattern gives [] (the evaluated script's behaviour)."""
    import re

    import pandas as pd

    out = []
    for t, pats in zip(target, patterns):
        row = []
        for p in (pats if pats is not None else []):
            try:
                row.append([m.start() for m in re.finditer(p, t or "")])
            except Exception:  # noqa: BLE001 - invalid pattern
                row.append([])
        out.append(row)
    return pd.Series(out)


def first_match_from_positions(options, positions, op: str = "min") -> Column:
    """T2 over precomputed offset lists (``positions[i]`` belongs to ``options[i]``)."""
    opts, pos = _c(options), _c(positions)
    cands = F.filter(F.transform(opts, lambda o, i: F.struct(F.element_at(pos, i + 1).alias("pos"),
                                                             (i if op == "min" else -i).alias("idx"),
                                                             o["key"].alias("key"))),
                     lambda c: F.size(c["pos"]) > 0)
    return (F.array_min(cands) if op == "min" else F.array_max(cands))["key"]


def infer_option_df(df, question_col: str, target_col: str, out_col: str = "answer",
                    value_match: str = "literal"):
    """C12 as a DataFrame step.  ``value_match='python'`` matches option values
    as Python regular expressions (exactly as the evaluated script, invalid
    patterns matching nothing) in an Arrow-batched UDF; ``'literal'`` stays
    JVM-side and treats values as plain text."""
    from evalcrate.functions.text import py_strip
    from evalcrate.session import ship_package

    d = df.withColumn("_opts", parse_options(question_col)).withColumn("_tgt", py_strip(target_col))
    opts, tgt = F.col("_opts"), F.col("_tgt")
    if value_match == "python":
        ship_package(df.sparkSession)
        d = d.withColumn("_vpos", _py_regex_positions(F.col(target_col), F.transform(opts, lambda o: o["value"])))
        by_value = first_match_from_positions("_opts", "_vpos")
    else:
        by_value = first_match(target_col, opts, True)
    exact_key = F.when(F.exists(opts, lambda o: o["key"] == tgt), tgt)
    exact_val = F.try_element_at(F.filter(opts, lambda o: py_strip(o["value"]) == tgt), F.lit(1))["key"]
    answer = F.when(F.size(opts) > 0, F.coalesce(exact_key, exact_val, first_match(target_col, opts, False), by_value))
    return d.withColumn(out_col, answer).drop("_opts", "_tgt", "_vpos")
