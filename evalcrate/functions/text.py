"""Column functions that clean raw model responses and normalise answers.

All functions map ``Column -> Column`` and compile to Catalyst built-ins, so
they stay inside whole-stage codegen (higher-order functions run
interpreted but still JVM-side).  Semantics follow Python's ``str`` methods
where the evaluated scripts use them; the Java-regex spelling needed for
parity is given next to each rule.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalcrate.functions.util import let

# ---------------------------------------------------------------------------
# Fixed values (must equal the evaluated scripts' definitions)
# ---------------------------------------------------------------------------
# Python's string.punctuation, the 32 ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# SQuAD article list.
ARTICLES = ("a", "an", "the")
# Strings dropped by the abstention answer extractor, in order.
EXTRACT_DROPS = ("</s>", "<pad>", "/n", "\\")
# ---------------------------------------------------------------------------

# Python str.split()/strip() whitespace = Unicode White_Space plus the
# four information separators \x1c-\x1f; Java's (?U)\s lacks the latter.
WS_CLASS = r"[\s\x1c-\x1f]"
WS_RUN = r"(?U)" + WS_CLASS + "+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(c) -> Column:
    """C4: Python ``str.strip()`` (Spark/DuckDB ``trim`` only strip spaces)."""
    return F.regexp_replace(_c(c), r"(?U)^" + WS_CLASS + r"+|" + WS_CLASS + r"+$", "")


def py_split(c) -> Column:
    """Python ``str.split()`` with no argument: whitespace runs, no empty items."""
    return F.filter(F.split(_c(c), WS_RUN), lambda t: t != "")


def py_pieces(c) -> Column:
    """The text cut behind every whitespace-separated token: a piece is a token with the white space before it (the last
    one may be white space alone).  Joined, the pieces are the text, character for character."""
    return F.split(_c(c), r"(?U)(?<=[^\s\x1c-\x1f])(?=" + WS_CLASS + ")")


def piece_count(pieces) -> Column:
    """Number of tokens among ``pieces`` of :func:`py_pieces`."""
    blank = F.element_at(pieces, -1).rlike(r"(?U)^" + WS_CLASS + "*$")
    return F.size(pieces) - blank.cast("int")


def cut_at_suffix(c, suffix: str | None) -> Column:
    """Text before the first occurrence of ``suffix``; empty/None = unchanged."""
    if not suffix:
        return _c(c)
    return F.substring_index(_c(c), suffix, 1)


def drop_suffix(c, suffix: str | None) -> Column:
    """Remove every occurrence of ``suffix``."""
    if not suffix:
        return _c(c)
    return F.replace(_c(c), F.lit(suffix), F.lit(""))


def drop_stop_tokens(c, stop_tokens: str | Iterable[str] | None) -> Column:
    """Remove every stop token; a string is split on ``+`` like the CLI form."""
    out = _c(c)
    if stop_tokens is None:
        return out
    toks = stop_tokens.split("+") if isinstance(stop_tokens, str) else list(stop_tokens)
    for t in toks:
        if t:
            out = F.replace(out, F.lit(t), F.lit(""))
    return out


def lower_nopunct(c) -> Column:
    """Lower-case, then delete (not blank) the ASCII punctuation characters."""
    return F.translate(F.lower(_c(c)), PUNCTUATION, "")


def answer_tokens(c) -> Column:
    """C6 ``get_tokens``: SQuAD-normalised whitespace tokens; NULL/'' -> []."""
    x = lower_nopunct(F.coalesce(_c(c), F.lit("")))
    x = F.regexp_replace(x, r"(?U)\b(" + "|".join(ARTICLES) + r")\b", " ")
    return py_split(x)


def normalize_answer(c) -> Column:
    """Lower -> drop punctuation -> articles to space -> collapse whitespace."""
    return F.array_join(answer_tokens(c), " ")


def resolve_binary(c, positive: str, negative: str) -> Column:
    """1 / 0 / -1 from the first positive/negative token, else first yes/no."""
    def pick(toks):
        first_pn = F.try_element_at(F.filter(toks, lambda t: t.isin(positive, negative)), F.lit(1))
        first_yn = F.try_element_at(F.filter(toks, lambda t: t.isin("yes", "no")), F.lit(1))
        mapped = F.when(first_yn == "yes", F.lit(positive)).when(first_yn == "no", F.lit(negative))
        resp = F.coalesce(first_pn, mapped)
        return F.when(resp == positive, F.lit(1)).when(resp == negative, F.lit(0)).otherwise(F.lit(-1))

    return let(answer_tokens(c), pick)


def format_class(cleaned, resolved, positive: str, negative: str) -> Column:
    """CORRECT (exact pos/neg) > RESOLVABLE (resolver found 0/1) > UNRESOLVABLE."""
    return (F.when(_c(cleaned).isin(positive, negative), F.lit("CORRECT"))
            .when(_c(resolved).isin(0, 1), F.lit("RESOLVABLE"))
            .otherwise(F.lit("UNRESOLVABLE")))


def extract_answer(c) -> Column:
    """Abstention answer extraction (drop markers, map to unanswerable/yes/no)."""
    x = _c(c)
    for s in EXTRACT_DROPS:
        x = F.replace(x, F.lit(s), F.lit(""))
    low = F.lower(x)
    return (F.when(low.contains("unanswerable"), F.lit("unanswerable"))
            .when(low.startswith("yes") | low.startswith(" yes"), F.lit("yes"))
            .when(low.startswith("no") | low.startswith(" no"), F.lit("no"))
            .otherwise(x))


def yes_flag(c) -> Column:
    """1 when the lower-cased text contains ``yes`` anywhere, else 0."""
    return F.lower(_c(c)).contains("yes").cast("int")


def label_contains(c, needle: str) -> Column:
    """substring predicate, e.g. ``'Y' in label``."""
    return _c(c).contains(needle)


def first_line(c) -> Column:
    """Strip, first line, strip."""
    return py_strip(F.substring_index(py_strip(c), "\n", 1))


def encode_label(c, vals: Iterable[str]) -> Column:
    """C14: index of the label in ``vals``; unseen labels -> len(vals) (OOV class)."""
    vals = list(vals)
    pos = F.array_position(F.array(*[F.lit(v) for v in vals]), _c(c))
    return F.when(pos > 0, pos - 1).otherwise(F.lit(len(vals))).cast("int")


def strip_prompt(text, prompt) -> Column:
    """P16 (text form): drop the echoed prompt from the start of the output."""
    t, p = _c(text), _c(prompt)
    return F.when(t.startswith(p), t.substr(F.length(p) + 1, F.lit(1 << 30))).otherwise(t)
