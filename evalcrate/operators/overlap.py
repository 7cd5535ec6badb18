"""Token-overlap metrics: exact match, token F1, ROUGE-N, corpus BLEU.

All of them reduce to the bag intersection of two token lists of the same
row.  :func:`evalcrate.functions.bags.bag_overlap` computes it inside the row
(sort + one linear fold), so these jobs are map-only projections followed by
a one-row global aggregate: no explode, no shuffle keyed by token, and no
skew however frequent a token or long a text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalcrate.functions import text as T
from evalcrate.functions.bags import bag_overlap, f1_from_overlap, ngrams

# ---------------------------------------------------------------------------
# BLEU "13a" tokenizer (public sacreBLEU/mteval-v13a rules).
# Pre-processing replacements, applied in this order:
BLEU_13A_REPLACE = (("<skipped>", ""), ("-\n", ""), ("\n", " "),
                    ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
# Regex substitutions, applied in this order (Java replacement syntax):
BLEU_13A_REGEX = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),   # pad most ASCII punctuation
    (r"([^0-9])([\.,])", "$1 $2 "),               # period/comma unless preceded by a digit
    (r"([\.,])([^0-9])", " $1 $2"),               # period/comma unless followed by a digit
    (r"([0-9])(-)", "$1 $2 "),                    # dash after a digit
)
# ROUGE tokens: lower-cased runs of ASCII letters and digits, no stemming.
ROUGE_TOKEN = "[a-z0-9]+"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rouge_tokens(c) -> Column:
    # what is between the tokens of ROUGE_TOKEN; a split is linear, extracting copies the text for every match
    return F.array_remove(F.split(F.lower(F.coalesce(_c(c), F.lit(""))), "[^a-z0-9]+"), "")


def bleu_13a_tokens(c) -> Column:
    x = F.coalesce(_c(c), F.lit(""))
    for a, b in BLEU_13A_REPLACE:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.concat(F.lit(" "), x, F.lit(" "))
    for pat, rep in BLEU_13A_REGEX:
        x = F.regexp_replace(x, pat, rep)
    return T.py_split(x)


def whitespace_tokens(c) -> Column:
    return T.py_split(F.coalesce(_c(c), F.lit("")))


TOKENIZERS = {"13a": bleu_13a_tokens, "whitespace": whitespace_tokens, "rouge": rouge_tokens,
              "squad": T.answer_tokens}


def token_overlap(df: DataFrame, a_col: str, b_col: str, out_col: str = "overlap") -> DataFrame:
    """Per row, the multiset intersection size of two token-array columns."""
    return df.withColumn(out_col, bag_overlap(a_col, b_col))


def token_overlap_intersect_all(a: DataFrame, b: DataFrame, id_col: str, token_col: str) -> DataFrame:
    """O1: the same counts through ``INTERSECT ALL`` on exploded (id, token) rows.

    Kept as the relational cross-check of J7; it shuffles on (id, token), so
    the per-row form is the one the metrics use."""
    return (a.select(id_col, token_col).intersectAll(b.select(id_col, token_col))
            .groupBy(id_col).agg(F.count(F.lit(1)).alias("overlap")))


def pair_token_scores(df: DataFrame, pred_col: str = "pred", ref_col: str = "ref") -> DataFrame:
    """Per pair: SQuAD tokens, overlap, exact match, F1 (agree / zero empty policies)."""
    p, r = T.answer_tokens(pred_col), T.answer_tokens(ref_col)
    s = df.select("*", p.alias("_pt"), r.alias("_rt"))
    s = s.select("*", bag_overlap("_pt", "_rt").alias("same"), F.size("_pt").alias("n_pred"),
                 F.size("_rt").alias("n_ref"))
    f1 = f1_from_overlap("same", "n_pred", "n_ref")
    either_empty = (F.col("n_pred") == 0) | (F.col("n_ref") == 0)
    return s.select(
        *df.columns, "same", "n_pred", "n_ref",
        (F.array_join("_pt", " ") == F.array_join("_rt", " ")).cast("int").alias("exact"),
        F.when(either_empty, ((F.col("n_pred") == 0) & (F.col("n_ref") == 0)).cast("double"))
        .otherwise(f1).alias("f1"),
        f1.alias("f1_strict"))


def exact_match(df: DataFrame, pred_col: str = "pred", ref_col: str = "ref",
                group_cols: Sequence[str] = ()) -> DataFrame:
    """M6: mean of normalised equality."""
    s = pair_token_scores(df, pred_col, ref_col)
    g = s.groupBy(*group_cols) if group_cols else s
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("exact").cast("double")).alias("exact_match"))


def token_f1(df: DataFrame, pred_col: str = "pred", ref_col: str = "ref", empty_policy: str = "agree",
             group_cols: Sequence[str] = ()) -> DataFrame:
    """M7 (``empty_policy='agree'``: both empty -> 1) / M8 (``'zero'``: no overlap -> 0)."""
    s = pair_token_scores(df, pred_col, ref_col)
    col = "f1" if empty_policy == "agree" else "f1_strict"
    g = s.groupBy(*group_cols) if group_cols else s
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(col).alias("token_f1"))


def rouge_n_scores(df: DataFrame, pred_col: str = "pred", ref_col: str = "ref",
                   orders: Sequence[int] = (1, 2)) -> DataFrame:
    """Per pair ROUGE-n precision/recall/F1 for each order."""
    s = df.select("*", rouge_tokens(pred_col).alias("_pt"), rouge_tokens(ref_col).alias("_rt"))
    cols = []
    for n in orders:
        pg, rg = ngrams("_pt", n), ngrams("_rt", n)
        ov = bag_overlap(pg, rg)
        npred, nref = F.size(pg), F.size(rg)
        cols += [F.struct(ov.alias("o"), npred.alias("p"), nref.alias("r")).alias(f"_r{n}")]
    s = s.select(*df.columns, *cols)
    out = []
    for n in orders:
        o, p, r = F.col(f"_r{n}.o"), F.col(f"_r{n}.p"), F.col(f"_r{n}.r")
        out += [(o / F.greatest(p, F.lit(1))).alias(f"rouge{n}_precision"),
                (o / F.greatest(r, F.lit(1))).alias(f"rouge{n}_recall"),
                f1_from_overlap(o, p, r).alias(f"rouge{n}")]
    return s.select(*df.columns, *out)


def rouge_n(df: DataFrame, pred_col: str = "pred", ref_col: str = "ref", orders: Sequence[int] = (1, 2),
            group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean ROUGE-n F1 over pairs (the plain mean; see M15 for the bootstrap)."""
    s = rouge_n_scores(df, pred_col, ref_col, orders)
    g = s.groupBy(*group_cols) if group_cols else s
    return g.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"rouge{n}").alias(f"rouge{n}") for n in orders])


def bleu_counters(df: DataFrame, pred_col: str = "pred", ref_col: str = "ref", tokenizer: str = "13a", max_order: int = 4,
                  keep: Sequence[str] = ()) -> DataFrame:
    """Per pair what corpus BLEU sums up: token numbers ``tl``, ``rl``, matches ``m1``.. and possible matches ``c1``.. ."""
    tok = TOKENIZERS[tokenizer]
    s = df.select(*keep, tok(pred_col).alias("_pt"), tok(ref_col).alias("_rt"))
    per = [F.size("_pt").alias("tl"), F.size("_rt").alias("rl")]
    for n in range(1, max_order + 1):
        per += [bag_overlap(ngrams("_pt", n), ngrams("_rt", n)).alias(f"m{n}"),
                F.greatest(F.size("_pt") - n + 1, F.lit(0)).alias(f"c{n}")]
    return s.select(*keep, *per)


def bleu_of_sums(max_order: int = 4) -> Column:
    """BLEU from the sums of the columns of :func:`bleu_counters`."""
    prec = [F.coalesce(F.try_divide(F.col(f"m{n}").cast("double"), F.col(f"c{n}").cast("double")), F.lit(0.0)) for n in range(1, max_order + 1)]
    geo = F.when(F.least(*prec) > 0, F.exp(sum(F.log(p) for p in prec) / max_order)).otherwise(F.lit(0.0))
    ratio = F.try_divide(F.col("tl").cast("double"), F.col("rl").cast("double"))
    return geo * F.when(ratio > 1.0, F.lit(1.0)).otherwise(F.exp(1 - F.try_divide(F.lit(1.0), ratio)))


def corpus_bleu(df: DataFrame, pred_col: str = "pred", ref_col: str = "ref", tokenizer: str = "13a",
                max_order: int = 4, group_cols: Sequence[str] = ()) -> DataFrame:
    """Corpus BLEU without smoothing (clipped n-gram matches summed over pairs).

    One map-side projection computes per-pair matches and possible matches for
    every order; a single aggregate sums them; the final row applies the
    geometric mean and brevity penalty.
    """
    s = bleu_counters(df, pred_col, ref_col, tokenizer, max_order, group_cols)
    g = s.groupBy(*group_cols) if group_cols else s
    sums = g.agg(F.sum("tl").alias("translation_length"), F.sum("rl").alias("reference_length"),
                 *[F.sum(f"m{n}").alias(f"matches_{n}") for n in range(1, max_order + 1)],
                 *[F.sum(f"c{n}").alias(f"possible_{n}") for n in range(1, max_order + 1)])
    prec = [F.when(F.col(f"possible_{n}") > 0, F.col(f"matches_{n}") / F.col(f"possible_{n}"))
            .otherwise(F.lit(0.0)) for n in range(1, max_order + 1)]
    sums = sums.select("*", *[p.alias(f"precision_{n}") for n, p in enumerate(prec, 1)])
    pcols = [F.col(f"precision_{n}") for n in range(1, max_order + 1)]
    geo = F.when(F.least(*pcols) > 0,
                 F.exp(sum(F.log(c) for c in pcols) / max_order)).otherwise(F.lit(0.0))
    ratio = F.try_divide(F.col("translation_length").cast("double"), F.col("reference_length").cast("double"))
    bp = F.when(ratio > 1.0, F.lit(1.0)).otherwise(F.exp(1 - F.try_divide(F.lit(1.0), ratio)))
    return sums.select(*group_cols, (geo * bp).alias("bleu"), *pcols, bp.alias("brevity_penalty"),
                       ratio.alias("length_ratio"), "translation_length", "reference_length",
                       *[F.col(f"matches_{n}") for n in range(1, max_order + 1)],
                       *[F.col(f"possible_{n}") for n in range(1, max_order + 1)])
