"""Operator 5: mixing sources to target weights by entropy balancing.

Every document gets a rate (expected copies) ``r = min(2, exp(l * x))`` with x
its size over the mean size of its source: the rates closest in relative entropy
to "each once" that meet the source's token target and the cap of two copies.
The multiplier ``l`` of each source solves the convex dual; all sources step
together, one distributed aggregate over (source, size) counts a Newton step,
kept inside a bracket.  Sums are exact decimals, so reruns agree bit by bit.

Rounding into copies: within a source, sizes go from large to small and carry
the words still owed, so a source ends about half its smallest document from its
target.  The copies of a (source, size) cell are dealt to 64 salted sub-cells in
proportion, and inside a sub-cell by a hash order of the doc_ids; a group of
equal sizes holding a third of all rows is spread over 64 groups.

The driver holds one row per source, as the target vector does.

Edge cases: a null or empty text has size 0 and takes 0 words; null is a source
of its own, last in order; a source without words has target 0; repeated rows
are documents of their own; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalcrate.llm.shared import hidden, local_rows, saved

WEIGHTS = (3, 1, 2)
SALTS = 64
CAP = 2
SPACE = r"[\x20\x09-\x0D]+"  # between words


def source_targets(sizes: list[tuple[str | None, int]], share: float = 1.5, cap: int = CAP,
                   weights: tuple = WEIGHTS) -> dict[str | None, float]:
    """Target words per source: ``share`` of all words by weight, no source above ``cap`` times its size."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, free, out = share * sum(size.values()), [s for s, _ in order], {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > cap * size[s]]
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = float(cap * size[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def _rate(lam, x):
    return F.when(lam * x >= F.lit(math.log(CAP)), F.lit(float(CAP))).otherwise(F.exp(lam * x))


def _solve(cells: DataFrame, stats: list, targets: dict, steps: int) -> dict[str | None, float]:
    """Multiplier of every source; infinite where even two copies of all only just reach the target."""
    spark = cells.sparkSession
    state = {}
    for r in stats:
        t = targets[r.source]
        if r.words and t < CAP * r.words:
            state[r.source] = [0.0, -math.inf, math.inf]
    done = {r.source: math.inf for r in stats if r.source not in state}
    mean = {r.source: r.words / r.docs for r in stats if r.words}
    for _ in range(steps):
        if not state:
            break
        params = local_rows(spark, [(s, v[0], mean[s]) for s, v in state.items()], "source string, lam double, mean double")
        x, words = F.col("size") / F.col("mean"), F.col("n") * F.col("size")
        rate = _rate(F.col("lam"), x)
        sums = (cells.join(params, cells.source.eqNullSafe(params.source)).select(
            params.source, (words * rate).cast("decimal(38,6)").alias("w"),
            F.when(rate < CAP, words * x * rate).otherwise(0.0).cast("decimal(38,6)").alias("g"))
            .groupBy("source").agg(F.sum("w").alias("w"), F.sum("g").alias("g")).collect())
        for r in sums:
            lam, low, high = state[r.source]
            gap, slope = float(r.w) - targets[r.source], float(r.g)
            if abs(gap) <= max(0.01, 1e-9 * targets[r.source]):
                done[r.source] = lam
                del state[r.source]
                continue
            low, high = (lam, high) if gap < 0 else (low, lam)
            step = lam - gap / slope if slope > 0 else math.nan
            if not low < step < high:
                step = (low + high) / 2 if math.isfinite(low + high) else (
                    2 * low + 1 if math.isinf(high) else 2 * high - 1)
            state[r.source] = [step, low, high]
    return done | {s: v[0] for s, v in state.items()}


def _copies(pdf):
    """Whole copies of each size of one source, largest size first, carrying the words owed."""
    pdf = pdf.sort_values("size", ascending=False, kind="stable")
    owed, out = 0.0, []
    for size, n, rate in zip(pdf["size"].tolist(), pdf["n"].tolist(), pdf["rate"].tolist()):
        owed += n * rate * size
        k = min(max(math.floor(owed / size + 0.5), 0), CAP * n) if size else 0
        owed -= k * size
        out.append(k)
    return pdf[["source", "size", "n"]].assign(k=out)


def _source_key(source):
    """Never null, so that the window's partitioning serves the join as well."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _sized(docs: DataFrame) -> DataFrame:
    # split, not matched one by one: a match result copies the whole text in Java
    words = F.coalesce(F.size(F.array_remove(F.split(F.col("text").cast("string"), SPACE), "")), F.lit(0)).cast("long")
    words = F.when(F.col("text").isNull(), F.lit(0).cast("long")).otherwise(words)
    return docs.withColumns({"_source": F.col("source").cast("string"), "_key": _source_key(F.col("source").cast("string")), "_size": words,
                             "_salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")})


def _dealt(docs: DataFrame, share: float, steps: int) -> tuple[DataFrame, DataFrame]:
    """Documents, all columns, with ``_copies``; and one row per source ``s, source_size, target``."""
    spark = docs.sparkSession
    slim = _sized(docs).select(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_salt").alias("salt"))
    sub = saved(slim.groupBy("source", "size", "salt").agg(F.count("*").alias("m")), "mix-cells")
    cells = saved(sub.groupBy("source", "size").agg(F.sum("m").alias("n")), "mix-sizes")
    stats = cells.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("words")).collect()
    targets = source_targets([(r.source, r.words) for r in stats], share)
    lams = _solve(cells, stats, targets, steps)
    params = local_rows(
        spark, [(r.source, r.words, targets[r.source], lams[r.source], r.words / r.docs) for r in stats],
        "s string, source_size long, target double, lam double, mean double")
    rate = F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("lam") == F.lit(math.inf), F.lit(float(CAP))).otherwise(
        _rate(F.col("lam"), F.col("size") / F.col("mean")))
    rates = cells.join(params, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", rate.alias("rate"))
    whole = saved(rates.groupBy("source").applyInPandas(_copies, "source string, size long, n long, k long"), "mix-copies")

    upto = F.sum("m").over(Window.partitionBy("source", "size").orderBy("salt"))
    dealt = sub.join(whole, sub.source.eqNullSafe(whole.source) & (sub["size"] == whole["size"])).select(
        sub.source, sub["size"], "salt", "m", "n", "k").withColumn("upto", upto)
    share_of = (F.expr("CAST(CAST(k AS DECIMAL(38,0)) * upto DIV n AS BIGINT)")
                - F.expr("CAST(CAST(k AS DECIMAL(38,0)) * (upto - m) DIV n AS BIGINT)"))
    dealt = dealt.select(_source_key(F.col("source")).alias("_s"), F.col("size").alias("_z"), F.col("salt").alias("_t"),
                         F.col("m").alias("_m"), share_of.alias("_k"))
    place = F.row_number().over(Window.partitionBy("_key", "_size", "_salt").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id"))
    out = (_sized(docs).withColumn("_place", place)
           .join(dealt, (F.col("_key") == F.col("_s")) & (F.col("_size") == F.col("_z")) & (F.col("_salt") == F.col("_t")))
           .withColumn("_copies", F.expr("_k DIV _m") + (F.col("_place") <= F.expr("_k % _m")).cast("long")))
    return out, params


_OWN = ["_source", "_key", "_size", "_salt", "_place", "_s", "_z", "_t", "_m", "_k", "_copies", "_copy"]


def mix_sources(docs: DataFrame, share: float = 1.5, steps: int = 60) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken``."""
    out, params = _dealt(docs.select("doc_id", "text", "source"), share, steps)
    return out.join(params, F.col("_source").eqNullSafe(F.col("s"))).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_copies") * F.col("_size")).alias("taken"))


def mixed(docs: DataFrame, share: float = 1.5, steps: int = 60) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as it is taken."""
    columns = docs.columns
    docs, back = hidden(docs, _OWN)
    out, _ = _dealt(docs, share, steps)
    out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))))
    return out.select(*docs.columns).withColumnsRenamed(back).select(*columns)
