"""Per-row multiset (bag) arithmetic on token arrays.

The size of the multiset intersection of two token lists (Python
``Counter(a) & Counter(b)``) is the core of token F1, ROUGE-N and BLEU.  It
is computed *inside the row*: both lists are sorted (O(n log n)) and merged
with one linear ``aggregate``.  No explode, no shuffle: the work per row is
bounded by the row itself, so a skewed key or a long document cannot pile up
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalcrate.functions.util import let


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bag_overlap(a, b) -> Column:
    """``sum((Counter(a) & Counter(b)).values())`` as a LONG column.

    Both lists are sorted (natural string order, no comparator lambda) and
    walked once with two cursors: equal heads count a match and advance both,
    otherwise the smaller head advances — the merge step of merge sort, so a
    token's matches are exactly ``min(count_a, count_b)``."""
    empty = F.array().cast("array<string>")

    def walk(x):
        sa, sb = x["a"], x["b"]
        na, nb = F.size(sa), F.size(sb)
        init = F.struct(F.lit(1).alias("i"), F.lit(1).alias("j"), F.lit(0).cast("long").alias("c"))

        def step(acc, _k):
            i, j = acc["i"], acc["j"]
            ai = F.element_at(sa, F.least(i, F.greatest(na, F.lit(1))))
            bj = F.element_at(sb, F.least(j, F.greatest(nb, F.lit(1))))
            return (F.when((i > na) | (j > nb), acc)
                    .when(ai == bj, F.struct((i + 1).alias("i"), (j + 1).alias("j"), (acc["c"] + 1).alias("c")))
                    .when(ai < bj, F.struct((i + 1).alias("i"), j.alias("j"), acc["c"].alias("c")))
                    .otherwise(F.struct(i.alias("i"), (j + 1).alias("j"), acc["c"].alias("c"))))

        steps = F.sequence(F.lit(1), F.greatest(na + nb, F.lit(1)))
        return F.aggregate(steps, init, step, lambda acc: acc["c"])

    pair = F.struct(F.sort_array(F.coalesce(_c(a), empty)).alias("a"), F.sort_array(F.coalesce(_c(b), empty)).alias("b"))
    return let(pair, walk)


def ngrams(tokens, n: int) -> Column:
    """Contiguous n-grams joined by a single space (tokens never hold spaces):
    ``n`` shifted slices of the token array zipped element-wise."""
    if n == 1:
        return _c(tokens)

    def grams(t):
        k = F.greatest(F.size(t) - n + 1, F.lit(0))
        g = F.slice(t, 1, k)
        for off in range(1, n):
            g = F.zip_with(g, F.slice(t, off + 1, k), lambda x, y: F.concat(x, F.lit(" "), y))
        return F.when(k > 0, g).otherwise(F.array().cast("array<string>"))

    return grams(_c(tokens)) if isinstance(tokens, str) else let(_c(tokens), grams)


def f1_from_overlap(overlap, n_pred, n_ref) -> Column:
    """``2·same/(n_pred+n_ref)``, 0 when nothing overlaps (equals 2PR/(P+R))."""
    o, p, r = _c(overlap), _c(n_pred), _c(n_ref)
    return F.when(o > 0, (2.0 * o) / (p + r)).otherwise(F.lit(0.0))
