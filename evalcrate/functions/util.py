"""Small Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def running_sums(values: Column) -> Column:
    """Sums of all elements before each element of an array of integers.

    Blocks of about the square root of the length keep the work at n * sqrt(n); a sum per element would be n * n."""
    def per_block(x):
        step, v = x["step"], x["v"]
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / step).cast("int")), lambda b: F.slice(v, b * step + 1, step))
        total = lambda a: F.aggregate(a, F.lit(0), lambda s, y: s + y)
        return let(F.struct(blocks.alias("b"), F.transform(blocks, total).alias("s")), lambda y: F.flatten(F.transform(
            y["b"], lambda block, i: let(F.struct(block.alias("block"), total(F.slice(y["s"], 1, i)).alias("first")), lambda z: F.transform(
                z["block"], lambda _, j: z["first"] + total(F.slice(z["block"], 1, j)))))))
    step = F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1))
    return F.when(F.size(values) > 0, let(F.struct(values.alias("v"), step.alias("step")), per_block)).otherwise(F.array().cast("array<int>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and bind it for ``body`` (``transform`` over a
    one-element array).  Higher-order functions run interpreted and do no
    common-subexpression elimination, so an expression used inside a lambda
    would otherwise be recomputed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)
