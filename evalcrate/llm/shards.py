"""Operator 2: byte-balanced sharding by histogram sort (DataFrame functions only).

Rows are sorted by ``(crc32 of the text, doc_id)``; shard ``i`` is the i-th range.
The splitters come from a histogram sort: each round counts, in one aggregate
over slim keys, the exact bytes in every probe bucket of the open intervals, and
keeps for each splitter the bucket its target falls into, until a bucket edge is
within ``tolerance`` of a shard's bytes or the bucket is one single key.  Probing
goes by the text's CRC first, so equal texts stay in one shard unless a group of
copies is itself larger than the tolerance; only such a group is refined by
doc_id.  Then the rows are exchanged once, by (shard, cell).

Slots are gapless within a shard: a cell is a narrow CRC range (a slice of the
doc_ids for a hot text), ``row_number`` runs inside cells and a running sum over
the cell counts gives each cell's first slot, so no task sorts a whole shard.

Edge cases: a null text has no bytes (size 8, CRC 0); a null doc_id sorts first;
repeated rows get slots of their own; an empty table returns no rows; columns
named like the results (``size, text_crc32, law, shard, slot, grown_shard``) are
replaced, all others are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalcrate.llm.shared import hidden, saved

PROBES = 256
CELL_ROWS = 100_000
HOT_TEXTS = 200
LOWEST = -(1 << 63)


@dataclass
class _Open:
    """A splitter still sought: the key range its target falls into, and the bytes below it."""
    target: float
    crc: int | None  # None: probing CRCs; else probing the doc_ids of this CRC
    low: int
    high: int
    below: int


def _probe(keys: DataFrame, spans: list[tuple]) -> dict[tuple, list]:
    """Exact bytes, first and last key of every non-empty probe bucket of each span, in key order."""
    where, span, bucket = F.lit(False), None, None
    for i, (crc, low, high) in enumerate(spans):
        value = F.col("crc") if crc is None else F.col("doc")
        inside = value.between(F.lit(low), F.lit(high))
        if crc is not None:
            inside = inside & (F.col("crc") == crc)
        offset = (value.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")).cast("double")
        b = F.floor(offset * F.lit(PROBES / (high - low + 1.0)))
        where = where | inside
        span = F.when(inside, i) if span is None else span.when(inside, i)
        bucket = F.when(inside, b) if bucket is None else bucket.when(inside, b)
    value = None
    for i, (crc, _, _) in enumerate(spans):
        v = F.col("crc") if crc is None else F.col("doc")
        value = F.when(F.col("s") == i, v) if value is None else value.when(F.col("s") == i, v)
    rows = (keys.where(where).withColumn("s", span).withColumn("b", bucket).groupBy("s", "b")
            .agg(F.sum("size").alias("bytes"), F.min(value).alias("first"), F.max(value).alias("last"),
                 F.min("doc").alias("d0"), F.max("doc").alias("d1")).collect())
    out: dict[tuple, list] = {s: [] for s in spans}
    for r in sorted(rows, key=lambda r: (r.s, r.b)):
        out[spans[r.s]].append(r)
    return out


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """``shards - 1`` keys ``(crc, doc)``: the last key of each shard but the last."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    slack = tolerance * total / shards
    top = (1 << 63) - 1
    cuts: list[tuple[int, int] | None] = [None] * (shards - 1)
    todo = {i: _Open((i + 1) * total / shards, None, 0, (1 << 32) - 1, 0) for i in range(shards - 1)}
    while todo:
        found = _probe(keys, sorted({(o.crc, o.low, o.high) for o in todo.values()}, key=str))
        for i, o in list(todo.items()):
            below = o.below
            for r in found[(o.crc, o.low, o.high)]:
                if below + r.bytes > o.target:
                    break
                below += r.bytes
            before, after = o.target - below, below + r.bytes - o.target
            single = r.first == r.last
            if min(before, after) <= slack or (single and (o.crc is not None or r.d0 == r.d1)):
                last = r.last if after < before else r.first - 1
                if o.crc is None:
                    cuts[i] = (last, top)
                else:
                    cuts[i] = (o.crc, last) if last >= LOWEST else (o.crc - 1, top)
                del todo[i]
            elif single:
                todo[i] = _Open(o.target, r.first, r.d0, r.d1, below)
            else:
                todo[i] = _Open(o.target, o.crc, r.first, r.last, below)
    return cuts


def histogram_shards(docs: DataFrame, shards: int = 24, tolerance: float = 0.005) -> DataFrame:
    """``docs`` with ``size, text_crc32, law, shard, slot, grown_shard``."""
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    docs, back = hidden(docs.drop(*new), ["_size", "_crc", "_doc", "_cell", "_rank", "_slice", "_first", "_local"])
    columns = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumns({
        "_size": F.octet_length(text).cast("long") + F.lit(8), "_crc": F.crc32(text.cast("binary")),
        "_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))})
    keys = saved(rows.select(F.col("_crc").alias("crc"), F.col("_doc").alias("doc"), F.col("_size").alias("size")),
                 "shard-keys")
    n = keys.count()
    limit = max(CELL_ROWS, n // HOT_TEXTS)
    hot = {r.crc: r for r in keys.groupBy("crc").agg(F.count("*").alias("n"), F.min("doc").alias("d0"),
                                                     F.max("doc").alias("d1")).where(F.col("n") > limit).collect()}
    width = max(1, (1 << 32) * limit // max(n, limit))

    def placed(df: DataFrame, crc: str, doc: str, cuts: list) -> DataFrame:
        shard = F.lit(0)
        for c, d in cuts:
            shard = shard + ((F.col(crc) > c) | ((F.col(crc) == c) & (F.col(doc) > d))).cast("int")
        slice_ = F.lit(0)
        for c, r in sorted(hot.items()):  # at most HOT_TEXTS of them
            part = F.floor((F.col(doc).cast("decimal(20,0)") - F.lit(r.d0).cast("decimal(20,0)")).cast("double")
                           * F.lit(-(-r.n // limit) / (r.d1 - r.d0 + 1.0)))
            slice_ = F.when(F.col(crc) == c, part.cast("int")).otherwise(slice_)
        cell = F.floor(F.col(crc) / F.lit(width))
        # a hot text is a cell of its own between its neighbours of the same range
        rank = F.lit(0)
        for c in sorted(hot):
            rank = rank + (F.col(crc) >= c).cast("int") + (F.col(crc) > c).cast("int")
        return df.withColumns({"shard": shard, "_cell": cell, "_rank": rank, "_slice": slice_})

    cuts = splitters(keys, shards, tolerance)
    cell = ["shard", "_cell", "_rank", "_slice"]
    order = Window.partitionBy("shard").orderBy("_cell", "_rank", "_slice")
    first = (placed(keys, "crc", "doc", cuts).groupBy(*cell).agg(F.count("*").alias("_n"))
             .withColumn("_first", F.sum("_n").over(order) - F.col("_n")).drop("_n"))
    local = F.row_number().over(Window.partitionBy(*cell).orderBy("_crc", "_doc")).cast("long") - 1
    return (placed(rows, "_crc", "_doc", cuts).withColumn("_local", local).join(first, cell)
            .withColumn("slot", F.col("_first") + F.col("_local"))
            .withColumnsRenamed({"_size": "size", "_crc": "text_crc32"})
            .withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
            .select(*columns, *new).withColumnsRenamed(back))
