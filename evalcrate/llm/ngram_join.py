"""Operator 7: n-gram Jaccard self-join as a blocked sparse matrix product.

Documents are rows and word n-grams columns of a sparse 0/1 matrix A; two
documents link when ``100 * overlap >= percent * union``.  The overlaps are
entries of A A^T; only blocks that can hold a linked pair are ever multiplied:

1. *Rows.*  Equal n-gram sets collapse into one row (a class), so thousands of
   exact copies cost one row.
2. *Columns.*  A pair at the threshold must share one of the first
   ``n - ceil(percent * n / 100) + 1`` n-grams of each set under any one global
   order.  The order puts n-grams found frequent (a count over all classes) last,
   so that shared passages do not bring unrelated rows together.  Columns that hold
   the same rows (count and two 64-bit hashes of the row ids agree) are compared once.
3. *Coarse product.*  Rows that share such a column are compared on set size and
   on a histogram of their n-gram hashes, whose cells follow the set's size (about
   four n-grams a cell, 16 to 1,024 cells; the finer of two is folded); half the
   histogram distance is a proven bound on the overlap, and pairs below the
   size-derived bound go.  Components of the rest are the blocks.
4. *Exact product.*  Every row enters its block once with its whole set.  Inside
   a block the overlap counts of one row with all rows are accumulated through
   the block's columns.  Rows already in the block's largest linked component
   need no product of their own, since every row outside it is multiplied with
   all rows; a large group of near copies is therefore not expanded into pairs.
5. Columns with more than ``2 * tile`` rows, and blocks with more rows than that
   or more than ``2 * TILE_GRAMS`` n-grams, are cut into tiles (pairs of row
   chunks), so no task holds an unbounded group.

No pair is capped, sampled or dropped: every step discards only pairs that
provably miss the threshold (n-grams are compared by 64-bit hashes).

Edge cases: null or empty texts and texts without words have the empty set
(``n_shingles`` 0) and link with nothing; texts with fewer words than the n-gram
length are one n-gram; repeated rows and equal texts share a component; a null
doc_id takes part in links but is never a component's id unless its component
has no other; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalcrate.llm import bytescan
from evalcrate.llm.shared import IdBits, components, for_python, hidden, saved, tester

LEAST_BITS, MOST_BITS = 4, 10  # unrelated sets of up to about 26 n-grams a cell are told apart at 0.8
FULL = 255  # a cell counts no further
TILE = 1024
TILE_GRAMS = 4 << 20
FREQUENT = 32
ORDER_LIST = 65536

_SKETCH = ("doc_id long, cid long, n_shingles long, prefix array<bigint>, hist binary")


def prefix_length(n: int, percent: int) -> int:
    return n - (-(-percent * n // 100)) + 1


def least_overlap(total, percent: int):
    """Smallest overlap of two sets with ``total`` elements together that meets the threshold."""
    return -((-percent * total) // (100 + percent))


def class_id(grams: np.ndarray) -> np.int64:
    """64-bit id of a set of n-gram hashes."""
    parts = np.array([grams.sum(dtype=np.uint64) + np.uint64(len(grams)),
                      np.bitwise_xor.reduce(bytescan.mix(grams ^ np.uint64(0xA5A5A5A55A5A5A5A)))], np.uint64)
    return bytescan.mix(parts).sum(dtype=np.uint64).view(np.int64)


def histogram(s: np.ndarray) -> bytes:
    """Counts of the hashes by their first bits, one byte a cell."""
    bits = min(max(len(s).bit_length() - 2, LEAST_BITS), MOST_BITS)
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), FULL).astype(np.uint8).tobytes()


class Histograms:
    """Histograms of many sets; pairs are compared on the coarser one's cells."""

    def __init__(self, parts: list[bytes]):
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        lengths = np.array([len(p) for p in parts], np.int64)
        self.off = np.cumsum(lengths) - lengths
        self.bits = np.round(np.log2(np.maximum(lengths, 1))).astype(np.int64)

    def _at(self, rows: np.ndarray, bits: int) -> np.ndarray:
        """Histograms of ``rows`` in ``1 << bits`` cells.  A full cell stays full when folded, so that the
        distance never exceeds the true one."""
        out = np.empty((len(rows), 1 << bits), np.int16)
        for b in np.unique(self.bits[rows]):
            of = self.bits[rows] == b
            cells = self.flat[self.off[rows[of]][:, None] + np.arange(1 << b)]
            out[of] = cells if b == bits else np.minimum(cells.reshape(len(cells), 1 << bits, -1).sum(axis=-1, dtype=np.int32), FULL)
        return out

    def distance(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Summed differences of the pairs ``x[i], y[i]``; ``x`` may be one row for all."""
        out, bits = np.empty(len(y), np.int64), np.minimum(self.bits[x], self.bits[y])
        for b in np.unique(bits):
            of = bits == b
            out[of] = np.abs(self._at(x if len(x) == 1 else x[of], b) - self._at(y[of], b)).sum(axis=-1)
        return out


def _sketcher(k: int, percent: int, frequent: np.ndarray, prefix_only: bool):
    order = np.argsort(frequent, kind="stable")
    by_hash = frequent[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytescan.slices(batches):
            h, off = bytescan.word_hashes(batch.column("text"), bytescan.NON_SPACE)
            cid = np.zeros(batch.num_rows, np.int64)
            sizes = np.zeros(batch.num_rows, np.int64)
            prefixes, lengths, hists = [], np.zeros(batch.num_rows + 1, np.int32), []
            for i in range(batch.num_rows):
                s = bytescan.shingles(h[off[i]:off[i + 1]], k)
                n = sizes[i] = len(s)
                if not n:
                    hists.append(b"")
                    continue
                cid[i] = class_id(s)
                p = prefix_length(n, percent)
                if len(by_hash):
                    at = np.minimum(np.searchsorted(by_hash, s), len(by_hash) - 1)
                    late = by_hash[at] == s
                    first = s[~late][:p]
                    if len(first) < p:
                        rank = order[at[late]]
                        first = np.concatenate([first, s[late][np.argsort(-rank, kind="stable")][:p - len(first)]])
                else:
                    first = s[:p]
                prefixes.append(first.view(np.int64))
                lengths[i + 1] = len(first)
                hists.append(b"" if prefix_only else histogram(s))
            values = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()), pa.array(cid), pa.array(sizes),
                pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(values)),
                pa.array(hists, pa.binary())], names=["doc_id", "cid", "n_shingles", "prefix", "hist"])
    return run


def sketches(docs: DataFrame, k: int, percent: int, frequent: np.ndarray, prefix_only: bool = False) -> DataFrame:
    """One row per document: class id, set size, first columns and histogram."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _sketcher(k, percent, frequent, prefix_only), _SKETCH)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end where a key group ends, with the groups' start positions (rows come sorted by key)."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        starts = _starts(held, keys)
        if len(starts) > 1:
            yield held.slice(0, starts[-1]), starts[:-1]
            held = held.slice(starts[-1]).combine_chunks()
    if held is not None and held.num_rows:
        yield held, _starts(held, keys)


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def forest(m: int, linked) -> list[tuple[int, int]]:
    """Edges that connect what ``linked(i) -> mask`` connects, without asking for every row.

    Rows of the largest component so far are skipped: a pair across components
    always has a row outside it, and that row's mask covers all rows."""
    comp, asked, edges = np.arange(m), np.zeros(m, dtype=bool), []
    while True:
        rest = np.flatnonzero((comp != np.argmax(np.bincount(comp))) & ~asked)
        if not len(rest):
            return edges
        i = int(rest[0])
        asked[i] = True
        near = np.flatnonzero(linked(i) & (comp != comp[i]))
        if len(near):
            parts, at = np.unique(comp[near], return_index=True)
            edges += [(i, int(near[j])) for j in at]
            comp[np.isin(comp, parts)] = comp[i]


def _coarse(percent: int):
    def near(n, hists, x, y):
        ok = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
        at = np.flatnonzero(ok)
        x, y = x if len(x) == 1 else x[at], y[at]
        total = n[x] + n[y]
        ok[at] = hists.distance(x, y) <= total - 2 * least_overlap(total, percent)
        return ok

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole_groups(batches, ["t", "a", "b"]):
            ids, n = t.column("cid").to_numpy(), t.column("n_shingles").to_numpy()
            hists = Histograms(t.column("hist").to_pylist())
            sizes = np.diff(np.append(starts, len(ids)))
            us, vs = [], []
            for m in np.unique(sizes[(sizes > 1) & (sizes <= 8)]):  # all pairs of small groups at once
                at = starts[sizes == m]
                for i in range(m):
                    for j in range(i + 1, m):
                        x, y = at + i, at + j
                        ok = near(n, hists, x, y)
                        us.append(ids[x[ok]])
                        vs.append(ids[y[ok]])
            for s, m in zip(starts[sizes > 8], sizes[sizes > 8]):
                group = np.arange(s, s + m)
                e = forest(m, lambda i: near(n, hists, group[i:i + 1], group))  # noqa: B023
                if e:
                    e = np.array(e)
                    us.append(ids[s + e[:, 0]])
                    vs.append(ids[s + e[:, 1]])
            if us:
                e = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(e[0]), pa.array(e[1])], names=["u", "v"])
    return run


def _exact(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole_groups(batches, ["comp", "a", "b"]):
            ids = t.column("cid").to_numpy()
            ends = np.append(starts, len(ids))[1:]
            for s, e in zip(starts, ends):
                sets = t.column("grams").slice(s, e - s).combine_chunks()
                at = np.frombuffer(sets.buffers()[1], np.int32)[sets.offset:sets.offset + e - s + 1]
                values = np.frombuffer(sets.buffers()[2], np.uint8)[at[0]:at[-1]].view(np.uint64)
                off = (at - at[0]).astype(np.int64) // 8
                n = np.diff(off)
                order = np.argsort(values, kind="stable")
                values = values[order]
                del sets
                new = np.append(True, values[1:] != values[:-1])
                ptr = np.append(np.flatnonzero(new), len(values))
                # column of each entry in row order, and the rows of each column
                col = np.empty(len(values), np.int32)
                col[order] = np.cumsum(new, dtype=np.int32) - 1
                by_col = np.repeat(np.arange(len(n), dtype=np.int32), n)[order]
                del values, order, new

                def linked(i, col=col, by_col=by_col, ptr=ptr, off=off, n=n):
                    c = col[off[i]:off[i + 1]]
                    lens = ptr[c + 1] - ptr[c]
                    at = np.repeat(ptr[c] - np.append(0, np.cumsum(lens)[:-1]), lens) + np.arange(lens.sum())
                    overlap = np.bincount(by_col[at], minlength=len(n))
                    return 100 * overlap >= percent * (n[i] + n - overlap)

                edges = forest(len(n), linked)
                if edges:
                    x = np.array(edges)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s + x[:, 0]]), pa.array(ids[s + x[:, 1]])],
                                                     names=["u", "v"])
    return run


def _gram_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytescan.slices(batches):
            h, off = bytescan.word_hashes(batch.column("text"), bytescan.NON_SPACE)
            grams = [bytescan.shingles(h[a:b], k) for a, b in zip(off, off[1:])]
            # a doc_id may stand in several rows: only the rows of the class itself
            own = pa.array([len(g) > 0 and class_id(g) == c for g, c in zip(grams, batch.column("cid").to_numpy())],
                           pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("cid", "comp", "a", "b")),
                 pa.array([g.tobytes() for g in grams], pa.binary())],
                names=["cid", "comp", "a", "b", "grams"]).filter(own)
    return run


def _tiled(df: DataFrame, chunks) -> DataFrame:
    """Add tile keys a <= b: one tile for a group of up to two ``chunks``, else one for every pair of chunks."""
    k = F.when(chunks <= 2, 1).otherwise(F.ceil(chunks)).cast("int")
    c = F.pmod(F.xxhash64("cid"), k).cast("int")
    return (df.withColumn("_c", c).withColumn("_o", F.explode(F.sequence(F.lit(0), k - 1)))
            .withColumn("a", F.least("_c", "_o")).withColumn("b", F.greatest("_c", "_o")).drop("_c", "_o"))


def jaccard_classes(docs: DataFrame, k: int = 3, percent: int = 90, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """One row per document ``doc_id, cid, n_shingles``, and one per n-gram set ``cid, comp, doc_id``
    (component over set ids, smallest doc_id of the set)."""
    spark = docs.sparkSession
    for_python(spark)
    # n-grams that many classes hold among their first columns, the most frequent ones last in the order
    first = (sketches(docs, k, percent, np.empty(0, np.uint64), prefix_only=True).where("n_shingles > 0")
             .groupBy("cid").agg(F.first("prefix").alias("prefix")))
    counts = (first.select(F.explode("prefix").alias("t")).groupBy("t").agg(F.count("*").alias("c"))
              .where(F.col("c") >= FREQUENT).orderBy(F.desc("c"), "t").limit(ORDER_LIST))
    listed = sorted(saved(counts, "ngram-frequent").collect(), key=lambda r: (-r.c, r.t))  # stored: its shuffle files go
    frequent = np.array([r.t for r in listed], np.int64).view(np.uint64)

    rows = saved(sketches(docs, k, percent, frequent), "ngram-rows")
    classes = saved(rows.where("n_shingles > 0").groupBy("cid").agg(
        F.first("n_shingles").alias("n_shingles"), F.first("prefix").alias("prefix"), F.first("hist").alias("hist"),
        F.min("doc_id").alias("doc_id")), "ngram-classes")
    columns = classes.select("cid", F.explode("prefix").alias("t"))
    shared = columns.groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    held = saved(columns.join(shared, "t").select("t", "c", "cid"), "ngram-columns")
    once = (held.groupBy("t").agg(F.first("c").alias("c"), F.bit_xor(F.xxhash64("cid")).alias("x"),
                                  F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("y"))
            .groupBy("c", "x", "y").agg(F.min("t").alias("t")).select("t"))
    cells = _tiled(held.join(once, "t").join(classes.select("cid", "n_shingles", "hist"), "cid"), F.col("c") / F.lit(tile))
    near = (cells.select("t", "a", "b", "cid", "n_shingles", "hist").repartition("t", "a", "b")
            .sortWithinPartitions("t", "a", "b").mapInArrow(_coarse(percent), "u long, v long"))
    blocks = components(near)

    members = blocks.withColumnRenamed("id", "cid")
    members = saved(members.join(classes.select("cid", "doc_id", "n_shingles"), "cid"), "ngram-members")
    sizes = members.groupBy("comp").agg(F.count("*").alias("c"), F.sum("n_shingles").alias("g"))
    reps = _tiled(members.join(sizes, "comp"), F.greatest(F.col("c") / F.lit(tile), F.col("g") / F.lit(TILE_GRAMS)))
    reps = reps.select("cid", "comp", "a", "b", "doc_id")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # texts of documents outside the blocks are left out before the shuffle
    texts = texts.where(IdBits(members.select("doc_id")).maybe(F.col("doc_id")))
    # texts go to the blocks, since they compress and hashes do not; the sets are built there
    placed = (texts.join(reps.withColumnRenamed("doc_id", "rep"), F.col("doc_id").eqNullSafe(F.col("rep")))
              .select("cid", "comp", "a", "b", "text").repartition("comp", "a", "b").sortWithinPartitions("comp", "a", "b"))
    sets_of, exact = _gram_sets(k), _exact(k, percent)
    links = placed.mapInArrow(lambda batches: exact(sets_of(batches)), "u long, v long")
    linked = components(links)

    sets = classes.select("cid", "doc_id").join(linked.select(F.col("id").alias("cid"), "comp"), "cid", "left")
    return rows.select("doc_id", "cid", "n_shingles"), sets.withColumn("comp", F.coalesce("comp", "cid"))


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, tile: int = TILE) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id`` (smallest doc_id reachable over links)."""
    rows, sets = jaccard_classes(docs, k, percent, tile)
    smallest = sets.groupBy("comp").agg(F.min("doc_id").alias("low"))
    of_set = sets.select("cid", "comp").join(smallest, "comp").select("cid", "low")
    return rows.join(of_set, "cid", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("low")).otherwise(F.col("doc_id"))
        .alias("component_id"))


def keep_one(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each component: the smallest doc_id's.

    Documents without words are all kept.  Rows are told apart by doc_id and n-gram set, so a doc_id
    that stands for two different texts keeps both."""
    columns = docs.columns
    docs, back = hidden(docs, ["_cid", "_kept", "_kept_cid", "_at"])
    rows, sets = jaccard_classes(docs, k, percent)
    kept = sets.groupBy("comp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "cid")).alias("m"))
    of_set = sets.select("cid", "comp").join(kept, "comp").select(F.col("cid").alias("_kept_cid"), F.col("m.doc_id").alias("_kept"),
                                                                  F.col("m.cid").alias("_best"))
    found = rows.where("n_shingles > 0").join(of_set, F.col("cid") == F.col("_kept_cid"))
    stays = F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.col("cid") == F.col("_best"))
    found = found.groupBy("doc_id", "cid").agg(F.first(stays).alias("stays"), F.count("*").alias("n"))
    # what goes, and what stays but is repeated: rows whose id is in neither table stay where they are, unhashed
    gone = saved(found.where("NOT stays").select(F.col("doc_id").alias("_kept"), F.col("cid").alias("_kept_cid")), "ngram-gone")
    again = saved(found.where("stays AND n > 1").select(F.col("doc_id").alias("_kept"), F.col("cid").alias("_kept_cid")), "ngram-again")
    listed = IdBits(gone.unionByName(again).select("_kept"))
    plain = docs.where(~listed.maybe(F.col("doc_id")))
    marked = docs.withColumn("_at", listed.at(F.col("doc_id"))).mapInArrow(
        _with_class(k, listed.bits), T.StructType([*docs.schema.fields, T.StructField("_cid", T.LongType())]))
    same = F.col("doc_id").eqNullSafe(F.col("_kept")) & F.col("_cid").eqNullSafe(F.col("_kept_cid"))
    left = marked.join(gone, same, "left_anti")
    if not again.isEmpty():  # only repeated rows meet again, and only for them the texts are read twice
        left = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "_cid"]))
    return plain.unionByName(left.select(*docs.columns)).withColumnsRenamed(back).select(*columns)


def _with_class(k: int, bits: np.ndarray):
    """The rows whose bit ``_at`` is set, with their class id."""
    test = tester(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.filter(pa.array(test(batch.column("_at").to_numpy()))).drop_columns(["_at"])
            for b in bytescan.slices([listed]):
                h, off = bytescan.word_hashes(b.column("text"), bytescan.NON_SPACE)
                cids = [int(class_id(bytescan.shingles(h[x:y], k))) if y > x else None for x, y in zip(off, off[1:])]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cids, pa.int64())], names=[*b.schema.names, "_cid"])
    return run
