"""Operator 13: hard negatives by exact search in a GNAT-style multiway hyperplane tree.

Scores are integer inner products.  With one more coordinate that brings all rows to the same norm, the
squared distance of an anchor a to a row x is |a|^2 + M - 2 a.x, so a window of scores is an annulus around the anchor.

Tree: every node has up to ``FAN`` split points, far apart in a bounded sample (about ``SAMPLE`` rows a leaf,
``FAN ** DEPTH`` leaves at most, drawn by hash); a row belongs to the nearest split point.  All rows are indexed; every split point
stores the least and largest distance to each sibling's subtree.  An annulus [r1, r2] around an anchor at distance d
of a split point can meet a subtree only where its range meets [max(d - r2, r1 - d), d + r2]; a subtree that fails for
one split point is left out.  Leaves are searched exactly, in blocks of about ``ROWS`` rows.

Search: anchors go in groups of about ``GROUP``, near ones together.  Round 0 looks at one block of the group's own
region, each later round at ``WIDER`` times as many of the others; after every round the lower end of a window rises to
the last of its best rows, so that later rounds keep few rows and leave out more subtrees.  Groups, not rows, are
joined with blocks.  Positives are the windows without bounds over the same label, negatives the windows between 80 and 100 %
of a positive's score over other labels.

Equal rows (id, label, vector) are one row with a number; a row's own copies are other rows.  The driver holds the split
points and ranges (at most ``FAN ** DEPTH`` leaves) and one count a leaf.

Edge cases: rows with a null label, a null vector, or a null or non-finite component take no part; components beyond
2^24 count as 2^24; vectors of unequal length are filled up with zeros; a null id comes last among equal scores; an
anchor that is repeated gives its rows as often; anchors without positives or negatives give no rows; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalcrate.llm.shared import for_python, saved

ROWS = 8192     # rows of a block
GROUP = 1024    # anchors of a group
FAN = 16        # split points of a node
DEPTH = 3
SAMPLE = 32     # sampled rows per leaf for the choice of split points: 131,072 vectors at most
WIDER = 16
LIMIT = 1 << 24  # largest component: scores and their percentages fit a long up to 1,024 components
OPEN = 1 << 62   # end of a window without bound
NULL_ID = (1 << 63) - 1  # stands for a null id while rows are packed; sorts last


# ---------------------------------------------------------------- vectors

def whole_vector(embedding: Column) -> Column:
    """``floor(256 * x)`` of every component; null where one is null or not finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(math.inf)))
    scaled = F.transform(embedding, lambda x: F.floor(F.greatest(F.least(x.cast("double") * 256, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int"))
    return F.when(~bad, scaled)


def _matrix(packed: list[bytes] | bytes, dim: int) -> np.ndarray:
    data = packed if isinstance(packed, bytes) else b"".join(packed)
    return np.frombuffer(data, "<i4").reshape(-1, dim)


def _scores(a: np.ndarray, b: np.ndarray, exact_in_double: bool) -> np.ndarray:
    """Inner products of integer rows: doubles hold them exactly below 2^53, else 64-bit integers."""
    kind = np.float64 if exact_in_double else np.int64
    return a.astype(kind) @ b.astype(kind).T


# ---------------------------------------------------------------- tree

class Tree:
    """Split points per inner node and the ranges to sibling subtrees; node k's child c is k * FAN + c + 1."""

    def __init__(self, dim: int, top: int, depth: int, points: dict[int, np.ndarray]):
        self.dim, self.top, self.depth, self.points = dim, top, depth, points
        self.low: dict[int, np.ndarray] = {}
        self.high: dict[int, np.ndarray] = {}

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Rows with the coordinate that brings them to the norm ``top``."""
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.top - (x * x).sum(1), 0.0))])

    def walk(self, x: np.ndarray):
        """Leaf of each row; yields (node, rows, distances to its split points, child) on the way down, the leaves last."""
        x = self.lifted(x)
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            for node in np.unique(at):
                rows = np.flatnonzero(at == node)
                d = _distances(x[rows], self.points[int(node)])
                child = d.argmin(1)
                yield int(node), rows, d, child
                at[rows] = node * FAN + child + 1
        yield -1, np.arange(len(x)), None, at

    def path(self, leaf: int) -> list[tuple[int, int]]:
        """(node, child) from the root to a leaf."""
        out = []
        while leaf:
            out.append(((leaf - 1) // FAN, (leaf - 1) % FAN))
            leaf = (leaf - 1) // FAN
        return out[::-1]

    def reach(self, queries: np.ndarray, near: np.ndarray, far: np.ndarray, leaves: list[int]) -> np.ndarray:
        """Which annuli (rows) may meet which leaves (columns)."""
        q = queries.astype(np.float64)
        slack = 1e-6 * (1.0 + math.sqrt(float(self.top)))
        fits: dict[tuple[int, int], np.ndarray] = {}
        out = np.ones((len(q), len(leaves)), bool)
        for col, leaf in enumerate(leaves):
            for node, child in self.path(leaf):
                if (node, child) not in fits:
                    p = self.points[node]
                    d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.top - 2 * q @ p[:, :-1].T, 0.0))
                    least = np.maximum(d - far[:, None], near[:, None] - d) - slack
                    fits[node, child] = ((least <= self.high[node][:, child]) & (d + far[:, None] + slack >= self.low[node][:, child])).all(1)
                out[:, col] &= fits[node, child]
        return out


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T, 0.0))


def _split(tree: Tree, sample: np.ndarray, fans: list[int]) -> None:
    """Split points of every node: far apart among the sampled rows of its region."""
    regions = {0: tree.lifted(sample)}
    for fan in fans:
        below = {}
        for node, x in regions.items():
            chosen = [0]
            away = _distances(x, x[:1])[:, 0]
            while len(chosen) < min(fan, len(x)) and away.max() > 0:
                chosen.append(int(away.argmax()))
                away = np.minimum(away, _distances(x, x[chosen[-1:]])[:, 0])
            tree.points[node] = x[chosen]
            child = _distances(x, tree.points[node]).argmin(1)
            for c in range(len(chosen)):
                below[node * FAN + c + 1] = x[child == c]
        regions = below


def fit_tree(rows: DataFrame, n: int, dim: int, top: int, leaf_rows: int) -> Tree:
    """Tree over ``rows(v)`` (packed vectors) for about ``leaf_rows`` rows a leaf."""
    leaves = min(math.ceil(n / leaf_rows), FAN ** DEPTH)
    depth = 0 if leaves <= 1 else max(1, math.ceil(math.log(leaves, FAN) - 1e-9))
    tree = Tree(dim, top, depth, {})
    if not depth:
        return tree
    fan = min(FAN, max(2, math.ceil(leaves ** (1 / depth))))
    bound = min(1.0, SAMPLE * leaves / n)
    hashed = F.pmod(F.xxhash64("v", "label", "id"), F.lit(1 << 32))
    drawn = rows.where(hashed < int(bound * (1 << 32))).select(hashed.alias("h"), "v").collect()
    drawn = [r.v for r in sorted(drawn, key=lambda r: (r.h, bytes(r.v)))] or [rows.select("v").first().v]
    _split(tree, _matrix([bytes(v) for v in drawn], dim), [fan] * depth)
    return tree


def _place(tree: Tree):
    def task(batches):
        for b in batches:
            at = np.zeros(0, np.int64)
            if b.num_rows:
                for _, _, _, at in tree.walk(_matrix(b.column("v").to_pylist(), tree.dim)):
                    pass
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=[*b.schema.names, "leaf"])
    return task


def _ranges(tree: Tree):
    def task(batches):
        low = {k: np.full((len(p), len(p)), np.inf) for k, p in tree.points.items()}
        high = {k: np.full((len(p), len(p)), -np.inf) for k, p in tree.points.items()}
        for b in batches:
            if not b.num_rows:
                continue
            for node, _, d, child in tree.walk(_matrix(b.column("v").to_pylist(), tree.dim)):
                for c in np.unique(child) if node >= 0 else ():
                    own = d[child == c]
                    low[node][:, c] = np.minimum(low[node][:, c], own.min(0))
                    high[node][:, c] = np.maximum(high[node][:, c], own.max(0))
        out = [(k, i, c, low[k][i, c], high[k][i, c]) for k in low for i in range(len(low[k])) for c in range(len(low[k]))
               if low[k][i, c] <= high[k][i, c]]
        yield pa.RecordBatch.from_pylist([dict(zip(("node", "i", "c", "low", "high"), r)) for r in out],
                                         schema=pa.schema([("node", pa.int64()), ("i", pa.int32()), ("c", pa.int32()),
                                                           ("low", pa.float64()), ("high", pa.float64())]))
    return task


def _measure(tree: Tree, rows: DataFrame) -> None:
    """Distance ranges over all rows."""
    for k, p in tree.points.items():
        tree.low[k], tree.high[k] = np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)
    if tree.depth:
        found = rows.select("v").mapInArrow(_ranges(tree), "node long, i int, c int, low double, high double")
        for r in found.groupBy("node", "i", "c").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            tree.low[r.node][r.i, r.c], tree.high[r.node][r.i, r.c] = r.low, r.high


# ---------------------------------------------------------------- packing

def _packed_vectors(dim: int):
    def task(batches):
        for b in batches:
            v = b.column("x")
            flat = np.zeros((b.num_rows, dim), "<i4")
            for i, row in enumerate(v.to_pylist()):
                flat[i, :len(row)] = row
            data = pa.array([r.tobytes() for r in flat], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("times"), b.column("anchor"), data],
                                             names=["id", "label", "times", "anchor", "v"])
    return task


def _pack(keys: list[str]):
    def task(pdf):
        pdf = pdf.assign(_v=pdf["v"]).sort_values(["id", "label", "_v"])
        return pd.DataFrame([(*(int(pdf[k].iloc[0]) for k in keys), pdf["id"].to_numpy(np.int64).tobytes(),
                              pdf["label"].to_numpy(np.int64).tobytes(), pdf["times"].to_numpy(np.int64).tobytes(), b"".join(pdf["v"]))],
                            columns=[*keys, "ids", "labels", "times", "v"])
    return task


PACKED = "ids binary, labels binary, times binary, v binary"


def _longs(data) -> np.ndarray:
    return np.frombuffer(bytes(data), np.int64)


# ---------------------------------------------------------------- search

def _annuli(tree: Tree, q: np.ndarray, high: np.ndarray, low: np.ndarray):
    """Radii of the windows [low, high] of scores around the anchors ``q``."""
    base = (q.astype(np.float64) ** 2).sum(1) + float(tree.top)
    return np.sqrt(np.maximum(base - 2.0 * high, 0.0)), np.sqrt(np.maximum(base - 2.0 * low, 0.0))


def _targets(tree: Tree, leaf_of: np.ndarray, groups: int, start: int, stop: int):
    """Per group of anchors the blocks of ranks [start, stop) from its home that some window may meet."""
    def task(batches):
        n = len(leaf_of)
        for b in batches:
            for r in b.to_pylist():
                home = r["part"] * n // groups
                blocks = [(home + k) % n for k in range(start, min(stop, n))]
                q = _matrix(r["v"], tree.dim)[np.array([w["i"] for w in r["windows"]], np.int64)]
                near, far = _annuli(tree, q, np.array([w["high"] for w in r["windows"]], np.int64), np.array([w["low"] for w in r["windows"]], np.int64))
                leaves = sorted({int(leaf_of[c]) for c in blocks})
                hit = dict(zip(leaves, tree.reach(q, near, far, leaves).any(0)))
                yield pa.RecordBatch.from_pylist([{"g": r["g"], "blocks": [c for c in blocks if hit[int(leaf_of[c])]]}],
                                                 schema=pa.schema([("g", pa.int64()), ("blocks", pa.list_(pa.int32()))]))
    return task


FOUND = pa.schema([("g", pa.int64()), ("i", pa.int32()), ("key", pa.int64()), ("score", pa.int64()), ("id", pa.int64())])


def _search(tree: Tree, leaf_of: np.ndarray, same: bool, k: int):
    """Best ``k`` rows of one block for every window of one group."""
    exact = tree.top < 1 << 52

    def one(r):
        q, x = _matrix(r["v"], tree.dim), _matrix(r["xv"], tree.dim)
        ids, labels, times = _longs(r["xids"]), _longs(r["xlabels"]), _longs(r["xtimes"])
        own_ids, own_labels = _longs(r["ids"]), _longs(r["labels"])
        at = np.array([w["i"] for w in r["windows"]], np.int64)
        high, low = np.array([w["high"] for w in r["windows"]], np.int64), np.array([w["low"] for w in r["windows"]], np.int64)
        keys = np.array([w["key"] for w in r["windows"]], np.int64)
        met = tree.reach(q[at], *_annuli(tree, q[at], high, low), [int(leaf_of[r["c"]])])[:, 0]
        order = np.flatnonzero(met)
        for s in range(0, len(order), 256):
            part = order[s:s + 256]
            mine, back = np.unique(at[part], return_inverse=True)
            scores = _scores(q[mine], x, exact)
            for w, line in zip(part, back):
                i, row = at[w], scores[line]
                fit = (row >= low[w]) & (row <= high[w]) & ((labels == own_labels[i]) if same else (labels != own_labels[i]))
                here = np.flatnonzero(fit)
                if len(here) > k + 1:
                    least = np.partition(row[here], len(here) - k - 1)[len(here) - k - 1]
                    here = here[row[here] >= least]
                here = here[np.argsort(-row[here], kind="stable")]  # rows are packed in the order of their ids
                left = k
                for j in here:
                    copies = int(times[j])
                    if same and ids[j] == own_ids[i] and labels[j] == own_labels[i] and np.array_equal(x[j], q[i]):
                        copies -= 1
                    for _ in range(min(copies, left)):
                        yield r["g"], int(i), int(keys[w]), int(row[j]), int(ids[j])
                    left -= min(copies, left)
                    if not left:
                        break

    def task(batches):
        for b in batches:
            for n in range(b.num_rows):
                out = list(one({name: col[0] for name, col in b.slice(n, 1).to_pydict().items()}))
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], f.type) for c, f in enumerate(FOUND)], schema=FOUND)
    return task


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("g", "i", "key").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _rounds(tree: Tree, leaf_of: np.ndarray, parts: int, groups: DataFrame, blocks: DataFrame, windows: DataFrame,
            same: bool, k: int) -> DataFrame:
    """Best ``k`` rows of every window ``(g, i, key, high, low)``: ``g, i, key, score, id, rank``."""
    n, start, best = len(leaf_of), 0, None
    stop = 1
    while start < n:
        now = windows
        if best is not None:  # a full window's lower end rises to its last row
            full = best.groupBy("g", "i", "key").agg(F.min("score").alias("last"), F.count("*").alias("n"))
            now = windows.join(full, ["g", "i", "key"], "left").withColumn(
                "low", F.when(F.col("n") == k, F.greatest("low", "last")).otherwise(F.col("low")))
        packed = now.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "key", "high", "low"))).alias("windows"))
        asked = groups.join(packed, "g")
        targets = asked.select("g", "part", "v", "windows").mapInArrow(
            _targets(tree, leaf_of, parts, start, stop), "g long, blocks array<int>")
        pairs = saved(targets.select("g", F.explode("blocks").alias("c")), "neg-pairs")
        found = pairs.join(asked.drop("part", "times"), "g").join(blocks, "c").mapInArrow(
            _search(tree, leaf_of, same, k), "g long, i int, key long, score long, id long")
        best = saved(_best(found if best is None else found.unionByName(best.drop("rank")), k), "neg-best")
        start, stop = stop, max(stop * WIDER, stop + 1)
    return best


def _floor_div(x: Column, by: int) -> Column:
    return F.call_function("div", x - F.pmod(x, F.lit(by)), F.lit(by))


def mine_negatives(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   leaf_rows: int = ROWS, group: int = GROUP) -> DataFrame:
    """``rows(id, label, embedding, anchor)`` to ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``: per anchor and positive the best rows of other labels with ``low * p <= 100 * n <= high * p``."""
    spark = rows.sparkSession
    for_python(spark)
    given = rows.where("label IS NOT NULL AND embedding IS NOT NULL").select(
        F.coalesce(F.col("id").cast("long"), F.lit(NULL_ID)).alias("id"), F.col("label").cast("long").alias("label"),
        whole_vector(F.col("embedding")).alias("x"), F.coalesce("anchor", F.lit(False)).alias("anchor")).where("x IS NOT NULL")
    given = saved(given.groupBy("id", "label", "x", "anchor").agg(F.count("*").alias("times")), "neg-rows")
    norm = F.aggregate("x", F.lit(0).cast("long"), lambda s, v: s + v.cast("long") * v.cast("long"))
    n, anchors, dim, top = given.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("x")), F.max(norm)).first()
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not anchors:
        return spark.createDataFrame([], shape)
    dim = max(dim, 1)
    whole = given.select("id", "label", "times", "anchor", "x").mapInArrow(
        _packed_vectors(dim), "id long, label long, times long, anchor boolean, v binary")
    whole = saved(whole, "neg-packed")
    tree = fit_tree(whole, n, dim, top, leaf_rows)
    _measure(tree, whole)
    placed = saved(whole.mapInArrow(_place(tree), whole.schema.simpleString()[7:-1].replace(":", " ") + ", leaf long"), "neg-placed")
    counts = sorted((r.leaf, r.n) for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect())
    leaf_of, starts = [], []
    for leaf, m in counts:
        cut = math.ceil(m / leaf_rows)
        starts.append((leaf, len(leaf_of), cut))
        leaf_of += [leaf] * cut
    leaf_of = np.array(leaf_of, np.int64)
    # one row a leaf: FAN ** DEPTH at most
    cuts = F.broadcast(spark.createDataFrame(starts, "leaf long, first long, cut long"))
    block = F.col("first") + F.pmod(F.xxhash64("id", "label", "v"), F.col("cut"))
    placed = placed.join(cuts, "leaf").withColumn("c", block.cast("int")).drop("first", "cut")
    blocks = saved(placed.groupBy("c").applyInPandas(_pack(["c"]), "c int, " + PACKED), "neg-blocks")
    blocks = blocks.select("c", *[F.col(x).alias("x" + x) for x in ("ids", "labels", "times", "v")])

    parts = math.ceil(anchors / group)
    own = placed.where("anchor").withColumn("part", F.floor(F.col("c") * F.lit(parts) / F.lit(len(leaf_of))).cast("int"))
    sizes = own.groupBy("part").agg(F.ceil(F.count("*") / F.lit(group)).alias("cut"))
    own = own.join(sizes, "part").withColumn("g", F.xxhash64("part", F.pmod(F.xxhash64("v", "id"), F.col("cut"))))
    groups = saved(own.groupBy("g").applyInPandas(_pack(["g", "part"]), "g long, part int, " + PACKED), "neg-anchors")

    listed = saved(groups.select("g", "ids", "times").mapInArrow(_listed, "g long, i int, id long, times long"), "neg-listed")
    every = listed.select("g", "i", F.lit(0).cast("long").alias("key"), F.lit(OPEN).alias("high"), F.lit(-OPEN).alias("low"))
    near = _rounds(tree, leaf_of, parts, groups, blocks, every, True, positives)
    p = F.col("score")
    windows = near.select("g", "i", p.alias("key"), _floor_div(p * high, 100).alias("high"),
                          (-_floor_div(-p * low, 100)).alias("low")).where("low <= high").distinct()
    far = _rounds(tree, leaf_of, parts, groups, blocks, saved(windows, "neg-windows"), False, negatives)
    pairs = near.select("g", "i", p.alias("key"), F.col("id").alias("positive_id"), p.alias("positive_score")).join(
        far.select("g", "i", "key", "rank", F.col("id").alias("negative_id"), p.alias("negative_score")), ["g", "i", "key"])
    out = pairs.join(listed, ["g", "i"]).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))

    def known(name):
        return F.when(F.col(name) != NULL_ID, F.col(name))
    return out.select(known("id").alias("anchor_id"), known("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                      known("negative_id").alias("negative_id"), "positive_score", "negative_score")


def _listed(batches):
    for b in batches:
        for r in b.to_pylist():
            ids, times = _longs(r["ids"]), _longs(r["times"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["g"]), pa.int64()), pa.array(np.arange(len(ids)), pa.int32()),
                                              pa.array(ids), pa.array(times)], names=["g", "i", "id", "times"])
