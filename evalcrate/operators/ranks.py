"""Exact ranks without sorting a table: key histograms, radix selection and the rank directory.

A key (one or more columns, ascending, nulls first) is read as a list of integer *digits* whose order is the key's
order.  One aggregate counts the rows per cell of a digit's range; cells that are too full are counted again, by
finer cells of the same digit or by the next digit.  Only counts reach the driver, never rows.

* ``keys_at`` descends into the cells that hold wanted ranks until few rows are left there, and returns the exact keys
  at these ranks.  A head, a slice or a sample is then one filter over the table: no sort, no window, no
  shuffle of rows.
* ``rank_directory`` splits all cells down to ``most`` rows and keeps the cuts with the number of rows before each.  It can
  be stored and serves any number of numberings and slices of the same table.

The results depend on the data alone, never on partitions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEW = 4096            # rows that a selection looks at one by one
HEAD = 64             # ranks below it come from one bounded top list
CELLS = 65_536        # cells counted for one node of a pass, at most
BUCKET_ROWS = 1_000_000
LEAST_BUCKETS = 64
NULL = -(1 << 57)     # digit of a null: below every other digit
_EDGE = float(1 << 62)


# ---------------------------------------------------------------- digits

def _halves(x: Column) -> list[Column]:
    """A long as two digits that leave room for differences."""
    return [F.shiftright(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))]


def _column_digits(c: Column, kind: T.DataType, longest: int | None) -> tuple[list[Column], bool]:
    """Digits of one column, and whether they tell all its values apart."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.BooleanType)):
        return [c.cast("long")], True
    if isinstance(kind, T.DateType):
        return [F.unix_date(c).cast("long")], True
    if isinstance(kind, T.LongType):
        return _halves(c), True
    if isinstance(kind, T.TimestampType):
        return _halves(F.unix_micros(c)), True
    if isinstance(kind, (T.StringType, T.BinaryType)):
        raw = c.cast("binary")
        parts = [F.conv(F.rpad(F.hex(F.substring(raw, 7 * i + 1, 7)), 14, "0"), 16, 10).cast("long") for i in range(-(-(longest or 0) // 7))]
        return [*parts, F.octet_length(raw).cast("long")], True
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        x = c.cast("double")
        x = F.when(F.isnan(x), F.lit(_EDGE)).when(c.isNotNull(), F.greatest(F.least(x, F.lit(_EDGE)), F.lit(-_EDGE)))
        whole = F.floor(x)
        return [*_halves(whole), F.floor((x - whole) * (1 << 52)).cast("long")], False
    return [], False


def longest_texts(df: DataFrame, keys: list[str]) -> dict[str, int | None]:
    """Bytes of the longest text in every text column of the key."""
    texts = [k for k in keys if isinstance(df.schema[k].dataType, (T.StringType, T.BinaryType))]
    return dict(zip(texts, df.agg(*[F.max(F.octet_length(F.col(k).cast("binary"))) for k in texts]).first())) if texts else {}


def digits(df: DataFrame, keys: list[str], longest: dict[str, int | None]) -> list[Column]:
    """Digits of the key; rows with equal digits may still differ in keys that no digit tells apart."""
    out: list[Column] = []
    for k in keys:
        own, exact = _column_digits(F.col(k), df.schema[k].dataType, longest.get(k))
        out += [F.coalesce(d, F.lit(NULL)) for d in own]
        if not exact:
            break
    return out or [F.lit(0).cast("long")]


# ---------------------------------------------------------------- counting

@dataclass
class _Node:
    """Rows with the digits ``fixed``, and the digit behind them in ``[low, high]``."""
    fixed: tuple[int, ...]
    low: int
    high: int
    first: int
    rows: int

    def holds(self, ds: list[Column]) -> Column:
        own = ds[len(self.fixed)].between(self.low, self.high)
        for d, v in zip(ds, self.fixed):
            own = (d == F.lit(v)) & own
        return own

    @property
    def start(self) -> tuple[int, ...]:
        return (*self.fixed, self.low)


def _next_digit(df: DataFrame, ds: list[Column], nodes: list[_Node]) -> list[_Node]:
    """Nodes of one digit value, carried over to the range of the next digit."""
    if not nodes:
        return []
    at = [len(n.fixed) + 1 for n in nodes]
    aggs = [f(F.when(n.holds(ds), ds[j])) for n, j in zip(nodes, at) for f in (F.min, F.max)]
    found = df.agg(*aggs).first()
    return [_Node((*n.fixed, n.low), found[2 * i], found[2 * i + 1], n.first, n.rows) for i, n in enumerate(nodes)]


def _split(df: DataFrame, ds: list[Column], nodes: list[_Node], cells: int) -> list[_Node]:
    """All nodes cut into cells, counted in one aggregate."""
    which, cell, widths = F.lit(None).cast("int"), F.lit(None).cast("long"), []
    for i, n in enumerate(nodes):
        width = -(-(n.high - n.low + 1) // cells)
        widths.append(width)
        inside, d = n.holds(ds), ds[len(n.fixed)]
        which = F.when(inside, F.lit(i)).otherwise(which)
        cell = F.when(inside, F.call_function("div", d - F.lit(n.low), F.lit(width).cast("long"))).otherwise(cell)
    rows = df.select(which.alias("n"), cell.alias("c")).where("n IS NOT NULL").groupBy("n", "c").agg(F.count("*").alias("k")).collect()
    out, first, last = [], 0, None
    for r in sorted(rows, key=lambda r: (r.n, r.c)):
        n, low = nodes[r.n], nodes[r.n].low + r.c * widths[r.n]
        first = n.first if r.n != last else first
        out.append(_Node(n.fixed, low, min(low + widths[r.n] - 1, n.high), first, r.k))
        first, last = first + r.k, r.n
    return out


def _root(df: DataFrame, ds: list[Column]) -> _Node:
    n, low, high = df.agg(F.count("*"), F.min(ds[0]), F.max(ds[0])).first()
    return _Node((), low or 0, high or 0, 0, n)


# ---------------------------------------------------------------- selection

def keys_at(df: DataFrame, keys: list[str], ranks: list[int], few: int = FEW) -> list[tuple | None] | None:
    """Exact keys at the 0-based ``ranks`` (None beyond the table), or None where equal keys make a rank ambiguous.

    Every pass reads the key columns only; at most ``few`` keys a rank are collected at the end."""
    df = df.select(*keys)
    if ranks and 0 <= min(ranks) and max(ranks) < min(HEAD, few):
        head = [tuple(r) for r in df.orderBy(*keys).limit(max(ranks) + 2).collect()]
        found = [head[r] if r < len(head) else None for r in ranks]
        return None if any(v is not None and head.count(v) > 1 for v in found) else found
    ds = digits(df, keys, longest_texts(df, keys))
    root = _root(df, ds)
    wanted = sorted({r for r in ranks if 0 <= r < root.rows})
    nodes, done = ([root] if wanted else []), []
    while nodes:
        small = [n for n in nodes if n.rows <= few]
        done += small
        large = [n for n in nodes if n.rows > few]
        single = [n for n in large if n.low == n.high]
        if any(len(n.fixed) + 1 == len(ds) for n in single):
            return None  # more equal keys than are looked at
        cut = _split(df, ds, wide, CELLS // len(wide)) if (wide := [n for n in large if n.low < n.high]) else []
        nodes = [n for n in [*_next_digit(df, ds, single), *cut] if any(n.first <= r < n.first + n.rows for r in wanted)]
    at: dict[int, tuple] = {}
    if done:
        done.sort(key=lambda n: n.first)
        which = F.lit(None).cast("int")
        for i, n in enumerate(done):
            which = F.when(n.holds(ds), F.lit(i)).otherwise(which)
        # a bounded set: few keys a rank
        rows = df.withColumn("_n", which).where("_n IS NOT NULL").orderBy("_n", *keys).collect()
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(r["_n"], []).append(tuple(r[k] for k in keys))
        for i, n in enumerate(done):
            for r in (r for r in wanted if n.first <= r < n.first + n.rows):
                own = by[i]
                at[r] = own[r - n.first]
                if own.count(at[r]) > 1:
                    return None
    return [at.get(r) for r in ranks]


def _literal(df: DataFrame, key: str, value) -> Column:
    return F.lit(value).cast(df.schema[key].dataType)


def _order(df: DataFrame, keys: list[str], values: tuple, strictly: bool) -> Column:
    """The key is below ``values`` (or equal to them), nulls first."""
    out = F.lit(not strictly)
    for k, v in reversed(list(zip(keys, values))):
        c = F.col(k)
        if v is None:
            out = c.isNull() & out
        else:
            x = _literal(df, k, v)
            below = (c < x) | c.isNull() if df.schema[k].nullable else c < x
            out = below | ((c == x) & out) if k != keys[-1] else (c < x if strictly else c <= x) | (
                c.isNull() if df.schema[k].nullable else F.lit(False))
    return out


def up_to(df: DataFrame, keys: list[str], values: tuple) -> Column:
    """Rows whose key is at most ``values``."""
    return F.coalesce(_order(df, keys, values, False), F.lit(False))


def before(df: DataFrame, keys: list[str], values: tuple) -> Column:
    """Rows whose key is below ``values``."""
    return F.coalesce(_order(df, keys, values, True), F.lit(False))


def equals(df: DataFrame, keys: list[str], values: tuple) -> Column:
    out = F.lit(True)
    for k, v in zip(keys, values):
        out = out & (F.col(k).isNull() if v is None else F.col(k) == _literal(df, k, v))
    return F.coalesce(out, F.lit(False))


# ---------------------------------------------------------------- directory

@dataclass
class RankDirectory:
    """Cuts of a table's key range: bucket ``i`` starts at the digits ``cuts[i]`` and holds the rows from position
    ``firsts[i]``; its size is ``sizes[i]``."""
    keys: list[str]
    longest: dict
    cuts: list[tuple[int, ...]]
    firsts: list[int]
    sizes: list[int]

    @property
    def total(self) -> int:
        return self.firsts[-1] + self.sizes[-1] if self.firsts else 0

    def save(self, spark: SparkSession, path: str) -> None:
        """Store the directory, one row a bucket."""
        about = json.dumps([self.keys, self.longest])
        rows = [(about, list(c), f, s) for c, f, s in zip(self.cuts, self.firsts, self.sizes)]
        spark.createDataFrame(rows, "about string, cut array<long>, first long, size long").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> RankDirectory:
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: tuple(r.cut))
        keys, longest = json.loads(rows[0].about) if rows else ([], {})
        return RankDirectory(keys, longest, [tuple(r.cut) for r in rows], [r.first for r in rows], [r["size"] for r in rows])

    def buckets(self, first: int, last: int) -> list[int]:
        """Buckets that hold positions of ``[first, last]``."""
        return [i for i, (f, s) in enumerate(zip(self.firsts, self.sizes)) if f <= last and first < f + s]


def rank_directory(df: DataFrame, keys: list[str], most: int | None = None) -> RankDirectory:
    """Directory of ``df`` by ``keys``: buckets of at most ``most`` rows (by default a million, and at least 64 buckets);
    only rows that are equal in the whole key share a larger one."""
    df = df.select(*keys)
    longest = longest_texts(df, keys)
    ds = digits(df, keys, longest)
    root = _root(df, ds)
    limit = most or max(1, min(BUCKET_ROWS, root.rows // LEAST_BUCKETS))
    nodes, leaves = ([root] if root.rows else []), []
    while nodes:
        full = [n for n in nodes if n.rows > limit]
        leaves += [n for n in nodes if n.rows <= limit]
        single = [n for n in full if n.low == n.high]
        leaves += [n for n in single if len(n.fixed) + 1 == len(ds)]
        wide, nodes = [n for n in full if n.low < n.high], []
        nodes += _next_digit(df, ds, [n for n in single if len(n.fixed) + 1 < len(ds)])
        for s in range(0, len(wide), 32):  # so many nodes a pass, with cells enough for the rows they hold
            part = wide[s:s + 32]
            cells = min(CELLS, max(256, 4 * -(-max(n.rows for n in part) // limit)))
            nodes += _split(df, ds, part, cells)
    leaves.sort(key=lambda n: n.first)
    cuts, firsts, sizes = [], [], []
    for n in leaves:  # neighbours share a bucket while they fit
        if sizes and sizes[-1] + n.rows <= limit:
            sizes[-1] += n.rows
        else:
            cuts.append(n.start)
            firsts.append(n.first)
            sizes.append(n.rows)
    return RankDirectory(keys, longest, cuts, firsts, sizes)


def with_bucket(df: DataFrame, directory: RankDirectory, bucket: str = "_bucket", first: str = "_first") -> DataFrame:
    """``df`` with the bucket of each row (binary search over the cuts) and the position of the bucket's first row."""
    depth = max((len(c) for c in directory.cuts), default=1)
    ds = digits(df, directory.keys, directory.longest)[:depth]
    low = NULL - 1
    cuts = [tuple(c) + (low,) * (depth - len(c)) for c in directory.cuts]
    names = [f"d{i}" for i in range(depth)]
    table = df.sparkSession.createDataFrame(
        [([dict(zip(names, c)) for c in cuts], directory.firsts)],
        T.StructType([T.StructField("cuts", T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in names]))),
                      T.StructField("firsts", T.ArrayType(T.LongType()))]))
    key = F.struct(*[d.alias(x) for d, x in zip(ds, names)])
    steps = [1 << b for b in reversed(range(max(1, len(cuts).bit_length())))]
    n = len(cuts)

    def step(i: Column, by: Column) -> Column:
        up = i + by
        return F.when((up < n) & (F.try_element_at(F.col("_cuts"), up + 1) <= F.col("_key")), up).otherwise(i)
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)
    return (df.withColumns({"_cuts": table.select("cuts").scalar(), "_key": key})
            .withColumn(bucket, found).drop("_cuts", "_key")
            .withColumn(first, F.element_at(table.select("firsts").scalar(), F.col(bucket) + 1)))
