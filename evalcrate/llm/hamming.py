"""Operator 9: exact top-k search over binary codes by incremental multi-index hashing.

Vectors become sign codes.  Equal codes are one index entry that keeps its ``k``
smallest ids, so a group of copies costs one entry.  Codes are cut into 16-bit
segments and every index block keeps one bucket table a segment.  A query probes
segment by segment all buckets at segment distance 0, then 1, and so on; after
segment ``j`` of radius ``r`` every code within distance ``m * r + j`` has been
seen, and the query stops once its k-th verified distance is that small.

Queries and entries are dealt into blocks, and each pair of blocks is one task
row group: a stated query set against all rows.  The best k of each block are
merged per query.

Edge cases: null vectors have no code, as query and as entry; null elements and
missing ones of shorter vectors are 0 bits; ties go to the smaller id; repeated
rows are entries of their own; fewer than k entries give fewer rows; an empty
table gives none; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalcrate.llm.shared import for_python, saved

BLOCK = 100_000
QUERIES = 20_000
LEAST = 256
CHUNK = 64
SEGMENT = 16
SALTS = 64
_MASKS = [np.flatnonzero(np.bitwise_count(np.arange(1 << SEGMENT, dtype=np.uint32)) == r).astype(np.uint16)
          for r in range(SEGMENT + 1)]


def sign_codes(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, code)``: one long per 64 dimensions, bit set where the element is above 0."""
    dims = rows.agg(F.coalesce(F.max(F.size(vector_col)), F.lit(0))).first()[0]
    words = []
    for w in range(max(1, -(-dims // 64))):
        bits = F.zip_with(F.slice(vector_col, 64 * w + 1, 64), F.sequence(F.lit(0), F.lit(63)),
                          lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        words.append(F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))
    return rows.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.array(*words).alias("code"))


class BlockIndex:
    """Bucket tables of one block of distinct codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = np.ascontiguousarray(codes).view(np.uint16).reshape(len(codes), -1)
        self.order = [np.argsort(self.parts[:, j], kind="stable") for j in range(self.parts.shape[1])]
        self.ptr = [np.append(0, np.cumsum(np.bincount(self.parts[:, j], minlength=1 << SEGMENT)))
                    for j in range(self.parts.shape[1])]

    def search(self, queries: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, entry, distance) of the k best entries of each query by (distance, id)."""
        n, m = len(self.codes), self.parts.shape[1]
        parts = np.ascontiguousarray(queries).view(np.uint16).reshape(len(queries), m)
        open_ = np.arange(len(queries))
        found = np.empty(0, np.int64)  # query row * n + entry, distinct
        dist = np.empty(0, np.int64)
        for r in range(SEGMENT + 1):
            for j in range(m):
                probe = (parts[open_, j][:, None] ^ _MASKS[r][None, :]).astype(np.int64)
                lo, hi = self.ptr[j][probe], self.ptr[j][probe + 1]
                lens = (hi - lo).ravel()
                at = np.repeat(lo.ravel() - np.append(0, np.cumsum(lens)[:-1]), lens) + np.arange(lens.sum())
                q = np.repeat(open_, (hi - lo).sum(axis=1))
                new = np.setdiff1d(q * n + self.order[j][at], found)
                dist = np.append(dist, np.bitwise_count(queries[new // n] ^ self.codes[new % n]).sum(axis=1, dtype=np.int64))
                found = np.append(found, new)
                covered = m * r + j
                near = np.bincount((found // n)[dist <= covered], minlength=len(queries))
                seen = np.bincount(found // n, minlength=len(queries))
                open_ = open_[(near[open_] < k) & (seen[open_] < n)]
                if not len(open_):
                    q, e = found // n, found % n
                    order = np.lexsort((ids[e], dist, q))
                    q, e, d = q[order], e[order], dist[order]
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    return q[place < k], e[place < k], d[place < k]
        raise AssertionError("all radii probed")


def _search(k: int):
    def run(key, queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(base):
            codes = np.array(base["code"].tolist(), np.int64).view(np.uint64)
            ids = base["low"].to_numpy()
            index = BlockIndex(codes)
            qc = np.array(queries["code"].tolist(), np.int64).view(np.uint64)
            qi = queries["q"].to_numpy()
            for a in range(0, len(qc), CHUNK):
                q, e, d = index.search(qc[a:a + CHUNK], ids, k)
                out.append(pd.DataFrame({"q": qi[a + q], "entry": ids[e], "distance": d}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "entry": [], "distance": []}, dtype="int64")
    return run


def exact_topk(rows: DataFrame, query: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
               k: int = 10) -> DataFrame:
    """Per row of ``query`` its ``k`` nearest rows: ``query_id, rank, vec_id, distance``."""
    spark = rows.sparkSession
    for_python(spark)
    codes = sign_codes(rows, id_col, vector_col).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    some = F.row_number().over(Window.partitionBy("code", "salt").orderBy("id"))
    best = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    kept = saved(codes.withColumn("r", some).where(F.col("r") <= k).withColumn("r", best).where(F.col("r") <= k)
                 .select("id", "code"), "codes")
    entries = saved(kept.groupBy("code").agg(F.min("id").alias("low")), "entries")
    asked = saved(sign_codes(query, id_col, vector_col).groupBy("code").agg(F.collect_list("id").alias("ids"))
                  .withColumn("q", F.xxhash64("code")), "queries")
    nb = max(1, -(-entries.count() // BLOCK))
    # enough query blocks to give every core some, each of at least LEAST queries
    n = asked.count()
    nq = max(1, -(-n // QUERIES), min(-(-n // LEAST), -(-2 * spark.sparkContext.defaultParallelism // nb)))
    base = entries.withColumn("b", F.pmod(F.xxhash64("low"), F.lit(nb))).withColumn(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))))
    probes = asked.select("q", "code").withColumn("a", F.pmod(F.xxhash64("q"), F.lit(nq))).withColumn(
        "b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long"))))
    near = (probes.groupBy("a", "b").cogroup(base.groupBy("a", "b"))
            .applyInPandas(_search(k), "q long, entry long, distance long"))
    order = Window.partitionBy("q").orderBy("distance", "entry")
    near = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
    ids = near.join(entries.withColumnRenamed("low", "entry"), "entry").join(kept, "code")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))
    top = ids.select("q", "distance", "id").withColumn("rank", rank).where(F.col("rank") <= k)
    return asked.select("q", F.explode("ids").alias("query_id")).join(top, "q").select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "distance")
