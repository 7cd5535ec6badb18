"""Operator 10: benchmark decontamination over a distributed positional inverted index.

``build_index`` cuts the corpus into segments (about ``SEGMENT`` bytes of text
each); a segment is one stored row: its documents, its sorted terms (64-bit
word hashes) and, per term, the ascending positions of the term.  Documents lie
one after another on the position axis with a gap between them.  Only terms of
the test set are posted while their list fits the bound ``MAX_TERMS``; beyond it
every term is (the filter only saves space).

``find_matches`` turns every test item into windows of ``width`` consecutive
words (a shorter item is one window) and intersects, segment by segment, the
posting lists of a window's terms shifted by their offsets, from the term that
is rarest in the whole corpus to the most frequent one, so nearly all
candidates die at the first lists.  ``slop`` 0 gives exact phrases, a larger
one proximity matches (every term within ``slop`` words of its place).  The test
set is shipped in blocks of at most about ``MAX_WINDOWS`` windows, a long item
in several pieces; more blocks mean more passes over the stored index, never a
dropped window.

Edge cases: null or empty texts have no words and no hits; repeated rows are
judged each; items without words or with a null item_id match nothing; two rows
of one item_id are one item; an empty table on either side gives no hits; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalcrate.llm import bytescan
from evalcrate.llm.shared import for_python, hidden, saved

SEGMENT = 2 << 20
GAP = 64
MAX_TERMS = 4_000_000
MAX_WINDOWS = 200_000

_INDEX = ("segment string, doc_ids array<bigint>, doc_starts array<int>, n_words array<int>, terms array<bigint>, "
          "counts array<int>, positions array<int>")
_FOUND = ("segment string, place int, doc_id long, n_words long, spans array<int>, items array<string>, "
          "near array<string>")
_DIGEST = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
           "n_near_items long")


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h, off = bytescan.word_hashes(b.column("text"), bytescan.ALNUM)
        yield pa.RecordBatch.from_arrays(
            [b.column("item"), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(h.view(np.int64)))],
            names=["item", "words"])


def _indexer(vocabulary: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in bytescan.slices(batches, most=SEGMENT):
            h, off = bytescan.word_hashes(part.column("text"), bytescan.ALNUM)
            n = np.diff(off)
            starts = off[:-1] + GAP * np.arange(len(n))
            pos = np.arange(len(h)) + GAP * np.repeat(np.arange(len(n)), n)
            if vocabulary is not None:
                at = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
                held = vocabulary[at] == h if len(vocabulary) else np.zeros(len(h), dtype=bool)
                h, pos = h[held], pos[held]
            order = np.argsort(h, kind="stable")
            terms, counts = np.unique(h, return_counts=True)

            def one(values, kind):
                return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))

            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), one(part.column("doc_id").cast(pa.int64()), pa.int64()),
                 one(starts.astype(np.int32), pa.int32()), one(n.astype(np.int32), pa.int32()),
                 one(terms.view(np.int64), pa.int64()), one(counts.astype(np.int32), pa.int32()),
                 one(pos[order].astype(np.int32), pa.int32())],
                names=["segment", "doc_ids", "doc_starts", "n_words", "terms", "counts", "positions"])
    return run


def test_words(items: DataFrame) -> DataFrame:
    """``(item, words)``: the word hashes of every test item."""
    return items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where(
        "item IS NOT NULL").mapInArrow(_item_words, "item string, words array<bigint>")


def build_index(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Positional inverted index of ``docs``, stored in the shared folder."""
    terms = words.select(F.explode("words").alias("t")).distinct()
    vocabulary = None
    if terms.count() <= MAX_TERMS:
        vocabulary = np.sort(np.array([r.t for r in terms.collect()], np.int64).view(np.uint64))
    return saved(docs.select("doc_id", F.col("text").cast("string").alias("text"))
                 .mapInArrow(_indexer(vocabulary), _INDEX), "positions")


def _windows(rows: list, width: int, counts: dict[int, int]):
    """Distinct windows as (terms, offsets, lengths) in order of rarity, and the items of each."""
    items: dict[tuple, set] = {}
    for r in rows:
        w = tuple(r.words)
        for i in range(max(len(w) - width, 0) + 1 if w else 0):
            items.setdefault(w[i:i + width], set()).add(r.item)
    terms = np.zeros((len(items), width), np.int64)
    offsets = np.zeros((len(items), width), np.int32)
    lengths = np.zeros(len(items), np.int32)
    for i, w in enumerate(items):
        by_rarity = sorted(range(len(w)), key=lambda j: (counts.get(w[j], 0), j))
        lengths[i] = len(w)
        terms[i, :len(w)] = [w[j] for j in by_rarity]
        offsets[i, :len(w)] = by_rarity
    return terms.view(np.uint64), offsets, lengths, [sorted(x) for x in items.values()]


def _matches(keys, first, counts, terms, offsets, lengths, slop):
    """(window, start) of all places where a window's terms stand at their offsets, give or take ``slop``."""
    width = terms.shape[1]
    at = np.minimum(np.searchsorted(first, terms), max(len(first) - 1, 0))
    here = (first[at] == terms) if len(first) else np.zeros(terms.shape, dtype=bool)
    used = np.arange(width) < lengths[:, None]
    live = np.flatnonzero((here | ~used).all(axis=1) & (lengths > 0))
    ptr = np.append(0, np.cumsum(counts))
    a = at[live, 0]
    n = counts[a]
    win = np.repeat(live, n)
    i = np.repeat(ptr[a] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
    start = (keys[i] & np.uint64(0xFFFFFFFF)).astype(np.int64) - offsets[win, 0]
    for r in range(1, width):
        term = at[win, r].astype(np.uint64) << np.uint64(32)
        # positions are shifted by GAP so that the slop never leaves the term's range
        place = start + offsets[win, r]
        low = term + np.maximum(place - slop, 0).astype(np.uint64)
        j = np.searchsorted(keys, low)
        hit = keys[np.minimum(j, len(keys) - 1)]
        ok = ((j < len(keys)) & (hit >= low) & (hit <= term + np.maximum(place + slop, 0).astype(np.uint64))
              & (place + slop >= 0)) | (r >= lengths[win])
        win, start = win[ok], start[ok]
    return win[start >= 0], start[start >= 0]


def _finder(block, slop: int):
    terms, offsets, lengths, items = block.value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, starts, n_words, first, counts, pos = (
                    batch.column(c)[row].values.to_numpy(zero_copy_only=False) if len(batch.column(c)[row]) else
                    np.empty(0, np.int64) for c in ("doc_ids", "doc_starts", "n_words", "terms", "counts", "positions"))
                id_list = batch.column("doc_ids")[row].as_py()
                first = first.astype(np.int64).view(np.uint64)
                keys = (np.repeat(np.arange(len(first), dtype=np.uint64), counts.astype(np.int64)) << np.uint64(32)) \
                    + pos.astype(np.uint64)
                found = []
                for s in (0, slop) if slop else (0,):
                    win, start = _matches(keys, first, counts.astype(np.int64), terms, offsets, lengths, s)
                    found.append((win, start, np.searchsorted(starts, start, "right") - 1))
                spans, named, near = ({} for _ in range(3))
                for w, s, d in zip(*found[0]):
                    spans.setdefault(d, []).append((int(s - starts[d]), int(s - starts[d] + lengths[w])))
                    named.setdefault(d, set()).update(items[w])
                for w, _, d in zip(*found[-1]):
                    near.setdefault(d, set()).update(items[w])
                out = range(len(id_list))
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column("segment")[row].as_py()] * len(id_list), pa.string()),
                    pa.array(out, pa.int32()), pa.array(id_list, pa.int64()), pa.array(n_words, pa.int64()),
                    pa.array([[x for s in spans.get(d, ()) for x in s] for d in out], pa.list_(pa.int32())),
                    pa.array([sorted(named.get(d, ())) for d in out], pa.list_(pa.string())),
                    pa.array([sorted(near.get(d, ())) for d in out], pa.list_(pa.string()))],
                    names=["segment", "place", "doc_id", "n_words", "spans", "items", "near"])
    return run


def _judge(block, slop: int):
    """Matches and their digest in one pass over the segments."""
    find = _finder(block, slop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _digest(find(batches))
    return run


def find_matches(index: DataFrame, words: DataFrame, width: int = 13, slop: int = 1) -> DataFrame:
    """Per document: flat ``spans`` (start, end word of every exact window match), matched ``items``
    and ``near`` items (proximity matches)."""
    return _found(index, words, width, slop, whole=False)


def _found(index: DataFrame, words: DataFrame, width: int, slop: int, whole: bool) -> DataFrame:
    """``find_matches``; with ``whole`` its digest."""
    spark = index.sparkSession
    posted = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(
        F.col("x.terms").alias("t")).agg(F.sum("x.counts").alias("c"))
    total = words.agg(F.sum(F.greatest(F.size("words") - F.lit(width - 1), F.lit(1)))).first()[0] or 0
    blocks = max(1, -(-3 * total // (2 * MAX_WINDOWS))) if total > MAX_WINDOWS else 1
    if blocks > 1:
        # pieces of at most a twentieth of a block's windows; each has all words of its windows
        piece = max(1, MAX_WINDOWS // 20)
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - F.lit(width), F.lit(0)), F.lit(piece))
        words = saved(words.where(F.size("words") > 0).select("item", "words", F.explode(starts).alias("lo")).select(
            "item", "lo", F.slice("words", F.col("lo") + 1, piece + width - 1).alias("words")), "test-words")
    block = F.pmod(F.xxhash64("item", "lo"), F.lit(blocks)) if blocks > 1 else F.lit(0)
    found = None
    for b in range(blocks):
        part = words.where(block == b)
        terms = part.select(F.explode("words").alias("t")).distinct()
        counts = {r.t: r.c for r in posted.join(terms, "t").collect()}
        sent = spark.sparkContext.broadcast(_windows(part.collect(), width, counts))
        if whole and blocks == 1:
            return index.mapInArrow(_judge(sent, slop), _DIGEST)
        one = index.mapInArrow(_finder(sent, slop), _FOUND)
        found = one if found is None else found.unionByName(one)
    if blocks == 1:
        return found
    # a document's matches with the blocks of the test set come together again
    lists = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("items", "near")]
    found = found.groupBy("segment", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"), *lists)
    return found.mapInArrow(_digest, _DIGEST) if whole else found


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    empty = hashlib.sha256(b"").hexdigest()
    for b in batches:
        n_words = b.column("n_words").to_numpy()
        n_hit, shas = np.zeros(b.num_rows, np.int64), []
        spans, items = b.column("spans").to_pylist(), b.column("items").to_pylist()
        for i, (s, x) in enumerate(zip(spans, items)):
            end = 0
            for lo, hi in sorted(zip(s[::2], s[1::2])):
                n_hit[i] += max(0, hi - max(lo, end))
                end = max(end, hi)
            shas.append(hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() if x else empty)
        yield pa.RecordBatch.from_arrays([
            b.column("doc_id"), b.column("n_words"), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()),
            pa.array(shas), pa.array((n_hit > 0) & (20 * n_hit >= n_words)),
            pa.array([len(x) for x in b.column("near").to_pylist()], pa.int64())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, slop: int = 1) -> DataFrame:
    """One row per document with its hit words, matched items and the verdict ``contaminated``
    (some word is hit, and at least one in twenty is)."""
    for_python(docs.sparkSession)
    words = saved(test_words(benchmark), "test-words")
    return _found(build_index(docs, words), words, width, slop, whole=True)


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated (equal texts share the verdict)."""
    columns = docs.columns
    docs, back = hidden(docs, ["_text", "_bad"])
    keyed = docs.withColumn("_text", F.xxhash64(F.col("text").cast("string")))
    bad = (contamination(keyed.select(F.col("_text").alias("doc_id"), "text"), benchmark, width, slop=0)
           .where("contaminated").select(F.col("doc_id").alias("_bad")).distinct())
    bad = saved(bad, "contaminated")  # a table of known size: a small one is broadcast and the texts stay where they are
    return (keyed.join(bad, F.col("_text").eqNullSafe(F.col("_bad")), "left_anti")
            .select(*docs.columns).withColumnsRenamed(back).select(*columns))
