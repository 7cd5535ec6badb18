"""Operator 4: token counts by rank-synchronous array merging.

The vocabulary is a sentencepiece BPE model with byte fallback.  Its pieces never
hold a space behind another character, and a character that occurs in no longer
piece never merges, so a text splits exactly into pre-tokens (a run of spaces
with the mergeable characters that follow it) and single characters.  The
distinct pre-tokens of a batch that are not in the worker's bounded cache are
held as one ragged array of symbols.  In every round each sequence's best-ranked
adjacent pair (the leftmost one of equals) is merged, in all sequences at once;
sequences without a mergeable pair leave the arrays.  The count of a pre-token is
the number of its surviving symbols (a character outside the vocabulary counts
its UTF-8 bytes).

A pre-token of more than ``LONG`` characters would need a round per merge over
its whole length; it is merged in the same order with a heap instead.

Edge cases: null and empty texts have 0 tokens; special strings inside texts are
plain text, as the library's default has it; texts are never cut; repeated rows
are counted each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalcrate.llm import bytescan
from evalcrate.llm.shared import for_python

LONG = 2048
CACHE = 500_000
CHUNK = 2 << 20
NONE = np.int64(1 << 40)
SPACE = "▁"

_MODELS: dict[str, "PieceModel"] = {}


def model_path(name: str) -> str:
    """``name`` if it is a path, else the place of a public tokenizer file."""
    if "/" in name:
        return name
    import public_tokenizers
    return str(public_tokenizers.path(name))


class PieceModel:
    """Merge table of a sentencepiece BPE model: pairs of symbols, their rank and the merged symbol."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("ﬁ  A ") != f"{SPACE}ﬁ{SPACE * 2}A{SPACE}":
            raise ValueError("the model must keep text as it is, with a space put in front")
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        scores = [sp.get_score(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(a != SPACE and b == SPACE for p in pieces for a, b in zip(p, p[1:])):
            raise ValueError("a piece holds a space behind another character")
        # equal scores share a rank: the leftmost pair goes first
        rank_of = {s: i for i, s in enumerate(sorted(set(scores), reverse=True))}
        self.ids = {p: i for i, p in enumerate(pieces)}
        ranks = [rank_of[s] for s in scores]
        joined = {c for p in pieces if len(p) > 1 for c in p}
        weight = [1] * len(pieces)
        for c in sorted(joined - self.ids.keys()):  # characters that only occur inside pieces
            self.ids[c] = len(weight)
            weight.append(len(c.encode()))
        self.weight = np.array(weight, np.int64)
        left, right, rank, out = [], [], [], []
        for p, i in list(self.ids.items()):
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(ranks[i])
                    out.append(i)
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(key)
        self.key, self.rank, self.out = key[order], np.array(rank, np.int64)[order], np.array(out, np.int64)[order]
        inner = "".join(re.escape(c) for c in sorted(joined - {SPACE}))
        self.split = re.compile(f"{SPACE}*[{inner}]+|{SPACE}+|[^{SPACE}{inner}]+").findall
        self.joined = joined
        self.cache: dict[str, int] = {}

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where the pair does not merge) and merged symbol of each pair."""
        k = a << 32 | b
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        ok = self.key[at] == k
        return np.where(ok, self.rank[at], NONE), self.out[at]

    def merged(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each pre-token, all of them merged rank by rank together."""
        sizes = np.array([len(w) for w in words])
        cp = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        chars, inv = np.unique(cp, return_inverse=True)
        sym = np.array([self.ids[chr(c)] for c in chars], np.int64)[inv]
        seq = np.repeat(np.arange(len(words)), sizes)
        last = np.zeros(len(sym), dtype=bool)
        last[np.cumsum(sizes) - 1] = True
        rank, out = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], out[:-1] = self.look(sym[:-1], sym[1:])
        rank[last] = NONE
        count = np.zeros(len(words), np.int64)
        while len(sym):
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            best = np.minimum.reduceat(rank, starts)
            lens = np.diff(np.append(starts, len(seq)))
            ended = best == NONE
            if ended.any():
                gone = np.repeat(ended, lens)
                count += np.bincount(seq[gone], weights=self.weight[sym[gone]], minlength=len(words)).astype(np.int64)
                sym, seq, last, rank, out = (x[~gone] for x in (sym, seq, last, rank, out))
                best, lens = best[~ended], lens[~ended]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, lens))
            at = at[np.append(True, seq[at][1:] != seq[at][:-1])]  # the leftmost of each sequence
            sym[at] = out[at]
            last[at] = last[at + 1]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            sym, seq, last, rank, out = (x[keep] for x in (sym, seq, last, rank, out))
            at = at - np.arange(len(at))
            left = at[at > 0] - 1
            for p in (at, left):
                nxt = np.minimum(p + 1, len(sym) - 1)
                r, o = self.look(sym[p], sym[nxt])
                rank[p], out[p] = np.where(last[p], NONE, r), o
        return count

    def heaped(self, word: str) -> int:
        """The same merges for one long pre-token, next pair from a heap."""
        sym = [self.ids[c] for c in word]
        n = len(sym)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        s = np.array(sym, np.int64)
        r, o = self.look(s[:-1], s[1:])
        heap = [(int(r[i]), int(i), sym[i], sym[i + 1], int(o[i])) for i in np.flatnonzero(r < NONE)]
        heapq.heapify(heap)
        table = self.pairs
        while heap:
            _, i, a, b, out = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = out, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for p in (prev[i], i):
                if p >= 0 and nxt[p] < n:
                    hit = table.get((sym[p], sym[nxt[p]]))
                    if hit:
                        heapq.heappush(heap, (hit[0], p, sym[p], sym[nxt[p]], hit[1]))
        return int(sum(self.weight[x] for x in sym if x >= 0))

    @property
    def pairs(self) -> dict:
        if not hasattr(self, "_pairs"):
            self._pairs = {(int(k >> 32), int(k & 0xFFFFFFFF)): (int(r), int(o))
                           for k, r, o in zip(self.key, self.rank, self.out)}
        return self._pairs

    def lone(self, run: str) -> int:
        """Tokens of characters that never merge."""
        return sum(1 if c in self.ids else len(c.encode()) for c in run)

    def counts(self, texts: list[str]) -> list[int]:
        parts = [self.split((SPACE + t).replace(" ", SPACE)) if t else [] for t in texts]
        fresh = set().union(*parts) - self.cache.keys()
        if len(self.cache) + len(fresh) > CACHE:
            self.cache.clear()
            fresh = set().union(*parts)
        short, cache = [], self.cache
        for w in fresh:
            if w[-1] not in self.joined:
                cache[w] = self.lone(w)
            elif len(w) > LONG:
                cache[w] = self.heaped(w)
            else:
                short.append(w)
        if short:
            cache.update(zip(short, self.merged(short).tolist()))
        got = [sum(map(cache.__getitem__, p)) for p in parts]
        for w in fresh:
            if len(w) > LONG:
                del cache[w]
        return got


def load(name: str) -> PieceModel:
    if name not in _MODELS:
        _MODELS[name] = PieceModel(model_path(name))
    return _MODELS[name]


def _counter(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(name)
        for b in bytescan.slices(batches, most=CHUNK):
            got = model.counts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("n_bytes"),
                                              pa.array(got, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_tokens, over_limit``."""
    for_python(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(_counter(model), "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)
