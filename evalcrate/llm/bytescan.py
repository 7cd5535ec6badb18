"""Vectorised word scanning over the UTF-8 bytes of Arrow string columns.

Shared by the n-gram join and the decontamination index.  Texts are scanned
whole, in pieces of a quarter of a megabyte, so memory stays bounded by the piece
and by eight bytes a word, however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# bytes of words split at white space: everything but 0x20 and 0x09-0x0D
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

# bytes of words made of 0-9, a-z (after lower-casing) and all non-ASCII characters
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

_R = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_TABLES: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _TABLES or len(_TABLES["p"]) < n:
        size = max(n, PIECE + 1)
        for name, base in (("p", _R), ("i", pow(_R, -1, 1 << 64))):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            _TABLES[name] = np.multiply.accumulate(t)
    return _TABLES["p"], _TABLES["i"]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null has no bytes."""
    a = pc.fill_null(col.cast(pa.large_string()), "")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    _, off, data = a.buffers()
    o = np.frombuffer(off, dtype=np.int64)[a.offset:a.offset + len(a) + 1]
    d = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return d, o


def slices(batches: Iterator[pa.RecordBatch], column: str = "text",
           most: int = 4 * PIECE) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``most`` text bytes (a longer text is a run of its own)."""
    for batch in batches:
        off = buffers(batch.column(column))[1]
        lo = 0
        while lo < batch.num_rows:
            hi = min(max(int(np.searchsorted(off, off[lo] + most, "right")) - 1, lo + 1), batch.num_rows)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _cuts(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> list[int]:
    """Piece bounds: at text ends where possible, else inside a text after a byte of no word."""
    cuts, end = [int(off[0])], int(off[-1])
    while cuts[-1] < end:
        a = cuts[-1]
        if end - a <= PIECE:
            cuts.append(end)
            break
        fit = int(off[np.searchsorted(off, a + PIECE, "right") - 1])
        if fit <= a:
            stop = int(off[np.searchsorted(off, a, "right")])
            if stop - a <= PIECE:
                fit = stop
            else:
                gaps = np.flatnonzero(~is_word[LOWER[data[a:a + PIECE]]])
                if len(gaps):
                    fit = a + int(gaps[-1]) + 1
                else:  # one word longer than a piece is taken whole
                    fit, step = stop, a + PIECE
                    while step < stop:
                        g = np.flatnonzero(~is_word[LOWER[data[step:min(step + PIECE, stop)]]])
                        if len(g):
                            fit = step + int(g[0]) + 1
                            break
                        step += PIECE
        cuts.append(fit)
    return cuts


def word_hashes(col: pa.Array, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, and word offsets (one more than texts)."""
    data, off = buffers(col)
    hashes, ends_at = [], []
    cuts = _cuts(data, off, is_word)
    for a, b in zip(cuts, cuts[1:]):
        low = LOWER[data[a:b]]
        m = is_word[low]
        before = np.empty_like(m)
        before[0] = False
        before[1:] = m[:-1]
        inner = off[np.searchsorted(off, a, "left"):np.searchsorted(off, b, "left")] - a
        before[inner] = False
        starts = np.flatnonzero(m & ~before)
        if not len(starts):
            continue
        after = np.empty_like(m)
        after[-1] = False
        after[:-1] = m[1:]
        after[inner[inner > 0] - 1] = False
        ends = np.flatnonzero(m & ~after)
        p, inv = _powers(len(low))
        v = (low.astype(np.uint64) + np.uint64(1)) * p[:len(low)]
        c = np.add.accumulate(v)
        h = (c[ends] - c[starts] + v[starts]) * inv[starts]
        hashes.append(mix(h + (ends - starts).astype(np.uint64) * np.uint64(_R)))
        ends_at.append(starts + a)
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(off), dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(ends_at), off, "left").astype(np.int64)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of one text's word hashes; a shorter
    text is one shingle, an empty one has none."""
    if not len(h):
        return h
    size = min(k, len(h))
    n = len(h) - size + 1
    acc = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        acc = acc * np.uint64(0xFF51AFD7ED558CCD) + h[j:j + n]
    return np.unique(mix(acc))
