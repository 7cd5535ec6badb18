"""Operator 8: language identification with interpolated Kneser-Ney character models.

Training counts every character 4-gram of all labelled training texts (lower
case, runs of non-letters as one space).  Raw counts serve the highest order,
numbers of distinct left contexts the lower ones; each order is discounted and
interpolated with the next, down to a uniform base.  The model keeps every
4-gram of every language.  What a task holds of it at a time is bounded by cutting
it into blocks of about ``MAX_GRAMS`` (language, 4-gram) pairs by ranges of the
third letter: a 4-gram, its shorter n-grams down to two letters and all their
contexts lie in one block, the single letters in each.  More blocks mean more
lookups a text, never a dropped n-gram.  Per order, the union of the languages'
n-grams is one sorted array of 64-bit keys with one log-probability column a
language, found by binary search; an n-gram no language knows backs off through
its context's weight.

A text gets the language of the lowest cross-entropy per character.  ``rejected``
marks texts without letters and texts that no model explains: their cross-entropy
lies ``z`` standard deviations, and at least ``MARGIN`` nats, above that of training texts of the language and like length.
One aggregate over all rightly predicted training texts gives means and deviations; a length class with fewer than
``EVIDENCE`` texts takes those of its language, a language with fewer those of all languages together.

Edge cases: a null text or one without a letter is ``und``, score 0, rejected; a
null label never trains; a null doc_id never trains and is not held out; ties go
to the first language by name; without training rows every text is ``und``;
repeated rows count each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalcrate.llm import bytescan
from evalcrate.llm.shared import for_python, hidden, local_rows, saved

ORDER = 4
MAX_GRAMS = 400_000
EVIDENCE = 30
MARGIN = 1.0
CHUNK = 1 << 16
_OTHER = 0xFFFE  # letters outside the basic plane
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point (basic plane) to its lower-case letter, or to a space."""
    if not _TABLE:
        t = np.full(1 << 16, 32, np.uint16)
        for c in range(1 << 16):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
        _TABLE.append(t)
    return _TABLE[0]


def normal(text: str) -> np.ndarray:
    """Lower-case letters with single spaces between, three spaces in front and one behind; empty without letters."""
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    high = cp >> 16 > 0
    x = _letters()[np.where(high, 0, cp)]
    if high.any():
        x[high] = [_OTHER if chr(c).isalpha() else 32 for c in cp[high]]
    x = x[(x != 32) | np.append(True, x[:-1] != 32)]
    x = x[int(x[0] == 32):len(x) - int(x[-1] == 32)] if len(x) else x
    return np.concatenate([[32, 32, 32], x, [32]]).astype(np.uint64) if len(x) else np.empty(0, np.uint64)


def grams(x: np.ndarray) -> np.ndarray:
    """64-bit keys of the 4-grams of one normalised text."""
    s = np.uint64(16)
    return ((x[:-3] << s | x[1:-2]) << s | x[2:-1]) << s | x[3:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def fold(lang):
        k = np.concatenate([a for a, _ in held[lang]])
        n = np.concatenate([b for _, b in held[lang]])
        u, inv = np.unique(k, return_inverse=True)
        held[lang] = [(u, np.bincount(inv, weights=n).astype(np.int64))]

    size: dict[str, int] = {}
    for b in bytescan.slices(batches):
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            x = normal(text)
            for i in range(0, max(len(x) - 3, 0), CHUNK):
                g = grams(x[i:i + CHUNK + 3])
                held.setdefault(lang, []).append((g, np.ones(len(g), np.int64)))
                size[lang] = size.get(lang, 0) + len(g)
            if size.get(lang, 0) > 8 * CHUNK:
                fold(lang)
                size[lang] = 0
    for lang in held:
        fold(lang)
        k, n = held[lang][0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)),
                                          pa.array(n)], names=["lang", "gram", "n"])


def _find(keys: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(q), np.int64), np.zeros(len(q), dtype=bool)
    at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
    return at, keys[at] == q


def _discount(n1: float, n2: float) -> float:
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.75


class CharModel:
    """Union tables of all languages, order by order.

    A block of a larger model gets what its own 4-grams cannot give as ``whole``: per language the
    single letters with their counts and the (ones, twos) of the lower orders, longest first."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], ones_twos: dict[str, tuple],
                 whole: dict[str, tuple] | None = None):
        self.langs = sorted(counts)
        size = len(self.langs)
        levels = []  # per order from 1: {lang: (keys, counts, discount)}
        for k in range(ORDER):
            levels.insert(0, {})
            for lang in self.langs:
                if k == 0:
                    keys, n = counts[lang]
                    d = _discount(*ones_twos[lang])
                else:  # distinct left contexts of the shorter n-gram
                    above = levels[1][lang][0]
                    keys, n = np.unique(above & np.uint64((1 << 16 * (ORDER - k)) - 1), return_counts=True)
                    if whole and k == ORDER - 1:
                        keys, n = whole[lang][0]
                    d = _discount(*(whole[lang][k] if whole else ((n == 1).sum(), (n == 2).sum())))
                levels[0][lang] = (keys, n.astype(np.float64), d)
        alphabet = len(np.unique(np.concatenate([levels[0][x][0] for x in self.langs]))) + 1
        self.base = np.log(1.0 / alphabet)
        self.keys, self.logp, self.contexts, self.weights = [], [], [], []
        for k, level in enumerate(levels):
            keys = np.unique(np.concatenate([level[x][0] for x in self.langs]))
            ctx = np.unique(keys >> np.uint64(16))
            weight, p = np.ones((len(ctx), size)), np.empty((len(keys), size))
            lower = np.full((len(keys), size), 1.0 / alphabet) if k == 0 else np.exp(
                self.logp[-1][_find(self.keys[-1], keys & np.uint64((1 << 16 * k) - 1))[0]].astype(np.float64))
            in_ctx = _find(ctx, keys >> np.uint64(16))[0]
            for j, lang in enumerate(self.langs):
                own, n, d = level[lang]
                at = _find(ctx, own >> np.uint64(16))[0]
                total = np.bincount(at, weights=n, minlength=len(ctx))
                types = np.bincount(at, minlength=len(ctx))
                seen = total > 0
                weight[seen, j] = d * types[seen] / total[seen]
                c = np.zeros(len(keys))
                c[_find(keys, own)[0]] = np.maximum(n - d, 0)
                p[:, j] = c / np.maximum(total, 1)[in_ctx] + weight[in_ctx, j] * lower[:, j]
            self.keys.append(keys)
            self.logp.append(np.log(np.maximum(p, 1e-12)).astype(np.float32))
            self.contexts.append(ctx)
            self.weights.append(np.log(np.maximum(weight, 1e-12)).astype(np.float32))

    def log_prob(self, g: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log-probability of the last character of each key, one column a language."""
        at, ok = _find(self.keys[order - 1], g)
        out = self.logp[order - 1][at]
        miss = np.flatnonzero(~ok)
        if len(miss):
            q = g[miss]
            c, known = _find(self.contexts[order - 1], q >> np.uint64(16))
            back = np.where(known[:, None], self.weights[order - 1][c], np.float32(0))
            out[miss] = back + (self.log_prob(q & np.uint64((1 << 16 * (order - 1)) - 1), order - 1) if order > 1
                                else np.float32(self.base))
        return out

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters scored and cross-entropy per character of each text, one column a language."""
        return _entropy(texts, len(self.langs), self.log_prob, CHUNK)


def _entropy(texts: list[str], size: int, log_prob, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``CharModel.entropy`` by ``log_prob``, asked for about ``most`` 4-grams at a time."""
    n, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), size))
    parts, docs, held = [], [], 0

    def flush():
        d = np.repeat(docs, [len(p) for p in parts])
        lp = log_prob(np.concatenate(parts))
        for j in range(size):
            total[:, j] -= np.bincount(d, weights=lp[:, j], minlength=len(texts))

    for i, t in enumerate(texts):
        x = normal(t) if t else ()
        n[i] = max(len(x) - 3, 0)
        for a in range(0, n[i], CHUNK):
            parts.append(grams(x[a:a + CHUNK + 3]))
            docs.append(i)
            held += len(parts[-1])
            if held >= most:
                flush()
                parts, docs, held = [], [], 0
    if parts:
        flush()
    return n, total / np.maximum(n, 1)[:, None]


class Blocks:
    """The whole model as broadcast ``CharModel`` blocks; block ``i`` has the third letters from ``starts[i]`` on."""

    def __init__(self, langs: list[str], starts: list[int], blocks: list):
        self.langs, self.starts, self.blocks = langs, np.array(starts, np.uint64), blocks

    def _block(self, i: int) -> CharModel:
        block = self.blocks[i]
        model = block.value
        if len(self.blocks) > 1 and getattr(block, "_path", None):
            block.__dict__.pop("_value", None)  # read again when needed: one block at a time in memory
        return model

    def log_prob(self, g: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.starts, g >> np.uint64(16) & np.uint64(0xFFFF), "right") - 1
        out = np.empty((len(g), len(self.langs)), np.float32)
        for i in np.unique(at):
            here = np.flatnonzero(at == i)
            model = self._block(i)
            for a in range(0, len(here), CHUNK):
                out[here[a:a + CHUNK]] = model.log_prob(g[here[a:a + CHUNK]])
            del model
        return out

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.blocks) == 1:
            return self._block(0).entropy(texts)
        return _entropy(texts, len(self.langs), self.log_prob, max(CHUNK, (1 << 22) // len(self.langs)))


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _per_lang(langs: list[str], counts: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and counts of each language."""
    got = counts.select("lang", "gram", "n").toArrow()
    lang = np.array(got.column("lang").to_pylist(), dtype=object)
    gram, n = got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy()
    per = {}
    for x in langs:
        own = np.flatnonzero(lang == x)
        own = own[np.argsort(gram[own])]
        per[x] = (gram[own], n[own])
    return per


def train(docs: DataFrame, most: int | None = None) -> Blocks | None:
    """Model of all labelled texts that are not held out, in blocks of about ``most`` (language, 4-gram) pairs
    (of fewer with more than eight languages, as the tables have a column a language)."""
    spark = docs.sparkSession
    for_python(spark)
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = saved(rows.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram")
                   .agg(F.sum("n").alias("n")), "grams")

    def ones_twos(table: DataFrame) -> dict[str, tuple]:
        return {r.lang: (r.a, r.b) for r in table.groupBy("lang").agg(
            F.count_if(F.col("n") == 1).alias("a"), F.count_if(F.col("n") == 2).alias("b")).collect()}

    top = ones_twos(counts)
    if not top:
        return None
    langs = sorted(top)
    third = F.shiftrightunsigned("gram", 16).bitwiseAND(F.lit(0xFFFF).cast("long"))
    limit = (MAX_GRAMS if most is None else most) * 8 // max(8, len(langs))
    starts, size = [0], 0
    for r in sorted(counts.groupBy(third.alias("x")).agg(F.count("*").alias("k")).collect()):
        if size and size + r.k > limit:
            starts.append(r.x)
            size = 0
        size += r.k
    if len(starts) == 1:
        return Blocks(langs, starts, [spark.sparkContext.broadcast(CharModel(_per_lang(langs, counts), top))])
    lower, level = {x: [] for x in langs}, counts
    for k in range(1, ORDER):  # distinct left contexts of the shorter n-grams, over all blocks
        level = saved(level.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 16 * (ORDER - k)) - 1).cast("long"))
                                    .alias("gram")).agg(F.count("*").alias("n")), "grams")
        for x, found in ones_twos(level).items():
            lower[x].append(found)
    letters = _per_lang(langs, level)
    whole = {x: (letters[x], *lower[x]) for x in langs}
    blocks = [spark.sparkContext.broadcast(CharModel(_per_lang(langs, counts.where(third.between(lo, hi - 1))), top, whole))
              for lo, hi in zip(starts, [*starts[1:], 1 << 16])]
    return Blocks(langs, starts, blocks)


def _scores(model: Blocks | None, texts: list[str]) -> list[pa.Array]:
    """Language, score, letters scored and cross-entropy of each text."""
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    n, best = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    if model is not None:
        n, h = model.entropy(texts)
        pick = h.argmin(axis=1)
        best = h[np.arange(len(texts)), pick]
        share = 1 / np.exp(-(h - best[:, None]) * np.minimum(n, 100)[:, None]).sum(axis=1)
        for i in np.flatnonzero(n):
            lang[i] = model.langs[pick[i]]
        score = np.where(n > 0, share, 0.0)
    return [pa.array(lang, pa.string()), pa.array(score), pa.array(n), pa.array(best)]


def _scored(docs: DataFrame, model: Blocks | None, column: str = "text") -> DataFrame:
    """``docs``, all columns, with ``_lang, _score, _n, _entropy`` of their text."""
    added = [("_lang", T.StringType()), ("_score", T.DoubleType()), ("_n", T.LongType()), ("_entropy", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bytescan.slices(batches, column):
            yield pa.RecordBatch.from_arrays([*b.columns, *_scores(model, b.column(column).to_pylist())],
                                             names=[*b.schema.names, *(c for c, _ in added)])
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in added)])
    return docs.mapInArrow(run, schema)


def _calibration(scored: DataFrame) -> list[tuple[str, int, int, float, float]]:
    """Per language and length class (powers of two): number, mean and variance of the cross-entropy of all rightly
    predicted training texts among ``scored`` (with the columns ``_label``, null where a row does not train)."""
    return [tuple(r) for r in scored.where("_n > 0 AND _lang = _label").groupBy("_lang", F.length(F.bin("_n")).alias("c"))
            .agg(F.count("*"), F.avg("_entropy"), F.var_pop("_entropy")).collect()]


def limits(stats: list[tuple[str, int, int, float, float]], langs: list[str]) -> dict[tuple[str, int], tuple[float, float]]:
    """Mean and deviation for every language and length class."""
    def pooled(rows):
        k = sum(r[2] for r in rows)
        mean = sum(r[2] * r[3] for r in rows) / k
        return mean, (sum(r[2] * (r[4] + (r[3] - mean) ** 2) for r in rows) / k) ** 0.5

    out = {}
    for lang in langs if stats else ():
        own = {r[1]: r for r in stats if r[0] == lang}
        mean, sd = pooled(own.values() if sum(r[2] for r in own.values()) >= EVIDENCE else stats)
        for c in range(1, 64):
            r = own.get(c)
            out[lang, c] = (max(r[3], mean), max(r[4] ** 0.5, sd)) if r and r[2] >= EVIDENCE else (mean, sd)
    return out


def _judged(scored: DataFrame, model: Blocks | None, z: float) -> DataFrame:
    """``scored`` with ``_bad``: without letters, or above the limit of the language and length class."""
    bounds = limits(_calibration(scored), model.langs) if model else {}
    bounds = local_rows(scored.sparkSession, [(x, c, m + max(z * sd, MARGIN)) for (x, c), (m, sd) in bounds.items()],
                        "_of string, _class int, _limit double")
    return scored.join(F.broadcast(bounds), (F.col("_lang") == F.col("_of")) & (F.length(F.bin("_n")) == F.col("_class")),
                       "left").withColumn("_bad", (F.col("_n") == 0) | F.coalesce(F.col("_entropy") > F.col("_limit"), F.lit(False)))


def _label():
    return F.when(F.col("doc_id").isNotNull() & ~held_out(), F.col("lang").cast("string"))


def identify(docs: DataFrame, z: float = 12.0) -> DataFrame:
    """Per document: ``doc_id, held_out, lang_pred, score, rejected``."""
    model = train(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), _label().alias("_label"),
                       F.col("text").cast("string").alias("text"))
    scored = saved(_scored(rows, model).drop("text"), "scored")
    return _judged(scored, model, z).select("doc_id", "held_out", F.col("_lang").alias("lang_pred"),
                                            F.col("_score").alias("score"), F.col("_bad").alias("rejected"))


def keep_identified(docs: DataFrame, z: float = 12.0) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not rejected.

    Only scores are stored; the rejected texts' hashes come back as a table of known size."""
    columns = docs.columns
    model = train(docs)
    docs, back = hidden(docs, ["_text", "_bad"])
    text = F.col("text").cast("string")
    rows = docs.select(_label().alias("_label"), F.md5(text).alias("_text"), text.alias("text"))
    scored = saved(_scored(rows, model).drop("text"), "scored")
    bad = saved(_judged(scored, model, z).where("_bad").select(F.col("_text").alias("_bad")).distinct(), "rejected")
    kept = docs.withColumn("_text", F.md5(text)).join(bad, F.col("_text").eqNullSafe(F.col("_bad")), "left_anti")
    return kept.select(*docs.columns).withColumnsRenamed(back).select(*columns)
