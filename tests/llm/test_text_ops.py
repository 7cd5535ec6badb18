"""Brute-force checks of the byte scanner, n-gram join, decontamination, token counts and language ID."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalcrate.llm import bytescan, decontam, langid, ngram_join, tokens

SPACE_WORDS = r"[^\x20\x09-\x0D]+"
ALNUM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def words(t, pattern):
    return re.findall(pattern, lower(t)) if t else []


def docs_of(spark, texts, extra=True):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    # columns that operators use themselves
    return df.withColumns({"cid": F.lit("x"), "_cid": F.lit(1), "size": F.lit(2), "shard": F.lit(3), "_text": F.lit("y"),
                           "_size": F.lit(5), "salt": F.lit(6), "rank": F.lit(7)}) if extra else df


def random_text(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.mark.parametrize("table,pattern", [(bytescan.NON_SPACE, SPACE_WORDS), (bytescan.ALNUM, ALNUM_WORDS)])
def test_word_hashes_match_regex(table, pattern, monkeypatch):
    rng = random.Random(5)
    alphabet = "abABz09 \t\n\x0b\x0c\r.-_é日🙂\x00\x7f\xa0"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [None, "", " ", "x" * 500, "ab " * 300, "é" * 200]
    for piece in (1 << 20, 64):
        monkeypatch.setattr(bytescan, "PIECE", piece)
        h, off = bytescan.word_hashes(pa.array(texts).slice(3), table)
        seen = {}
        for i, t in enumerate(texts[3:]):
            w = words(t, pattern)
            assert off[i + 1] - off[i] == len(w)
            for x, y in zip(w, h[off[i]:off[i + 1]].tolist()):
                assert seen.setdefault(x, y) == y
        assert len(set(seen.values())) == len(seen)


def gram_set(t, k=3):
    w = words(t, SPACE_WORDS)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(texts, percent=90):
    sets = [gram_set(t) for t in texts]
    comp = list(range(len(texts)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def near_copy_texts():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "one", "ONE", "two words", "Two  words", "a b c", "a b c", "a b c d"]
    for size in (12, 40, 90, 200):
        base = random_text(rng, size, vocabulary).split()
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                w[rng.randrange(size)] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    passage = random_text(rng, 30, vocabulary)
    texts += [passage + " " + random_text(rng, rng.randint(1, 60), vocabulary) for _ in range(40)]
    texts += [random_text(rng, 50, vocabulary) for _ in range(20)]
    return texts


@pytest.mark.parametrize("tile", [1024, 7])
def test_jaccard_components_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 5)
    monkeypatch.setattr(ngram_join, "TILE_GRAMS", 1 << 20 if tile == 1024 else 2000)
    texts = near_copy_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs_of(spark, texts), tile=tile).collect()}
    assert got == brute_components(texts)


def test_keep_one_keeps_one_of_each_component(spark):
    texts = near_copy_texts()
    df = docs_of(spark, texts)
    kept = ngram_join.keep_one(df.unionByName(df.where("doc_id % 3 = 0")))
    assert kept.columns == df.columns
    want = [i for i, (n, c) in brute_components(texts).items() if n == 0 or c == i]
    ids = sorted(r.doc_id for r in kept.collect())
    twice = [i for i in want if not gram_set(texts[i]) and i % 3 == 0]
    assert ids == sorted(want + twice)


def brute_contamination(texts, items, width=13):
    windows = {}
    for item, t in items:
        w = words(t, ALNUM_WORDS)
        if item is None or not w:
            continue
        for i in range(max(len(w) - width, 0) + 1):
            windows.setdefault(tuple(w[i:i + width]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in enumerate(texts):
        w, hit, named = words(t, ALNUM_WORDS), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                x = windows.get(tuple(w[i:i + k]))
                if x:
                    hit.update(range(i, i + k))
                    named |= x
        sha = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(named), sha, len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("most_windows,most_terms", [(200_000, 4_000_000), (40, 4_000_000), (200_000, 0)])
def test_contamination_brute_force(spark, most_windows, most_terms, monkeypatch):
    monkeypatch.setattr(decontam, "MAX_WINDOWS", most_windows)
    monkeypatch.setattr(decontam, "MAX_TERMS", most_terms)
    monkeypatch.setattr(decontam, "SEGMENT", 3000)
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(60)] + ["été", "日本"]
    items = [(i, random_text(rng, rng.choice([1, 5, 13, 14, 40]), vocabulary)) for i in range(30)]
    items += [(10, items[3][1]), (None, "v1 v2"), (50, ""), (51, None), (52, items[4][1].upper())]
    texts = [None, "", "...", items[2][1]]
    for _ in range(120):
        t = random_text(rng, rng.randint(0, 80), vocabulary)
        if rng.random() < 0.5:
            t += "! " + rng.choice(items[:30])[1].upper() + " " + random_text(rng, rng.randint(0, 300), vocabulary)
        texts.append(t)
    texts += [texts[-1]] * 3
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
           for r in decontam.contamination(docs_of(spark, texts), bench).collect()}
    want = brute_contamination(texts, items)
    assert got == want
    if most_windows == 200_000 and most_terms:
        clean = decontam.keep_clean(docs_of(spark, texts), bench)
        assert sorted(r.doc_id for r in clean.collect()) == [d for d in want if not want[d][4]]


def test_a_long_item_is_spread_over_test_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MAX_WINDOWS", 100)
    sent, windows = [], decontam._windows
    monkeypatch.setattr(decontam, "_windows", lambda rows, *a: sent.append(windows(rows, *a)) or sent[-1])
    long_item = [f"w{i}" for i in range(1012)]
    items = [(1, " ".join(long_item)), (2, "short one"), (3, " ".join(long_item[200:220]))]
    texts = [" ".join(long_item[i:i + 40]) for i in range(0, 1012, 9)] + ["a short one b", "nothing here"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
           for r in decontam.contamination(docs_of(spark, texts), bench).collect()}
    assert got == brute_contamination(texts, items)
    sizes = [len(x[2]) for x in sent]
    assert sum(sizes) >= 1001 and max(sizes) <= 100


def test_proximity_finds_a_phrase_with_a_word_put_in(spark):
    phrase = " ".join(f"p{i}" for i in range(13))
    texts = [phrase, phrase.replace("p6", "p6 extra"), phrase.replace("p6", "other")]
    bench = spark.createDataFrame([(1, phrase)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_near_items) for r in decontam.contamination(docs_of(spark, texts), bench, slop=1).collect()}
    assert got == {0: (13, 1), 1: (0, 1), 2: (0, 0)}


def test_token_counts_match_the_library(spark):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path("piece_bpe_32k.model"))
    rng = random.Random(1)
    parts = ["the", "ing", " ", "  ", "\n", "\t", "é", "日本", "▁", "🙂", "<s>", "</s>", "<0x0A>", "<unk>", "1", "29", "ﬁ", "\x00", "Th", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += ["", " ", "a" * 3000, "the" * 1500, " " * 3000, "word " * 5000, "".join(rng.choice("abcdefgh") for _ in range(5000))]
    df = docs_of(spark, texts + [None])
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(df).collect()}
    want = {i: (len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for i, t in enumerate(texts + [None])}
    assert got == want


def test_token_cache_is_bounded_and_exact(monkeypatch):
    model = tokens.load("piece_bpe_32k.model")
    texts = [f"alpha{i} beta{i}" for i in range(50)]
    want = model.counts(texts)
    monkeypatch.setattr(tokens, "CACHE", 10)
    assert [model.counts([t])[0] for t in texts] == want


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 200 and right / n >= 0.98


def test_language_model_in_blocks_is_the_whole_model(spark, monkeypatch):
    rng = random.Random(8)
    hot, small = [f"{c}{v}{d}" for c in "bdfgklm" for v in "aeiou" for d in "nprst"], ["жар", "мир", "дом", "лес", "сад"]
    rows = [(i, random_text(rng, 30, hot), "hot", "s", 0) for i in range(200)]
    rows += [(1000 + i, random_text(rng, 5, small), "small", "s", 0) for i in range(12)]
    df = spark.createDataFrame(rows, DOC)
    whole = langid.train(df)
    texts = [r[1] for r in rows] + ["жар banana", "zzz", "x 你好 y", None, "мир " * 40_000]
    n, h = whole.entropy(texts)
    for most in (1, 50, 400):
        blocks = langid.train(df, most=most)
        assert len(blocks.blocks) > 1 == len(whole.blocks) and blocks.langs == whole.langs == ["hot", "small"]
        got_n, got = blocks.entropy(texts)
        assert (got_n == n).all() and np.allclose(got, h, rtol=1e-5)
    monkeypatch.setattr(langid, "MAX_GRAMS", 100)
    got = {r.doc_id: r.lang_pred for r in langid.identify(df).collect()}
    assert got == {r[0]: r[2] for r in rows}


def test_language_limits_come_from_all_texts():
    stats = [("a", 8, 1000, 2.0, 0.01), ("a", 3, 29, 4.0, 0.25), ("b", 8, 20, 3.0, 0.04)]
    got = langid.limits(stats, ["a", "b", "c"])

    def pooled(rows):
        k = sum(r[2] for r in rows)
        mean = sum(r[2] * r[3] for r in rows) / k
        return pytest.approx((mean, (sum(r[2] * (r[4] + r[3] ** 2) for r in rows) / k - mean ** 2) ** 0.5))

    assert set(got) == {(x, c) for x in "abc" for c in range(1, 64)}
    mean, sd = got["a", 3]
    assert got["a", 3] == got["a", 60] == pooled(stats[:2])  # too few in the class: as in the language, not wider
    assert got["a", 8] == (max(2.0, mean), max(0.1, sd))
    assert got["b", 8] == got["c", 1] == pooled(stats)  # too few in the language: as in the corpus, never without a limit
    assert langid.limits([], ["a"]) == {}


def test_language_with_few_texts_still_rejects(spark):
    rng = random.Random(9)
    known = ["the", "house", "road", "people", "reason", "water", "other", "under", "garden", "winter"]
    rows = [(i, random_text(rng, 20, known), "en", "s", 0) for i in range(200)]
    rows += [(500 + i, random_text(rng, 20, ["жар", "мир", "дом", "лес", "сад"]), "ru", "s", 0) for i in range(5)]
    rows += [(900 + i, "".join(rng.choice("абвгдежзиклмнопрст ") for _ in range(200)), None, "s", 0) for i in range(10)]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, DOC)).collect()}
    assert all(out[900 + i].lang_pred == "ru" and out[900 + i].rejected for i in range(10))
    assert not any(r.rejected for d, r in out.items() if d < 900)


def test_language_edge_cases(spark):
    rows = [(i, ("the cat of the house and it is", "le chat de la maison et il est")[i % 2] + f" {'abcdefgh'[i % 8]}" * (i % 5),
             ("en", "fr")[i % 2], "s", 0) for i in range(80)]
    rows += [(100, None, "en", "s", 0), (101, "", "fr", "s", 0), (102, "123 !?", "en", "s", 0), (103, "the house", None, "s", 0),
             (None, "la maison", "fr", "s", 0), (104, "the house " * 60_000, None, "s", 0), (104, "the house " * 60_000, None, "s", 0),
             (105, "жшцфщ хъыь " * 50, None, "s", 0)]
    out = langid.identify(spark.createDataFrame(rows, DOC)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert all((by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True) for i in (100, 101, 102))
    assert by[103].lang_pred == by[104].lang_pred == "en" and by[None].lang_pred == "fr"
    assert by[105].rejected and not by[104].rejected
    assert all(0 <= r.score <= 1 for r in out)
    kept = langid.keep_identified(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(r.doc_id or -1 for r in kept) == sorted(r.doc_id or -1 for r in out if not r.rejected)
    none = langid.identify(spark.createDataFrame([(1, "text", None, "s", 0)], DOC)).collect()
    assert none[0].lang_pred == "und"


def test_kneser_ney_probabilities_sum_to_one():
    counts = {}
    for lang, text in (("a", "the cat sat on the mat and the rat"), ("b", "le chat est sur la table et le rat")):
        g = langid.grams(langid.normal(text))
        keys, n = np.unique(g, return_counts=True)
        counts[lang] = (keys, n)
    m = langid.CharModel(counts, {"a": (9, 3), "b": (8, 2)})
    alphabet = sorted({int(k & np.uint64(0xFFFF)) for keys, _ in counts.values() for k in keys})
    for ctx in ("  t", "the", "ch ", "xyz"):
        c = np.array([ord(x) for x in ctx], np.uint64)
        g = np.array([((int(c[0]) << 16 | int(c[1])) << 16 | int(c[2])) << 16 | w for w in alphabet], np.uint64)
        total = np.exp(m.log_prob(g).astype(float)).sum(axis=0)
        assert (total <= 1.0001).all() and (total > 0.9).all()


@pytest.mark.parametrize("apply", [
    lambda d, s: ngram_join.jaccard_components(d), lambda d, s: ngram_join.keep_one(d),
    lambda d, s: decontam.contamination(d, s.createDataFrame([(1, "a b")], "item_id long, text string")),
    lambda d, s: tokens.count_tokens(d), lambda d, s: langid.identify(d), lambda d, s: langid.keep_identified(d)])
def test_empty_tables(spark, apply):
    assert apply(spark.createDataFrame([], DOC), spark).collect() == []


def test_contamination_without_items(spark):
    got = decontam.contamination(docs_of(spark, ["a b c"]), spark.createDataFrame([], "item_id long, text string")).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(3, 0, False)]
