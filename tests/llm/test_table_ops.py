"""Checks of sharding, mixing, URL filter, HTML extraction, revisits, top-k search and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from evalcrate.llm import hamming, html, mixing, shards, urls, warc

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame(rows, DOC).withColumns({"shard": F.lit("a"), "_crc": F.lit(1), "_size": F.lit("b"),
                                                         "size": F.lit(9), "_copies": F.lit(4), "salt": F.lit(5)})


def sample_docs(n=600, hot=200):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["aa", "bbb", "cé", "dddd"]) for _ in range(rng.choice([0, 1, 5, 30, 200]))), "en",
             rng.choice(["s1", "s1", "s2", "s3", None, "é"]), 0) for i in range(n)]
    rows += [(10_000 + i, "the same text " * 5, "en", "s1", 0) for i in range(hot)]
    rows += [(20_000, None, None, None, None), (None, "no id", "en", "s2", 1), (None, None, "en", "s2", 1), rows[5]]
    return rows


@pytest.mark.parametrize("cell_rows", [100_000, 20])
def test_histogram_shards(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(shards, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(shards, "HOT_TEXTS", 40)
    rows = sample_docs()
    df = frame(spark, rows)
    out = shards.histogram_shards(df, shards=8)
    assert set(out.columns) == set(df.columns) | {"text_crc32", "law", "slot", "grown_shard"}
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    by, size_of = defaultdict(list), defaultdict(int)
    for r in got:
        data = (r.text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)
        by[r.shard].append(r)
        size_of[r.shard] += r["size"]
    assert set(by) <= set(range(8))
    total = sum(size_of.values())
    largest = max(r["size"] for r in got)
    assert all(abs(size_of[s] - total / 8) <= 2 * 0.005 * total / 8 + largest for s in range(8))
    last = None
    for s in sorted(by):
        group = sorted(by[s], key=lambda r: r.slot)
        assert [r.slot for r in group] == list(range(len(group)))
        for r in group:  # sorted over all shards
            key = (r.text_crc32, -(1 << 63) if r.doc_id is None else r.doc_id)
            assert last is None or last <= key
            last = key
    again = shards.histogram_shards(df.repartition(3), shards=8).collect()
    assert sorted((str(r.doc_id), r.shard) for r in again) == sorted((str(r.doc_id), r.shard) for r in got)


def test_histogram_shards_extremes(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(i, "x", "en", "s", 0) for i in (low, low + 1, -1, 0, 1, high - 1, high, None)]
    got = shards.histogram_shards(spark.createDataFrame(rows, DOC), shards=4).collect()
    assert Counter(r.shard for r in got) == {0: 2, 1: 2, 2: 2, 3: 2}
    assert shards.histogram_shards(spark.createDataFrame([], DOC), shards=4).collect() == []
    one = shards.histogram_shards(spark.createDataFrame(rows[:1], DOC), shards=4).collect()
    assert [r.slot for r in one] == [0]


def test_source_targets():
    got = mixing.source_targets([("b", 100), ("a", 10), (None, 1000)])
    # a (weight 3) is full at 20; b (weight 1) and null (weight 2) share the rest; b is full at 200
    assert got == {"a": 20.0, "b": 200.0, None: 1.5 * 1110 - 220}
    assert mixing.source_targets([("a", 0), ("b", 6)]) == {"a": 0.0, "b": 9.0}
    assert mixing.source_targets([]) == {}


def test_mix_meets_targets(spark):
    rows = sample_docs(900, 300)
    df = frame(spark, rows)
    got = mixing.mix_sources(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    targets = mixing.source_targets(list(sizes.items()))
    source = {(r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))): r[3] for r in rows}
    taken = Counter()
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s])
        assert 0 <= r.taken <= 2 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(5, 0.002 * targets[s])
    again = mixing.mix_sources(df.repartition(5)).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns
    assert Counter(r.doc_id for r in mixed.collect() if r.text and r.doc_id is not None) == +Counter(
        {d: sum(r.taken // r["size"] for r in got if r.doc_id == d) for d in {r.doc_id for r in got if r["size"] and r.doc_id is not None}})
    assert mixing.mix_sources(spark.createDataFrame([], DOC)).collect() == []
    assert [r.taken for r in mixing.mix_sources(frame(spark, [(1, None, "en", "s", 0)])).collect()] == [0]


def test_url_rules_and_hosts(spark):
    cases = {
        "http://A.Example.ORG/es/x?q": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/12#f": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "x://b.com/fr/": ("b.com", "/fr/", "com/fr/", "allow"),
        "x://b.com/de/1": ("b.com", "/de/1", "com/de/", "block"),
        "x://b.com/fr": ("b.com", "/fr", None, None),
        "http://org?x=/y": ("org", "", None, None),
        "http://É.Net/a": ("É.net", "/a", None, None),
        "no scheme": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None), "a://": ("", "", None, None),
        "http://u@h.co.uk:80/p/": ("u@h.co.uk:80", "/p/", None, None),
    }
    rows = [(i, u, "h") for i, u in enumerate(cases)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string").withColumn("n", F.lit(1))
    got = {r.page_id: r for r in urls.filter_urls(df).collect()}
    assert len(got) == len(cases)
    for i, want in enumerate(cases.values()):
        r = got[i]
        assert (r.host, r.path, r.rule) == want[:3]
        assert r.verdict == want[3] if want[3] else r.verdict in ("allow", "block")
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_reputation_shrinks_towards_parents(spark):
    rows = [(f"h{i}.bad.example", 1) for i in range(5) for _ in range(30)] + [(f"h{i}.good.example", 0) for i in range(5) for _ in range(30)]
    rows += [("new.bad.example", None), ("new.good.example", None), ("mixed.bad.example", 0)]
    got = {r.host: r for r in urls.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["h0.bad.example"]["mean"] > got["mixed.bad.example"]["mean"] > got["new.good.example"]["mean"]
    assert got["new.bad.example"]["mean"] > 0.8 and got["new.good.example"]["mean"] < 0.2
    assert got["new.bad.example"]["sd"] > got["h0.bad.example"]["sd"]


PAGES = {
    "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href='/'>Home</a></nav>"
    "<article><h1>Head &amp; more</h1><p>One\n  two<br>three &lt;b&gt;</p><script>var a='</p>';</script><p><b>Four<p>Five"
    "<div class='ad'>Buy now</div><aside>Side</aside><form><p>Name</p><input></form>"
    "<section id='comments'><p>First!</p></section><footer>by me</footer></article><footer>&copy; x</footer></body></html>":
        "Head & more\n\nOne two three <b>\n\nFour\n\nFive",
    "<article><p>a<!-- no --> b</p>\n\n<p>&#233;&nbsp;x</p><p> </p></article>": "a b\n\né x",
    "<body><div class='sidebar'><p>no</p></div><main><p>yes</p><ul><li>item one</li><li>item two</li></ul></main></body>": "yes\n\nitem one\n\nitem two",
    "<article><p>kept<script>never closed": "kept",
    "<body class='no-comments'><div class='page with-sidebar'><nav>n</nav><article><p>In</p><div class='ad'>x</div></article></div>": "In",
    "<article><p>In</p></article><div class='sidebar'><article><p>Teaser</p></article></div>": "In",
    "<article><p title=x\">One</p><div class='notice'>Read this</div><p>Two 3 < 4 <em>it's</em></p><p>cut <a href=\"/y": "One\n\nTwo 3 < 4 it's\n\ncut",
    "<article><p>Text</p></article><div class='cookie-notice'>We use cookies</div>": "Text",
    "<article><p>Text with <a href='/x'>a link</a> in it</p><p><a href='/y'>Read more</a></p></article>": "Text with a link in it",
    "": "", None: "", "<nav>only</nav>": "", "plain": "",
}


def test_main_text():
    for page, text in PAGES.items():
        assert html.main_text(page)[0] == text


def test_main_text_after_open_head_and_empty_svg():
    for page, text in {
        "<html><head><title>x</title><body><article><p>One</p></article></body>": "One",
        "<html><head><title>x</title><meta charset=utf-8><article><p>One</p></article>": "One",
        "<html><head><style>p{}</style><template><div>no</div></template><script>1</script><article><p>One</p></article>": "One",
        "<head><title>x</title></head><body><article><p>One</p></article>": "One",
        "<head><template><p>no</p><body><article><p>One</p></article>": "One",
        "<article><svg class='a'/><p>One</p><math/><p>Two</p></article>": "One\n\nTwo",
        "<article><p>One</p><svg viewBox='0 0 1 1'><path d='M0'/><text>no</text></svg><p>Two</p></article>": "One\n\nTwo",
        "<article><svg width=1/><text>no</text></svg><p>One</p></article>": "One",
    }.items():
        assert html.main_text(page)[0] == text


def test_main_text_without_article_marks():
    good = "The reason for this is that all of the people in the house were on the road when the rain came. " * 4
    page = (f"<body><div><a href='/a'>One</a> <a href='/b'>Two</a></div><h2>A heading</h2><p>{good}</p><p>Short one.</p><p>{good}</p>"
            "<div>© 2020 All rights of the owners are reserved by the people who own it and who made it what it is</div></body>")
    assert html.main_text(page)[0] == "\n\n".join(["A heading", good.strip(), "Short one.", good.strip()])


ITALIAN = ("Ogni mattina il vecchio pescatore scendeva verso il porto per guardare quelle barche che tornavano cariche di pesce, "
           "mentre tutti i bambini correvano lungo la spiaggia e le donne aprivano finestre delle case bianche. ")
POLISH = ("Każdego ranka stary rybak schodził do portu, aby patrzeć na łodzie wracające pełne ryb, podczas gdy dzieci biegały "
          "po plaży, a kobiety otwierały okna domów i rozmawiały o pogodzie, o morzu i o tym, że zima nadchodzi. ")
RUSSIAN = ("Каждое утро старый рыбак спускался в порт смотреть на лодки, которые возвращались полные рыбы, пока дети бегали по "
           "пляжу, а женщины открывали окна домов и говорили о погоде, о море и о том, что зима уже близко. ")
CHINESE = "每天早上老渔夫都会走到港口看着满载鱼儿归来的船只，孩子们在沙滩上奔跑，妇女们打开房子的窗户。"


def test_main_text_without_marks_in_other_languages():
    for text in (ITALIAN, POLISH, RUSSIAN, CHINESE * 3):
        page = (f"<body><div><a href='/a'>One</a> <a href='/b'>Two</a></div><h2>{text[:20]}</h2><p>{text * 2}</p>"
                f"<p>{text[:30]} <a href='/x'>{text[4:8]}</a></p><p>{text * 3}</p></body>")
        want = [text[:20], text * 2, f"{text[:30]} {text[4:8]}", text * 3]
        assert html.main_text(page)[0] == "\n\n".join(" ".join(w.split()) for w in want)
    good = "The reason for this is that all of the people in the house were on the road when the © sign came. " * 4
    assert html.main_text(f"<body><p>{good}</p></body>")[0] == good.strip()


def test_frequent_words_come_from_the_pages(spark):
    rng = random.Random(11)
    rare = ["".join(rng.choice("bcdfgłmnprst") + rng.choice("aeiouy") for _ in range(4)) for _ in range(3000)]
    common = ["się", "nie", "że", "jest", "przez", "oraz"]

    def text(n, words=common):
        return " ".join(rng.choice(words) if rng.random() < 0.4 else rng.choice(rare) for _ in range(n))

    rows = [(i, "u", f"<html lang='pl'><body><article><p>{text(120)}</p></article></body></html>") for i in range(80)]
    good, junk = text(80), text(60, rare)
    page = f"<body><p>{good}</p><p>{text(50)}</p><p>{good}</p><p>{good}</p><div>{junk}</div></body></html>"
    rows += [(900, "u", "<html lang='pl'>" + page), (901, "u", "<html lang='xx'>" + page)]
    got = {r.page_id: r for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 82 and all(got[i].n_kept == 1 for i in range(80))
    assert got[900].n_kept == 4 and junk not in got[900].text  # the derived list tells running text from junk
    assert got[901].n_kept == 5  # no list: length decides
    lists = html.frequent_words(spark.createDataFrame([("pl", r.text) for r in got.values()], "lang string, text string"))
    assert set(lists) == {"pl"} and set(common) <= lists["pl"] and len(lists["pl"]) <= 500


def test_extract_pages(spark):
    rows = [(i, f"u{i}", h, "x") for i, h in enumerate(PAGES)] + [(0, None, "<article><p>w</p></article>" + " " * 100_000, "y")]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert Counter((r.page_id, r.url, r.text, r.n_chars) for r in got) == Counter(
        [(i, f"u{i}", t, len(t)) for i, t in enumerate(PAGES.values())] + [(0, None, "w", 1)])
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_canonical_urls(spark):
    cases = {"HTTP://User@Ex.COM:80/a/index.html?b=2&utm_source=x&a=1#f": "ex.com/a?a=1&b=2", "https://ex.com/": "ex.com",
             "https://ex.com:8080/A/?ref=1": "ex.com:8080/A", "": "", None: ""}
    df = spark.createDataFrame([(u,) for u in cases], "u string").select(warc.canonical_url(F.col("u")).alias("c"))
    assert [r.c for r in df.collect()] == list(cases.values())


def test_revisits(spark, monkeypatch):
    monkeypatch.setattr(warc, "BUCKET_ROWS", 7)
    rng = random.Random(2)
    rows = []
    for i in range(300):
        full = rng.random() < 0.3
        url = "http://hot.example/" if rng.random() < 0.5 else f"http://h{rng.randrange(9)}.example/"
        rows.append((i, rng.randrange(60), url, "response" if full else "revisit", rng.choice(["a", "b", None]) and rng.choice(
            ["", "W/"]) + rng.choice("ab"), rng.choice(["m1", "m2", None]), {"ETag": "t", "Server": f"s{i}", "Date": f"d{i}"}, f"p{i}" if full else None))
    rows += [(900, None, "http://hot.example/", "revisit", "a", None, None, None), (901, 50, None, "revisit", "a", None, {}, None),
             (902, 50, "http://hot.example/", "request", None, None, None, None)]
    schema = ("record_id long, ts long, url string, type string, etag string, last_modified string, headers map<string,string>, "
              "payload string")
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, schema).withColumn("bucket", F.lit(1))).collect()}
    assert set(got) == {r[0] for r in rows if r[3] == "revisit"}
    for r in rows:
        if r[3] != "revisit":
            continue
        past = [x for x in rows if x[3] == "response" and x[2] == r[2] and r[1] is not None and r[2] and x[1] < r[1]]
        m = max(past, key=lambda x: (x[1], x[0]), default=None)
        def tag(x):
            return x[4].removeprefix("W/") if x[4] is not None else None
        if not m:
            want = "no_response"
        elif tag(r) is not None and tag(m) is not None:
            want = "resolved" if tag(r) == tag(m) else "mismatch"
        elif r[5] and m[5]:
            want = "resolved" if r[5] == m[5] else "mismatch"
        else:
            want = "no_validator"
        g = got[r[0]]
        assert g.result == want
        if want == "resolved":
            assert (g.matched_id, g.payload) == (m[0], m[7])
            assert g.headers == {"etag": "t", "server": f"s{m[0]}", "date": f"d{r[0]}"}
        else:
            assert g.matched_id is None and g.payload is None
    assert warc.resolve_revisits(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("block,queries,dims", [(100_000, 20_000, 64), (60, 10, 64), (100_000, 20_000, 100)])
def test_exact_topk(spark, block, queries, dims, monkeypatch):
    monkeypatch.setattr(hamming, "BLOCK", block)
    monkeypatch.setattr(hamming, "QUERIES", queries)
    rng = random.Random(6)
    vectors = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(200)]
    vectors += [vectors[3]] * 120 + [[-x for x in vectors[3]], [None] * dims, [], [0.5] * 3]
    rows = [(i, v, 1) for i, v in enumerate(vectors)] + [(900, None, 1), (None, vectors[0], 1), (3, vectors[3], 2)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                           T.StructField("code", T.IntegerType())])
    df = spark.createDataFrame(rows, schema)
    got = defaultdict(list)
    for r in hamming.exact_topk(df, df.where("vec_id % 20 = 0"), k=10).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.distance))
    bits = [(i, tuple((x or 0) > 0 for x in v) + (False,) * (dims - len(v))) for i, v, _ in rows if v is not None and i is not None]
    for q in {i for i, _ in bits if i % 20 == 0}:
        qb = dict(bits)[q]
        near = sorted((sum(a != b for a, b in zip(qb, c)), i) for i, c in bits)[:10]
        assert sorted(got[q]) == [(n + 1, i, d) for n, (d, i) in enumerate(near)]
    empty = df.limit(0)
    assert hamming.exact_topk(empty, empty).collect() == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "12 34", "en", "s", 5)], docs.schema)
    docs = docs.unionByName(extra)
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL).persist()
        if i < 4:
            assert out.columns == columns
            assert out.schema.simpleString() == docs.schema.simpleString()
        if name == "language id":
            gone = docs.join(out, "doc_id", "left_anti").collect()
            assert {9001, 9002, 9003} <= {r.doc_id for r in gone} and len(gone) <= 5
        elif i in (1, 2):
            assert out.count() <= docs.count() and out.join(docs, columns, "left_semi").count() == out.count()
        docs = out
    assert "shard" in docs.columns and docs.select("shard", "slot").distinct().count() == docs.count()


def test_pipeline_empty(spark):
    docs = spark.createDataFrame([], DOC)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.count() == 0
