"""License notices by diagonal voting: planted notices, and base places against a plain scan."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from evalcrate.llm import licenses as L

DOC = "doc_id long, text string"


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_base(text):
    w = plain_words(text)
    places = [(i, label) for label, phrase in L.PHRASES for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    return (len(w), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
            ",".join(sorted({label for _, label in places})))


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, DOC).withColumns({n: F.lit("x") for n in ("key", "w", "p", "h2", "at3", "template", "island")})
    return L.scan_licenses(df, **kw)


def test_base_places_and_edges(spark):
    rng = random.Random(12)
    bits = ["CC", "by", "cc-by", "General", "public", "license", "all", "rights", "reserved", "é", "x9", ",", "İ"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 3, 10, 60])))) for i in range(300)]
    rows += [(None, "All rights reserved, all RIGHTS reserved"), (None, "cc by"), (None, None), (400, ""), (401, "cc"),
             (402, "word " * 300_000 + "cc by cc by"), rows[7], rows[7], (7, "another text, cc by")]
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in run(spark, rows).collect())
    assert got == Counter((d, *plain_base(t)) for d, t in rows)
    assert L.scan_licenses(spark.createDataFrame([], DOC)).collect() == []


def test_notices(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    bsd = dict(L.NOTICES)["bsd"]
    cases = {
        1: ("Some text. " + gpl, "gpl", 1.0),
        2: ("Released under the MIT License.", "mit", 1.0),
        3: ("licensed under CC BY-NC 4.0", "cc-by,cc-by-nc", 1.0),
        4: (bsd.replace("binary forms", "compiled binary forms"), "bsd", 1.0),          # an inserted word
        5: (bsd.replace("source and binary ", ""), "bsd", 18 / 21),                      # missing words
        6: (" ".join(bsd.split()[:9]), "", 0.0),                                          # less than half
        7: ("the software is licensed under an agreement", "", 0.0),
        8: ("licensed under the licensed under the Apache License, version 2.0", "apache", 1.0),
    }
    rows = [(i, "start here. " * i + text) for i, (text, _, _) in cases.items()]
    for r in run(spark, rows).collect():
        assert r.labels == cases[r.doc_id][1], r
        assert abs(r.score - cases[r.doc_id][2]) < 1e-9, r
    spans = {(r.doc_id, r.label): (r.first_word, r.last_word) for r in L.license_spans(spark.createDataFrame(rows, DOC)).where("NOT base").collect()}
    assert spans[2, "mit"] == (4, 8) and spans[4, "bsd"] == (8, 8 + 21)


def test_own_templates_and_plan(spark):
    rows = [(1, "one two"), (2, "one two three four five"), (3, "two one")]
    got = {r.doc_id: (r.n_base, r.labels) for r in run(spark, rows, phrases=(("a", "one two"),), notices=(("b", "two three four five"),)).collect()}
    assert got == {1: (1, "a"), 2: (1, "a,b"), 3: (0, "")}
    plan = run(spark, rows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
