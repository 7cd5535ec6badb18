"""Revisits: repeated records, missing ids, header names, hot responses, and all outcomes on the given pages."""

from collections import Counter

import pytest

from evalcrate.llm import warc

SCHEMA = "record_id long, ts long, url string, type string, etag string, last_modified string, headers map<string,string>, payload string"


def rec(i, ts, kind, headers=None, payload=None, etag="t", url="http://a.example/"):
    return (i, ts, url, kind, etag, None, headers or {}, payload)


@pytest.mark.parametrize("hot", [50_000, 1])
def test_repeated_records_and_ids(spark, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT_ROWS", hot)
    rows = [rec(1, 1, "response", {"Server": "s"}, "p"), rec(2, 5, "revisit", {"Date": "d"}), rec(2, 5, "revisit", {"Date": "d"}),
            rec(1, 1, "response", {"Server": "s"}, "p"), rec(None, 6, "revisit", {"Set-Cookie": "x", "set-cookie": "y", "ETag": "1", "etag": "2"}),
            rec(None, 7, "response", {}, "never", url="http://b.example/"), rec(9, 8, "revisit", url="http://b.example/")]
    got = Counter((r.record_id, r.result, r.matched_id, tuple(sorted((r.headers or {}).items())), r.payload)
                  for r in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == Counter({(2, "resolved", 1, (("date", "d"), ("server", "s")), "p"): 2,
                           (None, "resolved", 1, (("etag", "2"), ("server", "s")), "p"): 1, (9, "no_response", None, (), None): 1})


def test_one_id_for_several_responses(spark):
    rows = [rec(1, 1, "response", {"A": "1"}, "old"), rec(1, 3, "response", {"A": "2"}, "new"), rec(2, 9, "revisit")]
    r, = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (r.matched_id, r.headers, r.payload) == (1, {"a": "2"}, "new")


def test_outcomes_of_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = Counter(r.result for r in warc.resolve_revisits(warc.records_of_pages(pages)).select("result").collect())
    assert set(got) == {"resolved", "mismatch", "no_response", "no_validator"} and sum(got.values()) == pages.count()
