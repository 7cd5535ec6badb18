"""A JSON document read in byte ranges against Python's json."""

import json
import os
import random

import pytest

from evalcrate.operators import qa as Q
from evalcrate.sources.json_document import scan_json_document


def document(n, seed):
    rng = random.Random(seed)
    nasty = ['}', '{', '"', '\\', '}}{{', '\\"}', 'é}', '[', ']', 'plain', '\n', '", "x": {"', '\\\\', '']
    out = {}
    for i in range(n):
        out[f"p{i}" + rng.choice(["", "}", '"', "\\"])] = {"t": "".join(rng.choice(nasty) for _ in range(rng.randrange(30))),
                                                          "xs": [rng.choice(nasty) for _ in range(rng.randrange(4))],
                                                          "o": {"d": {"e": rng.choice(nasty)}}, "n": None if i % 3 else i}
    return out


SCHEMA = "struct<t: string, xs: array<string>, o: struct<d: struct<e: string>>, n: int>"


@pytest.mark.parametrize("piece", ["64m", "700b", "97b"])
@pytest.mark.parametrize("indent", [None, 2])
def test_ranges_equal_json(spark, tmp_path, piece, indent):
    docs = [document(60, 1), document(1, 2), {}]
    for i, d in enumerate(docs):
        (tmp_path / f"d{i}.json").write_text(json.dumps(d, indent=indent, ensure_ascii=i == 0) + ("\n" if i else ""))
    two = [document(9, 5), {k + "'": v for k, v in document(7, 6).items()}]
    two = [{f"{k}+": v for k, v in d.items()} for d in two]
    (tmp_path / "two.json").write_text("\n".join(json.dumps(d, indent=indent) for d in two))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", piece)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        df = scan_json_document(spark, str(tmp_path), SCHEMA)
        got = {r.key: r.value.asDict(True) for r in df.collect()}
        assert df.count() == 77
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == docs[0] | docs[1] | two[0] | two[1]


def test_whole_file_equals_lines(spark, tmp_path):
    papers = {f"q{i}": {"qas": [{"question_id": f"q{i}-{j}", "answers": [{"annotation_id": "a", "answer": {
        "unanswerable": False, "extractive_spans": ["s {", "} t"], "free_form_answer": "", "yes_no": None}}]} for j in range(3)]} for i in range(40)}
    os.makedirs(tmp_path / "whole"), os.makedirs(tmp_path / "lines")
    (tmp_path / "whole" / "d.json").write_text(json.dumps(papers))
    (tmp_path / "lines" / "d.json").write_text("\n".join(json.dumps({k: v}) for k, v in papers.items()))
    rows = [sorted(map(tuple, Q.resolve_references(Q.scan_nested_qa(spark, str(tmp_path / d), whole_file=d == "whole")).collect()))
            for d in ("whole", "lines")]
    assert rows[0] == rows[1] and len(rows[0]) == 120
