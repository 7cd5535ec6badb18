"""Portable SQL of the derived evaluation tables (FIXTURES.md part B), for the oracle."""

from __future__ import annotations

FIXTURE_SQL = {
    "text_pairs": """
SELECT conv_id * 100 + turn AS id,
       CASE conv_id % 10 WHEN 0 THEN 'The ' || nxt || '!' WHEN 1 THEN 'the.' WHEN 2 THEN 'An' ELSE text END AS pred,
       CASE conv_id % 10 WHEN 2 THEN '!' ELSE nxt END AS ref
FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt
      FROM conversations) q
WHERE nxt IS NOT NULL""",
    "em_preds": """
SELECT doc_id AS id,
       CASE WHEN toxic = 1 THEN 'y' ELSE 'n' END AS truth_text,
       CASE doc_id % 7 WHEN 0 THEN 'y' WHEN 1 THEN 'n' WHEN 2 THEN 'Y.'
            WHEN 3 THEN 'The answer: n' WHEN 4 THEN 'Yes, the same' WHEN 5 THEN 'unsure'
            ELSE CASE WHEN toxic = 1 THEN 'y' ELSE 'n' END END AS response
FROM labels""",
    "class3": """
SELECT o_orderkey AS id,
       CASE o_orderstatus WHEN 'F' THEN 'SUPPORTS' WHEN 'O' THEN 'REFUTES' ELSE 'NOT_ENOUGH_INFO' END AS gold,
       CASE WHEN o_orderkey % 11 = 0 THEN 'MAYBE' WHEN o_orderkey % 5 = 0 THEN 'SUPPORTS'
            WHEN o_orderkey % 7 = 0 THEN 'REFUTES'
            ELSE CASE o_orderstatus WHEN 'F' THEN 'SUPPORTS' WHEN 'O' THEN 'REFUTES' ELSE 'NOT_ENOUGH_INFO' END END AS pred
FROM orders""",
    "toxic_groups": """
SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'Y' ELSE 'N' END AS label,
       CASE doc_id % 3 WHEN 0 THEN 'Yes, it is' WHEN 1 THEN 'no' ELSE 'I would say yes' END AS response,
       CAST(doc_id % 10 AS DOUBLE) / 10 AS male, CAST(doc_id % 7 AS DOUBLE) / 7 AS female
FROM labels""",
    "multi_ref_gold": """
SELECT conv_id AS question_id, turn AS ref_pos, text AS answer,
       CASE turn % 4 WHEN 0 THEN 'extractive' WHEN 1 THEN 'abstractive' WHEN 2 THEN 'boolean' ELSE 'none' END AS type
FROM conversations WHERE role = 'assistant'""",
    "multi_ref_pred": """
SELECT conv_id AS question_id,
       CASE WHEN conv_id % 5 = 0 THEN 'Unanswerable.</s>' WHEN conv_id % 5 = 1 THEN 'Yes, sure' ELSE text END AS prediction
FROM conversations WHERE turn = 0 AND conv_id % 9 <> 0""",
    "record_pairs": """
SELECT a.c_custkey AS id, a.c_name AS left_name, b.c_name AS right_name,
       a.c_mktsegment AS left_segment,
       CASE WHEN b.c_custkey % 3 = 0 THEN NULL ELSE b.c_mktsegment END AS right_segment,
       CASE WHEN a.c_nationkey = b.c_nationkey THEN 'y' ELSE 'n' END AS overall_label
FROM customer a JOIN customer b ON a.c_custkey + 1 = b.c_custkey""",
    "run_events": """
SELECT event_type AS model, user_id % 4 AS shots, event_id AS id, ts,
       CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS gold,
       CASE WHEN event_id % 5 < 2 THEN 1 ELSE 0 END AS pred
FROM events""",
    "token_vectors": """
SELECT CAST(floor(vec_id / 128) AS BIGINT) * 1000 + label AS pair_id, vec_id, CASE WHEN vec_id % 2 = 0 THEN 'pred' ELSE 'ref' END AS side, embedding
FROM embeddings""",
}


def with_fixtures(*names: str, extra: str = "") -> str:
    """``WITH name AS (...), ...`` prefix; ``extra`` appends more CTEs."""
    parts = [f"{n} AS ({FIXTURE_SQL[n]})" for n in names]
    if extra:
        parts.append(extra)
    return "WITH " + ",\n".join(parts) + "\n"

FIXTURE_SQL["dialogues"] = """
SELECT a.conv_id * 100 + a.turn AS id, a.text AS dialogue, 'turn ' || CAST(a.turn AS VARCHAR) AS section_header,
       b.text AS section_text
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
WHERE a.role = 'user'"""

FIXTURE_SQL["mc_questions"] = """
SELECT p_partkey AS id,
       'Which description fits ' || p_name || '? {A: ' || p_brand || ', B: ' || p_type || ', C: size '
         || CAST(p_size AS VARCHAR) || ', D: ' || p_name || '}' AS question,
       CASE p_partkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN ' B ' WHEN 2 THEN p_type WHEN 3 THEN 'I think C) is right'
            WHEN 4 THEN 'maybe ' || p_name || ' or so' ELSE 'none of these' END AS target
FROM part"""
