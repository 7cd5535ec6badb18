"""Registered queries of the llm operators and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from evalcrate.llm.conversations import damaged, repair_report
from evalcrate.llm.decontam import contamination
from evalcrate.llm.hamming import exact_topk
from evalcrate.llm.html import extract_pages
from evalcrate.llm.langid import identify
from evalcrate.llm.licenses import COVERED, SLACK, scan_licenses, template_rows
from evalcrate.llm.mixing import mix_sources
from evalcrate.llm.negatives import mine_negatives
from evalcrate.llm.ngram_join import jaccard_components
from evalcrate.llm.shards import histogram_shards
from evalcrate.llm.shared import table
from evalcrate.llm.tokens import count_tokens
from evalcrate.llm.urls import RULES, SECOND_LEVEL, filter_urls
from evalcrate.llm.warc import TRACKING, records_of_pages, resolve_revisits

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return put


# words split at white space, A-Z lower-cased
WORDS = (r"list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
         r" '[\x20\x09-\x0D]+'), lambda x: x <> '')")

NGRAM_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN t IS NULL OR len(t) = 0 THEN [] WHEN len(t) < 3 THEN [array_to_string(t, ' ')]
      ELSE list_distinct(list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' '))) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM x a JOIN x b USING (g) WHERE a.doc_id <> b.doc_id
      GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n a ON u = a.doc_id JOIN n b ON v = b.doc_id WHERE 100 * c >= 90 * (a.n + b.n - c)),
r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(min(r.v), n.doc_id)) AS component_id
FROM n LEFT JOIN r ON r.u = n.doc_id GROUP BY n.doc_id, n
"""


@query("op7_ngram_jaccard", NGRAM_SQL)
def op7(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


# runs of 0-9, a-z and non-ASCII characters, A-Z lower-cased
ALNUM_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
               r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

DECONTAM_SQL = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {ALNUM_WORDS} AS t FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(t), 13) AS k, array_to_string(t[i:i + least(len(t), 13) - 1], ' ') AS w
       FROM (SELECT *, unnest(range(1, greatest(len(t) - 12, 1) + 1)) AS i FROM b WHERE len(t) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
d AS (SELECT doc_id, {ALNUM_WORDS} AS t FROM documents),
dw AS (SELECT doc_id, k, i, array_to_string(t[i:i + k - 1], ' ') AS w
       FROM (SELECT d.doc_id, d.t, ks.k, unnest(range(1, len(d.t) - ks.k + 2)) AS i FROM d, ks WHERE len(d.t) >= ks.k)),
m AS (SELECT dw.doc_id, dw.i, dw.k, bw.item FROM dw JOIN bw USING (k, w)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s
       FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(t) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(t) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@query("op10_decontam", DECONTAM_SQL)
def op10(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_near_items")


@query("op2_histogram_shards")
def op2(spark, sf_dir):
    return histogram_shards(table(spark, sf_dir, "documents"), shards=24).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op5_entropy_mix")
def op5(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


def _url_sql() -> str:
    def strength(t, n, b):
        return f"""(SELECT CASE WHEN N IS NULL OR K = 0 OR K = N OR N - N2 / N - (G - 1) <= 0 THEN 1.0 ELSE
            1 / greatest(0.01, least(0.99, (Q - K * K / N - (K / N) * (1 - K / N) * (G - 1))
            / ((K / N) * (1 - K / N) * (N - N2 / N - (G - 1))))) - 1 END
            FROM (SELECT CAST(sum({n}) AS DOUBLE) AS N, CAST(sum({b}) AS DOUBLE) AS K, CAST(count(*) AS DOUBLE) AS G,
            CAST(sum({n} * {n}) AS DOUBLE) AS N2, sum(CAST({b} AS DOUBLE) * {b} / {n}) AS Q FROM {t} WHERE {n} > 0))"""
    names, verdicts = [], []
    for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"(host = '{h}' OR suffix(host, '.{h}')) AND prefix(path, '{p}')"
        names.append(f"WHEN {fits} THEN '{h}{p}'")
        verdicts.append(f"WHEN {fits} THEN '{v}'")
    second = ", ".join(f"'{x}'" for x in SECOND_LEVEL)
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT *, CASE {' '.join(names)} END AS rule, CASE {' '.join(verdicts)} END AS given FROM h),
a AS (SELECT host, string_split(host, '.') AS p, count(given) AS n, count(*) FILTER (given = 'block') AS bad FROM j GROUP BY host),
b AS (SELECT *, CASE WHEN len(p) >= 3 AND length(p[-1]) = 2 AND p[-2] IN ({second}) THEN 2 ELSE 1 END AS k FROM a),
hosts AS (SELECT host, n, bad, CASE WHEN len(p) >= k THEN array_to_string(p[len(p) - k + 1:], '.') ELSE host END AS sfx,
      CASE WHEN len(p) >= k + 1 THEN array_to_string(p[len(p) - k:], '.') ELSE host END AS dom FROM b),
doms AS (SELECT sfx, dom, sum(n) AS dn, sum(bad) AS db FROM hosts GROUP BY ALL),
sfxs AS (SELECT sfx, sum(dn) AS sn, sum(db) AS sb FROM doms GROUP BY ALL),
w AS (SELECT (CAST(sum(sb) AS DOUBLE) + 1) / (sum(sn) + 2) AS p0, {strength('sfxs', 'sn', 'sb')} AS ms,
      {strength('doms', 'dn', 'db')} AS md, {strength('hosts', 'n', 'bad')} AS mh FROM sfxs),
q AS (SELECT host, n, bad, mh, (db + md * ((sb + ms * p0) / (sn + ms))) / (dn + md) AS pd
      FROM hosts JOIN doms USING (sfx, dom) JOIN sfxs USING (sfx), w),
ab AS (SELECT host, bad + mh * pd AS a, n - bad + mh * (1 - pd) AS b FROM q)
SELECT page_id, j.host, path, rule, coalesce(given, CASE WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5
       THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN ab USING (host)
"""


@query("op6_url_filter", _url_sql())
def op6(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"))


@query("op4_token_counts")
def op4(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), model="piece_bpe_32k.model", limit=4096)


@query("op8_language_id")
def op8(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


@query("op1_html_main_text")
def op1(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


CANONICAL = (r"""(host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END)""")
WARC_SQL = rf"""
WITH g AS (SELECT page_id, url, coalesce(html, '') AS html, ((page_id % 7) + 7) % 7 AS k FROM pages),
r AS (SELECT page_id * 3 AS record_id, page_id AS ts, url, true AS whole, md5(html) AS etag, html AS payload FROM g WHERE coalesce(k <> 1, true)
  UNION ALL SELECT page_id * 3 + 1, page_id + 25, url, true, md5(html || '<!-- 2 -->'), html || '<!-- 2 -->' FROM g WHERE k = 3
  UNION ALL SELECT page_id * 3 + 2, page_id + 50, url || CASE WHEN instr(url, '?') > 0 THEN '&utm_source=again' ELSE '#again' END,
  false, CASE k WHEN 2 THEN md5('outdated') WHEN 3 THEN md5(html || '<!-- 2 -->') WHEN 4 THEN NULL ELSE md5(html) END, NULL FROM g),
s AS (SELECT *, regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '#.*$', '') AS t FROM r),
p AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(t, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', '') AS host,
  regexp_replace(regexp_extract(t, '^[^/?]*([^?]*)', 1), '/(index\.html?)?$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(t, '\?(.*)$', 1), '&'), lambda x: x <> '' AND
  NOT regexp_matches(x, '(?i)^{TRACKING}(=|$)'))), '&') AS q FROM s),
c AS (SELECT record_id, ts, coalesce({CANONICAL}, '') AS canonical_url, whole, etag, payload FROM p),
m AS (SELECT a.record_id, a.ts, a.canonical_url, a.etag, max(struct_pack(ts := b.ts, id := b.record_id, etag := b.etag, payload := b.payload)) AS b
  FROM c a LEFT JOIN c b ON b.whole AND a.canonical_url = b.canonical_url AND a.canonical_url <> '' AND b.ts < a.ts WHERE NOT a.whole
  GROUP BY ALL),
x AS (SELECT *, CASE WHEN b.id IS NULL THEN 'no_response' WHEN etag IS NULL THEN 'no_validator' WHEN etag = b.etag THEN 'resolved' ELSE 'mismatch' END AS result FROM m)
SELECT record_id, ts, canonical_url, result, CASE WHEN result = 'resolved' THEN b.id END AS matched_id,
  CASE WHEN result = 'resolved' THEN 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || b.etag END AS headers,
  CASE WHEN result = 'resolved' THEN md5(b.payload) END AS payload_md5,
  CASE WHEN result = 'resolved' THEN CAST(length(b.payload) AS BIGINT) END AS n_chars FROM x
"""


@query("op3_warc_revisits", WARC_SQL)
def op3(spark, sf_dir):
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e.key, F.lit(": "), e.value))), "\n")
    return resolve_revisits(records_of_pages(table(spark, sf_dir, "pages"))).select(
        "record_id", "ts", "canonical_url", "result", "matched_id", lines.alias("headers"),
        F.md5("payload").alias("payload_md5"), F.length("payload").cast("long").alias("n_chars"))


TOPK_SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: coalesce(x > 0, false)) AS b FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
d AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(len(list_filter(list_zip(q.b, c.b), lambda x: x[1] <> x[2])) AS BIGINT) AS distance
      FROM c q, c WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""


@query("op9_hamming_topk", TOPK_SQL)
def op9(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return exact_topk(rows, rows.where("vec_id % 20 = 0"), k=10)


# CRC-32 of an ASCII string, bit by bit
CRC32 = ("xor(list_reduce(list_transform(string_split({s}, ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda acc, b: "
         "list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))), 4294967295), 4294967295)")


def _repair_sql() -> str:
    """One fold over a conversation's rows that carries the least (cost, audit, repaired text) of every state."""
    dead = "struct_pack(c := 999999999, a := '', r := '')"

    def least(*ways):
        return f"list_sort([{', '.join(ways)}])[1]"

    def step(s, cost, edit, line):
        return (f"struct_pack(c := {s}.c + {cost}, a := {s}.a || '{edit}', r := {s}.r || CASE WHEN {s}.r = '' THEN '' ELSE chr(10) END || {line})"
                if line else f"struct_pack(c := {s}.c + {cost}, a := {s}.a || '{edit}', r := {s}.r)")
    # states: 0 nothing, 1 after s, 2 after u, 3 after a; inserted turns first
    user = least("acc[3]", step("acc[1]", 3, "I", "'user:'"), step("acc[2]", 3, "I", "'user:'"), step("acc[4]", 3, "I", "'user:'"))
    reply = least("acc[4]", step("u", 3, "I", "'assistant:'"))
    late = "CASE WHEN x.fault = 'truncated' THEN 3 ELSE 0 END"

    def keep(s, initial):
        return f"CASE WHEN x.fault IN ('blank', 'duplicate') OR x.initial <> '{initial}' THEN {dead} ELSE {step(s, late, 'K', 'x.line')} END"

    def rerole(s, name):
        return (f"CASE WHEN x.fault IN ('blank', 'duplicate') THEN {dead} ELSE "
                + step(s, f"3 + {late}", "R", f"'{name}:' || x.text") + " END")
    z, s, u, a = "p[1]", "p[2]", "p[3]", "p[4]"
    new = ", ".join([
        step(z, 4, "D", None),
        least(step(s, 4, "D", None), keep(z, "s")),
        least(step(u, 4, "D", None), *[keep(q, "u") for q in (z, s, a)], *[rerole(q, "user") for q in (z, s, a)]),
        least(step(a, 4, "D", None), keep(u, "a"), rerole(u, "assistant"))])
    start = f"[struct_pack(c := 0, a := '', r := ''), {dead}, {dead}, {dead}]"
    insert_user = f"list_transform([{user}], lambda u: [acc[1], acc[2], u, {reply}])[1]"
    # a user turn may also follow an inserted reply; such a way is never cheapest, since it returns to its state
    end = least("acc[1]", "acc[4]", step("acc[3]", 3, "I", "'assistant:'"),
                step(f"({step('acc[2]', 3, 'I', chr(39) + 'user:' + chr(39))})", 3, "I", "'assistant:'"))
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {CRC32.format(s="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS h FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
  CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM c WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
  CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END AS initial,
  lag(CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END) OVER (PARTITION BY conv_id ORDER BY i) AS was FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (was IS NOT NULL AND was || initial NOT IN ('su', 'ua', 'au')) AS illegal,
  list_reduce(list(struct_pack(fault, initial, text, line := role || ':' || text) ORDER BY i), lambda acc, x:
    list_transform([{insert_user}], lambda p: [{new}])[1], {start}) AS acc FROM f GROUP BY conv_id),
r AS (SELECT *, {end} AS best FROM g)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(best.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN r ON k.conv_id IS NOT DISTINCT FROM r.conv_id
"""


@query("op11_conversation_repair", _repair_sql())
def op11(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_report(rows, damaged(rows))


def _license_sql() -> str:
    rows = ", ".join(f"({i}, {base}, '{label}', {n}, {t}, {k}, '{' '.join(gram)}')" for i, base, label, n, t, k, gram in template_rows())
    return f"""
WITH g(template, base, label, n, t, k, gram) AS (VALUES {rows}),
d AS (SELECT DISTINCT doc_id, text, {ALNUM_WORDS} AS w FROM documents),
p AS (SELECT doc_id, text, k, unnest(range(0, len(w) - k + 1)) AS p, w FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k),
v AS (SELECT doc_id, text, template, base, label, n, p - t AS diagonal, bit_or(((1::BIGINT << p.k) - 1) << t) AS mask
  FROM p JOIN g ON g.k = p.k AND array_to_string(p.w[p + 1:p + p.k], ' ') = gram GROUP BY ALL),
c AS (SELECT *, CASE WHEN base OR diagonal - lag(diagonal, 1, -1000000) OVER (PARTITION BY doc_id, text, template ORDER BY diagonal) > {SLACK}
  THEN 1 ELSE 0 END AS cut FROM v),
i AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id, text, template ORDER BY diagonal) AS island FROM c),
s AS (SELECT doc_id, text, base, label, min(diagonal) AS low, greatest(max(bit_count(mask) / n), CASE WHEN max(diagonal) - min(diagonal) <= {2 * SLACK}
  THEN bit_count(bit_or(mask)) / n ELSE 0 END) AS covered FROM i GROUP BY doc_id, text, template, base, label, n, island),
a AS (SELECT doc_id, text, count(*) FILTER (base) AS n_base, min(low) FILTER (base) AS first_word, max(low) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
  max(covered) AS score FROM s WHERE covered >= CASE WHEN base THEN 1 ELSE {COVERED} END GROUP BY ALL)
SELECT e.doc_id, CAST(len(e.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0.0) AS score
FROM (SELECT doc_id, text, {ALNUM_WORDS} AS w FROM documents) e
LEFT JOIN a ON e.doc_id IS NOT DISTINCT FROM a.doc_id AND e.text IS NOT DISTINCT FROM a.text
"""


@query("op12_license_scan", _license_sql())
def op12(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


NEGATIVES_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS r FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.r AS ar, b.vec_id AS id, b.r AS br, a.label = b.label AS same,
  CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1] * z[2], 0))) AS BIGINT) AS score
  FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.r <> b.r),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(e.select(F.col("vec_id").alias("id"), moved.alias("label"), "embedding", (F.col("vec_id") % 100 == 0).alias("anchor")))
