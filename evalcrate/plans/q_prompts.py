"""Dataset-construction queries: scans/slices (S1, S4-S8, W4), prompts (P1-P18),
few-shot attachment (J5), chat export (K1)."""

from __future__ import annotations

import string

import uuid

from pyspark.sql import functions as F

from evalcrate.functions import text as T
from evalcrate.operators import chat as H
from evalcrate.operators import prompts as P
from evalcrate.operators.positions import row_position
from evalcrate.plans.fixture_sql import with_fixtures
from evalcrate.plans.registry import register
from evalcrate.session import ensure_checkpoint_dir
from evalcrate.sinks.writers import chat_jsonl_column, export_chat_jsonl
from evalcrate.sources import fixtures as FX
from evalcrate.sources import readers as R

FAMILIES = [f for f, *_ in P.FAMILY_PROMPTS]
SUM_START, SUM_END = dict((m, (s, e)) for m, s, e in P.SUMMARY_PROMPTS)["openai"]
SYSTEM = "You summarise dialogues between two people. "
TRANSACTION = "\n\nPlease summarize the following dialogue."
POSITIONS = (0, 1, 5)


def sq(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def duck_template(fmt: str, **fields: str) -> str:
    parts = []
    for lit_text, field, _s, _c in string.Formatter().parse(fmt):
        if lit_text:
            parts.append(sq(lit_text))
        if field is not None:
            parts.append(f"coalesce(CAST({fields[field]} AS VARCHAR), 'None')")
    return "(" + " || ".join(parts) + ")"


def _test_question(prefix: str = "") -> str:
    return duck_template(P.TASK_TEMPLATES["dialogue"], dialogue=f"{prefix}dialogue", section_header=f"{prefix}section_header")


def _spark_test_question():
    return P.template(P.TASK_TEMPLATES["dialogue"], dialogue=F.col("dialogue"), section_header=F.col("section_header"))


_PICK_SQL = f"""
picked AS (SELECT *, CASE rn {' '.join(f'WHEN {p} THEN {i + 1}' for i, p in enumerate(POSITIONS))} END AS k
           FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS rn FROM dialogues) x
           WHERE rn IN ({', '.join(map(str, POSITIONS))})),
ex AS (SELECT k, {duck_template(P.EXAMPLE_TEMPLATES['dialogue'], k='k', dialogue='dialogue', section_header='section_header')}
              AS question, coalesce(section_text, 'None') AS response FROM picked)"""


def _examples(spark, sf_dir):
    d = FX.dialogues(spark, sf_dir)
    picked = R.pick_positions(d, "id", POSITIONS)
    return P.example_rows(picked, P.EXAMPLE_TEMPLATES["dialogue"], "section_text",
                          dialogue="dialogue", section_header="section_header")


# ---------------------------------------------------------------- scans and slices

@register("scan_split", "SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3'")
def q_scan_split(spark, sf_dir):
    return R.scan_split(spark, f"{sf_dir}/documents.parquet", "src3", "source", ["doc_id", "lang", "n_chars"])


@register("project", "SELECT doc_id, n_chars FROM documents")
def q_project(spark, sf_dir):
    return R.project(R.read_table(spark, sf_dir, "documents"), "doc_id", "n_chars")


@register("split_slice", with_fixtures("dialogues") +
          "SELECT id, section_header FROM dialogues ORDER BY id LIMIT 50 OFFSET 10")
def q_split_slice(spark, sf_dir):
    sl = R.get_dataset_slices({"validation": FX.dialogues(spark, sf_dir)}, "id", {"valid": "validation[10:60]"})
    return sl["valid"].select("id", "section_header")


@register("split_slice_tail", with_fixtures("dialogues") +
          "SELECT id FROM dialogues ORDER BY id OFFSET 100")
def q_split_slice_tail(spark, sf_dir):
    """S4 with an open end: numbered by the distributed row position."""
    return R.split_slice(FX.dialogues(spark, sf_dir), "id", 100, None).select("id")


ORDERS_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"


@register("split_slice_wide", f"SELECT {ORDERS_COLUMNS} FROM orders ORDER BY o_orderkey LIMIT 3500 OFFSET 10500")
def q_split_slice_wide(spark, sf_dir):
    """S4 over several columns, beyond the first ten thousand rows."""
    o = R.read_table(spark, sf_dir, "orders").select(*ORDERS_COLUMNS.split(", "))
    return R.get_dataset_slices({"train": o}, "o_orderkey", {"valid": "train[10500:14000]"})["valid"]


@register("split_slice_negative", f"SELECT {ORDERS_COLUMNS} FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey DESC) AS r FROM orders) "
          "WHERE r <= 3000 AND r > 500")
def q_split_slice_negative(spark, sf_dir):
    o = R.read_table(spark, sf_dir, "orders").select(*ORDERS_COLUMNS.split(", "))
    return R.split_slice(o, "o_orderkey", -3000, -500)


@register("sample_n_large", f"SELECT {ORDERS_COLUMNS} FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':3'), o_orderkey LIMIT 12000")
def q_sample_n_large(spark, sf_dir):
    return R.sample_n(R.read_table(spark, sf_dir, "orders").select(*ORDERS_COLUMNS.split(", ")), "o_orderkey", 12_000, seed=3)


@register("pick_positions_far", f"SELECT CASE rn WHEN 5 THEN 1 WHEN 11000 THEN 2 ELSE 3 END AS k, {ORDERS_COLUMNS} FROM "
          "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders) WHERE rn IN (5, 11000, 14990)")
def q_pick_positions_far(spark, sf_dir):
    o = R.read_table(spark, sf_dir, "orders").select(*ORDERS_COLUMNS.split(", "))
    return R.pick_positions(o, "o_orderkey", [5, 11_000, 14_990]).drop("pos")


@register("row_position_wide", "SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos FROM lineitem")
def q_row_position_wide(spark, sf_dir):
    """W4 with every column of the table kept."""
    return row_position(R.read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "pos")


@register("row_position", "SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos FROM conversations")
def q_row_position(spark, sf_dir):
    c = R.read_table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return row_position(c, ["conv_id", "turn"], "pos")


@register("head_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def q_head_limit(spark, sf_dir):
    return R.head_limit(R.read_table(spark, sf_dir, "orders"), "o_orderkey", 100).select("o_orderkey", "o_totalprice")


@register("pick_positions", with_fixtures("dialogues", extra=_PICK_SQL) + "SELECT k, id FROM picked")
def q_pick_positions(spark, sf_dir):
    return R.pick_positions(FX.dialogues(spark, sf_dir), "id", POSITIONS).select("k", "id")


@register("sample_n", with_fixtures("dialogues") +
          "SELECT id FROM dialogues ORDER BY md5(CAST(id AS VARCHAR) || ':7'), id LIMIT 20")
def q_sample_n(spark, sf_dir):
    return R.sample_n(FX.dialogues(spark, sf_dir), "id", 20, seed=7).select("id")


# ---------------------------------------------------------------- prompt columns

@register("concat_flagged", with_fixtures("dialogues") +
          "SELECT id, 'Claim: ' || dialogue || ' ' || 'Evidence: ' || section_text AS concat_col FROM dialogues")
def q_concat_flagged(spark, sf_dir):
    d = FX.dialogues(spark, sf_dir)
    return d.select("id", P.concat_flagged("dialogue", "section_text").alias("concat_col"))


@register("wrap_prompt", with_fixtures("dialogues") +
          f"SELECT id, {sq(SUM_START)} || dialogue || {sq(SUM_END)} AS prompt FROM dialogues")
def q_wrap_prompt(spark, sf_dir):
    d = FX.dialogues(spark, sf_dir)
    return d.select("id", P.wrap_prompt("dialogue", SUM_START, SUM_END).alias("prompt"))


_FAM_VALUES = ", ".join(f"({sq(f)}, {sq(a)}, {sq(b)}, {sq(c)})" for f, a, b, c in P.FAMILY_PROMPTS)


@register("family_wrap", with_fixtures("dialogues") + f"""
, fam(family, chat_start, end_prompt, suffix) AS (VALUES {_FAM_VALUES})
SELECT d.id, f.family, f.chat_start || 'Classify: ' || d.dialogue || f.end_prompt AS prompt, f.suffix AS remove_suffix
FROM (SELECT *, {str(FAMILIES).replace('"', "'")}[(id % 5) + 1] AS family FROM dialogues) d
JOIN fam f USING (family)""")
def q_family_wrap(spark, sf_dir):
    d = FX.dialogues(spark, sf_dir)
    d = d.withColumn("family", F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (F.col("id") % 5 + 1).cast("int")))
    return P.family_wrap(d, "dialogue", "family", "Classify: ").select("id", "family", "prompt", "remove_suffix")


@register("template_task", with_fixtures("dialogues") + f"SELECT id, {_test_question()} AS test_question FROM dialogues")
def q_template_task(spark, sf_dir):
    return FX.dialogues(spark, sf_dir).select("id", _spark_test_question().alias("test_question"))


@register("example_block", with_fixtures("dialogues", extra=_PICK_SQL) +
          "SELECT string_agg(question || response, '' ORDER BY k) AS examples FROM ex")
def q_example_block(spark, sf_dir):
    return P.example_block(_examples(spark, sf_dir), with_response=True)


@register("example_block_comment", with_fixtures("toxic_groups", extra="""
p AS (SELECT id, label, row_number() OVER (ORDER BY id) - 1 AS pos FROM toxic_groups),
c AS (SELECT CASE pos WHEN 11 THEN 1 WHEN 50 THEN 2 ELSE 3 END AS k, d.text, p.label FROM p JOIN documents d ON d.doc_id = p.id
      WHERE pos IN (11, 50, 21))""") +
          "SELECT string_agg(chr(10) || chr(10) || 'Example ' || k || ':' || chr(10) || chr(10) || '## Comment:' || chr(10) || text || chr(10) "
          "|| chr(10) || '## Response:' || label, '' ORDER BY k) AS examples FROM c")
def q_example_block_comment(spark, sf_dir):
    """P10, toxicity form: comments picked by position with their labels as responses."""
    rows = R.pick_positions(FX.toxic_groups(spark, sf_dir).select("id", "label"), "id", [11, 50, 21])
    rows = rows.join(R.read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    return P.example_block(P.example_rows(rows, P.EXAMPLE_TEMPLATES["comment"], "label", text="text"), with_response=True)


_SET_SQL = """
p AS (SELECT id, response, truth_text, row_number() OVER (ORDER BY id) AS k FROM em_preds),
ex AS (SELECT 'odd' AS dataset, k, 'Is it ' || truth_text || '?' AS question, response FROM p WHERE k <= 3
       UNION ALL SELECT 'even', k, 'Q ' || k, truth_text FROM p WHERE k <= 5)"""


@register("fewshot_by_dataset", with_fixtures("em_preds", extra=_SET_SQL) +
          "SELECT e.id, (SELECT string_agg(question || response, '' ORDER BY k) FROM ex WHERE dataset = 'even' AND k <= 4) || e.response "
          "AS prompt FROM em_preds e")
def q_fewshot_by_dataset(spark, sf_dir):
    """P4/P5 material from one table of examples keyed by dataset, four shots."""
    preds = FX.em_preds(spark, sf_dir)
    first = R.pick_positions(preds, "id", [0, 1, 2, 3, 4])
    odd = first.where("k <= 3").select(F.lit("odd").alias("dataset"), "k", F.concat(F.lit("Is it "), "truth_text", F.lit("?")).alias("question"), "response")
    even = first.select(F.lit("even").alias("dataset"), "k", F.concat(F.lit("Q "), F.col("k").cast("string")).alias("question"),
                        F.col("truth_text").alias("response"))
    block = P.example_block(P.examples_of(odd.unionByName(even), "even"), with_response=True, shots=4)
    return P.attach_scalar(preds, block, "examples").select("id", F.concat("examples", "response").alias("prompt"))


_PREFIX_START = "Summarise each dialogue. "
_PREFIX_TRANSITION = "\n\nNow the dialogue to summarise."


@register("fewshot_prefix", with_fixtures("dialogues", extra=_PICK_SQL) +
          f"SELECT {sq(_PREFIX_START)} || string_agg(question || response, '' ORDER BY k) || {sq(_PREFIX_TRANSITION)} "
          "AS prefix FROM ex WHERE k <= 2")
def q_fewshot_prefix(spark, sf_dir):
    ex = _examples(spark, sf_dir).select("k", F.concat("question", "response").alias("shot"))
    return P.fewshot_prefix(ex, 2, _PREFIX_START, _PREFIX_TRANSITION)


@register("attach_examples", with_fixtures("dialogues", extra=_PICK_SQL + f""",
pre AS (SELECT {sq(_PREFIX_START)} || string_agg(question || response, '' ORDER BY k) || {sq(_PREFIX_TRANSITION)}
        AS prefix FROM ex WHERE k <= 2)""") + f"SELECT id, (SELECT prefix FROM pre) || {_test_question()} AS prompt FROM dialogues")
def q_attach_examples(spark, sf_dir):
    ex = _examples(spark, sf_dir).select("k", F.concat("question", "response").alias("shot"))
    pre = P.fewshot_prefix(ex, 2, _PREFIX_START, _PREFIX_TRANSITION)
    d = P.attach_scalar(FX.dialogues(spark, sf_dir), pre, "prefix")
    return d.select("id", F.concat("prefix", _spark_test_question()).alias("prompt"))


def _chat_sql(shots: int) -> str:
    """Long-form (id, pos, role, content) of the few-shot chat for every dialogue."""
    rows = []
    for k in range(1, shots + 1):
        q = f"(SELECT {sq(SYSTEM) + ' || ' if k == 1 else ''}question FROM ex WHERE k = {k})"
        rows.append(f"SELECT id, {2 * (k - 1)} AS pos, 'user' AS role, {q} AS content FROM dialogues")
        rows.append(f"SELECT id, {2 * k - 1}, 'assistant', (SELECT response FROM ex WHERE k = {k}) FROM dialogues")
    rows.append(f"SELECT id, {2 * shots}, 'user', {sq(TRANSACTION)} || {_test_question()} FROM dialogues")
    return " UNION ALL ".join(rows)


def _chat(spark, sf_dir, shots):
    d = FX.dialogues(spark, sf_dir)
    return P.fewshot_chat(d, _spark_test_question(), _examples(spark, sf_dir), shots, SYSTEM, TRANSACTION)


@register("fewshot_chat", with_fixtures("dialogues", extra=_PICK_SQL) + _chat_sql(2))
def q_fewshot_chat(spark, sf_dir):
    return H.to_long(_chat(spark, sf_dir, 2), "id")


_FALCON_START = "A helpful assistant.\nSummarize each dialogue."


@register("fewshot_chat_text", with_fixtures("dialogues", extra=_PICK_SQL) + f"""
SELECT id, (SELECT {sq(_FALCON_START)} || chr(10) || string_agg('User: ' || question || chr(10) || 'Assistant: ' || response,
                                                              chr(10) ORDER BY k) FROM ex WHERE k <= 2)
           || chr(10) || 'User: ' || dialogue || chr(10) || 'Assistant:' AS prompt
FROM dialogues""")
def q_fewshot_chat_text(spark, sf_dir):
    d = FX.dialogues(spark, sf_dir)
    out = P.fewshot_chat_text(d, F.col("dialogue"), _examples(spark, sf_dir), 2, _FALCON_START)
    return out.select("id", "prompt")


@register("flat_fewshot", with_fixtures("dialogues", extra=_PICK_SQL) +
          f"SELECT id, {sq(SYSTEM)} || (SELECT string_agg(question || response, '' ORDER BY k) FROM ex WHERE k <= 2) "
          f"|| {sq(TRANSACTION)} || {_test_question()} AS prompt FROM dialogues")
def q_flat_fewshot(spark, sf_dir):
    block = P.example_block(_examples(spark, sf_dir), with_response=True, shots=2)
    d = P.attach_scalar(FX.dialogues(spark, sf_dir), block, "examples")
    return d.select("id", P.flat_fewshot(SYSTEM, F.col("examples"), TRANSACTION, _spark_test_question()).alias("prompt"))


def _render_sql(shots: int, gen: bool = True) -> str:
    pre = {r: b for r, b, _a in P.CHATML["turn"]}
    post = {r: a for r, _b, a in P.CHATML["turn"]}
    case_pre = "CASE role " + " ".join(f"WHEN '{r}' THEN {sq(b)}" for r, b in pre.items()) + " ELSE '' END"
    case_post = "CASE role " + " ".join(f"WHEN '{r}' THEN {sq(a)}" for r, a in post.items()) + " ELSE '' END"
    g = f" || {sq(P.CHATML['generation'])}" if gen else ""
    return (f", chat AS ({_chat_sql(shots)}) "
            f"SELECT id, string_agg({case_pre} || content || {case_post}, '' ORDER BY pos){g} AS text FROM chat GROUP BY id")


@register("render_chat", with_fixtures("dialogues", extra=_PICK_SQL) + _render_sql(1))
def q_render_chat(spark, sf_dir):
    return _chat(spark, sf_dir, 1).select("id", P.render_chat("messages").alias("text"))


def _rewrite_sql(expr: str) -> str:
    for a, b in P.ROLE_REWRITES:
        expr = f"replace({expr}, {sq(a)}, {sq(b)})"
    return expr


def _rewrite_roles_sql() -> str:
    pre = "CASE role " + " ".join(f"WHEN '{r}' THEN {sq(b)}" for r, b, _a in P.CHATML["turn"]) + " ELSE '' END"
    post = "CASE role " + " ".join(f"WHEN '{r}' THEN {sq(a)}" for r, _b, a in P.CHATML["turn"]) + " ELSE '' END"
    rendered = f"string_agg({pre} || content || {post}, '' ORDER BY pos) || {sq(P.CHATML['generation'])}"
    return (with_fixtures("dialogues", extra=_PICK_SQL + ", chat AS (" + _chat_sql(1) + ")")
            + f"SELECT id, {_rewrite_sql(rendered)} AS text FROM chat GROUP BY id")


@register("rewrite_roles", _rewrite_roles_sql())
def q_rewrite_roles(spark, sf_dir):
    return _chat(spark, sf_dir, 1).select("id", P.rewrite_roles(P.render_chat("messages")).alias("text"))


_INS_START, _INS_END, _INS_SUFFIX = "### Summarize: ", "### Begin summary:", "</s>"


@register("instruction_text", with_fixtures("dialogues") +
          f"SELECT id, {sq(_INS_START)} || dialogue || {sq(_INS_END)} || section_text || {sq(_INS_SUFFIX)} AS text FROM dialogues")
def q_instruction_text(spark, sf_dir):
    d = FX.dialogues(spark, sf_dir)
    return d.select("id", P.instruction_text("dialogue", "section_text", _INS_START, _INS_END, _INS_SUFFIX).alias("text"))


@register("instruction_chat", with_fixtures("dialogues") + f"""
SELECT id, {sq(P.CHATML['turn'][1][1])} || {sq(SYSTEM)} || {sq(TRANSACTION)} || {_test_question()} || {sq(P.CHATML['turn'][1][2])}
        || {sq(P.CHATML['turn'][2][1])} || section_text || {sq(P.CHATML['turn'][2][2])} AS text FROM dialogues""")
def q_instruction_chat(spark, sf_dir):
    d = FX.dialogues(spark, sf_dir)
    chat = P.instruction_chat(F.concat(F.lit(SYSTEM), F.lit(TRANSACTION), _spark_test_question()), "section_text")
    return d.select("id", P.render_chat(chat, add_generation_prompt=False).alias("text"))


_WS_SQL = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _ws_tokens_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_WS_SQL}'), lambda w: w <> '')"


def _head_sql(n: int) -> str:
    """The first ``n`` tokens with the white space before them."""
    return rf"^(?:{_WS_SQL[:-1]}*[^{_WS_SQL[1:-1]}+){{{n}}}"


_TRUNC_END = " [/INST]"


@register("truncate_keep_tail", with_fixtures("dialogues") + f"""
SELECT id, CASE WHEN len({_ws_tokens_sql("'Summarize: ' || dialogue || " + sq(_TRUNC_END))}) > 64
                THEN regexp_extract('Summarize: ' || dialogue, '{_head_sql(62)}') || {sq(_TRUNC_END)}
                ELSE 'Summarize: ' || dialogue || {sq(_TRUNC_END)} END AS prompt FROM dialogues""")
def q_truncate_keep_tail(spark, sf_dir):
    d = FX.dialogues(spark, sf_dir)
    return d.select("id", P.truncate_keep_tail(F.concat(F.lit("Summarize: "), "dialogue"), _TRUNC_END, 64).alias("prompt"))


@register("pretokenize", with_fixtures("dialogues") + f"""
SELECT id, CAST(len({_ws_tokens_sql('dialogue')}[1:32]) AS INTEGER) AS n_tokens,
       array_to_string({_ws_tokens_sql('dialogue')}[1:32], ' ') AS head FROM dialogues""")
def q_pretokenize(spark, sf_dir):
    d = FX.dialogues(spark, sf_dir).select("id", P.pretokenize("dialogue", 32).alias("t"))
    return d.select("id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("head"))


@register("cut_tokens", with_fixtures("dialogues") + f"""
SELECT id, CASE WHEN len({_ws_tokens_sql('dialogue')}) > 32 THEN regexp_extract(dialogue, '{_head_sql(32)}')
           ELSE dialogue END AS head FROM dialogues""")
def q_cut_tokens(spark, sf_dir):
    d = FX.dialogues(spark, sf_dir)
    return d.select("id", F.when(T.piece_count(T.py_pieces("dialogue")) > 32, P.cut_tokens("dialogue", 32)).otherwise(F.col("dialogue")).alias("head"))


@register("strip_prompt_tokens", with_fixtures("dialogues") + "SELECT id, chr(10) || section_text AS output FROM dialogues")
def q_strip_prompt_tokens(spark, sf_dir):
    d = FX.dialogues(spark, sf_dir)
    prompt = P.wrap_prompt("dialogue", SUM_START, SUM_END)
    full = d.select("id", prompt.alias("prompt"), F.concat(F.rtrim(prompt), F.lit("\n"), "section_text").alias("full"))
    return full.select("id", P.strip_prompt_tokens("full", "prompt").alias("output"))


@register("strip_prompt", with_fixtures("dialogues") + "SELECT id, section_text AS output FROM dialogues")
def q_strip_prompt(spark, sf_dir):
    d = FX.dialogues(spark, sf_dir)
    prompt = P.wrap_prompt("dialogue", SUM_START, SUM_END)
    full = d.select("id", prompt.alias("prompt"), F.concat(prompt, "section_text").alias("full"))
    return full.select("id", T.strip_prompt("full", "prompt").alias("output"))


_PAIR_COLS = ("name", "segment")


def _serialize_sql() -> str:
    blocks = [f"'LEFT {c}: ' || coalesce(left_{c}, 'NA') || chr(10) || 'RIGHT {c}: ' || coalesce(right_{c}, 'NA')"
              for c in _PAIR_COLS]
    return (" || chr(10) || chr(10) || ").join(blocks)


@register("serialize_pair", with_fixtures("record_pairs") + f"SELECT id, {_serialize_sql()} AS prompt FROM record_pairs")
def q_serialize_pair(spark, sf_dir):
    df = FX.record_pairs(spark, sf_dir)
    return df.select("id", P.serialize_pair(df, _PAIR_COLS).alias("prompt"))


_DATASETS = [k for k, _ in P.EM_SYSTEM]


@register("literal_column", with_fixtures("record_pairs") + f"""
SELECT id, dataset, CASE dataset {' '.join(f'WHEN {sq(k)} THEN {sq(v)}' for k, v in P.EM_SYSTEM)} END AS system_message
FROM (SELECT id, {str(_DATASETS).replace('"', "'")}[(id % 2) + 1] AS dataset FROM record_pairs) r""")
def q_literal_column(spark, sf_dir):
    df = FX.record_pairs(spark, sf_dir).select(
        "id", F.element_at(F.array(*[F.lit(k) for k in _DATASETS]), (F.col("id") % 2 + 1).cast("int")).alias("dataset"))
    return P.literal_column(df, "dataset", P.EM_SYSTEM, "system_message")


_EM_SYS = dict(P.EM_SYSTEM)["entity_match"]
_EM_TRANS = dict(P.EM_TRANSACTION)["entity_match"]


def _em_examples(spark, sf_dir):
    rp = FX.record_pairs(spark, sf_dir)
    picked = R.pick_positions(rp, "id", (0, 1, 2))
    return picked.select("k", F.concat(F.lit("\n"), P.serialize_pair(picked, _PAIR_COLS), F.lit("\n")).alias("question"),
                         F.col("overall_label").alias("response"))


@register("fewshot_chat_merged", with_fixtures("record_pairs") + f""",
picked AS (SELECT *, rn + 1 AS k FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS rn FROM record_pairs) x WHERE rn < 3),
ex AS (SELECT k, chr(10) || {_serialize_sql()} || chr(10) AS question, overall_label AS response FROM picked)
SELECT id, 0 AS pos, 'user' AS role, {sq(_EM_SYS)} || (SELECT question FROM ex WHERE k = 1) AS content FROM record_pairs
UNION ALL SELECT id, 1, 'assistant', (SELECT response FROM ex WHERE k = 1) FROM record_pairs
UNION ALL SELECT id, 2, 'user', (SELECT question FROM ex WHERE k = 2) FROM record_pairs
UNION ALL SELECT id, 3, 'assistant', (SELECT response FROM ex WHERE k = 2) FROM record_pairs
UNION ALL SELECT id, 4, 'user', {_serialize_sql()} || {sq(_EM_TRANS)} FROM record_pairs""")
def q_fewshot_chat_merged(spark, sf_dir):
    df = FX.record_pairs(spark, sf_dir)
    out = P.fewshot_chat_merged(df, P.serialize_pair(df, _PAIR_COLS), _em_examples(spark, sf_dir), 2, _EM_SYS, _EM_TRANS)
    return H.to_long(out, "id")


_EXPORT_SYS = "You match records."


@register("export_chat_jsonl", with_fixtures("record_pairs") + f"""
SELECT overall_label AS split, to_json({{'messages': [{{'role': 'system', 'content': {sq(_EXPORT_SYS)}}},
                                  {{'role': 'user', 'content': {_serialize_sql()}}},
                                  {{'role': 'assistant', 'content': overall_label}}]}})::VARCHAR AS line FROM record_pairs""")
def q_export_chat_jsonl(spark, sf_dir):
    """K1: the export written as one folder of JSON lines per split, and read back."""
    df = FX.record_pairs(spark, sf_dir)
    lines = df.select(chat_jsonl_column(P.serialize_pair(df, _PAIR_COLS), F.col("overall_label"), _EXPORT_SYS).alias("line"),
                      F.col("overall_label").alias("split"))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/evalcrate-io/chat-{uuid.uuid4().hex}"
    export_chat_jsonl(lines, "line", path)
    return spark.read.schema("value string, split string").text(path).select("split", F.col("value").alias("line"))
