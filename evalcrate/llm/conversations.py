"""Operator 11: repair of conversation structure by Hirschberg's divide and conquer.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``.  Four states follow the
initials (nothing yet, after s, after u, after a); a row is kept, given another role or deleted, and empty
turns may be inserted before it.  Wanted is the cheapest edit list, and of several the one that is least as
a string of the initials Keep, Rerole, Delete, Insert.

Every row is a 4 x 4 matrix: the cost from state to state, with a rank that orders the least edit strings from
one state to the others.  Two such strings end with the same row's edit and differ before their ends, so the
rank of a product follows from the ranks of its factors: matrices of costs and ranks can be multiplied in any
grouping, ties included.

1. Rows get a position by (conversation, turn, role, text); runs of ``BLOCK`` positions are cut into one segment per
   conversation, reduced to one matrix each; up to ``FAN`` neighbouring matrices of a conversation are multiplied
   per level until one is left.  No task holds more than a block or ``FAN`` matrices of a conversation.
2. The last matrix gives cost and final state.  Downwards, level by level, each sequence of children is cut in
   the middle: the forward vector (four costs with ranks) and the backward vector (four costs) meet, the cheapest
   crossing of the least rank is taken, and both halves recurse - space is linear, no table is kept.

Rows that are equal in all of conversation, turn, role and text travel once with their number; the copies after the
first must be deleted.

Edge cases: null turns come first; rows of one turn are taken by role, then text (first 64 characters, then hash);
a null conversation id is a conversation of its own; a null role or text counts as one space; an empty role has the initial
space; roles other than s, u, a cannot be kept; repeated rows are duplicates; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalcrate.llm.shared import for_python, saved
from evalcrate.operators.positions import row_position

BLOCK = 1024  # rows of a segment
FAN = 1024    # matrices multiplied at a time
INF = 1 << 60
START, SYSTEM, USER, REPLY = range(4)
INSERTED = (USER, USER, REPLY, USER)         # the state after the turn that may come next
INITIALS = {"s": 0, "u": 1, "a": 2}
TAIL_COST, TAIL = (0, 6, 3, 0), ("", "II", "I", "")
NAMES = {"u": "user", "a": "assistant"}
SHAPE = "_conv string, g long, cost array<long>, rank array<int>, base long, first int, last int, illegal long"


# ---------------------------------------------------------------- four-state algebra

def _kept(state: int, initial: int) -> int | None:
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return USER if state in (START, SYSTEM, REPLY) else None
    return REPLY if initial == 2 and state == USER else None


@lru_cache(None)
def row_matrix(code: int) -> tuple[tuple, tuple, tuple]:
    """Costs, ranks and edit strings (16 each, from state * 4 + to state) of one row; ``code`` is its initial
    (0 s, 1 u, 2 a, 3 other) plus 4 if it is cut short, or 8 if it must be deleted."""
    best: list[tuple | None] = [None] * 16
    for start in range(4):
        state = start
        for inserts in range(3):
            late = 3 if code & 4 else 0
            ways = [(state, 4, "D")]
            if code < 8:
                ways.append((INSERTED[state], 3 + late, "R"))
                if (to := _kept(state, code & 3)) is not None:
                    ways.append((to, late, "K"))
            for to, cost, edit in ways:
                way = (cost + 3 * inserts, "I" * inserts + edit)
                if best[start * 4 + to] is None or way < best[start * 4 + to]:
                    best[start * 4 + to] = way
            state = INSERTED[state]
    ranks = [0] * 16
    for start in range(4):
        order = sorted((best[start * 4 + to][1], to) for to in range(4) if best[start * 4 + to])
        for r, (_, to) in enumerate(order):
            ranks[start * 4 + to] = r
    return (tuple(b[0] if b else INF for b in best), tuple(ranks), tuple(b[1] if b else "" for b in best))


def _forward(cost, rank, m_cost, m_rank):
    """The vector (costs, ranks) of one entry state, carried over a matrix."""
    out, keys = [INF] * 4, []
    for to in range(4):
        way = None
        for c in range(4):
            w = cost[c] + m_cost[c * 4 + to]
            if w < INF and (way is None or (w, rank[c]) < way[:2]):
                way = (w, rank[c], m_rank[c * 4 + to])
        if way:
            out[to] = way[0]
            keys.append((way[1], way[2], to))
    ranks = [0] * 4
    for r, (_, _, to) in enumerate(sorted(keys)):
        ranks[to] = r
    return tuple(out), tuple(ranks)


def _backward(cost, m_cost):
    return tuple(min(min(m_cost[c * 4 + to] + cost[to] for to in range(4)), INF) for c in range(4))


def _level(cost):
    low = min(cost)
    return low, tuple(c - low if c < INF else INF for c in cost)


@lru_cache(1 << 16)
def _forward_row(cost, rank, code):
    cost, rank = _forward(cost, rank, *row_matrix(code)[:2])
    low, cost = _level(cost)
    return low, cost, rank


@lru_cache(1 << 16)
def _backward_row(cost, code):
    return _level(_backward(cost, row_matrix(code)[0]))[1]


class Rows:
    """A sequence of row codes."""

    def __init__(self, codes):
        self.codes = codes

    def __len__(self):
        return len(self.codes)

    def forward(self, state, low, high):
        cost, rank, total = _unit(state), (0, 0, 0, 0), 0
        for i in range(low, high):
            add, cost, rank = _forward_row(cost, rank, self.codes[i])
            total += add
        return total, cost, rank

    def backward(self, state, low, high):
        cost = _unit(state)
        for i in range(high - 1, low - 1, -1):
            cost = _backward_row(cost, self.codes[i])
        return cost


class Matrices:
    """A sequence of (costs, ranks)."""

    def __init__(self, items):
        self.items = items

    def __len__(self):
        return len(self.items)

    def forward(self, state, low, high):
        cost, rank = _unit(state), (0, 0, 0, 0)
        for i in range(low, high):
            cost, rank = _forward(cost, rank, *self.items[i])
        return 0, cost, rank

    def backward(self, state, low, high):
        cost = _unit(state)
        for i in range(high - 1, low - 1, -1):
            cost = _backward(cost, self.items[i][0])
        return cost


def _unit(state):
    return tuple(0 if s == state else INF for s in range(4))


def product(seq) -> tuple[list[int], list[int]]:
    """Costs and ranks (16 each) of a whole sequence."""
    costs, ranks = [], []
    for state in range(4):
        total, cost, rank = seq.forward(state, 0, len(seq))
        costs += [c + total if c < INF else INF for c in cost]
        ranks += rank
    return costs, ranks


def hirschberg(seq, entry: int, end: int) -> list[tuple[int, int]]:
    """(state before, state after) of every item on the best way from ``entry`` to ``end``."""
    out = [None] * len(seq)
    todo = [(0, len(seq), entry, end)]
    while todo:
        low, high, a, b = todo.pop()
        if high - low == 1:
            out[low] = (a, b)
            continue
        mid = (low + high) // 2
        _, cost, rank = seq.forward(a, low, mid)
        back = seq.backward(b, mid, high)
        _, _, cross = min((cost[c] + back[c], rank[c], c) for c in range(4))
        todo += [(low, mid, a, cross), (mid, high, cross, b)]
    return out


# ---------------------------------------------------------------- inside the tasks

def _items(codes, times):
    """Row codes with their copies: the copies after the first are a run of rows to delete."""
    seq, of, run = [], [], []
    for i, (code, n) in enumerate(zip(codes.tolist(), times.tolist())):
        if code >= 8:
            seq.append(8)
            of.append(i)
            run.append(n)
            continue
        seq.append(code)
        of.append(i)
        run.append(1)
        if n > 1:
            seq.append(8)
            of.append(i)
            run.append(n - 1)
    return seq, of, run


def _segment_sums(frames):
    for pdf in frames:
        rows = []
        for conv, g, codes, times, initials in zip(pdf["_conv"], pdf["g"], pdf["code"], pdf["times"], pdf["initial"]):
            seq, _, run = _items(codes, times)
            cost, rank = product(Rows(seq))
            ini = initials.tolist()
            bad = sum(n - 1 for n in times.tolist()) + sum(not _fits(a, b) for a, b in zip(ini, ini[1:]))
            rows.append((conv, g, cost, rank, sum(4 * (n - 1) for n in run), ini[0], ini[-1], bad))
        yield pd.DataFrame(rows, columns=["_conv", "g", "cost", "rank", "base", "first", "last", "illegal"])


def _fits(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def _children(items) -> Matrices:
    return Matrices([(tuple(x["cost"]), tuple(x["rank"])) for x in items])


def _node_sums(frames):
    for pdf in frames:
        rows = []
        for conv, g, items in zip(pdf["_conv"], pdf["g"], pdf["items"]):
            cost, rank = product(_children(items))
            bad = sum(x["illegal"] for x in items) + sum(not _fits(a["last"], b["first"]) for a, b in zip(items, items[1:]))
            rows.append((conv, g, cost, rank, sum(x["base"] for x in items), items[0]["first"], items[-1]["last"], bad))
        yield pd.DataFrame(rows, columns=["_conv", "g", "cost", "rank", "base", "first", "last", "illegal"])


def _node_ways(frames):
    for pdf in frames:
        rows = []
        for conv, items, entry, end, tail in zip(pdf["_conv"], pdf["items"], pdf["entry"], pdf["end"], pdf["tail"]):
            ways = hirschberg(_children(items), entry, end)
            for i, (x, (a, b)) in enumerate(zip(items, ways)):
                rows.append((conv, x["g"], a, b, tail if i == len(items) - 1 else ""))
        yield pd.DataFrame(rows, columns=["_conv", "g", "entry", "end", "tail"])


def _segment_ways(frames):
    for pdf in frames:
        out = []
        for pos, codes, times, entry, end, tail in zip(pdf["pos"], pdf["code"], pdf["times"], pdf["entry"], pdf["end"], pdf["tail"]):
            seq, of, run = _items(codes, times)
            edits, roles = [""] * len(codes), [""] * len(codes)
            for code, i, n, (a, b) in zip(seq, of, run, hirschberg(Rows(seq), entry, end)):
                edit = row_matrix(code)[2][a * 4 + b]
                edits[i] += "D" * (n - 1) + edit
                roles[i] += _emitted(a, edit, code)
            edits[-1] += tail
            roles[-1] += _emitted(end, tail, 8)
            out.append((pos, edits, roles))
        yield pd.DataFrame(out, columns=["pos", "edit", "roles"])


def _emitted(state: int, edit: str, code: int) -> str:
    """Initials of the turns that an edit string leaves."""
    out = ""
    for e in edit:
        if e == "K":
            out += "sua"[code & 3]
        elif e != "D":
            state = INSERTED[state]
            out += "-sua"[state]
    return out


def _digests(batches):
    """Audit and digest per conversation from rows in order; a conversation streams through, batch by batch."""
    conv, audit, sha, some, done = None, [], hashlib.sha256(), False, []

    def close():
        if conv is not None:
            done.append((conv, "".join(audit), sha.hexdigest()))
    for batch in batches:
        for c, edit, roles, role, text in zip(*(batch.column(n).to_pylist() for n in ("_conv", "edit", "roles", "role", "text"))):
            if c != conv:
                close()
                conv, audit, sha, some = c, [], hashlib.sha256(), False
            audit.append(edit)
            for e, r in zip(edit.replace("D", ""), roles):
                line = (role if e == "K" else NAMES[r]) + ":" + ("" if e == "I" else text)
                sha.update((("\n" if some else "") + line).encode())
                some = True
        yield _table(done)
        done.clear()
    close()
    yield _table(done)


def _table(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)],
                                      names=["_conv", "audit", "repaired_sha256"])


# ---------------------------------------------------------------- jobs

def conversation_key(conv: Column) -> Column:
    """A string that is never null and differs for different ids."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def damaged(rows: DataFrame) -> DataFrame:
    """The damage of the query: a row is dropped, emptied, robbed of its end marks, repeated or made a user's, by a hash of its key."""
    def text_of(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = (F.when(fate == 1, "").when(fate == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text")))
    return rows.where(fate != 0).select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"),
        F.when(fate == 3, 2).otherwise(1).alias("times"))


def placed(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text, times)`` once per distinct row, in order, with the fault of the first copy:
    ``_conv, pos, conv_id, turn, role, text, times, fault, initial, code``."""
    given = rows.select(conversation_key(F.col("conv_id")).alias("_conv"), "conv_id", "turn", "role", "text", "times")
    once = given.groupBy("_conv", "conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    once = saved(once.withColumns({"head": F.left("text", F.lit(64)), "key": F.md5("text")}), "conv-rows")
    rows = row_position(once, ["_conv", "turn", "role", "head", "key"], "pos").drop("head")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    rows = rows.withColumn("same", F.when(~blank, F.md5(F.concat_ws("\0", "_conv", "role", "key"))))
    rows = saved(rows.drop("key"), "conv-placed")
    # only what occurs more than once, stored: its size is known, and adaptive execution can split a hot text's rows
    firsts = rows.where("same IS NOT NULL").groupBy("same").agg(F.min("pos").alias("seen"), F.count("*").alias("n"))
    firsts = saved(firsts.where("n > 1").drop("n"), "conv-firsts")
    rows = rows.join(firsts, "same", "left")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = (F.when(F.col("same").isNull(), "blank").when(F.col("seen") < F.col("pos"), "duplicate")
             .when(cut, "truncated").otherwise(""))
    initial = F.coalesce(F.array_position(F.array(*map(F.lit, INITIALS)), F.left("role", F.lit(1))), F.lit(0)).cast("int")
    rows = rows.withColumns({"fault": fault, "initial": F.when(initial == 0, 3).otherwise(initial - 1).cast("int")})
    code = F.when(F.col("fault").isin("blank", "duplicate"), 8).otherwise(
        F.col("initial") + F.when(F.col("fault") == "truncated", 4).otherwise(0)).cast("int")
    return rows.select("_conv", "pos", "conv_id", "turn", "role", "text", "times", "fault", "initial", code.alias("code"))


def _grouped(nodes: DataFrame, fan: int) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct("g", "cost", "rank", "base", "first", "last", "illegal")))
    return nodes.groupBy("_conv", F.floor(F.col("g") / F.lit(fan)).cast("long").alias("p")).agg(items.alias("items"))


def repair(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Repair plan of ``rows(conv_id, turn, role, text, times)``.

    First table: one row per distinct row, ``_conv, pos, conv_id, turn, role, text, times, fault, edit, roles``: its edits with
    the insertions before it (behind the last row also those after it) and the initials of the turns they leave.
    Second table: ``_conv, cost, illegal`` per conversation."""
    spark = rows.sparkSession
    for_python(spark)
    rows = saved(placed(rows), "conv-faults")
    last = rows.agg(F.max("pos")).first()[0]
    items = F.sort_array(F.collect_list(F.struct("pos", "code", "times", "initial")))
    segments = rows.groupBy("_conv", F.floor(F.col("pos") / F.lit(block)).cast("long").alias("g")).agg(items.alias("x"))
    segments = saved(segments.select("_conv", "g", "x.pos", "x.code", "x.times", "x.initial"), "conv-segments")
    levels = [saved(segments.mapInPandas(_segment_sums, SHAPE), "conv-sums")]
    top = 0 if last is None else last // block
    while top:
        nodes = _grouped(levels[-1], fan).withColumnRenamed("p", "g").mapInPandas(_node_sums, SHAPE)
        levels.append(saved(nodes, "conv-sums"))
        top //= fan
    cost = F.transform(F.slice("cost", 1, 4), lambda c, i: F.struct(
        (c + F.element_at(F.array(*map(F.lit, TAIL_COST)), i + 1)).alias("cost"), F.element_at("rank", i + 1).alias("rank"), i.alias("end")))
    best = levels[-1].withColumn("best", F.array_min(cost))
    whole = best.select("_conv", (F.col("best.cost") + F.col("base")).alias("cost"), "illegal")
    ways = best.select("_conv", "g", F.lit(START).alias("entry"), F.col("best.end").alias("end"),
                       F.element_at(F.array(*map(F.lit, TAIL)), F.col("best.end") + 1).alias("tail"))
    for nodes in reversed(levels[:-1]):
        found = _grouped(nodes, fan).join(ways.withColumnRenamed("g", "p"), ["_conv", "p"]).drop("p")
        ways = saved(found.mapInPandas(_node_ways, "_conv string, g long, entry int, end int, tail string"), "conv-ways")
    edits = segments.join(ways, ["_conv", "g"]).select("pos", "code", "times", "entry", "end", "tail").mapInPandas(
        _segment_ways, "pos array<long>, edit array<string>, roles array<string>")
    edits = edits.select(F.inline(F.arrays_zip("pos", "edit", "roles")))
    return rows.drop("initial", "code").join(edits, "pos"), whole


def messages(plan: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, pos, place, role, text``, in the order of (pos, place)."""
    name = F.when(F.col("e") == "K", F.col("role")).when(F.col("r") == "u", "user").otherwise("assistant")
    kept = F.regexp_replace("edit", "D", "")
    turns = F.arrays_zip(F.split(kept, "").alias("e"), F.split("roles", "").alias("r"))
    return (plan.where(F.col("roles") != "").select("conv_id", "pos", "role", "text", F.posexplode(turns).alias("place", "x"))
            .select("conv_id", "pos", "place", "role", "text", "x.e", "x.r")
            .select("conv_id", "pos", "place", name.alias("role"), F.when(F.col("e") == "I", "").otherwise(F.col("text")).alias("text")))


def repair_report(original: DataFrame, rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """One row per conversation of ``original``: what was wrong in ``rows`` and how it was repaired.

    The digest runs over a conversation's rows as a sorted stream, one batch in memory."""
    plan, whole = repair(rows, block, fan)
    plan = saved(plan, "conv-plan")
    first = F.when(F.col("fault") == "", 0).otherwise(1)
    many = F.col("times")
    turns = plan.where("turn IS NOT NULL").groupBy("_conv", "turn").agg(F.lit(1).alias("one")).groupBy("_conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))
    counts = plan.groupBy("_conv").agg(
        F.sum(F.when(F.col("fault") == "blank", many).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "duplicate", many).when(F.col("fault") == "blank", 0).otherwise(many - 1)).alias("duplicate"),
        F.sum(F.when(F.col("fault") == "truncated", first).otherwise(0)).alias("truncated"))
    digests = (plan.select("_conv", "pos", "edit", "roles", "role", "text").repartition("_conv").sortWithinPartitions("_conv", "pos")
               .select("_conv", "edit", "roles", "role", "text").mapInArrow(_digests, "_conv string, audit string, repaired_sha256 string"))
    out = original.select("conv_id").distinct().withColumn("_conv", conversation_key(F.col("conv_id")))
    for part in (turns, counts, whole, digests):
        out = out.join(part, "_conv", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.select("conv_id", *[zero[c].alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
