"""Conversation repair against a plain search over edit strings."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evalcrate.llm import conversations as C

ROWS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def plain(rows):
    """Everything about one conversation's rows [(turn, role, text)], in order: states with their least (cost, audit, lines)."""
    seen, faults = set(), []
    for _, role, text in rows:
        mark = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not mark else "duplicate" if (role, text) in seen else "truncated" if mark[-1] not in ".!?" else "")
        seen.add((role, text))

    def add(best, key, way):
        if key not in best or way < best[key]:
            best[key] = way

    def insert(best):
        for _ in range(3):
            for done, (cost, audit, lines) in list(best.items()):
                name = "assistant" if done == "u" else "user"
                add(best, name[0], (cost + 3, audit + "I", lines + ((name, ""),)))
        return best
    best = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for done, (cost, audit, lines) in insert(best).items():
            add(new, done, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            late = 3 if fault else 0
            follows = "a" if done == "u" else "u"
            if role[:1] == follows or (role[:1] == "s" and done == ""):
                add(new, role[:1], (cost + late, audit + "K", lines + ((role, text),)))
            add(new, follows, (cost + late + 3, audit + "R", lines + (({"u": "user", "a": "assistant"}[follows], text),)))
        best = new
    cost, audit, lines = min(way for done, way in insert(best).items() if done in ("", "a"))
    assert LEGAL.match("".join(r[0] for r, _ in lines))
    initials = [r[:1] or " " for _, r, _ in rows]
    turns = [t for t, _, _ in rows if t is not None]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(), lines)


def cases():
    rng = random.Random(11)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "Ü"]
    texts = ["Yes.", "No!", "cut", "", " \t", "Why?", "a\nb.", "x. \n"]
    rows = []
    for conv in range(120):
        for turn in range(rng.choice([1, 2, 4, 8, 40])):
            turn = rng.choice([None, turn, turn, turn, turn + 3])
            rows.append((conv if conv else None, turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.random()}."))
    return rows + rows[:30]


@pytest.mark.parametrize("block,fan", [(1024, 1024), (3, 2), (1, 2)])
def test_repair_brute_force(spark, block, fan):
    rows = cases()
    df = spark.createDataFrame(rows, ROWS).withColumns({"pos": F.lit("x"), "_conv": F.lit(1), "code": F.lit(2)})
    given = df.withColumn("times", F.lit(1))
    got = {r.conv_id: tuple(r)[1:] for r in C.repair_report(df, given, block, fan).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role, text))
    assert set(got) == set(by)
    for conv, items in by.items():
        items.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        assert got[conv] == plain(items)[:-1], conv


def test_messages_and_long_texts(spark):
    rows = [(1, 0, "user", "x" * 200_000 + "."), (1, 1, "user", "Then?"), (2, 0, "assistant", "Hi."), (3, 0, "user", "   "),
            (4, 5, "system", "S."), (4, 9, "user", "q?")]
    plan, whole = C.repair(spark.createDataFrame(rows, ROWS).withColumn("times", F.lit(2)))
    got = defaultdict(list)
    for r in C.messages(plan).orderBy("pos", "place").collect():
        got[r.conv_id].append((r.role, r.text))
    for conv in (1, 2, 3, 4):
        items = [(t, r, x) for c, t, r, x in rows if c == conv for _ in range(2)]
        assert tuple(got[conv]) == plain(items)[-1]
    assert {r._conv: r.cost for r in whole.collect()}["=3"] == 8


def test_damage(spark):
    rows = [(c, t, "assistant", "a.b!c?") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    import zlib
    got = defaultdict(list)
    for r in C.damaged(spark.createDataFrame(rows, ROWS)).collect():
        got[r.conv_id, r.turn].append((r.role, r.text, r.times))
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want = {0: [], 1: [(role, "", 1)], 2: [(role, "abc" if c is not None else " ", 1)], 3: [(role, text, 2)],
                4: [("user", text, 1)]}.get(fate, [(role, text, 1)])
        assert got[c, t] == want


def test_empty_and_dropped(spark):
    empty = spark.createDataFrame([], ROWS)
    assert C.repair_report(empty, C.damaged(empty)).collect() == []
    one = spark.createDataFrame([(7, 1, "user", "a.")], ROWS)
    assert [tuple(r) for r in C.repair_report(one, C.damaged(one).where("false")).collect()] == [
        (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_ranks_give_the_least_string():
    """Products of row matrices, in any grouping, against all edit strings."""
    rng = random.Random(3)
    for _ in range(300):
        codes = [rng.choice([0, 1, 2, 3, 4, 5, 6, 7, 8]) for _ in range(rng.randint(1, 6))]
        whole = C.product(C.Rows(codes))
        parts, at = [], 0
        while at < len(codes):
            n = rng.randint(1, 3)
            cost, rank = C.product(C.Rows(codes[at:at + n]))
            parts.append((tuple(cost), tuple(rank)))
            at += n
        again = C.product(C.Matrices(parts))
        assert whole[0] == again[0]
        for a in range(4):
            order = [whole[1][a * 4 + b] for b in range(4) if whole[0][a * 4 + b] < C.INF]
            assert order == [again[1][a * 4 + b] for b in range(4) if whole[0][a * 4 + b] < C.INF]
