"""Conversation repair: the solver against a search over all edits, the query against its SQL."""

import hashlib
import heapq
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, differences
from pyspark.sql import functions as F

from streamweave.llm import conversations
from streamweave.llm.registry import ORACLE_SQL

GRAMMAR = re.compile(r"(s?(ua)+)?")


def facts(rows):
    """(role, text, fault) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "none"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def search(rows):
    """(cost, audit, lines) by Dijkstra over what has been said so far, checked against the grammar as a pattern."""
    rows, best, heap = facts(rows), {}, [(0, "", 0, "", ())]
    while heap:
        cost, audit, i, said, lines = heapq.heappop(heap)
        tail = (i, said[-1:] or ("" if not said else "?"), len(said) > 0)
        if best.get(tail, (1 << 30, "")) <= (cost, audit) and tail in best:
            continue
        best[tail] = (cost, audit)
        if i == len(rows) and GRAMMAR.fullmatch(said):
            return cost, audit, lines
        able = lambda x: any(GRAMMAR.fullmatch(x + rest) for rest in ("", "a", "ua"))
        for name in ("user", "assistant"):
            if able(said + name[0]):
                heapq.heappush(heap, (cost + 3, audit + "I", i, said + name[0], (*lines, f"{name}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, said, lines))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                if role[:1] and able(said + role[0]):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, said + role[0], (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if able(said + name[0]):
                        heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, said + name[0], (*lines, f"{name}:{text}")))


def answer(rows, turns):
    found = facts(rows)
    cost, audit, lines = search(rows)
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False))
    number = lambda f: sum(x[2] == f for x in found)
    return gaps, number("blank"), number("duplicate"), number("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(conversations.ALPHABET, max_size=9))
def test_solver_against_search(signature):
    rows, used = [], []
    for i, c in enumerate(signature):
        role, fault = divmod(conversations.ALPHABET.index(c), 4)
        text = {0: f"{i}.", 1: " ", 3: f"{i}"}.get(fault)
        role = ["system", "user", "assistant", "tool"][role]
        if text is None:
            earlier = [r for r in used if r[0] == role]
            if not earlier:
                return
            text = earlier[0][1]
        rows.append((role, text))
        used += [rows[-1]] if text.strip() else []
    cost, audit, _ = search(rows)
    assert conversations.Solver().solve(signature) == (cost, audit)


def test_long_signatures_are_combined_alike():
    import random

    r = random.Random(4)
    for n in (700, 1500):
        s = "".join(r.choice("AEIEIEIMFKH") for _ in range(n))
        best = {0: (0, "")}
        for c in s:  # row by row
            after = {}
            for (a, b), (cost, text) in conversations._row(c).items():
                if a in best:
                    after[b] = min(after.get(b, (1 << 30, "")), (best[a][0] + cost, best[a][1] + text))
            best = after
        ends = [(best[a][0] + c, best[a][1] + t) for (a, b), (c, t) in conversations.INSERTS.items() if b in conversations.FINAL and a in best]
        assert conversations.Solver().solve(s) == min(ends)


def test_query_equals_its_sql(spark):
    for d in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert differences(conversations.op12_conversation_repair(spark, d), connect(d), ORACLE_SQL["op12_conversation_repair"]) == []


def expected(rows, damaged=False):
    groups = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        own = groups.setdefault(conv, [])
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        if draw:
            role = "user" if draw == 4 else role
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            own += [(turn, role, text)] * (2 if draw == 3 else 1)
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
        out[conv] = answer([x[1:] for x in own], [x[0] for x in own])
    return out


ROWS = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Why?"), (1, 2, "assistant", "Because."),
    (2, 0, "user", "One."), (2, 5, "user", "Two"), (2, 5, "user", "Two"), (2, None, "assistant", "Early."), (2, None, None, "Who?"),
    (3, 0, None, None), (3, 1, "", "No role."), (3, 2, "User", "Capital."), (3, 3, "unknown", "Begins with u."),
    (4, None, "user", "  \t"), (4, None, "user", "x"), (None, 1, "user", "Null id."), (None, 2, "assistant", "Yes.\n\n"),
    (5, 3, "assistant", "Ends at a tab.\t\x0b"), (5, 4, "assistant", "Ünï ☃"), (6, 0, "tool", "Long! " * 20_000), (6, 1, "user", "w" * 100_000),
]


def test_rows_as_they_are(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("Audit", F.lit(1)).withColumn("n", F.lit("x")).withColumn("cost", F.lit(None))
    got = {r["conv_id"]: tuple(r[1:]) for r in conversations.repair(df).collect()}
    assert got == expected(ROWS)
    assert conversations.repair(df.limit(0)).count() == 0


def test_damaged_rows(spark, tmp_path):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c % 3} {t % 5}.") for c in range(60) for t in range(c % 9)] + [(c, 0, "user", "Hi.") for c in range(100, 180)] + ROWS
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r[1:]) for r in conversations.op12_conversation_repair(spark, str(tmp_path)).collect()}
    want = expected(rows, True)
    assert got == want
    assert any(v[5:] == (0, "", hashlib.sha256(b"").hexdigest()) for v in want.values())  # one that lost all rows


def test_a_conversation_of_many_pieces(spark):
    rows = [(7, t // 2, ("user", "assistant", "system", "x")[t * t % 7 % 4], f"{t % 611}{'.' if t % 3 else ''}") for t in range(2000)] + [(8, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    own = sorted([r[1:] for r in rows if r[0] == 7], key=lambda x: (x[0], x[1], hashlib.sha256(x[2].encode()).hexdigest()))
    got = {r["conv_id"]: tuple(r[1:]) for r in conversations.repair(df).collect()}
    assert got[7] == answer([x[1:] for x in own], [x[0] for x in own])
    assert got[7][0] == 0
