"""Repaired conversations against a plain search that orders by cost and then by the edits' letters."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from tessella.llm import conversations
from tessella.llm.conversations import STRETCH, damaged, repaired

SCHEMA = "conv_id long, turn long, role string, text string"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
BLANK = " \t\n\x0b\x0c\r"


def harmed(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        at = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if at:
            text = "" if at == 1 else re.sub("[.!?]", "", text) if at == 2 else text
            out += [(conv, turn, "user" if at == 4 else role, text)] * (2 if at == 3 else 1)
    return out


def expected(rows):
    """The row of one conversation; ``rows`` in order."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(BLANK)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, state, inserted):
        """(cost, audit, lines) of rows i and later."""
        ways = []
        if i == len(rows) and state in (0, 3):
            ways.append((0, "", ()))
        if inserted < 3:
            r = "a" if state == 2 else "u"
            c, a, lines = best(i, STEP[state, r], inserted + 1)
            ways.append((c + 3, "I" + a, (("user:" if r == "u" else "assistant:"), *lines)))
        if i < len(rows):
            role, text = rows[i][2:]
            c, a, lines = best(i + 1, state, 0)
            ways.append((c + 4, "D" + a, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                if (state, role[:1]) in STEP:
                    c, a, lines = best(i + 1, STEP[state, role[:1]], 0)
                    ways.append((c + more, "K" + a, (f"{role}:{text}", *lines)))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if (state, r) in STEP:
                        c, a, lines = best(i + 1, STEP[state, r], 0)
                        ways.append((c + more + 3, "R" + a, (f"{name}:{text}", *lines)))
        return min(ways, default=(10**9, "", ()))

    for i in range(len(rows), -1, -1):  # fills the cache without deep recursion
        for s in range(4):
            for k in (3, 2, 1, 0):
                best(i, s, k)
    cost, audit, lines = best(0, 0, 0)
    turns = [t for _, t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:], strict=False)]
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    illegal = sum(p not in ("su", "ua", "au") for p in pairs)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def all_expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], [])
    for r in harmed(rows):
        by[r[0]].append(r)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest())
    return {conv: expected(sorted(mine, key=order)) for conv, mine in by.items()}


def made(seed, n_convs, lengths):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "cut off", "", " \n", "Fine. ", "naïve 😀", "ok.\t"]
    roles = ["user", "assistant"] * 5 + ["system", "tool", "", None, "u", "System"]
    rows = []
    for conv in range(n_convs):
        for turn in range(rng.choice(lengths)):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.5 else f"turn {turn}" + rng.choice(".!?,")
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, rng.choice([text, text, text, None])))
    return rows


def run(spark, rows, partitions=3):
    given = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = repaired(damaged(given), given.select("conv_id").distinct()).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_short_conversations(spark):
    rows = made(1, 300, range(1, 9)) + [(None, 0, "user", "Hi."), (None, None, "assistant", "Yes."), (None, 4, None, None)]
    assert run(spark, rows) == all_expected(rows)


def test_long_conversations_are_composed_of_stretches(spark, monkeypatch):
    rows = made(2, 12, [STRETCH - 1, STRETCH, STRETCH + 1, 3 * STRETCH, 5 * STRETCH + 7])
    rows += [(50, i, "user", "x" + "." * (i % 3)) for i in range(4 * STRETCH)] + [(51, None, "user", "same.")] * 200
    assert run(spark, rows, 7) == all_expected(rows)


def test_all_rows_lost_and_no_rows(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert run(spark, [(lost, 0, "user", "Hi.")]) == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    given = spark.createDataFrame([], SCHEMA)
    assert repaired(damaged(given), given.select("conv_id")).count() == 0


def test_one_very_long_turn_and_clashing_columns(spark):
    rows = [(1, 0, "user", "w " * 1_000_000 + "."), (1, 1, "assistant", "." * 1_000_000 + " " * 1_000_000), (2, 0, "system", "a.")]
    given = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", conv string, place string")
    got = {r.conv_id: tuple(r)[1:] for r in repaired(damaged(given), given.select("conv_id").distinct()).collect()}
    assert got == all_expected(rows)


def test_stretches_meet_as_one(monkeypatch):
    rng = random.Random(5)
    for _ in range(400):
        codes = "".join(rng.choice("suax") + rng.choice("kkktd") for _ in range(rng.randrange(0, 9)))
        accept = conversations._ACCEPT
        whole = conversations.cost_layers(codes, accept, True, 15)
        cut = 2 * rng.randrange(0, len(codes) // 2 + 1)
        tail = conversations.cost_layers(codes[cut:], accept, True, 15)
        ends = tuple(conversations.first_cost(tail, q) for q in range(4))
        head = conversations.cost_layers(codes[:cut], ends, False, 15)
        for q in range(4):
            assert conversations.first_cost(whole, q) == conversations.first_cost(head, q)
            one, exit_ = conversations.trace(codes[:cut], head, ends, False, q)
            assert one + conversations.trace(codes[cut:], tail, accept, True, exit_)[0] == conversations.trace(codes, whole, accept, True, q)[0]


def test_registered_query(spark):
    import duckdb

    queries = pytest.importorskip("tessella.llm.queries").queries()
    rows = [tuple(r) for r in duckdb.sql("SELECT conv_id, turn, role, text FROM read_parquet('/root/testdata/sf0.001/conversations.parquet')").fetchall()]
    got = {r.conv_id: tuple(r)[1:] for r in queries["op13_conversation_repair"](spark, "/root/testdata/sf0.001").collect()}
    assert got == all_expected(rows)
