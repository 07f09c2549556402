"""Conversations repaired at the least cost: cost layers of bitsets of grammar states.

A conversation's roles should read ``(s?(ua)+)?`` by their initials. Edits: Keep
a row (0), Rerole it to user or assistant (3), Delete it (4; blank and repeated
rows must go), Insert a user or assistant turn without text anywhere (3); a
truncated row that stays adds 3. For each cost in turn, a bitset a row says from
which states of the grammar the rest can be repaired at that cost; the first
layer with the start state gives the cost, and a walk along set bits the
cheapest edits that read least as a string of their initials.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.places import numbered

from .common import written

#: White space, as in ``[\x20\x09-\x0D]``.
SPACE = " \t\n\x0b\x0c\r"
#: Rows of a conversation that are solved together; longer ones are composed of stretches.
STRETCH = 64

# states: 0 nothing yet, 1 after the system turn, 2 after user, 3 after assistant; 0 and 3 accept
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_NEXT = ("u", "u", "a", "u")  # the one turn that can be written anew in each state
_ROLE = {"u": "user", "a": "assistant"}
_ACCEPT = (0, None, None, 0)


def _before(initial: str) -> tuple[int, ...]:
    """For each bitset of states, the states that a turn takes into it."""
    return tuple(sum(1 << p for (p, r), q in _STEP.items() if r == initial and into >> q & 1) for into in range(16))


_PRE = {r: _before(r) for r in "sua"} | {"x": (0,) * 16}
_NEW = tuple(u | a for u, a in zip(_PRE["u"], _PRE["a"], strict=True))


def cost_layers(codes: str, ends: tuple, last: bool, wanted: int) -> dict[int, dict[int, int]]:
    """layers[cost][i]: the states from which rows i and later can be repaired at this cost and at no lower one.

    ``codes`` has a pair of letters for each row: its role's initial (``x`` for
    any other) and ``k``, ``t`` (truncated) or ``d`` (must go). ``ends`` has the
    cost of what follows the rows in each state, None where nothing can. Turns
    are inserted behind the last row only where ``last``. Layers end with the
    first that completes the ``wanted`` states at row 0.
    """
    n = len(codes) // 2
    layers: dict[int, dict[int, int]] = {}
    waiting: dict[int, dict[int, int]] = {}

    def put(cost: int, i: int, bits: int) -> None:
        if bits & ~seen[i]:
            layer = waiting.setdefault(cost, {})
            layer[i] = layer.get(i, 0) | bits

    seen = [0] * (n + 1)
    for q, cost in enumerate(ends):
        if cost is not None:
            put(cost, n, 1 << q)
    cost = min(waiting, default=0)
    while waiting and seen[0] & wanted != wanted:
        layer = waiting.get(cost, {})
        for i in range(max(layer, default=-1), -1, -1):
            new = layer.get(i, 0) & ~seen[i]
            if not new:
                continue
            seen[i] |= new
            layers.setdefault(cost, {})[i] = new
            if i < n or last:
                put(cost + 3, i, _NEW[new])
            if i:
                initial, fault = codes[2 * i - 2], codes[2 * i - 1]
                put(cost + 4, i - 1, new)
                if fault != "d":
                    more = 3 if fault == "t" else 0
                    put(cost + more, i - 1, _PRE[initial][new])
                    put(cost + more + 3, i - 1, _NEW[new])
        waiting.pop(cost, None)
        cost += 1
    return layers


def first_cost(layers: dict[int, dict[int, int]], state: int) -> int | None:
    return next((c for c in sorted(layers) if layers[c].get(0, 0) >> state & 1), None)


def trace(codes: str, layers: dict[int, dict[int, int]], ends: tuple, last: bool, state: int) -> tuple[str, int]:
    """The edits that read least among the cheapest from ``state`` at row 0, and the state behind them."""
    n, cost = len(codes) // 2, first_cost(layers, state)
    out: list[str] = []
    on = lambda c, i, q: layers.get(c, {}).get(i, 0) >> q & 1
    i = 0
    while i < n or ends[state] != cost:
        initial, fault = (codes[2 * i], codes[2 * i + 1]) if i < n else ("x", "d")
        more = 3 if fault == "t" else 0
        anew, kept = _STEP[state, _NEXT[state]], _STEP.get((state, initial))
        if i < n and on(cost - 4, i + 1, state):
            letter, cost, i = "D", cost - 4, i + 1
        elif (i < n or last) and on(cost - 3, i, anew):
            letter, cost, state = "I", cost - 3, anew
        elif fault != "d" and kept is not None and on(cost - more, i + 1, kept):
            letter, cost, i, state = "K", cost - more, i + 1, kept
        else:
            letter, cost, i, state = "R", cost - more - 3, i + 1, anew
        out.append(letter)
    return "".join(out), state


def replayed(codes: str, audit: str, state: int) -> Iterator[tuple[int | None, str | None]]:
    """(row or None, new role or None) of each turn that the edits leave."""
    i = 0
    for letter in audit:
        if letter in "RI":
            yield (i if letter == "R" else None), _ROLE[_NEXT[state]]
            state = _STEP[state, _NEXT[state]]
        elif letter == "K":
            yield i, None
            state = _STEP[state, codes[2 * i]]
        i += letter != "I"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by crc32 of ``conv_id:turn`` modulo 20; nulls read as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    at = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    cut = rows.select("conv_id", "turn", space("role").alias("_role"), space("text").alias("_text"), at.alias("_at")).where("_at <> 0")
    text = F.when(F.col("_at") == 1, "").when(F.col("_at") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    role = F.when(F.col("_at") == 4, "user").otherwise(F.col("_role"))
    times = F.when(F.col("_at") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return cut.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")).drop("_copy")


def _solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Conversations of one stretch."""
    for f in frames:
        out = []
        for codes in f["codes"]:
            layers = cost_layers(codes, _ACCEPT, True, 1)
            out.append((0, first_cost(layers, 0), trace(codes, layers, _ACCEPT, True, 0)[0]))
        yield pd.concat([f[["conv", "stretch", "codes"]].reset_index(drop=True), pd.DataFrame(out, columns=["state", "cost", "audit"])], axis=1)


def _matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The costs of a stretch from each state to each state behind it; of the last stretch, to acceptance."""
    for f in frames:
        out = []
        for codes, last in zip(f["codes"], f["last"], strict=True):
            to = [_ACCEPT] if last else [tuple(0 if p == q else None for p in range(4)) for q in range(4)]
            found = [cost_layers(codes, ends, last, 15) for ends in to]
            out.append([first_cost(layers, p) for layers in found for p in range(4)])
        yield pd.DataFrame({"conv": f["conv"], "stretch": f["stretch"], "costs": out})


def _composed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What follows each stretch costs, from the last to the first."""
    for f in frames:
        rows = []
        for conv, stretches in zip(f["conv"], f["stretches"], strict=True):
            after: list = list(_ACCEPT)
            for s in reversed(list(stretches)):
                rows.append((conv, s["stretch"], after))
                costs = [None if pd.isna(c) else int(c) for c in s["costs"]]
                if len(costs) == 4:
                    after = costs
                else:
                    ways = [[(costs[4 * q + p], after[q]) for q in range(4)] for p in range(4)]
                    after = [min((a + b for a, b in way if a is not None and b is not None), default=None) for way in ways]
        yield pd.DataFrame(rows, columns=["conv", "stretch", "ends"])


def _traced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The edits of a stretch from each state before it."""
    for f in frames:
        out = []
        for codes, last, ends in zip(f["codes"], f["last"], f["ends"], strict=True):
            ends = tuple(None if pd.isna(e) else int(e) for e in ends)
            layers = cost_layers(codes, ends, last, 15)
            costs = [first_cost(layers, q) for q in range(4)]
            ways = [trace(codes, layers, ends, last, q) if costs[q] is not None else (None, None) for q in range(4)]
            out.append((costs, [a for a, _ in ways], [q for _, q in ways]))
        yield pd.concat([f[["conv", "stretch", "codes"]].reset_index(drop=True), pd.DataFrame(out, columns=["costs", "audits", "exits"])], axis=1)


def _chained(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state before each stretch, from the first to the last."""
    for f in frames:
        rows = []
        for conv, stretches in zip(f["conv"], f["stretches"], strict=True):
            state = 0
            for s in stretches:
                rows.append((conv, s["stretch"], state))
                state = int(s["exits"][state])
        yield pd.DataFrame(rows, columns=["conv", "stretch", "state"])


def _turns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [
            (conv, stretch, at, None if i is None else stretch * STRETCH + i + 1, role)
            for conv, stretch, codes, audit, state in f[["conv", "stretch", "codes", "audit", "state"]].itertuples(index=False)
            for at, (i, role) in enumerate(replayed(codes, audit, state))
        ]
        yield pd.DataFrame(rows, columns=["conv", "stretch", "at", "place", "role"]).astype({"place": "Int64"})


class Repair:
    """Repaired conversations, from rows of (conv_id, turn, role, text); further columns are not looked at.

    Rows are taken by turn, nulls first, ties by role and then by the SHA-256 of
    role and text. Null roles and texts read as one space, which is blank. A null
    conv_id is a conversation. Turns are whole numbers. No task holds a whole
    conversation's rows: they are numbered in ranges, solved in stretches of 64
    rows, and stretches meet as tables of four states.
    """

    def __init__(self, rows: DataFrame):
        space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
        conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv")
        self.rows = written(rows.select("conv_id", conv, "turn", space("role"), space("text"), F.monotonically_increasing_id().alias("row")), "turns")
        trimmed = F.rtrim("text", F.lit(SPACE))
        facts = self.rows.select(
            "conv",
            "turn",
            "role",
            F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"),
            (trimmed == "").alias("is_blank"),
            (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("is_cut"),
            "row",
        )
        placed = numbered(facts, ["conv"], [F.col("turn"), F.col("role"), F.col("said")], total="of")
        firsts = placed.groupBy("conv", "said").agg(F.min("place").alias("place"), F.lit(True).alias("is_first"))
        # the key holds the place, so the copies of one turn are spread
        judged = placed.join(firsts, ["conv", "said", "place"], "left")
        fault = F.when(F.col("is_blank"), "b").when(F.col("is_first").isNull(), "d").when(F.col("is_cut"), "t").otherwise("k")
        initial = F.left("role", F.lit(1))
        self.places = written(
            judged.select(
                "conv", "row", "place", "turn", fault.alias("fault"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
                F.expr(f"(place - 1) div {STRETCH}L").alias("stretch"), (F.expr(f"(of - 1) div {STRETCH}L") == F.expr(f"(place - 1) div {STRETCH}L")).alias("last"),
            ),
            "turn-places",
        )
        code = F.concat("initial", F.when(F.col("fault") == "b", "d").otherwise(F.col("fault")))
        self.stretches = written(
            self.places.groupBy("conv", "stretch", "last").agg(
                F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", code.alias("code")))), lambda x: x["code"]), "").alias("codes"),
                *[F.count_if(F.col("fault") == f).alias(name) for f, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))],
                F.min(F.col("turn").cast("long")).alias("low"),
                F.max(F.col("turn").cast("long")).alias("high"),
                F.size(F.collect_set("turn")).cast("long").alias("distinct"),
            ),
            "stretches",
        )
        self.edits = written(self._edits(), "edits")

    def _edits(self) -> DataFrame:
        """(conv, stretch, codes, state, cost, audit): the edits of each stretch from the state before it; the cost is of this stretch and all behind it."""
        columns = "conv string, stretch long, codes string"
        short = self.stretches.where("last AND stretch = 0").select("conv", "stretch", "codes")
        solved = short.mapInPandas(_solved, f"{columns}, state int, cost long, audit string")
        long = self.stretches.where("NOT (last AND stretch = 0)").select("conv", "stretch", "codes", "last")
        listed = lambda df, *c: df.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("stretch", *c))).alias("stretches"))
        costs = listed(long.mapInPandas(_matrices, "conv string, stretch long, costs array<long>"), "costs")
        ends = costs.mapInPandas(_composed, "conv string, stretch long, ends array<long>")
        traced = written(
            long.join(ends, ["conv", "stretch"]).mapInPandas(_traced, f"{columns}, costs array<long>, audits array<string>, exits array<int>"), "traced"
        )
        states = listed(traced, "exits").mapInPandas(_chained, "conv string, stretch long, state int")
        at = lambda c: F.get(c, F.col("state")).alias(c[:-1])
        chained = traced.join(states, ["conv", "stretch"]).select("conv", "stretch", "codes", "state", at("costs"), at("audits"))
        return solved.unionByName(chained)

    def turns(self) -> DataFrame:
        """(conv, stretch, at, role, text): the repaired turns, in order of stretch and ``at``."""
        plan = self.edits.mapInPandas(_turns, "conv string, stretch long, at int, place long, role string")
        kept = plan.where("place IS NOT NULL").join(self.places.select("conv", "place", "row"), ["conv", "place"])
        texts = self.rows.select("row", F.col("role").alias("was"), "text")
        kept = kept.join(texts, "row").select("conv", "stretch", "at", F.coalesce("role", "was").alias("role"), "text")
        return kept.unionByName(plan.where("place IS NULL").select("conv", "stretch", "at", "role", F.lit("").alias("text")))

    def summary(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): a row for each conversation.

        A stretch's turns become one text. Where it is the whole conversation, its
        hash goes on instead of it; the texts of a longer one pass in order
        through one hash, a batch at a time.
        """
        line = F.concat("role", F.lit(":"), "text")
        texts = self.turns().groupBy("conv", "stretch").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]), "\n").alias("text")
        )
        told = self.stretches.join(self.edits.select("conv", "stretch", "cost", "audit"), ["conv", "stretch"]).join(texts, ["conv", "stretch"], "left")
        alone = F.col("last") & (F.col("stretch") == 0) & F.col("text").isNotNull()
        told = told.withColumn("sha", F.when(alone, F.sha2(F.col("text").cast("binary"), 256))).withColumn("text", F.when(~alone, F.col("text")))
        told = told.repartition("conv").sortWithinPartitions("conv", "stretch").mapInArrow(_summed, SUMMARY)
        ids = self.rows.groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
        return ids.join(told, "conv").drop("conv")


SUMMARY = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LEGAL = {"su", "ua", "au"}


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, from its stretches in order; a conversation may span batches."""
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    now: dict = {}

    def closed() -> dict:
        span = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["distinct"]
        return {n: now.get(n) for n in names} | {"gaps": span, "audit": "".join(now["audits"]), "repaired_sha256": now["sha"] or now["hash"].hexdigest()}

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            initials = r["codes"][::2]
            if now and now["conv"] != r["conv"]:
                out.append(closed())
                now = {}
            if not now:
                now = {"conv": r["conv"], "cost": r["cost"], "low": None, "high": None, "sha": r["sha"], "hash": hashlib.sha256(), "text": False, "audits": [], "end": ""}
                now |= dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "distinct"), 0)
            for n in ("blank", "duplicate", "truncated"):
                now[n] += r[n]
            pairs = now["end"] + initials
            now["illegal"] += sum(pairs[i : i + 2] not in _LEGAL for i in range(len(pairs) - 1))
            now["end"] = initials[-1]
            if r["low"] is not None:
                now["distinct"] += r["distinct"] - (r["low"] == now["high"])
                now["low"], now["high"] = r["low"] if now["low"] is None else now["low"], r["high"]
            now["audits"].append(r["audit"])
            if r["text"] is not None:
                now["hash"].update((("\n" if now["text"] else "") + r["text"]).encode("utf-8"))
                now["text"] = True
        if out:
            yield pa.RecordBatch.from_pylist(out, _SUMMARY)
    if now:
        yield pa.RecordBatch.from_pylist([closed()], _SUMMARY)


_SUMMARY = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (c.split() for c in SUMMARY.split(", "))])


def repaired(rows: DataFrame, every: DataFrame) -> DataFrame:
    """The summary of each conversation of ``every`` (conv_id, each once); one without rows has zeros, no edits and the hash of no text.

    An empty table gives no rows.
    """
    told = Repair(rows).summary().withColumnRenamed("conv_id", "_id")
    out = every.join(told, every["conv_id"].eqNullSafe(told["_id"]), "left")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        every["conv_id"], *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    )
