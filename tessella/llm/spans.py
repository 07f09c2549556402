"""Spans of regular-expression matches as SQL expressions, without Python code.

``split`` yields the pieces between matches and ``regexp_extract_all`` the
matches; their lengths, added up in turn, give offsets in code points. The
expressions are written as SQL text: they are large, and building them out of
columns costs seconds on the driver.

Patterns must hold no group under a greedy or lazy quantifier: Java's engine
calls itself once per repeat of such a group and overflows the stack on long
texts. A possessive quantifier (``(?:...)++``) loops instead, and matches the
same text wherever nothing that follows could make the loop give something back.
A pattern that scans a run of characters before it can fail should start at the
run's beginning or where the match before ended (``\\G``), so that every
character is looked at a bounded number of times.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
#: As ``SPAN``, with what stands before (at most ``CONTEXT`` characters) and after (at most one), up to the neighbouring matches.
FRAMED = "array<struct<kind:string,start:int,end:int,value:string,before:string,after:string>>"
CONTEXT = 24
#: Matches that are walked at a time.
CHUNK = 128


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for the value of an expression, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def matches(text: str, kind: str, pattern: str, holds: str | None = None, framed: bool = False) -> str:
    """SQL for the leftmost non-overlapping matches of ``pattern`` as an array of (kind, start, end, value), or with ``framed`` with their surroundings.

    A match is dropped where ``holds``, a condition on ``v``, is not true. An
    array is copied when a span is appended to it, so the matches are walked in
    chunks and the chunks are joined at the end: a text of many matches costs
    about its length.
    """
    array, p = (FRAMED if framed else SPAN), quoted(pattern)
    before = f", 'before', right(p, {CONTEXT})" if framed else ""
    # the last piece has no match behind it
    step = f"zip_with(slice(pieces, 1, greatest(size(pieces) - 1, 0)), regexp_extract_all({text}, {p}, 0), (p, v) -> named_struct('gap', length(p), 'value', v{before}))"
    if framed:
        step = f"zip_with({step}, slice(pieces, 2, size(pieces)), (x, p) -> named_struct('gap', x.gap, 'value', x.value, 'before', x.before, 'after', left(p, 1)))"
    step = let(f"split({text}, {p}, -1)", "pieces", step)
    frame = ", 'before', x.before, 'after', x.after" if framed else ""
    span = f"named_struct('kind', '{kind}', 'start', a.at + x.gap, 'end', a.at + x.gap + length(x.value), 'value', x.value{frame})"
    out = f"concat(a.out, array({span}))"
    if holds is not None:
        out = f"CASE WHEN {let('x.value', 'v', holds)} THEN {out} ELSE a.out END"
    walk = f"named_struct('at', a.at + x.gap + length(x.value), 'out', {out})"
    own = f"aggregate(chunk, named_struct('at', w.at, 'out', CAST(array() AS {array})), (a, x) -> {walk})"
    joined = let(own, "own", "named_struct('at', own.at, 'out', concat(w.out, array(own.out)))")
    start = f"named_struct('at', 0, 'out', CAST(array() AS array<{array}>))"
    walked = f"aggregate({chunks(step, CHUNK)}, {start}, (w, chunk) -> {joined}, w -> flatten(w.out))"
    return f"CASE WHEN {text} RLIKE {p} THEN {walked} ELSE CAST(array() AS {array}) END"


def chunks(array: str, size: int) -> str:
    """SQL for an array cut into arrays of ``size`` elements; the last may be shorter."""
    return let(array, "whole", f"CASE WHEN size(whole) > 0 THEN transform(sequence(1, size(whole), {size}), at -> slice(whole, at, {size})) ELSE array(whole) END")


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` by start, then the kinds in the order given, comma-joined."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.element_at(rank, s["kind"]).alias("b"), s["end"].alias("c"), s["kind"].alias("d")))
    return F.array_join(F.transform(F.sort_array(keyed), lambda s: F.concat_ws(":", s["d"], s["a"].cast("string"), s["c"].cast("string"))), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
