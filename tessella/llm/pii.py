"""Personal data by candidate generation and gradient boosting, in DataFrame functions only.

Strict patterns with checks (octets, Luhn, digit counts) give the base spans,
which always stay. High-recall generators propose more, overlapping spans:
marks that are spelled out, other separators, a missing plus, a number that
stands beside another one. Each candidate gets features of its format (form,
number of digits, whether the value passes its kind's check once it is brought
to plain form) and of its context.

No labels of personal data exist, so the examples are made from the corpus, and
none is a span that the result can contain:

- Every base span, in its own context, is written in one of the forms of its
  kind (``FORMS``, by hash) as a positive example, and with a digit or an end
  spoilt in one of the forms as a negative one.
- A few made-up values (``SEEDS``) in all their forms, right and spoilt, so that
  a corpus without base spans can be learned from, too.
- A candidate that overlaps no base span and fails its check is a negative
  example. Where look-alikes pass the check by chance (one card number in ten),
  one in nine of the failing ones counts as such a look-alike, too (``CHANCE``).

Depth-two trees are boosted on the counts of all feature combinations. The
threshold of each kind is the lowest score with the wanted precision on held-out
examples (a third, by hash of the value). Candidates of that score which overlap
no base span are added; of a run of overlapping ones the best score wins (ties:
first, longest).

Null and empty texts have no spans. Rows are judged one by one, so repeated rows
and repeated or null ids do not matter, nor do other columns. Very long texts
cost about their length.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import boosting, spans
from .common import whole, written

BASE_KINDS = ("email", "ip", "card", "phone")
# The base patterns, in the order in which kinds are listed, in forms that take linear time (see ``spans``).
EMAIL = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9](?:[\\x20-]?[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"

#: How the marks of a mail address and of an address in figures can be written.
AT = "\\x20{0,2}(?:@|[(\\[{](?i:at)[)\\]}])\\x20{0,2}"
DOT = "(?:\\.|\\x20?[(\\[{](?i:dot|\\.)[)\\]}]\\x20?)"
#: Generators of candidates: (kind, cheap test, pattern). They propose more than is true, and those of one kind may overlap.
GENERATORS = (
    ("email", "[(\\[{](?i:at)[)\\]}]|\\x20@|@\\x20", f"(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++"),
    ("ip", "[0-9][.)\\]}\\x20]", f"(?<![0-9A-Za-z.])[0-9]{{1,4}}{DOT}[0-9]{{1,4}}{DOT}[0-9]{{1,4}}{DOT}[0-9]{{1,4}}(?![0-9A-Za-z])"),
    ("card", "[0-9]{13}", "(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])"),
    ("card", "[0-9]{4}[\\x20._-][0-9]{4}", "(?<![0-9A-Za-z])[0-9]{4}[\\x20._-][0-9]{4}[\\x20._-][0-9]{4}[\\x20._-][0-9]{2,4}(?![0-9A-Za-z])"),
    ("phone", "[+0][0-9]", "(?<![0-9A-Za-z+])(?:\\+|00)[0-9]{1,3}[\\x20./-]?\\(?[0-9]{2,4}\\)?[\\x20./-]?[0-9]{2,4}[\\x20./-]?[0-9]{2,4}(?![0-9A-Za-z])"),
    ("phone", "[0-9]{3}[)\\x20./-]", "(?<![0-9A-Za-z+.])\\(?[0-9]{3}\\)?[\\x20./-]{1,2}[0-9]{3}[\\x20./-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"),
)
KINDS = (*BASE_KINDS, *(f"loose_{k}" for k in BASE_KINDS))
FEATURES = ("kind", "form", "valid", "digits", "before", "after", "cue")
#: How many failing look-alikes there are for one that passes the check by chance.
CHANCE = {"card": 9}


def luhn(digits: str) -> str:
    """SQL: does a string of digits pass the Luhn check."""
    doubled = "CASE WHEN (length(d) - i) % 2 = 1 THEN int(c) WHEN int(c) > 4 THEN int(c) * 2 - 9 ELSE int(c) * 2 END"
    return spans.let(digits, "d", f"aggregate(transform(filter(split(d, ''), c -> c <> ''), (c, i) -> {doubled}), 0, (a, x) -> a + x) % 10 = 0")


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _octets(value: str) -> str:
    return f"forall(split({value}, '[.]'), o -> coalesce(try_cast(o AS bigint) <= 255, false))"


#: Checks of the base kinds, as SQL on a match ``v``.
CHECKS = {
    "email": None,
    "ip": _octets("v"),
    "card": f"length(v) BETWEEN 14 AND 37 AND length({_digits('v')}) BETWEEN 14 AND 19 AND {luhn(_digits('v'))}",
    "phone": f"length({_digits('v')}) BETWEEN 10 AND 15",
}


def base_spans(text: str, kind: str, framed: bool = False) -> str:
    """SQL for the checked spans of a base kind; a failed match is dropped and not retried inside."""
    found = spans.matches(text, kind, {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}[kind], CHECKS[kind], framed)
    return f"CASE WHEN contains({text}, '@') THEN {found} ELSE CAST(array() AS {spans.FRAMED if framed else spans.SPAN}) END" if kind == "email" else found


def plain(kind: str, value: str) -> str:
    """SQL for a value of any form in the plain form of its kind."""
    if kind in ("card", "phone"):
        return _digits(value)
    dots = f"regexp_replace({value}, {spans.quoted(DOT)}, '.')"
    return dots if kind == "ip" else f"lower(regexp_replace({dots}, {spans.quoted(AT)}, '@'))"


#: Does a value ``p`` in plain form pass the check of its kind.
VALID = {
    "email": f"p RLIKE {spans.quoted('^[a-z0-9._%+-]++@(?:[a-z0-9-]++[.])++[a-z]{2,}$')}",
    "ip": _octets("p"),
    "card": f"length(p) BETWEEN 13 AND 19 AND {luhn('p')}",
    "phone": "length(p) BETWEEN 10 AND 15",
}


def _first_like(column: str, *cases: tuple[str, str]) -> str:
    """SQL for the name of the first pattern that ``column`` holds, or "none"."""
    return "CASE " + " ".join(f"WHEN {column} RLIKE {spans.quoted(pattern)} THEN '{name}'" for pattern, name in cases) + " ELSE 'none' END"


CLASSES = (("^$", "edge"), ("[\\x20\\x09-\\x0D]", "space"), ("[0-9]", "digit"), ("[\\p{L}_]", "letter"), ("[.,;:!?)\\]\"']", "stop"))
MARKS = (("[(\\[{](?i:at|dot|\\.)[)\\]}]", "spelled"), ("@", "at"), ("^\\+", "plus"), ("^00", "zeros"), ("[(]", "bracket"), ("[-/]", "dash"), ("[.]", "dot"), ("[\\x20_]", "space"))
CUES = (
    ("mail|contact", "mail"),
    ("tel|phone|call|fax|mobil", "phone"),
    ("card|visa|pay|iban", "card"),
    ("host|addr|server|\\bip\\b", "net"),
    ("ver|rev|no\\.|id|isbn|order", "number"),
)


def _features(kind: str, x: str) -> str:
    """SQL for the features of ``x``, a struct with value, before and after, as arguments of ``named_struct``."""
    size = "CASE WHEN n < 7 THEN 'few' WHEN n < 10 THEN '7-9' WHEN n < 13 THEN '10-12' WHEN n < 16 THEN '13-15' WHEN n = 16 THEN '16' ELSE 'many' END"
    return ", ".join(
        (
            f"'kind', '{kind}'",
            f"'form', {_first_like(f'{x}.value', *MARKS)}",
            f"'valid', CASE WHEN {spans.let(plain(kind, f'{x}.value'), 'p', VALID[kind])} THEN 'yes' ELSE 'no' END",
            f"'digits', {spans.let(f'length({_digits(f"{x}.value")})', 'n', size)}",
            f"'before', {spans.let(f'right({x}.before, 1)', 'b', _first_like('b', *CLASSES))}",
            f"'after', {_first_like(f'{x}.after', *CLASSES)}",
            f"'cue', {spans.let(f'lower({x}.before)', 'b', _first_like('b', *CUES))}",
        )
    )


#: Ways to write a checked value ``v`` of each kind, as SQL; the first as it is.
FORMS = {
    "email": ("v", "replace(replace(v, '@', ' (at) '), '.', ' (dot) ')", "replace(replace(v, '@', '[at]'), '.', '[dot]')", "replace(v, '@', ' @ ')"),
    "ip": ("v", "replace(v, '.', '[.]')", "replace(v, '.', '(dot)')"),
    "card": ("v", _digits("v"), *(f"regexp_replace({_digits('v')}, '([0-9]{{4}})(?=[0-9])', '$1{mark}')" for mark in (" ", "-", "."))),
    "phone": ("v", "replace(v, '+', '00')", "replace(v, '+', '')", "regexp_replace(v, '[^0-9+]+', '.')", "regexp_replace(replace(v, '+', ''), '[^0-9]+', '-')"),
}
#: A checked value ``v`` that no longer passes, as SQL: a domain that ends in digits, a first octet too large, another last digit, too few digits.
SPOILT = {
    "email": "regexp_replace(v, '[A-Za-z0-9-]+$', '12')",
    "ip": "regexp_replace(v, '^[0-9]+', '777')",
    "card": "concat(left(v, length(v) - 1), string(pmod(int(right(v, 1)) + 5, 10)))",
    "phone": "left(v, greatest(length(v) - 6, 2))",
}


def _examples(kind: str, checked: str) -> str:
    """SQL for a positive and a negative example from every checked span of one kind."""
    picked = lambda salt: f"CASE pmod(xxhash64({salt}, v), {len(FORMS[kind])}) " + " ".join(f"WHEN {k} THEN {form}" for k, form in enumerate(FORMS[kind])) + " END"
    side = lambda v, y: f"named_struct('value', {v}, 'before', s.before, 'after', s.after, 'held', pmod(xxhash64(5, s.value), 3) = 0, 'y', {y})"
    true, false = spans.let("s.value", "v", picked(1)), spans.let(spans.let("s.value", "v", SPOILT[kind]), "v", picked(2))
    values = f"flatten(transform({checked}, s -> array({side(true, 1)}, {side(false, 0)})))"
    return f"transform({values}, x -> named_struct({_features(kind, 'x')}, 'held', x.held, 'y', x.y))"


#: Made-up values of each kind: one example in every form, so that forms can be told from spoilt ones in a corpus without base spans, too.
SEEDS = {"email": "jo.doe@mail.example.org", "ip": "192.0.2.17", "card": "4111 1111 1111 1111", "phone": "+1 (202) 555-0143"}


def seeds() -> str:
    """SQL for the examples from ``SEEDS``, between blanks, both to learn from and held out."""
    rows = []
    for kind, value in SEEDS.items():
        for form in FORMS[kind]:
            for v, y in ((spans.quoted(value), 1), (spans.let(spans.quoted(value), "v", SPOILT[kind]), 0)):
                x = f"named_struct('value', {spans.let(v, 'v', form)}, 'before', ' ', 'after', ' ')"
                rows.append(f"transform(array({x}), x -> named_struct({_features(kind, 'x')}, 'y', {y}))")
    return f"concat({', '.join(rows)})"


def candidates(text: str) -> str:
    """SQL for everything that the generators propose, with features."""
    found = []
    for kind, test, pattern in GENERATORS:
        some = f"CASE WHEN {text} RLIKE {spans.quoted(test)} THEN {spans.matches(text, kind, pattern, framed=True)} ELSE CAST(array() AS {spans.FRAMED}) END"
        found.append(f"transform({some}, x -> named_struct('start', x.start, 'end', x.end, {_features(kind, 'x')}, 'hash', pmod(xxhash64(x.value), {1 << 20})))")
    return f"concat({', '.join(found)})"


def proposed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, doc_id, base, examples, candidates) of every row, written from one pass over the whole texts."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole(F.col(text).cast("string")).alias("_text"))
    rows = rows.selectExpr("doc_id", "_text", *[f"{base_spans('_text', k, framed=True)} AS _{k}" for k in BASE_KINDS])
    short = "transform(concat(_email, _ip, _card, _phone), s -> named_struct('kind', s.kind, 'start', s.start, 'end', s.end))"
    examples = f"concat({', '.join(_examples(k, f'_{k}') for k in BASE_KINDS)})"
    return written(
        rows.selectExpr("monotonically_increasing_id() AS key", "doc_id", f"{short} AS base", f"{examples} AS examples", f"{candidates('_text')} AS candidates"), "pii"
    )


def fresh(table: DataFrame) -> DataFrame:
    """(key, start, end, features, hash) of the candidates that overlap no base span of their row.

    One sort for each row that has candidates, instead of comparing all spans with each other.
    """
    some = table.where(F.size("candidates") > 0)
    proposals = some.select("key", F.explode("candidates").alias("c")).select("key", F.col("c.start").alias("at"), F.col("c.end").alias("to"), "c")
    checked = some.select("key", F.explode("base").alias("b")).select("key", F.col("b.start").alias("at"), F.col("b.end").alias("to"))
    both = checked.unionByName(proposals, allowMissingColumns=True)
    by_start = Window.partitionBy("key").orderBy("at")
    upto = F.max(F.when(F.col("c").isNull(), F.col("to"))).over(by_start)  # rows of one start count as before each other
    # from the end backwards: a frame that only grows takes one pass
    since = F.min(F.when(F.col("c").isNull(), F.col("at"))).over(Window.partitionBy("key").orderBy(F.desc("at")))
    marked = both.withColumn("_upto", upto).withColumn("_since", since)
    free = (F.coalesce("_upto", F.lit(0)) <= F.col("at")) & (F.coalesce("_since", F.col("to")) >= F.col("to"))
    return marked.where(F.col("c").isNotNull() & free).select("key", "c.*")


def learn(table: DataFrame, fresh: DataFrame, precision: float = 0.75, rounds: int = 40) -> tuple[boosting.Model, dict[str, float]]:
    """Model and threshold by kind. The driver gets one row for each combination of feature values."""
    made = table.select(F.explode("examples").alias("e")).select("e.*")
    fixed = table.sparkSession.range(1).select(F.explode(F.expr(seeds())).alias("e")).select("e.*").withColumn("held", F.explode(F.array(F.lit(True), F.lit(False))))
    made = made.unionByName(fixed.select(made.columns))
    failed = fresh.where("valid = 'no'").withColumn("held", F.col("hash") % 3 == 0)
    chance = F.lit(False)
    for kind, n in CHANCE.items():
        chance = F.when(F.col("kind") == kind, F.expr(f"hash div 3 % {n} = 0")).otherwise(chance)
    look_alike = F.explode(F.when(chance, F.array(F.lit("no"), F.lit("yes"))).otherwise(F.array(F.lit("no"))))
    failed = failed.withColumn("valid", look_alike).withColumn("y", F.lit(0))
    cells = made.unionByName(failed.select(made.columns)).groupBy(*FEATURES, "held").agg(F.count_if(F.col("y") == 1).alias("yes"), F.count_if(F.col("y") == 0).alias("no"))
    rows = [({f: r[f] for f in FEATURES}, r["held"], r["yes"], r["no"]) for r in cells.orderBy(*FEATURES, "held").collect()]
    model = boosting.fit([(cell, a, b) for cell, held, a, b in rows if not held], rounds)
    limits = {}
    for kind in BASE_KINDS:
        limits[kind] = boosting.threshold([(model.logit(cell), a, b) for cell, held, a, b in rows if held and cell["kind"] == kind], precision)
    return model, limits


def selected(table: DataFrame, fresh: DataFrame, model: boosting.Model, limits: dict[str, float]) -> DataFrame:
    """(doc_id, spans): base spans and the candidates that the model adds."""
    limit = F.lit(math.inf)
    for kind, value in limits.items():
        limit = F.when(F.col("kind") == kind, F.lit(float(value))).otherwise(limit)
    passing = fresh.withColumn("score", model.column(F.col)).where(F.col("score") >= limit).select("key", "start", "end", "kind", "score")
    before = Window.partitionBy("key").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    opens = passing.withColumn("_opens", F.coalesce(F.max("end").over(before) <= F.col("start"), F.lit(True)).cast("long"))
    runs = opens.withColumn("run", F.sum("_opens").over(Window.partitionBy("key").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    best = F.struct(F.col("score"), -F.col("start"), F.col("end"), F.concat(F.lit("loose_"), "kind").alias("kind"))
    won = runs.groupBy("key", "run").agg(F.max_by(F.struct(F.concat(F.lit("loose_"), "kind").alias("kind"), "start", "end"), best).alias("s"))
    added = won.groupBy("key").agg(F.collect_list("s").alias("added"))
    return table.select("key", "doc_id", "base").join(added, "key", "left").select("doc_id", F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))).alias("spans"))


def detect(docs: DataFrame, precision: float = 0.75, rounds: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans) of every document; spans are (kind, start, end) in code points."""
    table = proposed(docs, doc_id, text)
    free = written(fresh(table), "pii-candidates")
    return selected(table, free, *learn(table, free, precision, rounds))
