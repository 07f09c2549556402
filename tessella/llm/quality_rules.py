"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is true where it rejects, and names the statistics it reads.
``plan_cascade`` estimates on a sample what each rule costs (the work of its
statistics, by bytes and words) and how much it rejects, and orders the rules by
rejections per cost. The sample is drawn from all partitions; its expected size
is fixed.

``surviving`` computes a statistic only for rows that passed the rules before
it. ``verdicts`` returns all rows: a statistic is null where an earlier rule had
rejected the row and so stopped the cascade, except for those that the caller
wants for every row. The order never changes which rows are kept, only what that
costs and which of several rejecting rules is named as the first.

Null text has no words; such rows, like empty texts, fail ``too_few_words``.
Repeated rows are judged one by one; other columns pass through, and a column
that has the name of a statistic is replaced by it. Very long texts are read
whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole

WINDOW = 5
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[], Column]


def _words(df: DataFrame, text: str) -> DataFrame:
    trimmed = F.btrim(whole(text), F.lit(BLANKS))
    return df.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")))


def _n_words(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("n_words", F.size("_words").cast("long"))


def _word_chars(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))


def _n_symbols(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("n_symbols", F.regexp_count(whole(text), F.lit("[#*$%&|<>]")).cast("long"))


def _lines(df: DataFrame, text: str) -> DataFrame:
    lines = F.filter(F.split(whole(text), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return (
        df.withColumn("_lines", lines)
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .drop("_lines")
    )


def _n_repeat_words(df: DataFrame, text: str) -> DataFrame:
    """Words inside windows of five words that occur at least twice in the text.

    A hash set tells whether any window repeats. Only then are the windows
    sorted by (hash, start): equal windows become neighbours, and the lengths
    of the union of their starts are summed.
    """
    h = F.col("_hashes")
    grams = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    with_grams = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))).withColumn(
        "_grams", F.when(F.size("_hashes") > WINDOW, grams).otherwise(F.array().cast("array<bigint>"))
    )
    ordered = F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    repeats = F.size(F.array_distinct("_grams")) < F.size("_grams")
    with_order = with_grams.withColumn("_order", F.when(repeats, ordered))
    pairs = F.filter(
        F.zip_with("_order", F.slice("_order", 2, F.size("_order")), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"]))),
        lambda p: p.isNotNull(),
    )
    covered = F.aggregate(
        F.sort_array(F.array_distinct(F.flatten(pairs))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return with_order.withColumn("n_repeat_words", F.when(F.col("_order").isNull(), F.lit(0).cast("long")).otherwise(covered)).drop(
        "_hashes", "_grams", "_order"
    )


def _n_distinct_words(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("n_distinct_words", F.size(F.array_distinct("_words")).cast("long"))


def _letters(df: DataFrame, text: str) -> DataFrame:
    """ASCII letters, and capital ones among them."""
    count = lambda pattern: F.regexp_count(whole(text), F.lit(pattern)).cast("long")
    return df.withColumn("n_letters", count("[A-Za-z]")).withColumn("n_capitals", count("[A-Z]"))


#: Statistic: how to add it, and what it needs first.
STATISTICS: dict[str, tuple[Callable[[DataFrame, str], DataFrame], tuple[str, ...]]] = {
    "_words": (_words, ()),
    "n_words": (_n_words, ("_words",)),
    "word_chars": (_word_chars, ("_words",)),
    "n_symbols": (_n_symbols, ()),
    "n_dup_lines": (_lines, ()),
    "n_repeat_words": (_n_repeat_words, ("_words",)),
    "n_distinct_words": (_n_distinct_words, ("_words",)),
    "n_capitals": (_letters, ()),
}
#: Columns that a statistic brings along.
ALONG = {"n_dup_lines": ("n_lines",), "n_capitals": ("n_letters",)}


def with_statistics(docs: DataFrame, names: tuple[str, ...], text: str = "text", done: set[str] | None = None) -> DataFrame:
    """Add the named statistics and what they need; ``done`` holds those that are there."""
    done = set() if done is None else done
    for name in names:
        if name not in done:
            add, first = STATISTICS[name]
            docs = add(with_statistics(docs, first, text, done), text)
            done.add(name)
    return docs


def default_rules() -> list[Rule]:
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    return [
        Rule("too_few_words", ("n_words",), lambda: n < 10),
        Rule("repetition", ("n_words", "n_repeat_words"), lambda: 100 * F.col("n_repeat_words") > 20 * n),
        Rule("symbols", ("word_chars", "n_symbols"), lambda: 100 * F.col("n_symbols") > 10 * chars),
        Rule("word_length", ("n_words", "word_chars"), lambda: (chars > 25 * n) | (chars < 2 * n)),
        Rule("repeated_lines", ("n_dup_lines",), lambda: (lines >= 4) & (2 * F.col("n_dup_lines") > lines)),
        Rule("few_distinct_words", ("n_words", "n_distinct_words"), lambda: (n >= 50) & (20 * F.col("n_distinct_words") < n)),
        Rule("capitals", ("n_capitals",), lambda: (F.col("n_letters") >= 20) & (2 * F.col("n_capitals") > F.col("n_letters"))),
    ]


#: Work of a statistic, behind what it needs first: nanoseconds a byte of text and a word, as once measured. Only their relations matter.
WORK = {
    "_words": (9.0, 0.0),
    "n_words": (0.0, 0.1),
    "word_chars": (0.5, 10.0),
    "n_symbols": (12.0, 0.0),
    "n_dup_lines": (10.0, 0.0),
    "n_repeat_words": (0.0, 250.0),
    "n_distinct_words": (0.0, 60.0),
    "n_capitals": (25.0, 0.0),
}


def _all_needs(names: tuple[str, ...]) -> set[str]:
    out: set[str] = set()
    for name in names:
        out |= {name} | _all_needs(STATISTICS[name][1])
    return out


def plan_cascade(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = 1000, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """Order ``rules`` by rejections per cost on a random sample of about ``sample_rows`` rows.

    Returns (rule, share rejected, cost in nanoseconds a row), best first; on an
    empty sample the given order stays. The cost is counted, not timed: the work
    of a rule's statistics (``WORK``) over the sample's bytes and words. So the
    order repeats, and one pass over the sample is enough. A rule of no cost
    counts as one nanosecond.
    """
    total = docs.count()
    sample = docs.select(text).sample(min(1.0, sample_rows / max(total, 1)), seed)
    needs = tuple(dict.fromkeys(n for r in rules for n in r.needs))
    seen = with_statistics(sample, tuple(dict.fromkeys(("n_words", *needs))), text)
    hits = [F.count_if(F.coalesce(r.rejects(), F.lit(False))).alias(f"_hits{i}") for i, r in enumerate(rules)]
    told = seen.agg(F.count("*").alias("_n"), F.sum(F.octet_length(whole(text))).alias("_bytes"), F.sum("n_words").alias("_words"), *hits).first()
    if not told["_n"]:
        return [(r, 0.0, 0.0) for r in rules]
    a_byte, a_word = told["_bytes"] / told["_n"], told["_words"] / told["_n"]
    measured = []
    for i, rule in enumerate(rules):
        cost = sum(WORK[s][0] * a_byte + WORK[s][1] * a_word for s in sorted(_all_needs(rule.needs)))
        measured.append((rule, told[f"_hits{i}"] / told["_n"], max(cost, 1.0)))
    return sorted(measured, key=lambda m: (-m[1] / m[2], m[2], m[0].name))


def surviving(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Rows that no rule rejects; each statistic is computed only behind the filters before it."""
    columns, done, df = docs.columns, set(), docs
    for rule in rules:
        df = with_statistics(df, rule.needs, text, done)
        df = df.filter(~F.coalesce(rule.rejects(), F.lit(False)))
    return df.select(*columns)


def verdicts(docs: DataFrame, rules: list[Rule], text: str = "text", always: tuple[str, ...] = ()) -> DataFrame:
    """All rows with the statistics of the rules, ``failed_rule`` (the first in the given order; null where kept) and ``kept``.

    Statistics in ``always`` are computed for every row. The others see no text
    once a rule before theirs has rejected the row, and are null there.
    """
    done: set[str] = set()
    df = with_statistics(docs, always, text, done).withColumn("failed_rule", F.lit(None).cast("string"))
    for rule in rules:
        before = set(done)
        if not set(rule.needs) <= done:
            df = with_statistics(df.withColumn("_live", F.when(F.col("failed_rule").isNull(), F.col(text))), rule.needs, "_live", done).drop("_live")
            late = [c for s in sorted(done - before) if s != "_words" for c in (s, *ALONG.get(s, ()))]
            df = df.withColumns({c: F.when(F.col("failed_rule").isNull(), F.col(c)) for c in late})
        rejected = F.when(F.coalesce(rule.rejects(), F.lit(False)), F.lit(rule.name))
        df = df.withColumn("failed_rule", F.when(F.col("failed_rule").isNotNull(), F.col("failed_rule")).otherwise(rejected))
    return df.drop("_words").withColumn("kept", F.col("failed_rule").isNull())
