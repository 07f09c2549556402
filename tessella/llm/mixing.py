"""Mixing sources to target weights by temperature, in DataFrame functions only.

The token share p of each source is raised to an exponent a in [0, 1] and
normalised: w = p**a / sum(p**a). The exponent is found by bisection so that the
entropy of w meets a target, then raised if a source would be read more often
than ``max_repeats`` times. The target is a share of the largest entropy
(``entropy_share``), or what the natural shares have and a part of what they miss
to the largest (``entropy_gain``), which always binds. Both conditions need only
sums over the sources (of p**a and of p**a * ln p) and the extreme shares, so
each step cuts the interval at several points with one aggregation over the table
of source totals; only the sums reach the driver, however many sources there are.
Each source gets w * budget tokens, in whole numbers by largest remainder: as
many whole passes as fit, and a part of one more. With ``cover``, the budget is
the least that reads every source whole at least once, so no document is lost.

A pass is a block permutation: documents fall into blocks of about
``block_tokens`` by hash (of the id and of where the row was read, so that null
and repeated ids fill all blocks too), blocks into groups (the square root of the
number of blocks), groups are ordered by a hash of (pass, group), blocks inside a
group and documents inside a block likewise. Running token sums over the groups of a
source, the blocks of a group and the documents of a block give each copy its
place, so no task sorts a whole source, and what a task sorts grows with the
square root of the largest source at most. The last pass ends before the budget
would be passed.

Null sources are one source of their own ("" in the result if it has no such
source, else mixed with it). Null and empty texts have no tokens and come along
in passes that are read whole. Repeated rows are separate documents that stand
side by side; a null id is an id like any other. A source without tokens gets no
budget. An empty table gives an empty plan. Very long texts are one document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.places import numbered

from .common import whole, written

#: Points at which one aggregation cuts the interval of the exponent, and such steps: 33**8 parts.
CUTS, STEPS = 32, 8
#: Parts of a source when its documents meet its totals, so that a hot source is spread over tasks.
SALTS = 32


@dataclass(frozen=True)
class Mix:
    exponent: float
    norm: float
    total: int
    budget: int

    def weight(self, tokens: Column) -> Column:
        return F.when(tokens > 0, F.pow(tokens / F.lit(float(max(self.total, 1))), F.lit(self.exponent)) / F.lit(self.norm)).otherwise(0.0)


def _sums(totals: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """sum(p**a) and sum(p**a * ln p) over the sources for every exponent a, in one aggregation."""
    a = F.array(*[F.lit(float(x)) for x in exponents])
    rows = totals.select("p", F.posexplode(a).alias("i", "a")).groupBy("i").agg(F.sum(F.pow("p", "a")).alias("s"), F.sum(F.pow("p", "a") * F.log("p")).alias("l"))
    found = {r.i: (r.s, r.l) for r in rows.collect()}  # a row an exponent
    return [found[i] for i in range(len(exponents))]


def _smallest(totals: DataFrame, holds, low: float, high: float) -> float:
    """The smallest exponent where ``holds(a, s, l)`` is true, if it is false below and true above."""
    for _ in range(STEPS):
        points = [low + (high - low) * (k + 1) / (CUTS + 1) for k in range(CUTS)]
        true = [holds(x, *sums) for x, sums in zip(points, _sums(totals, points))]
        first = true.index(True) if True in true else CUTS
        low, high = (points[first - 1] if first else low), (points[first] if first < CUTS else high)
    return high


def solve(totals: DataFrame, total: int, budget: int | None, entropy_share: float | None = None, max_repeats: float | None = None, entropy_gain: float | None = None) -> float:
    """Exponent for a target entropy under a repetition limit; ``totals`` has a row (source, total) for each source.

    Without a budget, it is the least that covers every source.
    """
    shares = totals.where("total > 0").select((F.col("total") / F.lit(float(max(total, 1)))).alias("p"))
    n, smallest, largest = shares.agg(F.count("*"), F.min("p"), F.max("p")).first()
    if n < 2:
        return 1.0
    entropy = lambda a, s, l: math.log(s) - a * l / s  # noqa: E741, E731
    exponent = 1.0
    natural = entropy(1.0, *_sums(shares, [1.0])[0])
    target = natural + entropy_gain * (math.log(n) - natural) if entropy_gain is not None else entropy_share and entropy_share * math.log(n)
    if target is not None:
        if natural < target:
            exponent = _smallest(shares, lambda a, s, l: entropy(a, s, l) <= target, 0.0, 1.0)  # noqa: E741
    if max_repeats is not None:
        # w / p = p**(a - 1) / sum(p**a) is largest for the smallest share; the covering budget gives the largest source one pass
        repeats = lambda a, s: (largest / smallest) ** (1 - a) if budget is None else smallest ** (a - 1) / s * budget / total
        within = lambda a, s, l: repeats(a, s) <= max_repeats  # noqa: E741, E731
        if not within(exponent, *_sums(shares, [exponent])[0]):
            exponent = _smallest(shares, within, exponent, 1.0)
    return exponent


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, tokens): tokens are words between white space."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), whole(F.col(source).cast("string")).alias("source"), F.regexp_count(whole(text), F.lit("\\S+")).cast("long").alias("tokens")
    )


def plan(docs: DataFrame, budget: int | None = None, entropy_share: float | None = 0.95, max_repeats: float | None = 4.0, block_tokens: int = 1 << 18, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source", entropy_gain: float | None = None, cover: bool = False) -> DataFrame:
    """A row for each copy of a document: (doc_id, source, epoch, block, position, n_tokens, mix_rank).

    ``position`` is the token offset in its source's sequence; reading all copies
    by ``mix_rank`` (position over the source's budget) interleaves the sources.
    The default budget is the number of tokens there are; with ``cover`` it is
    the least that reads every source whole.
    """
    tokens = written(counted(docs, doc_id, text, source).withColumn("_key", F.monotonically_increasing_id()), "tokens")
    return placed(tokens, totals_of(tokens), budget, entropy_share, max_repeats, block_tokens, seed, entropy_gain, cover).drop("_key")


def totals_of(tokens: DataFrame) -> DataFrame:
    return written(tokens.groupBy("source").agg(F.sum("tokens").alias("total")), "sources")


def dealt_shares(some: DataFrame, mix: Mix, cover: bool) -> DataFrame:
    """(source, total, share): whole tokens that add up to the budget, by largest remainder; with ``cover`` no less than the source has."""
    exact = mix.weight(F.col("total")) * F.lit(float(mix.budget))
    parts = written(some.select("source", "total", F.floor(exact).cast("long").alias("share"), (F.floor(exact) - exact).alias("short")), "shares")
    left = mix.budget - (parts.agg(F.sum("share")).first()[0] or 0)
    ranked = numbered(parts, [], [F.col("short"), F.col("source")])
    share = F.col("share") + F.when(F.col("place") <= left, 1).otherwise(0)
    return ranked.select("source", "total", (F.greatest(share, "total") if cover else share).alias("share"))


def placed(tokens: DataFrame, totals: DataFrame, budget: int | None, entropy_share: float | None, max_repeats: float | None, block_tokens: int = 1 << 18, seed: int = 17, entropy_gain: float | None = None, cover: bool = False) -> DataFrame:
    """The plan for (doc_id, source, tokens, _key) rows, which may have more columns, and their (source, total) rows; ``_key`` tells rows apart."""
    total = totals.agg(F.sum("total")).first()[0] or 0
    budget = None if cover else total if budget is None else budget
    exponent = solve(totals, total, budget, entropy_share, max_repeats, entropy_gain)
    some = totals.where("total > 0")
    share = F.col("total") / float(max(total, 1))
    norm, largest = some.agg(F.sum(F.pow(share, F.lit(exponent))), F.max(share)).first()
    norm, largest = norm or 1.0, largest or 1.0
    budget = math.ceil(total * norm * largest ** (1 - exponent) - 1e-6) if budget is None else budget
    mix = Mix(exponent, norm, total, budget)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("total") / block_tokens)).cast("int")
    sources = dealt_shares(some, mix, cover).select("source", "total", "share", blocks.alias("blocks"), F.ceil(F.sqrt(blocks)).cast("int").alias("groups"))
    sources = sources.withColumn("passes", F.floor(F.col("share") / F.col("total")).cast("int")).withColumn("rest", F.col("share") % F.col("total"))
    salted = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = tokens.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(SALTS)).cast("int")).join(salted, ["source", "_salt"]).drop("_salt")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_key"), F.col("blocks")).cast("int"))
    sizes = dealt.groupBy("source", "block", "groups", "passes", "rest").agg(F.sum("tokens").alias("size"))
    sizes = sizes.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), F.lit("group"), "block"), F.col("groups")).cast("int"))
    epochs = sizes.withColumn("epoch", F.explode(F.expr("sequence(0, passes)")))
    order = lambda *columns: [F.xxhash64(F.lit(seed), "epoch", *columns), *columns]
    ahead = Window.unboundedPreceding, -1
    of_group = epochs.groupBy("source", "epoch", "group").agg(F.sum("size").alias("_size"))
    of_group = of_group.select("source", "epoch", "group", F.coalesce(F.sum("_size").over(Window.partitionBy("source", "epoch").orderBy(*order("group")).rowsBetween(*ahead)), F.lit(0)).alias("_group"))
    in_group = Window.partitionBy("source", "epoch", "group").orderBy(*order("block")).rowsBetween(*ahead)
    at = epochs.withColumn("_inside", F.coalesce(F.sum("size").over(in_group), F.lit(0))).join(of_group, ["source", "epoch", "group"])
    # the pass after the whole ones is read up to the rest of the budget
    used = at.withColumn("before", F.col("_group") + F.col("_inside")).where((F.col("epoch") < F.col("passes")) | (F.col("before") < F.col("rest"))).select("source", "epoch", "block", "before")
    copies = dealt.withColumn("epoch", F.explode(F.expr("sequence(0, passes)"))).join(used, ["source", "epoch", "block"])
    inside = Window.partitionBy("source", "epoch", "block").orderBy(F.xxhash64(F.lit(seed), "epoch", "doc_id"), "doc_id", "tokens", "_key")
    running = copies.withColumn("to", F.col("before") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    kept = running.where((F.col("epoch") < F.col("passes")) | (F.col("to") <= F.col("rest")))
    position = F.col("epoch") * F.col("total") + F.col("to") - F.col("tokens")
    rest = [c for c in tokens.columns if c not in ("doc_id", "source", "tokens")]
    return kept.select(
        "doc_id", "source", "epoch", "block", position.alias("position"), F.col("tokens").alias("n_tokens"), (position / F.col("share")).alias("mix_rank"), *rest
    )


def mixed(docs: DataFrame, budget: int | None = None, entropy_share: float | None = 0.95, max_repeats: float | None = 4.0, block_tokens: int = 1 << 18, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source", entropy_gain: float | None = None, cover: bool = False) -> DataFrame:
    """The plan with the text of every copy in a column ``text``."""
    key = F.monotonically_increasing_id().alias("_key")
    keyed = written(docs.select(key, F.col(text).cast("string").alias("text"), F.col(doc_id).alias("doc_id"), whole(F.col(source).cast("string")).alias("source")), "keyed")
    tokens = written(keyed.select("doc_id", "source", F.regexp_count(whole("text"), F.lit("\\S+")).cast("long").alias("tokens"), "_key"), "tokens")
    copies = placed(tokens, totals_of(tokens), budget, entropy_share, max_repeats, block_tokens, seed, entropy_gain, cover)
    return copies.join(keyed.select("_key", "text"), "_key").drop("_key")
