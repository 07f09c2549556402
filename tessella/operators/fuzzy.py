"""Resolving loosely written names to nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _grams(size: int) -> Column:
    """The distinct substrings of ``text`` of one length; ``text`` is as long at least."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - size + 1), lambda i: F.substring(F.col("text"), i, F.lit(size))))


def contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(model, inner, outer): pairs of texts of a model where the first lies in the second; both sides have distinct (model, text).

    A text of three characters and more is looked up by that of its 3-grams
    which the fewest outer texts hold, and not at all if one is in none; what is
    found is verified. Texts of one or two characters are looked up whole.
    Empty inner texts give no pairs.
    """
    out = None
    for size in (1, 2, 3):
        asked = inner.where(F.length("text") == size if size < 3 else F.length("text") >= size)
        postings = outer.where(F.length("text") >= size).select("model", F.col("text").alias("outer"), F.explode(_grams(size)).alias("gram"))
        if size < 3:
            pairs = asked.select("model", F.col("text").alias("inner"), F.col("text").alias("gram")).join(postings, ["model", "gram"])
        else:
            counts = postings.groupBy("model", "gram").agg(F.count("*").alias("n"))
            grams = asked.select("model", F.col("text").alias("inner"), F.explode(_grams(size)).alias("gram")).join(counts, ["model", "gram"], "left")
            n = F.coalesce("n", F.lit(0))
            rarest = grams.groupBy("model", "inner").agg(F.min(F.struct(n.alias("n"), "gram")).alias("r")).where("r.n > 0").select("model", "inner", F.col("r.gram").alias("gram"))
            pairs = rarest.join(postings, ["model", "gram"]).where(F.contains("outer", F.col("inner")))
        pairs = pairs.select("model", "inner", "outer")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def resolve(hint: DataFrame, node: DataFrame, step: DataFrame | None = None) -> DataFrame:
    """(all columns of ``hint`` but its name, id, tier): the best match of a name, first in order inside a tier.

    Tiers: 1 id, 2 id of a top-level step (given as ``step``), 3 exact name,
    4 name without case, 5 one name inside the other without case. The first
    four are equi-joins on the hint; only hints that none of them resolves go
    on to tier 5, which looks them up in an index of the model's distinct names.
    """
    keys = [c for c in hint.columns if c != "name"]
    tiers = [(1, F.col("id"), False), (3, F.col("name"), False), (4, F.lower("name"), True)]
    found = None
    for tier, key, fold in tiers:
        side = node.select("model", key.alias("_key"), F.col("id").alias("_id"), "ord")
        asked = hint.withColumn("_key", F.lower("name") if fold else F.col("name"))
        rows = asked.join(side, ["model", "_key"]).select(*keys, F.lit(tier).alias("tier"), "ord", "_id")
        found = rows if found is None else found.unionByName(rows)
    if step is not None:
        tops = step.where("parent_step_id IS NULL").select("model", F.col("step_id").alias("name"), F.col("pos").alias("ord"), F.col("step_id").alias("_id"))
        found = found.unionByName(hint.join(tops, ["model", "name"]).select(*keys, F.lit(2).alias("tier"), "ord", "_id"))
    names = node.groupBy("model", F.lower("name").alias("_low")).agg(F.min(F.struct("ord", "id")).alias("n"))
    rest = hint.join(found.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lower("name").alias("_asked"))
    asked, known = rest.select("model", F.col("_asked").alias("text")).distinct(), names.select("model", F.col("_low").alias("text"))
    into = contained(asked, known).select("model", F.col("inner").alias("_asked"), F.col("outer").alias("_low"))
    pairs = into.unionByName(contained(known, asked).select("model", F.col("outer").alias("_asked"), F.col("inner").alias("_low")))
    loose = rest.join(pairs, ["model", "_asked"]).join(names, ["model", "_low"]).select(*keys, "n")
    # the empty text lies in every other
    first = names.groupBy("model").agg(F.min("n").alias("n"))
    loose = loose.unionByName(rest.where("_asked = ''").join(first, "model").select(*keys, "n"))
    loose = loose.unionByName(rest.join(names.where("_low = ''"), "model").select(*keys, "n"))
    found = found.unionByName(loose.select(*keys, F.lit(5).alias("tier"), F.col("n.ord").alias("ord"), F.col("n.id").alias("_id")))
    return found.groupBy(*keys).agg(F.min(F.struct("tier", "ord", "_id")).alias("b")).select(*keys, F.col("b._id").alias("id"), "b.tier")
