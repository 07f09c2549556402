"""Differences between two snapshots of a model. Fields compare null-safe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .flows import step_counts

#: Fields of a node that count as modified, and the shorter list of the sync summary.
NODE_FIELDS = ("name", "description", "kind", "technology", "external", "shape", "status", "parent_id", "sources", "contract", "notes", "properties")
SYNC_FIELDS = ("name", "description", "kind", "technology", "status", "parent_id", "contract")


def compare(base: DataFrame, now: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, change, fields): added, removed or modified rows; ``fields`` names what differs, comma-joined.

    Fields that neither snapshot has are passed over. Keys must be unique in
    each snapshot.
    """
    fields = [f for f in fields if f in base.columns and f in now.columns]
    side = lambda df, name: df.select(*keys, F.struct(F.lit(1).alias("_here"), *fields).alias(name))
    both = side(base, "old").join(side(now, "new"), list(keys), "full_outer")
    differs = lambda f: F.when(~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}")), F.lit(f))
    changed = F.concat_ws(",", *[differs(f) for f in fields])
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(changed != "", "modified")
    return both.select(*keys, change.alias("change"), F.when(change == "modified", changed).otherwise("").alias("fields")).where("change IS NOT NULL")


def nodes(base: DataFrame, now: DataFrame) -> DataFrame:
    return compare(base, now, ["model", "id"], NODE_FIELDS)


def sync_summary(base: DataFrame, now: DataFrame) -> DataFrame:
    """(model, change, names) over the shorter field list; names sorted, comma-joined."""
    rows = compare(base, now, ["model", "id"], SYNC_FIELDS)
    named = rows.join(now.select("model", "id", F.col("name").alias("new_name")), ["model", "id"], "left").join(
        base.select("model", "id", F.col("name").alias("old_name")), ["model", "id"], "left"
    )
    return named.groupBy("model", "change").agg(F.array_join(F.array_sort(F.collect_list(F.coalesce("new_name", "old_name"))), ",").alias("names"))


def edges(base: DataFrame, now: DataFrame) -> DataFrame:
    """Edge changes; ends do not count as modified, a null label equals an empty one."""

    def plain(df: DataFrame) -> DataFrame:
        method = F.coalesce("method", F.lit("")) if "method" in df.columns else F.lit("")
        return df.select("model", "id", F.coalesce("label", F.lit("")).alias("label"), method.alias("method"))

    return compare(plain(base), plain(now), ["model", "id"], ["label", "method"])


def flows(base: DataFrame, now: DataFrame) -> DataFrame:
    """(model, flow_id, change, steps_before, steps_after, differs): ``modified`` where the number of steps changes.

    A reworded step is no reported change; ``differs`` tells it all the same.
    """
    content = lambda df, name: df.groupBy("model", "flow_id").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct(*[c for c in sorted(df.columns) if c not in ("model", "flow_id")])))), "|"), 256).alias(name)
    )
    old = step_counts(base).withColumnRenamed("steps", "steps_before").join(content(base, "h0"), ["model", "flow_id"])
    new = step_counts(now).withColumnRenamed("steps", "steps_after").join(content(now, "h1"), ["model", "flow_id"])
    both = old.join(new, ["model", "flow_id"], "full_outer")
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("steps_before") != F.col("steps_after"), "modified")
    return both.select("model", "flow_id", change.alias("change"), "steps_before", "steps_after", (~F.col("h0").eqNullSafe(F.col("h1"))).alias("differs")).where(
        "change IS NOT NULL OR differs"
    )


def touched_parents(base: DataFrame, now: DataFrame, base_edge: DataFrame, edge: DataFrame) -> DataFrame:
    """(model, parent_id): parents of changed, added and removed nodes, and of the ends of changed edges."""
    ids = nodes(base, now).select("model", "id")
    parents = base.select("model", "id", "parent_id").unionByName(now.select("model", "id", "parent_id"))
    moved = edges(base_edge, edge).select("model", F.col("id").alias("edge_id"))
    ends = base_edge.select("model", F.col("id").alias("edge_id"), "source", "target").unionByName(edge.select("model", F.col("id").alias("edge_id"), "source", "target"))
    far = ends.join(moved, ["model", "edge_id"], "left_semi").select("model", F.explode(F.array("source", "target")).alias("id"))
    return parents.join(ids.unionByName(far).distinct(), ["model", "id"], "left_semi").where("parent_id IS NOT NULL").select("model", "parent_id").distinct()


def oldest_unacknowledged(history: DataFrame) -> DataFrame:
    """(model, id, old): per node the oldest value that is not acknowledged, from (model, id, version, old, acknowledged); of several values of one version the smallest."""
    return history.where("NOT acknowledged").groupBy("model", "id").agg(F.min_by("old", F.struct("version", "old")).alias("old"))


def focus(changed: DataFrame, depth: DataFrame) -> DataFrame:
    """(model, parent_id): the shallowest and then busiest parent of changed nodes; ties take the smallest id."""
    busy = changed.where("parent_id IS NOT NULL").groupBy("model", "parent_id").agg(F.count("*").alias("n"))
    ranked = busy.join(depth.select("model", F.col("id").alias("parent_id"), "depth"), ["model", "parent_id"])
    return ranked.groupBy("model").agg(F.min_by("parent_id", F.struct("depth", (-F.col("n")).alias("n"), "parent_id")).alias("parent_id"))


def retained(history: DataFrame, keep: int = 10) -> DataFrame:
    """The last ``keep`` versions of (model, version, content) after dropping those equal to the one before."""
    w = Window.partitionBy("model").orderBy("version")
    fresh = history.withColumn("_last", F.lag("content").over(w)).where(~F.col("content").eqNullSafe(F.col("_last")) | F.col("_last").isNull()).drop("_last")
    newest = Window.partitionBy("model").orderBy(F.desc("version"))
    return fresh.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep).drop("_n")

