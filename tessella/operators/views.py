"""What a level view shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.places import numbered
from tessella.schema import CODE_KINDS

from .graph import resolve_endpoints
from .runs import numbered_runs


def level_view(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(model, view, id, role, relations): for every node, its children and the nodes on its own edges.

    Reference nodes are not shown where the view is a component's (code level),
    and components and code-level nodes are never references. ``relations``
    lists direction and label of the edges to a reference, sorted.
    """
    kinds = node.select("model", F.col("id").alias("view"), F.col("kind").alias("view_kind"), F.col("parent_id").alias("above"))
    owned = node.where("parent_id IS NOT NULL").select("model", F.col("parent_id").alias("view"), "id").join(kinds.select("model", "view"), ["model", "view"], "left_semi")
    views = owned.select("model", "view").distinct().join(kinds, ["model", "view"]).where("view_kind IN ('system', 'container')")
    ends = edge.select("model", F.explode(F.array(
        F.struct(F.col("source").alias("view"), F.col("target").alias("id"), F.concat(F.lit("out:"), F.coalesce("label", F.lit(""))).alias("relation")),
        F.struct(F.col("target").alias("view"), F.col("source").alias("id"), F.concat(F.lit("in:"), F.coalesce("label", F.lit(""))).alias("relation")),
    )).alias("e")).select("model", "e.*")
    far = views.join(ends, ["model", "view"]).where("id <> view").join(
        node.where(~F.col("kind").isin("component", *CODE_KINDS)).select("model", "id"), ["model", "id"], "left_semi"
    ).join(owned, ["model", "view", "id"], "left_anti")
    reference = far.groupBy("model", "view", "id").agg(F.array_join(F.array_sort(F.collect_list("relation")), ";").alias("relations"))
    return owned.select("model", "view", "id", F.lit("owned").alias("role"), F.lit("").alias("relations")).unionByName(
        reference.select("model", "view", "id", F.lit("reference").alias("role"), "relations")
    )


def injected_members(node: DataFrame) -> DataFrame:
    """(model, id, operations, processes, models, has_children) of every component; lists by order, comma-joined."""

    def listed(kind: str):
        rows = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "name"))))
        return F.array_join(F.transform(rows, lambda x: x["name"]), ",")

    kids = node.groupBy("model", F.col("parent_id").alias("id")).agg(listed("operation").alias("operations"), listed("process").alias("processes"), listed("model").alias("models"))
    rows = node.where("kind = 'component'").select("model", "id").join(kids, ["model", "id"], "left")
    return rows.withColumn("has_children", F.col("operations").isNotNull()).fillna("", ["operations", "processes", "models"])


def chips(node: DataFrame, most: int = 8) -> DataFrame:
    """(model, id, chips, overflow): processes, models, then operations in order; the first ``most`` and how many more."""
    rank = F.when(F.col("kind") == "process", 0).when(F.col("kind") == "model", 1).otherwise(2)
    w = Window.partitionBy("model", "parent_id").orderBy("rank", "ord")
    rows = node.where(F.col("kind").isin(*CODE_KINDS)).withColumn("rank", rank).withColumn("n", F.row_number().over(w))
    return rows.groupBy("model", F.col("parent_id").alias("id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("n") <= most, F.struct("n", "name")))), lambda x: x["name"]), ",").alias("chips"),
        F.greatest(F.count("*") - most, F.lit(0)).alias("overflow"),
    )


def mention_candidates(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(model, id, candidate): code-level members of a component and of its neighbour components."""
    comps = node.where("kind = 'component'").select("model", "id")
    ends = resolve_endpoints(edge, node, "kind").where("s_kind = 'component' AND t_kind = 'component'")
    near = ends.select("model", F.col("source").alias("id"), F.col("target").alias("other")).unionByName(ends.select("model", F.col("target").alias("id"), F.col("source").alias("other")))
    homes = near.unionByName(comps.select("model", "id", F.col("id").alias("other"))).distinct()
    members = node.where(F.col("kind").isin(*CODE_KINDS)).select("model", F.col("parent_id").alias("other"), F.col("id").alias("candidate"))
    return homes.join(members, ["model", "other"]).select("model", "id", "candidate").distinct()


def decorations(node: DataFrame, member: DataFrame, changed: DataFrame, drifted: DataFrame, hint: DataFrame) -> DataFrame:
    """(model, id, group_id, hints, changed, drifted); of several groups the last by id counts."""
    group = member.groupBy("model", F.col("node_id").alias("id")).agg(F.max("group_id").alias("group_id"))
    hints = hint.groupBy("model", F.col("node_id").alias("id")).agg(F.count("*").alias("hints"))
    flag = lambda df, name: df.select("model", "id", F.lit(True).alias(name)).distinct()
    rows = node.select("model", "id").join(group, ["model", "id"], "left").join(hints, ["model", "id"], "left")
    rows = rows.join(flag(changed, "changed"), ["model", "id"], "left").join(flag(drifted, "drifted"), ["model", "id"], "left")
    return rows.fillna(0, ["hints"]).fillna(False, ["changed", "drifted"])


def visible_groups(group: DataFrame, member: DataFrame, node: DataFrame) -> DataFrame:
    """(model, view, id, parent_group_id): groups whose members all have this parent; a parent group stays only if it is visible too."""
    placed = member.join(node.select("model", F.col("id").alias("node_id"), F.col("parent_id").alias("view")), ["model", "node_id"], "left")
    level = placed.groupBy("model", "group_id").agg(F.min("view").alias("view"), (F.count_distinct("view") == 1).alias("one"), F.count_if(F.col("view").isNull()).alias("lost"))
    shown = group.join(level.where("one AND lost = 0").select("model", F.col("group_id").alias("id"), "view"), ["model", "id"])
    above = shown.select("model", "view", F.col("id").alias("parent_group_id"), F.lit(True).alias("_up"))
    return shown.join(above, ["model", "view", "parent_group_id"], "left").select("model", "view", "id", F.when(F.col("_up"), F.col("parent_group_id")).alias("parent_group_id"))


def open_hints(hint: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Hints that were not dismissed by node and message."""
    return hint.join(dismissed.select("model", "node_id", "message"), ["model", "node_id", "message"], "left_anti")


def collapsed_log(log: DataFrame, keep: int = 200, chunk: int = 10_000) -> DataFrame:
    """(model, run, text, times): equal neighbours become one line with a number; the last ``keep`` lines.

    Sequence numbers are read in stretches of ``chunk``, so that a long log is no single group.
    """
    differs = lambda before, row: ~before["text"].eqNullSafe(row["text"])
    runs = numbered_runs(log, ["model"], ["seq"], F.floor(F.col("seq") / chunk), ["text"], differs)
    lines = runs.groupBy("model", "run").agg(F.first("text").alias("text"), F.count("*").alias("times"))
    last = lines.groupBy("model").agg(F.max("run").alias("_last"))
    return lines.join(last, "model").where(F.col("run") > F.col("_last") - keep).select("model", "run", "text", "times")


def grid(size: DataFrame, gap: int = 40, most_columns: int = 4) -> DataFrame:
    """(model, view, id, x, y): a grid of ceil(sqrt(n)) columns, four at most; columns as wide and rows as high as their largest cell."""
    w = Window.partitionBy("model", "view").orderBy("ord")
    n = F.count("*").over(Window.partitionBy("model", "view"))
    cells = size.withColumn("_cols", F.least(F.lit(most_columns), F.ceil(F.sqrt(n)).cast("int"))).withColumn("_i", F.row_number().over(w) - 1)
    cells = cells.withColumn("col", F.expr("_i % _cols")).withColumn("row", F.expr("_i div _cols"))

    def offsets(axis: str, extent: str, name: str) -> DataFrame:
        line = cells.groupBy("model", "view", axis).agg(F.max(extent).alias("_e"))
        before = Window.partitionBy("model", "view").orderBy(axis).rowsBetween(Window.unboundedPreceding, -1)
        return line.select("model", "view", axis, F.coalesce(F.sum(F.col("_e") + gap).over(before), F.lit(0)).alias(name))

    return cells.join(offsets("col", "width", "x"), ["model", "view", "col"]).join(offsets("row", "height", "y"), ["model", "view", "row"]).select("model", "view", "id", "x", "y")


def by_distance(edge: DataFrame, node: DataFrame) -> DataFrame:
    """(model, id, d, place): edges by squared distance of their ends' positions, ties by id."""
    ends = resolve_endpoints(edge, node, "x", "y")
    d = (F.col("s_x") - F.col("t_x")) * (F.col("s_x") - F.col("t_x")) + (F.col("s_y") - F.col("t_y")) * (F.col("s_y") - F.col("t_y"))
    return numbered(ends.select("model", "id", d.alias("d")), ["model"], [F.col("d"), F.col("id")])
