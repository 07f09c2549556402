"""The dependency-ordered task planner as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella import places
from tessella.schema import CODE_KINDS, DONE

from .graph import closure, resolve_endpoints


def child_states(node: DataFrame) -> DataFrame:
    """(model, id, has_status_children, children_done): over children of the expected kind that have a status."""
    expected = F.when(F.col("p_kind") == "container", "component").when(F.col("p_kind") == "system", "container")
    parents = node.select("model", F.col("id").alias("parent_id"), F.col("kind").alias("p_kind"))
    kids = node.where("status IS NOT NULL").select("model", "parent_id", "kind", "status").join(parents, ["model", "parent_id"]).where(F.col("kind") == expected)
    state = kids.groupBy("model", "parent_id").agg(F.bool_and(F.col("status").isin(*DONE)).alias("done"))
    return node.select("model", "id").join(state.withColumnRenamed("parent_id", "id"), ["model", "id"], "left").select(
        "model", "id", F.col("done").isNotNull().alias("has_status_children"), F.coalesce("done", F.lit(True)).alias("children_done")
    )


def with_states(node: DataFrame) -> DataFrame:
    """Nodes with child states, ``satisfied`` and whether their parent is external."""
    outside = node.where("external").select("model", F.col("id").alias("parent_id"), F.lit(True).alias("p_external"))
    satisfied = (
        F.when(F.coalesce("external", F.lit(False)), True)
        .when(F.col("has_status_children"), F.col("children_done"))
        .otherwise(F.col("status").isNull() | F.col("status").isin(*DONE))
    )
    return (
        node.join(child_states(node), ["model", "id"])
        .join(outside, ["model", "parent_id"], "left")
        .withColumn("under_external", F.coalesce("p_external", F.lit(False)))
        .drop("p_external")
        .withColumn("satisfied", satisfied)
    )


def eligible(node: DataFrame, scope: str | None = None, keep_vagrant: bool = False) -> DataFrame:
    """Containers and components that are tasks. The scoped planner drops vagrant nodes, global progress keeps them."""
    rows = with_states(node).where(
        F.col("kind").isin("container", "component")
        & F.col("status").isNotNull()
        & ~F.col("under_external")
        & ~((F.col("kind") == "container") & F.col("has_status_children"))
    )
    if not keep_vagrant:
        rows = rows.where("status <> 'vagrant'")
    if scope is not None:
        inside = closure(node).where(F.col("ancestor") == scope).select("model", F.col("descendant").alias("id"))
        rows = rows.join(inside, ["model", "id"], "left_semi")
    return rows


def progress(node: DataFrame, scope: str | None = None, keep_vagrant: bool = False) -> DataFrame:
    """(model, completed, total)."""
    return eligible(node, scope, keep_vagrant).groupBy("model").agg(F.count_if("satisfied").alias("completed"), F.count("*").alias("total"))


def blocking(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(model, id, blocker): components and the unsatisfied sibling components they point at."""
    states = with_states(node).select("model", "id", "kind", "parent_id", "satisfied")
    ends = resolve_endpoints(edge, states, "kind", "parent_id", "satisfied")
    return ends.where("s_kind = 'component' AND t_kind = 'component' AND s_parent_id <=> t_parent_id AND NOT t_satisfied").select(
        "model", F.col("source").alias("id"), F.col("target").alias("blocker")
    ).distinct()


def work(node: DataFrame, edge: DataFrame, scope: str | None = None) -> DataFrame:
    """Unsatisfied tasks with ``state`` ready or blocked; containers never block."""
    blocked = blocking(node, edge).select("model", "id", F.lit("blocked").alias("b")).distinct()
    return eligible(node, scope).where("NOT satisfied").join(blocked, ["model", "id"], "left").withColumn("state", F.coalesce("b", F.lit("ready"))).drop("b")


def stalled(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(model, ids): where work exists and nothing is ready, all blocked ids."""
    rows = work(node, edge).groupBy("model").agg(F.count_if(F.col("state") == "ready").alias("ready"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))
    return rows.where("ready = 0").select("model", "ids")


def roll_up(node: DataFrame) -> DataFrame:
    """Containers and systems to be marked implemented: their status children are all done."""
    return with_states(node).where(
        F.col("kind").isin("container", "system") & ~F.coalesce(F.col("status").isin("implemented", "verified"), F.lit(False)) & F.col("has_status_children") & F.col("children_done")
    ).select("model", "id", "name")


def pending_members(node: DataFrame, parents: str = "any") -> DataFrame:
    """Proposed code-level nodes under a component: of ``any`` component, or only of implemented and verified ``done`` ones."""
    comp = node.where("kind = 'component'")
    if parents == "done":
        comp = comp.where(F.col("status").isin("implemented", "verified"))
    return node.where(F.col("kind").isin(*CODE_KINDS) & (F.col("status") == "proposed")).join(
        comp.select("model", F.col("id").alias("parent_id")), ["model", "parent_id"], "left_semi"
    ).select("model", "id", "parent_id")


def scaffolds(node: DataFrame, group: DataFrame, member: DataFrame) -> DataFrame:
    """(model, group_id): groups whose members are all existing containers and all proposed."""
    kinds = node.select("model", F.col("id").alias("node_id"), "kind", "status")
    rows = member.join(kinds, ["model", "node_id"], "left").groupBy("model", "group_id").agg(
        F.bool_and(F.coalesce((F.col("kind") == "container") & (F.col("status") == "proposed"), F.lit(False))).alias("ok")
    )
    return group.select("model", F.col("id").alias("group_id")).join(rows.where("ok").select("model", "group_id"), ["model", "group_id"], "left_semi")


def menu(node: DataFrame, group: DataFrame, member: DataFrame) -> DataFrame:
    """(model, group_id, id): containers that need work, by their first group; a row set only where there are several."""
    states = with_states(node)
    open_kids = node.where(F.col("status").isNotNull() & ~F.col("status").isin(*DONE)).select("model", F.col("parent_id").alias("id"), F.lit(True).alias("kids")).distinct()
    rows = (
        states.where("kind = 'container' AND status IS NOT NULL AND NOT under_external AND NOT coalesce(external, false)")
        .join(open_kids, ["model", "id"], "left")
        .where(~F.col("satisfied") | F.coalesce("kids", F.lit(False)))
    )
    first = member.groupBy("model", F.col("node_id").alias("id")).agg(F.min("group_id").alias("group_id"))
    listed = rows.join(first, ["model", "id"], "left").select("model", F.coalesce("group_id", F.lit("")).alias("group_id"), "id")
    several = listed.groupBy("model").agg(F.count("*").alias("n")).where("n > 1")
    return listed.join(several.select("model"), "model", "left_semi")


def work_unit(node: DataFrame, edge: DataFrame, scope: str | None = None) -> DataFrame:
    """(model, id, ord): all ready containers, or else the ready components that share the first one's parent."""
    ready = work(node, edge, scope).where("state = 'ready'")
    first = ready.groupBy("model").agg(
        F.bool_or(F.col("kind") == "container").alias("containers"), F.min_by(F.struct("parent_id"), "ord").alias("p")
    )
    rows = ready.join(first, "model").where(
        F.when(F.col("containers"), F.col("kind") == "container").otherwise(F.col("parent_id").eqNullSafe(F.col("p.parent_id")))
    )
    return rows.select("model", "id", "ord")


def next_up(node: DataFrame, edge: DataFrame, scope: str | None = None) -> DataFrame:
    """(model, id): the first ready node outside the unit, or else the first blocked one."""
    unit = work_unit(node, edge, scope).select("model", "id", F.lit(True).alias("in_unit"))
    rows = work(node, edge, scope).join(unit, ["model", "id"], "left").where("state = 'blocked' OR in_unit IS NULL")
    rank = F.struct(F.when(F.col("state") == "ready", 0).otherwise(1).alias("tier"), "ord")
    return rows.groupBy("model").agg(F.min_by("id", rank).alias("id"))


def decision(node: DataFrame, edge: DataFrame, group: DataFrame, member: DataFrame, scope: str | None = None) -> DataFrame:
    """(model, decision): the planner's branch: done, complete, stall, scaffold, menu or unit."""
    tasks = eligible(node, scope).groupBy("model").agg(F.count("*").alias("tasks"))
    todo = work(node, edge, scope).groupBy("model").agg(F.count("*").alias("todo"), F.count_if(F.col("state") == "ready").alias("ready"))
    chosen = scaffolds(node, group, member)
    if scope is not None:
        up = closure(node).where(F.col("descendant") == scope).select("model", F.col("ancestor").alias("node_id"))
        chosen = chosen.join(member.join(up, ["model", "node_id"], "left_semi").select("model", "group_id").distinct(), ["model", "group_id"], "left_semi")
    has_scaffold = chosen.select("model", F.lit(True).alias("scaffold")).distinct()
    rows = node.select("model").distinct().join(tasks, "model", "left").join(todo, "model", "left").join(has_scaffold, "model", "left")
    if scope is None:
        rows = rows.join(menu(node, group, member).select("model", F.lit(True).alias("menu")).distinct(), "model", "left")
    else:
        rows = rows.withColumn("menu", F.lit(None).cast("boolean"))
    return rows.select(
        "model",
        F.when(F.coalesce("tasks", F.lit(0)) == 0, "done")
        .when(F.coalesce("todo", F.lit(0)) == 0, "complete")
        .when(F.col("ready") == 0, "stall")
        .when(F.col("scaffold"), "scaffold")
        .when(F.col("menu"), "menu")
        .otherwise("unit")
        .alias("decision"),
    )


def payload(node: DataFrame, edge: DataFrame, scope: str | None = None) -> DataFrame:
    """(model, id, members, depends_on, needed_by) of the work unit, lists sorted and comma-joined."""
    unit = work_unit(node, edge, scope).select("model", "id")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    kids = node.where(F.col("kind").isin(*CODE_KINDS)).groupBy("model", F.col("parent_id").alias("id")).agg(joined("id").alias("members"))
    ends = resolve_endpoints(edge, node, "name")
    out = ends.groupBy("model", F.col("source").alias("id")).agg(joined("t_name").alias("depends_on"))
    into = ends.groupBy("model", F.col("target").alias("id")).agg(joined("s_name").alias("needed_by"))
    rows = unit
    for part in (kids, out, into):
        rows = rows.join(part, ["model", "id"], "left")
    return rows.fillna("", ["members", "depends_on", "needed_by"])


def completion(node: DataFrame) -> DataFrame:
    """(model, kind, id): what is left once no task is open: nodes to roll up and pending members of finished components."""
    return roll_up(node).select("model", F.lit("roll_up").alias("kind"), "id").unionByName(
        pending_members(node, "done").select("model", F.lit("pending").alias("kind"), "id")
    )


def numbered(unit: DataFrame) -> DataFrame:
    """Unit rows with their place in document order."""
    return places.numbered(unit, ["model"], [F.col("ord"), F.col("id")])
