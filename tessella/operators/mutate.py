"""Mutations as functions from snapshot to snapshot.

A rejected change raises and leaves the snapshot as it was. Checks collect at
most a few offending ids for the message.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.predicates import label_too_long, parsed_status
from tessella.schema import CODE_KINDS

from .flows import duplicate_steps, labels_to_descriptions
from .graph import closure, first_by, last_wins
from .validate import children_of_external, parent_errors, verified_gate


class Rejected(ValueError):
    """A change that breaks a rule."""


def _reject(rows: DataFrame, column: str, why: str) -> None:
    bad = [r[0] for r in rows.select(column).distinct().limit(5).collect()]
    if bad:
        raise Rejected(f"{why}: {', '.join(map(str, sorted(map(str, bad))))}")


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Replace rows of the same key, append the others; of a key's changes the last in ``order`` counts."""
    final = last_wins(changes, list(keys), order).select(*base.columns)
    return base.join(final.select(*keys), list(keys), "left_anti").unionByName(final)


def set_model(node: DataFrame, edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checked full replacement: first edge of an id stays, positions go."""
    _reject(children_of_external(node), "node_id", "children of an external system")
    _reject(node.groupBy("model", "id").count().where("count > 1"), "id", "duplicate node id")
    flat = node.drop("x", "y")
    return flat, first_by(edge, ["model", "id"], "ord")


def add_nodes(node: DataFrame, new: DataFrame) -> DataFrame:
    """Append nodes with fresh ids in the order given; persons have no status. All or nothing."""
    top = node.groupBy("model").agg(
        F.max(F.regexp_extract("id", "^node-([0-9]+)\\z", 1).try_cast("bigint")).alias("_top"), F.max("ord").alias("_ord")
    )
    w = Window.partitionBy("model").orderBy("ord")
    rows = (
        new.join(top, "model", "left")
        .withColumn("_n", F.row_number().over(w))
        .withColumn("id", F.concat(F.lit("node-"), (F.coalesce("_top", F.lit(-1)) + F.col("_n")).cast("string")))
        .withColumn("ord", F.coalesce("_ord", F.lit(0)) + F.col("_n"))
        .withColumn("status", F.when(F.col("kind") != "person", F.col("status")))
        .select(*node.columns)
    )
    after = node.unionByName(rows)
    _reject(parent_errors(after).join(rows.select("model", F.col("id").alias("node_id")), ["model", "node_id"], "left_semi"), "error", "parent rule")
    return after


def subtree_ids(node: DataFrame, roots: Sequence[str], with_roots: bool = True) -> DataFrame:
    rows = closure(node).where(F.col("ancestor").isin(*roots))
    if not with_roots:
        rows = rows.where("depth > 0")
    return rows.select("model", F.col("descendant").alias("id")).distinct()


def delete_nodes(node: DataFrame, edge: DataFrame, ids: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes, all below them and all touching edges go; source maps and groups keep their entries (see ``orphans``)."""
    missing = [i for i in ids if node.where(F.col("id") == i).isEmpty()]
    if missing:
        raise Rejected(f"unknown nodes: {', '.join(missing)}")
    return _without(node, edge, subtree_ids(node, ids))


def _without(node: DataFrame, edge: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    edges = edge
    for end in ("source", "target"):
        edges = edges.join(gone.withColumnRenamed("id", end), ["model", end], "left_anti")
    return node.join(gone, ["model", "id"], "left_anti").select(*node.columns), edges.select(*edge.columns)


def orphans(node: DataFrame, source_map: DataFrame, member: DataFrame) -> DataFrame:
    """(model, relation, id): source-map owners and group members that are no node."""
    ids = node.select("model", "id")
    owners = source_map.select("model", F.lit("source_map").alias("relation"), F.col("owner_id").alias("id"))
    members = member.select("model", F.lit("group_member").alias("relation"), F.col("node_id").alias("id"))
    return owners.unionByName(members).join(ids, ["model", "id"], "left_anti").select("model", "relation", "id").distinct()


def set_node(node: DataFrame, edge: DataFrame, node_id: str, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace everything below a node; new edges whose id exists are skipped."""
    rest, edges = _without(node, edge, subtree_ids(node, [node_id], with_roots=False))
    _reject(new_nodes.join(rest.select("model", "id"), ["model", "id"], "left_semi"), "id", "id in use")
    after = rest.unionByName(new_nodes.select(*node.columns))
    fresh = new_nodes.select("model", F.col("id").alias("node_id"))
    _reject(parent_errors(after).join(fresh, ["model", "node_id"], "left_semi"), "error", "parent rule")
    below = subtree_ids(after, [node_id], with_roots=False)
    _reject(new_nodes.join(below, ["model", "id"], "left_anti"), "id", "not below the node")
    for end in ("source", "target"):
        _reject(new_edges.join(after.select("model", F.col("id").alias(end)), ["model", end], "left_anti"), end, "unknown edge end")
    added = new_edges.join(edges.select("model", "id"), ["model", "id"], "left_anti")
    return after, edges.unionByName(first_by(added, ["model", "id"], "ord").select(*edge.columns))


def update_nodes(node: DataFrame, patches: DataFrame, item: DataFrame, member: DataFrame) -> DataFrame:
    """Patch only supplied fields, patches to one node in order of ``seq``.

    ``patches`` has (model, id, seq, reason) and any fields, null where not
    supplied. A status needs a reason that is not blank; an unknown status
    clears it; ``verified`` needs a passed gate.
    """
    fields = [c for c in patches.columns if c in node.columns and c not in ("model", "id", "ord")]
    _reject(patches.join(node.select("model", "id"), ["model", "id"], "left_anti"), "id", "unknown node")
    merged = patches.groupBy("model", "id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in fields])
    if "status" in fields:
        _reject(patches.where("status IS NOT NULL AND trim(coalesce(reason, '')) = ''"), "id", "a status needs a reason")
    after = node.join(merged, ["model", "id"], "left")
    for c in fields:
        value = F.when(F.col(f"_{c}").isNotNull(), parsed_status(F.col(f"_{c}"))).otherwise(F.col(c)) if c == "status" else F.coalesce(F.col(f"_{c}"), F.col(c))
        after = after.withColumn(c, value)
    after = after.select(*node.columns)
    if "status" in fields:
        claimed = merged.where("_status = 'verified'").select("model", "id")
        failed = verified_gate(after, item, member).where("NOT passes").join(claimed, ["model", "id"], "left_semi")
        _reject(failed, "id", "unmet expectations")
    return after


def add_edges(edge: DataFrame, new: DataFrame, node: DataFrame) -> DataFrame:
    """Append edges under the id edge-<source>-<target>."""
    rows = new.withColumn("id", F.concat(F.lit("edge-"), "source", F.lit("-"), "target"))
    for end in ("source", "target"):
        _reject(rows.join(node.select("model", F.col("id").alias(end)), ["model", end], "left_anti"), end, "unknown edge end")
    _reject(rows.where(label_too_long(F.col("label"))), "id", "label too long")
    _reject(edge.select("model", "id").unionByName(rows.select("model", "id")).groupBy("model", "id").count().where("count > 1"), "id", "edge exists")
    return edge.unionByName(rows.select(*edge.columns))


def update_edges(edge: DataFrame, patches: DataFrame) -> DataFrame:
    """Patch label and method, null where not supplied."""
    _reject(patches.join(edge.select("model", "id"), ["model", "id"], "left_anti"), "id", "unknown edge")
    _reject(patches.where(label_too_long(F.col("label"))), "id", "label too long")
    new = patches.select("model", "id", F.col("label").alias("_label"), F.col("method").alias("_method"))
    return edge.join(new, ["model", "id"], "left").withColumn("label", F.coalesce("_label", "label")).withColumn("method", F.coalesce("_method", "method")).select(*edge.columns)


def delete_edges(edge: DataFrame, ids: Sequence[str]) -> DataFrame:
    return edge.where(~F.col("id").isin(*ids))


def set_flows(flow: DataFrame, step: DataFrame, new_flow: DataFrame, new_step: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace or append flows with all their steps."""
    _reject(duplicate_steps(new_step), "step_id", "duplicate step id")
    flows = upsert(flow, new_flow, ["model", "id"], "ord")
    replaced = new_flow.select("model", F.col("id").alias("flow_id")).distinct()
    steps = step.join(replaced, ["model", "flow_id"], "left_anti").select(*step.columns).unionByName(labels_to_descriptions(new_step).select(*step.columns))
    return flows, steps


def delete_flow(flow: DataFrame, step: DataFrame, flow_id: str) -> tuple[DataFrame, DataFrame]:
    if flow.where(F.col("id") == flow_id).isEmpty():
        raise Rejected(f"unknown flow: {flow_id}")
    return flow.where(F.col("id") != flow_id), step.where(F.col("flow_id") != flow_id)


def set_groups(group: DataFrame, member: DataFrame, new_group: DataFrame, new_member: DataFrame, node: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace or append groups. A node is in one group: the last one of the batch takes it; groups left empty go."""
    known = node.select("model", F.col("id").alias("node_id"), "kind")
    _reject(new_member.join(known, ["model", "node_id"], "left_anti"), "node_id", "unknown member")
    kinds = new_member.join(known, ["model", "node_id"])
    _reject(kinds.where(~F.col("kind").isin("container", "component")), "node_id", "only containers and components can be grouped")
    _reject(kinds.groupBy("model", "group_id").agg(F.count_distinct("kind").alias("n")).where("n > 1"), "group_id", "members of several levels")
    groups = upsert(group, new_group, ["model", "id"], "ord")
    placed = new_member.join(new_group.select("model", F.col("id").alias("group_id"), F.col("ord").alias("_ord")), ["model", "group_id"])
    taken = last_wins(placed, ["model", "node_id"], "_ord").select(*member.columns)
    kept = member.join(new_group.select("model", F.col("id").alias("group_id")), ["model", "group_id"], "left_anti").join(
        taken.select("model", "node_id"), ["model", "node_id"], "left_anti"
    )
    members = kept.select(*member.columns).unionByName(taken)
    return groups.join(members.select("model", F.col("group_id").alias("id")).distinct(), ["model", "id"], "left_semi").select(*group.columns), members


def delete_group(group: DataFrame, member: DataFrame, group_id: str, adopt: bool = False) -> tuple[DataFrame, DataFrame]:
    """Without a group; ``adopt`` hands its child groups to its own parent instead of leaving their parent dangling."""
    if group.where(F.col("id") == group_id).isEmpty():
        raise Rejected(f"unknown group: {group_id}")
    rest = group.where(F.col("id") != group_id)
    if adopt:
        up = group.where(F.col("id") == group_id).select("model", F.col("parent_group_id").alias("_up"))
        rest = rest.join(up, "model", "left").withColumn("parent_group_id", F.when(F.col("parent_group_id") == group_id, F.col("_up")).otherwise(F.col("parent_group_id"))).select(*group.columns)
    return rest, member.where(F.col("group_id") != group_id)


def update_source_map(source_map: DataFrame, owner_id: str, rows: DataFrame, node: DataFrame, flow: DataFrame) -> DataFrame:
    """Replace the entries of a node or flow; no rows remove them."""
    if node.where(F.col("id") == owner_id).isEmpty() and flow.where(F.col("id") == owner_id).isEmpty():
        raise Rejected(f"unknown owner: {owner_id}")
    return source_map.where(F.col("owner_id") != owner_id).unionByName(rows.select(*source_map.columns))


def code_level(node: DataFrame) -> DataFrame:
    return node.where(F.col("kind").isin(*CODE_KINDS))
