"""Validation rules of a model. Each returns rows, not messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import closure, pair_duplicates, resolve_endpoints


def _ends(edge: DataFrame) -> DataFrame:
    """Every edge from both of its ends: (model, edge_id, a, b)."""
    return edge.select("model", F.col("id").alias("edge_id"), F.explode(F.array(
        F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b"))
    )).alias("e")).select("model", "edge_id", "e.a", "e.b")


def view_members(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(model, view, node_id, role): owned and reference nodes of every level view."""
    n = node.select("model", "id", "kind", "parent_id", F.coalesce("external", F.lit(False)).alias("external"))
    tops = n.where(F.col("kind").isin("person", "system"))
    system_level = tops.select("model", F.lit("system").alias("view"), F.col("id").alias("node_id"), F.lit("owned").alias("role"))

    def children(parent_kind: str, kind: str) -> DataFrame:
        parents = n.where(F.col("kind") == parent_kind)
        if parent_kind == "system":
            parents = parents.where("NOT external")
        parents = parents.select("model", F.col("id").alias("parent_id"), F.col("parent_id").alias("above"))
        return n.where(F.col("kind") == kind).join(parents, ["model", "parent_id"]).select(
            "model", F.concat(F.lit(f"{kind}:"), "parent_id").alias("view"), F.col("parent_id").alias("top"), "above", "id"
        )

    owned = children("system", "container").unionByName(children("container", "component"))
    shown = owned.select("model", "view", F.col("id").alias("node_id"), F.lit("owned").alias("role"))
    ends = _ends(edge)
    # container level: other persons and systems that share an edge with the system or one of its containers
    own = owned.where("view LIKE 'container:%'")
    near = own.select("model", "view", "top", F.col("id").alias("a")).unionByName(own.select("model", "view", "top", F.col("top").alias("a"))).distinct()
    refs = near.join(ends, ["model", "a"]).where("b <> top").select("model", "view", F.col("b").alias("id")).distinct()
    refs = refs.join(tops.select("model", "id"), ["model", "id"], "left_semi")
    # component level: far ends of edges on the container itself
    own = owned.where("view LIKE 'component:%'").select("model", "view", "top", "above").distinct()
    far = own.join(ends.withColumnRenamed("a", "top"), ["model", "top"]).where(~F.col("b").eqNullSafe(F.col("above")))
    far = far.select("model", "view", F.col("b").alias("id")).distinct().join(n.where("kind <> 'component'").select("model", "id"), ["model", "id"], "left_semi")
    reference = refs.unionByName(far).select("model", "view", F.col("id").alias("node_id"), F.lit("reference").alias("role"))
    return system_level.unionByName(shown).unionByName(reference)


def disconnected_nodes(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(model, view, node_id, problem) with problem ``elsewhere``, ``no_edges`` or ``not_to_children``."""
    members = view_members(node, edge)
    ends = _ends(edge).select("model", "a", "b").distinct()
    linked = (
        members.select("model", "view", F.col("node_id").alias("a"))
        .join(ends, ["model", "a"])
        .join(members.select("model", "view", F.col("node_id").alias("b")), ["model", "view", "b"], "left_semi")
        .select("model", "view", F.col("a").alias("node_id"))
        .distinct()
    )
    touched = ends.select("model", F.col("a").alias("node_id"), F.lit(True).alias("touched")).distinct()
    owned = members.where("role = 'owned'").groupBy("model", "view").agg(F.count("*").alias("owned"))
    lonely = members.join(linked, ["model", "view", "node_id"], "left_anti").join(owned, ["model", "view"]).join(touched, ["model", "node_id"], "left")
    problem = F.when(F.col("role") == "reference", "not_to_children").when(F.col("touched"), "elsewhere").when(F.col("owned") > 1, "no_edges")
    return lonely.select("model", "view", "node_id", problem.alias("problem")).where("problem IS NOT NULL")


def bidirectional_edges(edge: DataFrame) -> DataFrame:
    return pair_duplicates(edge)


def mentions(text: Column, allow_empty: bool = True) -> Column:
    """Names inside ``@[...]``; an unterminated mention is none."""
    return F.regexp_extract_all(text, F.lit("@\\[([^\\]]*)\\]" if allow_empty else "@\\[([^\\]]+)\\]"), F.lit(1))


def mentions_without_edge(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(model, node_id, mentioned, pos): mentions whose two nodes, with all their ancestors, share no edge.

    Itself, a child, the parent and a sibling under the same parent are exempt;
    unknown names are ignored; of equal names the last node counts; a repeated
    mention is reported again.
    """
    named = node.where("name IS NOT NULL").groupBy("model", "name").agg(F.max_by(F.struct("id", "parent_id"), F.struct("ord", "id")).alias("t"))
    said = node.select("model", "id", "parent_id", F.posexplode(mentions(F.col("description"))).alias("pos", "name"))
    pairs = said.join(named, ["model", "name"]).select("model", F.col("id").alias("node_id"), "parent_id", "pos", F.col("t.id").alias("mentioned"), F.col("t.parent_id").alias("other_parent"))
    pairs = pairs.where(
        (F.col("node_id") != F.col("mentioned"))
        & ~F.col("other_parent").eqNullSafe(F.col("node_id"))
        & ~F.col("parent_id").eqNullSafe(F.col("mentioned"))
        & ~F.coalesce(F.col("parent_id") == F.col("other_parent"), F.lit(False))
    )
    up = closure(node)
    # pairs of nodes that an edge links through any of their ancestors, only for the pairs in question
    wanted = pairs.select("model", "node_id", "mentioned").distinct()
    a = up.select("model", F.col("descendant").alias("node_id"), F.col("ancestor").alias("a"))
    b = up.select("model", F.col("descendant").alias("mentioned"), F.col("ancestor").alias("b"))
    linked = wanted.join(a, ["model", "node_id"]).join(b, ["model", "mentioned"]).join(_ends(edge).select("model", "a", "b").distinct(), ["model", "a", "b"], "left_semi")
    return pairs.join(linked.select("model", "node_id", "mentioned").distinct(), ["model", "node_id", "mentioned"], "left_anti").select("model", "node_id", "mentioned", "pos")


def cross_container_edges(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Edges between components of different parents."""
    ends = resolve_endpoints(edge, node, "kind", "parent_id")
    return ends.where("s_kind = 'component' AND t_kind = 'component' AND NOT (s_parent_id <=> t_parent_id)").select("model", "id", "source", "target")


def children_of_external(node: DataFrame) -> DataFrame:
    """(model, node_id): the first node in order that lies under an external system."""
    outside = node.where("kind = 'system' AND external").select("model", F.col("id").alias("parent_id"))
    return node.join(outside, ["model", "parent_id"], "left_semi").groupBy("model").agg(F.min_by("id", F.struct("ord", "id")).alias("node_id"))


def parent_errors(node: DataFrame) -> DataFrame:
    """(model, node_id, error) of nodes that break the containment rule."""
    above = node.select("model", F.col("id").alias("parent_id"), F.col("kind").alias("p_kind"), F.coalesce("external", F.lit(False)).alias("p_external"))
    wanted = F.when(F.col("kind") == "container", "system").when(F.col("kind") == "component", "container").otherwise("component")
    top = F.col("kind").isin("person", "system")
    error = (
        F.when(top, F.when(F.col("parent_id").isNotNull(), "must_be_top_level"))
        .when(F.col("parent_id").isNull(), "needs_parent")
        .when(F.col("p_kind").isNull(), "unknown_parent")
        .when(F.col("p_kind") != wanted, "wrong_parent_kind")
        .when((F.col("kind") == "container") & F.col("p_external"), "external_parent")
    )
    return node.join(above, ["model", "parent_id"], "left").select("model", F.col("id").alias("node_id"), error.alias("error")).where("error IS NOT NULL")


def unmet_expectations(node: DataFrame, item: DataFrame, member: DataFrame) -> DataFrame:
    """(model, id, owner_id, pos): expect items not passed on a node, its ancestors and the groups that hold any of these directly."""
    up = closure(node).select("model", F.col("descendant").alias("id"), F.col("ancestor").alias("owner_id"))
    groups = up.join(member.select("model", F.col("node_id").alias("owner_id"), "group_id"), ["model", "owner_id"]).select("model", "id", F.col("group_id").alias("owner_id")).distinct()
    open_items = item.where("section = 'expect' AND NOT (passed <=> true)").select("model", "owner_id", "pos", "text")
    return up.unionByName(groups).join(open_items, ["model", "owner_id"]).select("model", "id", "owner_id", "pos")


def verified_gate(node: DataFrame, item: DataFrame, member: DataFrame) -> DataFrame:
    """(model, id, unmet, passes) of every node."""
    unmet = unmet_expectations(node, item, member).groupBy("model", "id").agg(F.count("*").alias("unmet"))
    return node.select("model", "id").join(unmet, ["model", "id"], "left").select(
        "model", "id", F.coalesce("unmet", F.lit(0)).cast("long").alias("unmet"), F.col("unmet").isNull().alias("passes")
    )


def report(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(model, rule, subject, detail) of all checks."""
    row = lambda df, rule, subject, detail: df.select("model", F.lit(rule).alias("rule"), subject.alias("subject"), detail.alias("detail"))
    pairs = bidirectional_edges(edge).withColumn("_", F.explode(F.expr("sequence(1, int(warnings))")))
    return (
        row(disconnected_nodes(node, edge), "disconnected", F.col("node_id"), F.concat_ws(" ", "problem", "view"))
        .unionByName(row(pairs, "bidirectional", F.col("a"), F.col("b")))
        .unionByName(row(mentions_without_edge(node, edge), "mention", F.col("node_id"), F.col("mentioned")))
        .unionByName(row(cross_container_edges(node, edge), "cross_container", F.col("source"), F.col("target")))
    )


def missing_externals(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(model, parent_id, external_id): nodes linked to a system or container but to nothing inside it."""
    inner = closure(node).where("depth > 0").select("model", F.col("ancestor").alias("parent_id"), F.col("descendant").alias("inside"))
    parents = inner.select("model", "parent_id").distinct().join(
        node.where(F.col("kind").isin("system", "container")).select("model", F.col("id").alias("parent_id")), ["model", "parent_id"], "left_semi"
    )
    ends = _ends(edge).select("model", "a", "b").distinct()
    far = parents.join(ends.select("model", F.col("a").alias("parent_id"), F.col("b").alias("external_id")), ["model", "parent_id"]).where("parent_id <> external_id")
    far = far.join(inner.withColumnRenamed("inside", "external_id"), ["model", "parent_id", "external_id"], "left_anti")
    far = far.join(node.select("model", F.col("id").alias("external_id")), ["model", "external_id"], "left_semi")
    met = inner.join(ends.select("model", F.col("a").alias("inside"), F.col("b").alias("external_id")), ["model", "inside"]).select("model", "parent_id", "external_id").distinct()
    return far.join(met, ["model", "parent_id", "external_id"], "left_anti").select("model", "parent_id", "external_id").distinct()


def invalid_property_labels(prop: DataFrame) -> DataFrame:
    """(model, node_id, label): the first label of a node that is no type name."""
    bad = prop.where(~F.coalesce(F.col("label").rlike("^[A-Za-z][A-Za-z0-9_]*\\z"), F.lit(False)))
    return bad.groupBy("model", "node_id").agg(F.min_by("label", F.struct("pos", "label")).alias("label"))
