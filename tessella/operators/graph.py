"""Containment trees and dependency edges as relations.

Closures double the known path length in every round, so a chain of n steps
needs about log2(n) joins. They are set-based and therefore safe on cycles; the
depth of a pair is its shortest distance.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.lineage import cut, written


#: Closures of the node tables in use, so that the operators of one query share them.
_closures: WeakKeyDictionary[DataFrame, dict[tuple[str, str], DataFrame]] = WeakKeyDictionary()


def closure(node: DataFrame, child: str = "id", parent: str = "parent_id") -> DataFrame:
    """(model, ancestor, descendant, depth) including every node itself at depth 0.

    Parents that are no node are left out. On a cycle a node reaches itself at
    depth 0 only. The closure is written once for each node table (the same
    DataFrame object), which must not change while it is in use.
    """
    known = _closures.setdefault(node, {})
    if (child, parent) not in known:
        known[child, parent] = _closed(node, child, parent)
    return known[child, parent]


def _closed(node: DataFrame, child: str, parent: str) -> DataFrame:
    ids = node.select("model", F.col(child).alias("id")).distinct()
    step = (
        node.where(F.col(parent).isNotNull())
        .select("model", F.col(child).alias("descendant"), F.col(parent).alias("ancestor"))
        .distinct()
        .join(ids.withColumnRenamed("id", "ancestor"), ["model", "ancestor"], "left_semi")
        .withColumn("depth", F.lit(1))
    )
    paths = cut(ids.select("model", F.col("id").alias("ancestor"), F.col("id").alias("descendant"), F.lit(0).alias("depth")).unionByName(step))
    reach = 1
    while True:
        upper = paths.select("model", F.col("ancestor").alias("top"), F.col("descendant").alias("ancestor"), F.col("depth").alias("above")).where(
            F.col("above") > 0
        )
        longer = paths.where(F.col("depth") == reach).join(upper, ["model", "ancestor"]).select(
            "model", F.col("top").alias("ancestor"), "descendant", (F.col("depth") + F.col("above")).alias("depth")
        )
        wider = cut(paths.unionByName(longer).groupBy("model", "ancestor", "descendant").agg(F.min("depth").alias("depth")))
        # a path of twice the reach is the only one that the next round could make longer
        if (wider.agg(F.max("depth")).first()[0] or 0) < 2 * reach:
            return wider
        paths, reach = wider, reach * 2


def descendants(node: DataFrame, root: str) -> DataFrame:
    """(model, id, depth) of the subtree of ``root`` without itself."""
    return closure(node).where((F.col("ancestor") == root) & (F.col("depth") > 0)).select("model", F.col("descendant").alias("id"), "depth")


def ancestor_chain(node: DataFrame) -> DataFrame:
    """(model, id, chain): ancestor ids of each node, root first, without itself."""
    pairs = closure(node).where("depth > 0").groupBy("model", F.col("descendant").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), F.col("ancestor").alias("id")))).alias("c")
    )
    return node.select("model", "id").join(pairs, ["model", "id"], "left").select(
        "model", "id", F.coalesce(F.transform("c", lambda x: x["id"]), F.array().cast("array<string>")).alias("chain")
    )


def breadcrumbs(node: DataFrame) -> DataFrame:
    """(model, id, crumbs): names from the root down to the node; an unnamed ancestor shows its id."""
    pairs = closure(node).join(node.select("model", F.col("id").alias("ancestor"), "name"), ["model", "ancestor"])
    return pairs.groupBy("model", F.col("descendant").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), F.coalesce("name", "ancestor").alias("n")))).alias("c")
    ).select("model", "id", F.array_join(F.transform("c", lambda x: x["n"]), " / ").alias("crumbs"))


def resolve_endpoints(edge: DataFrame, node: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """Edges with ``s_`` and ``t_`` columns of both ends; the inner form drops dangling edges."""
    side = lambda p, key: node.select("model", F.col("id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return edge.join(side("s", "source"), ["model", "source"], how).join(side("t", "target"), ["model", "target"], how)


def edge_labels(edge: DataFrame, node: DataFrame) -> DataFrame:
    """Edges with the names of their ends; a missing or unnamed node shows its id."""
    named = resolve_endpoints(edge, node, "name", how="left")
    return named.select("model", "id", F.coalesce("s_name", "source").alias("source_name"), F.coalesce("t_name", "target").alias("target_name"))


def dangling(edge: DataFrame, node: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = node.select("model", "id")
    good = edge.join(ids.withColumnRenamed("id", "source"), ["model", "source"], "left_semi").join(
        ids.withColumnRenamed("id", "target"), ["model", "target"], "left_semi"
    )
    return edge.join(good.select("model", "id"), ["model", "id"], "left_anti")


def subtree_edges(node: DataFrame, edge: DataFrame, keep_dangling: bool = True) -> DataFrame:
    """(model, root, edge_id, side, outside_id, outside_name, outside_kind) of every subtree.

    ``internal`` edges have both ends in the subtree, ``external`` ones exactly
    one. An external edge whose outside node is missing stays with a null name,
    unless ``keep_dangling`` is false.
    """
    inside = closure(node).select("model", F.col("ancestor").alias("root"), F.col("descendant").alias("id"))
    ends = edge.select("model", F.col("id").alias("edge_id"), F.explode(F.array(
        F.struct(F.col("source").alias("id"), F.col("target").alias("other"), F.lit(1).alias("s"), F.lit(0).alias("t")),
        F.struct(F.col("target").alias("id"), F.col("source").alias("other"), F.lit(0).alias("s"), F.lit(1).alias("t")),
    )).alias("e")).select("model", "edge_id", "e.*")
    touched = ends.join(inside, ["model", "id"]).groupBy("model", "root", "edge_id").agg(
        F.max("s").alias("s"), F.max("t").alias("t"), F.max(F.when(F.col("s") == 1, F.col("other"))).alias("target"), F.max(F.when(F.col("t") == 1, F.col("other"))).alias("source")
    )
    sided = touched.withColumn("side", F.when(F.col("s") + F.col("t") == 2, "internal").otherwise("external")).withColumn(
        "outside_id", F.when(F.col("s") + F.col("t") == 2, F.lit(None)).when(F.col("s") == 1, F.col("target")).otherwise(F.col("source"))
    )
    outside = node.select("model", F.col("id").alias("outside_id"), F.col("name").alias("outside_name"), F.col("kind").alias("outside_kind"))
    out = sided.join(outside, ["model", "outside_id"], "left").select("model", "root", "edge_id", "side", "outside_id", "outside_name", "outside_kind")
    return out if keep_dangling else out.where((F.col("side") == "internal") | F.col("outside_kind").isNotNull())


def reversed_pairs(edge: DataFrame) -> DataFrame:
    """Edges A to B for which there is an edge B to A."""
    back = edge.select("model", F.col("target").alias("source"), F.col("source").alias("target")).distinct()
    return edge.join(back, ["model", "source", "target"], "left_semi")


def pair_duplicates(edge: DataFrame) -> DataFrame:
    """(model, a, b, edges, warnings): unordered pairs with n > 1 edges give n - 1 warnings."""
    pairs = edge.groupBy("model", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    return pairs.agg(F.count("*").alias("edges")).where("edges > 1").withColumn("warnings", F.col("edges") - 1)


def degrees(edge: DataFrame, hub: int = 3) -> DataFrame:
    """(model, id, degree, is_hub), both ends counted; an edge to itself counts twice."""
    ends = edge.select("model", F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("model", "id").agg(F.count("*").alias("degree")).withColumn("is_hub", F.col("degree") >= hub)


def components(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(model, id, component): smallest node id reachable over undirected edges.

    Alternating large-star and small-star steps; each round is two aggregations
    and two joins, whatever the diameter. Minima are cut before they are joined,
    so that the many edges of one hub can be split there. Labels only fall, so
    the rounds end.
    """
    ends = resolve_endpoints(edge, node)
    now = cut(ends.where("source <> target").select("model", F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")).distinct())
    seen = None
    while True:
        both = now.unionByName(now.select("model", F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("model", "u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, ["model", "u"]).where("v > u").select("model", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        lowest = cut(large.groupBy("model", "u").agg(F.min("v").alias("m")))
        small = large.join(lowest, ["model", "u"]).select("model", F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = cut(small.select("model", "e.u", "e.v").where("u <> v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("model", "u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    labels = now.select("model", F.col("u").alias("id"), F.col("v").alias("component"))
    return node.select("model", "id").join(labels, ["model", "id"], "left").select("model", "id", F.coalesce("component", "id").alias("component"))


def group_chain(node: DataFrame, group: DataFrame, member: DataFrame) -> DataFrame:
    """(model, node_id, group_id, depth): the first group that holds a node, then its parents upward; a group is visited once."""
    order = group.select("model", F.col("id").alias("group_id"), "ord") if "ord" in group.columns else group.select("model", F.col("id").alias("group_id"), F.col("id").alias("ord"))
    first = member.join(order, ["model", "group_id"]).groupBy("model", "node_id").agg(F.min_by("group_id", F.struct("ord", "group_id")).alias("first"))
    first = first.join(node.select("model", F.col("id").alias("node_id")), ["model", "node_id"], "left_semi")
    up = closure(group, "id", "parent_group_id")
    return first.join(up.withColumnRenamed("descendant", "first"), ["model", "first"]).select("model", "node_id", F.col("ancestor").alias("group_id"), "depth")


def group_nesting_errors(group: DataFrame, member: DataFrame, node: DataFrame) -> DataFrame:
    """(model, group_id, error): ``self_parent``, ``unknown_parent``, ``cycle`` or ``level`` (members of another kind than the parent's)."""
    ids = group.select("model", F.col("id").alias("parent_group_id"), F.lit(True).alias("known"))
    plain = group.join(ids, ["model", "parent_group_id"], "left").select(
        "model",
        F.col("id").alias("group_id"),
        F.when(F.col("parent_group_id") == F.col("id"), "self_parent").when(F.col("parent_group_id").isNotNull() & F.col("known").isNull(), "unknown_parent").alias("error"),
    ).where("error IS NOT NULL")
    proper = group.where("parent_group_id IS NOT NULL AND parent_group_id <> id")
    up = closure(group, "id", "parent_group_id").where("depth > 0").select("model", F.col("ancestor").alias("parent_group_id"), F.col("descendant").alias("x"))
    # a group is on a cycle if its parent can reach back to it
    cyclic = proper.select("model", "id", "parent_group_id").join(
        up.select("model", F.col("x").alias("parent_group_id"), F.col("parent_group_id").alias("id")), ["model", "parent_group_id", "id"], "left_semi"
    ).select("model", F.col("id").alias("group_id"), F.lit("cycle").alias("error"))
    kinds = member.join(node.select("model", F.col("id").alias("node_id"), "kind"), ["model", "node_id"]).groupBy("model", "group_id").agg(F.min("kind").alias("kind"))
    level = (
        proper.select("model", F.col("id").alias("group_id"), "parent_group_id")
        .join(kinds, ["model", "group_id"])
        .join(kinds.select("model", F.col("group_id").alias("parent_group_id"), F.col("kind").alias("parent_kind")), ["model", "parent_group_id"])
        .where("kind <> parent_kind")
        .select("model", "group_id", F.lit("level").alias("error"))
    )
    return plain.unionByName(cyclic).unionByName(level)


#: Rows that share one copy of an inherited text.
PORTION = 4096


def inherited_contract(node: DataFrame, item: DataFrame) -> DataFrame:
    """(model, id, section, texts): contract texts from the root down to the node; groups do not count; duplicates stay.

    Nodes with the same chain of owners above them inherit the same text. It is
    made once for each chain and meets its nodes in the last join, a copy for
    every ``PORTION`` of them, so that only ids and own texts are moved for each
    node and the long results are not moved at all.
    """
    key = ["model", "section", "chain"]
    listed = lambda of: F.when(F.count("text") > 0, F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(of, "text"))), lambda x: x["text"]), "|")).alias("text")
    own = written(item.groupBy("model", F.col("owner_id").alias("ancestor"), "section").agg(listed("pos")), "contract")
    above = F.when(F.col("depth") > 0, F.struct((-F.col("depth")).alias("d"), F.col("ancestor").alias("id")))
    chains = closure(node).join(own.select("model", "ancestor", "section"), ["model", "ancestor"]).groupBy("model", F.col("descendant").alias("id"), "section").agg(
        F.transform(F.sort_array(F.collect_list(above)), lambda x: x["id"]).alias("chain")
    )
    chains = written(chains, "chains")
    sizes = chains.groupBy(*key).agg(F.ceil(F.count("*") / PORTION).alias("portions"))
    parts = sizes.select(*key, "portions", F.posexplode("chain").alias("pos", "ancestor")).join(own, ["model", "ancestor", "section"])
    inherited = parts.groupBy(*key, "portions").agg(listed("pos")).select(*key, F.col("text").alias("inherited"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1)).alias("portion"))
    dealt = chains.join(own.withColumnRenamed("ancestor", "id"), ["model", "id", "section"], "left").join(sizes, key).withColumn("portion", F.pmod(F.xxhash64("id"), F.col("portions")))
    texts = F.when(F.coalesce("inherited", "text").isNotNull(), F.concat_ws("|", "inherited", "text"))
    return dealt.drop("portions").join(inherited, [*key, "portion"], "left").select("model", "id", "section", texts.alias("texts"))


def inherited_notes(node: DataFrame, note: DataFrame) -> DataFrame:
    """(model, id, notes): ancestors' notes as "Name: note", then the node's own, bare."""
    own = note.select("model", F.col("node_id").alias("ancestor"), "pos", "text")
    rows = closure(node).join(own, ["model", "ancestor"]).join(node.select("model", F.col("id").alias("ancestor"), "name"), ["model", "ancestor"])
    line = F.when(F.col("depth") > 0, F.concat_ws(": ", F.coalesce("name", "ancestor"), "text")).otherwise(F.col("text"))
    return rows.groupBy("model", F.col("descendant").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), "pos", line.alias("line")))).alias("c")
    ).select("model", "id", F.array_join(F.transform("c", lambda x: x["line"]), "|").alias("notes"))


def first_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """First row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Last row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def bounding_box(node: DataFrame, *keys: str) -> DataFrame:
    """Extent and centre of positioned nodes."""
    return node.groupBy(*keys).agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.avg("x").alias("mid_x"), F.avg("y").alias("mid_y")
    )


def next_id(ids: DataFrame, prefix: str, column: str = "id") -> DataFrame:
    """(model, next_id): the largest numeric suffix after ``prefix-`` plus one, 0 if there is none."""
    suffix = F.regexp_extract(column, f"^{prefix}-([0-9]+)\\z", 1).try_cast("bigint")
    return ids.groupBy("model").agg(F.concat(F.lit(f"{prefix}-"), F.coalesce(F.max(suffix) + 1, F.lit(0)).cast("string")).alias("next_id"))
