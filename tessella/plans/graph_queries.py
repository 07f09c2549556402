"""Hierarchy, joins, aggregation and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import graph

from .registry import query
from .relations import edge, node, note

CLOSURE = """clo(ancestor, descendant, depth) AS (
 SELECT id, id, 0 FROM nodes UNION ALL SELECT c.ancestor, n.id, c.depth + 1 FROM clo c JOIN nodes n ON n.parent_id = c.descendant)"""
GROUPS_UP = """gup(node_id, group_id, depth) AS (
 SELECT node_id, min(group_id), 0 FROM group_member WHERE node_id IN (SELECT id FROM nodes) GROUP BY node_id
 UNION ALL SELECT u.node_id, g.parent_group_id, u.depth + 1 FROM gup u JOIN model_group g ON g.id = u.group_id WHERE g.parent_group_id IS NOT NULL)"""


@query("r1_closure_by_system", CLOSURE + """
SELECT c.ancestor AS system_id, count(*) AS nodes, max(depth) AS max_depth FROM clo c JOIN nodes n ON n.id = c.ancestor WHERE n.kind = 'system' GROUP BY 1""")
def r1_closure_by_system(f):
    n = node(f)
    systems = n.where("kind = 'system'").select("model", F.col("id").alias("ancestor"))
    return graph.closure(n).join(systems, ["model", "ancestor"]).groupBy("model", F.col("ancestor").alias("system_id")).agg(
        F.count("*").alias("nodes"), F.max("depth").alias("max_depth")
    )


@query("r1_descendants", CLOSURE + """
SELECT descendant AS id, depth FROM clo WHERE ancestor = 'system-1' AND depth > 0""")
def r1_descendants(f):
    return graph.descendants(node(f), "system-1")


@query("r2_is_descendant", CLOSURE + """
SELECT n.id, EXISTS (SELECT 1 FROM clo WHERE ancestor = 'system-0' AND descendant = n.id AND depth > 0) AS below FROM nodes n""")
def r2_is_descendant(f):
    n = node(f)
    return n.select("model", "id").join(graph.descendants(n, "system-0"), ["model", "id"], "left").select("model", "id", F.col("depth").isNotNull().alias("below"))


@query("r3_ancestor_chain", CLOSURE + """
SELECT n.id, coalesce((SELECT string_agg(ancestor, '>' ORDER BY depth DESC) FROM clo WHERE descendant = n.id AND depth > 0), '') AS chain FROM nodes n""")
def r3_ancestor_chain(f):
    return graph.ancestor_chain(node(f)).select("model", "id", F.array_join("chain", ">").alias("chain"))


@query("r4_group_chain", GROUPS_UP + """
SELECT node_id, group_id, depth FROM gup""")
def r4_group_chain(f):
    return graph.group_chain(node(f), f["model_group"], f["group_member"])


@query("r5_group_nesting", """bad AS (SELECT id, CASE WHEN id LIKE '%-0' THEN id ELSE concat(substr(id, 1, 7), '9') END parent_group_id FROM model_group)
SELECT id AS group_id, CASE WHEN parent_group_id = id THEN 'self_parent' ELSE 'unknown_parent' END AS error FROM bad
WHERE parent_group_id = id OR parent_group_id NOT IN (SELECT id FROM model_group)""")
def r5_group_nesting(f):
    broken = f["model_group"].withColumn("parent_group_id", F.when(F.col("id").like("%-0"), F.col("id")).otherwise(F.concat(F.substring("id", 1, 7), F.lit("9"))))
    return graph.group_nesting_errors(broken, f["group_member"], node(f))


@query("r6_contract_inheritance", CLOSURE + """
SELECT c.descendant AS id, i.section, string_agg(i.text, '|' ORDER BY c.depth DESC, i.pos) AS texts FROM clo c JOIN contract_item i ON i.owner_id = c.ancestor GROUP BY 1, 2""")
def r6_contract_inheritance(f):
    return graph.inherited_contract(node(f), f["contract_item"])


NOTES = """note AS (SELECT n.id node_id, p.pos, concat('note on ', n.name) AS text FROM nodes n JOIN (SELECT 0 pos UNION ALL SELECT 1) p ON p.pos = 0 OR n.kind = 'component'
 WHERE n.kind IN ('system', 'container') OR (n.kind = 'component' AND n.status IS NOT NULL))"""


@query("r7_notes_inheritance", CLOSURE + ", " + NOTES + """
SELECT c.descendant AS id, string_agg(CASE WHEN c.depth > 0 THEN concat(a.name, ': ', i.text) ELSE i.text END, '|' ORDER BY c.depth DESC, i.pos) AS notes
FROM clo c JOIN note i ON i.node_id = c.ancestor JOIN nodes a ON a.id = c.ancestor GROUP BY 1""")
def r7_notes_inheritance(f):
    return graph.inherited_notes(node(f), note(f))


@query("r8_breadcrumbs", CLOSURE + """
SELECT c.descendant AS id, string_agg(coalesce(a.name, a.id), ' / ' ORDER BY c.depth DESC) AS crumbs FROM clo c JOIN nodes a ON a.id = c.ancestor GROUP BY 1""")
def r8_breadcrumbs(f):
    return graph.breadcrumbs(node(f))


@query("r15_annotated_directories", """dirs AS (SELECT DISTINCT path, array_to_string(string_split(path, '/')[1:k], '/') AS dir FROM file, (SELECT unnest([1, 2]) AS k))
SELECT dir, bool_or(path LIKE '%f7%') AS annotated, count(*) AS files FROM dirs GROUP BY dir""")
def r15_annotated_directories(f):
    from tessella.operators.drift import directory_flags

    return directory_flags(f["file"], F.col("path").contains("f7"))


@query("j1_edge_labels", """SELECT e.id, coalesce(s.name, e.source) AS source_name, coalesce(t.name, e.target) AS target_name
FROM edges e LEFT JOIN nodes s ON s.id = e.source LEFT JOIN nodes t ON t.id = e.target""")
def j1_edge_labels(f):
    return graph.edge_labels(edge(f), node(f))


@query("j2_endpoint_kinds", """SELECT s.kind AS s_kind, t.kind AS t_kind, s.parent_id IS NOT DISTINCT FROM t.parent_id AS siblings, count(*) AS edges
FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target GROUP BY 1, 2, 3""")
def j2_endpoint_kinds(f):
    ends = graph.resolve_endpoints(edge(f), node(f), "kind", "parent_id")
    return ends.groupBy("model", "s_kind", "t_kind", F.col("s_parent_id").eqNullSafe(F.col("t_parent_id")).alias("siblings")).agg(F.count("*").alias("edges"))


@query("j3_subtree_edges", CLOSURE + """, part AS (
 SELECT r.id AS root, e.id AS edge_id, EXISTS (SELECT 1 FROM clo WHERE ancestor = r.id AND descendant = e.source) AS s,
  EXISTS (SELECT 1 FROM clo WHERE ancestor = r.id AND descendant = e.target) AS t, e.source, e.target
 FROM nodes r, edges e WHERE r.kind IN ('system', 'container'))
SELECT root, edge_id, CASE WHEN s AND t THEN 'internal' ELSE 'external' END AS side, o.id AS outside_id, o.name AS outside_name, o.kind AS outside_kind
FROM part LEFT JOIN nodes o ON o.id = CASE WHEN s AND t THEN NULL WHEN s THEN target ELSE source END WHERE s OR t""")
def j3_subtree_edges(f):
    roots = node(f).where("kind IN ('system', 'container')").select("model", F.col("id").alias("root"))
    return graph.subtree_edges(node(f), edge(f)).join(roots, ["model", "root"], "left_semi")


@query("j4_subtree_sources", CLOSURE + """
SELECT owner_id, pattern FROM source_map WHERE owner_id IN (SELECT descendant FROM clo WHERE ancestor = 'system-1')""")
def j4_subtree_sources(f):
    inside = graph.closure(node(f)).where("ancestor = 'system-1'").select("model", F.col("descendant").alias("owner_id"))
    return f["source_map"].join(inside, ["model", "owner_id"], "left_semi").select("owner_id", "pattern")


@query("j5_ungrouped_containers", """SELECT id, name FROM nodes WHERE kind = 'container' AND id NOT IN (SELECT node_id FROM group_member)""")
def j5_ungrouped_containers(f):
    return node(f).where("kind = 'container'").join(f["group_member"].select("model", F.col("node_id").alias("id")), ["model", "id"], "left_anti").select("id", "name")


@query("j6_reversed_pairs", """SELECT e.id FROM edges e WHERE EXISTS (SELECT 1 FROM edges b WHERE b.source = e.target AND b.target = e.source)""")
def j6_reversed_pairs(f):
    return graph.reversed_pairs(edge(f)).select("id")


@query("j9_first_and_last_group", """SELECT node_id, min(group_id) AS first_group, max(group_id) AS last_group, count(*) AS groups FROM group_member GROUP BY node_id""")
def j9_first_and_last_group(f):
    arrays = f["group_member"].groupBy("model", "group_id").agg(F.collect_list("node_id").alias("member_ids"))
    rows = arrays.select("model", "group_id", F.explode("member_ids").alias("node_id"))
    return rows.groupBy("model", "node_id").agg(F.min("group_id").alias("first_group"), F.max("group_id").alias("last_group"), F.count("*").alias("groups"))


@query("a1_next_ids", """SELECT split_part(id, '-', 1) AS prefix, concat(split_part(id, '-', 1), '-', CAST(max(CAST(split_part(id, '-', 2) AS BIGINT)) + 1 AS STRING)) AS next_id
FROM nodes GROUP BY 1 UNION ALL SELECT 'flow', 'flow-0'""")
def a1_next_ids(f):
    n = node(f)
    out = None
    for prefix in ("person", "system", "container", "component", "operation", "flow"):
        row = graph.next_id(n, prefix).select("model", F.lit(prefix).alias("prefix"), "next_id")
        out = row if out is None else out.unionByName(row)
    return out


@query("a2_counts", """SELECT kind, coalesce(status, 'none') AS status, count(*) AS nodes FROM nodes GROUP BY 1, 2 UNION ALL SELECT 'edge', '', count(*) FROM edges""")
def a2_counts(f):
    from tessella.functions.predicates import status_label

    kinds = node(f).groupBy("model", "kind", status_label(F.col("status")).alias("status")).agg(F.count("*").alias("nodes"))
    return kinds.unionByName(edge(f).groupBy("model").agg(F.count("*").alias("nodes")).select("model", F.lit("edge").alias("kind"), F.lit("").alias("status"), "nodes"))


@query("a9_unordered_duplicates", """SELECT least(source, target) AS a, greatest(source, target) AS b, count(*) AS edges, count(*) - 1 AS warnings FROM edges GROUP BY 1, 2 HAVING count(*) > 1""")
def a9_unordered_duplicates(f):
    return graph.pair_duplicates(edge(f))


@query("a10_degrees", """SELECT id, count(*) AS degree, count(*) >= 3 AS is_hub FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) e GROUP BY id""")
def a10_degrees(f):
    return graph.degrees(edge(f))


@query("a12_nodes_by_parent", """SELECT parent_id, kind, string_agg(id, ',' ORDER BY ord) AS ids FROM nodes WHERE kind IN ('container', 'component') GROUP BY 1, 2""")
def a12_nodes_by_parent(f):
    rows = node(f).where("kind IN ('container', 'component')").groupBy("model", "parent_id", "kind")
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]), ",").alias("ids"))


@query("a13_bounding_boxes", """SELECT kind, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, floor(avg(x) * 1000) AS mid_x, floor(avg(y) * 1000) AS mid_y
FROM (SELECT kind, CAST(ord % 97 AS DOUBLE) AS x, CAST(ord % 31 AS DOUBLE) AS y FROM nodes) p GROUP BY kind""")
def a13_bounding_boxes(f):
    placed = node(f).select("model", "kind", (F.col("ord") % 97).cast("double").alias("x"), (F.col("ord") % 31).cast("double").alias("y"))
    box = graph.bounding_box(placed, "model", "kind")
    return box.withColumn("mid_x", F.floor(F.col("mid_x") * 1000).cast("double")).withColumn("mid_y", F.floor(F.col("mid_y") * 1000).cast("double"))


@query("a15_distinct_pairs", """SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b, min(id) OVER (PARTITION BY least(source, target), greatest(source, target)) AS first_id FROM edges""")
def a15_distinct_pairs(f):
    pairs = edge(f).select("model", "id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    return graph.first_by(pairs, ["model", "a", "b"], "id").select("a", "b", F.col("id").alias("first_id"))


@query("w1_first_in_order", """SELECT parent_id, id FROM nodes QUALIFY parent_id IS NOT NULL AND row_number() OVER (PARTITION BY parent_id ORDER BY ord) = 1""")
def w1_first_in_order(f):
    return graph.first_by(node(f).where("parent_id IS NOT NULL"), ["model", "parent_id"], "ord").select("parent_id", "id")


@query("w2_last_wins", """SELECT name, id FROM nodes QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord DESC) = 1""")
def w2_last_wins(f):
    return graph.last_wins(node(f), ["model", "name"], "ord").select("name", "id")


@query("u1_union_distinct", """SELECT node_id AS id FROM group_member UNION SELECT owner_id FROM contract_item""")
def u1_union_distinct(f):
    return f["group_member"].select(F.col("node_id").alias("id")).union(f["contract_item"].select("owner_id")).distinct()


@query("u2_upsert", """SELECT id, coalesce(u.label, e.label) AS label FROM edges e LEFT JOIN (SELECT id AS uid, 'new' AS label FROM edges WHERE id LIKE '%7') u ON u.uid = e.id UNION ALL SELECT 'edge-added', 'new'""")
def u2_upsert(f):
    from tessella.operators.mutate import upsert

    e = edge(f).select("model", "id", "label")
    changes = e.where(F.col("id").like("%7")).withColumn("label", F.lit("new")).withColumn("ord", F.lit(0))
    added = changes.groupBy("model").agg(F.lit("edge-added").alias("id"), F.lit("new").alias("label"), F.lit(0).alias("ord"))
    return upsert(e, changes.unionByName(added), ["model", "id"], "ord")


@query("u3_except_intersect", """SELECT CASE WHEN b.id IS NULL THEN 'only_now' ELSE 'both' END AS side, count(*) AS nodes FROM nodes n LEFT JOIN baseline b ON b.id = n.id GROUP BY 1""")
def u3_except_intersect(f):
    ids, old = node(f).select("model", "id"), f["baseline"].select("model", "id")
    only = ids.join(old, ["model", "id"], "left_anti").agg(F.lit("only_now").alias("side"), F.count("*").alias("nodes"))
    return only.unionByName(ids.join(old, ["model", "id"], "left_semi").agg(F.lit("both").alias("side"), F.count("*").alias("nodes")))


@query("l9_components", """reach AS (SELECT id, id AS label FROM nodes UNION SELECT e.t, r.label FROM reach r JOIN (SELECT source s, target t FROM edges UNION SELECT target, source FROM edges) e ON e.s = r.id)
SELECT id, min(label) AS component FROM reach GROUP BY id""")
def l9_components(f):
    return graph.components(node(f), edge(f))
