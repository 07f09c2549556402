"""Validation rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import validate

from .graph_queries import CLOSURE
from .registry import query
from .relations import described, edge, node

VIEWS = """ends AS (SELECT id, source a, target b FROM edges UNION ALL SELECT id, target, source FROM edges),
member AS (
 SELECT 'system' AS view, id AS node_id, 'owned' AS role FROM nodes WHERE kind IN ('person', 'system')
 UNION ALL SELECT concat('container:', s.id), c.id, 'owned' FROM nodes s JOIN nodes c ON c.parent_id = s.id AND c.kind = 'container' WHERE s.kind = 'system' AND NOT s.ext
 UNION ALL SELECT concat('component:', s.id), c.id, 'owned' FROM nodes s JOIN nodes c ON c.parent_id = s.id AND c.kind = 'component' WHERE s.kind = 'container'
 UNION ALL SELECT DISTINCT concat('container:', s.id), r.id, 'reference' FROM nodes s JOIN nodes c ON c.parent_id = s.id AND c.kind = 'container'
   JOIN ends e ON e.a = s.id OR e.a = c.id JOIN nodes r ON r.id = e.b AND r.kind IN ('person', 'system') AND r.id <> s.id WHERE s.kind = 'system' AND NOT s.ext
 UNION ALL SELECT DISTINCT concat('component:', s.id), r.id, 'reference' FROM nodes s JOIN ends e ON e.a = s.id JOIN nodes r ON r.id = e.b AND r.kind <> 'component' AND r.id IS DISTINCT FROM s.parent_id
   WHERE s.kind = 'container' AND EXISTS (SELECT 1 FROM nodes c WHERE c.parent_id = s.id AND c.kind = 'component')),
loose AS (
 SELECT m.* FROM member m WHERE NOT EXISTS (SELECT 1 FROM ends e JOIN member o ON o.node_id = e.b AND o.view = m.view WHERE e.a = m.node_id)),
lonely AS (
 SELECT l.view, l.node_id, CASE WHEN l.role = 'reference' THEN 'not_to_children' WHEN EXISTS (SELECT 1 FROM ends e WHERE e.a = l.node_id) THEN 'elsewhere'
  WHEN (SELECT count(*) FROM member o WHERE o.view = l.view AND o.role = 'owned') > 1 THEN 'no_edges' END AS problem FROM loose l)"""

MENTIONS = """said AS (SELECT n.id, n.parent_id, generate_subscripts(regexp_extract_all(d.description, '@\\[([^\\]]*)\\]', 1), 1) - 1 AS pos, unnest(regexp_extract_all(d.description, '@\\[([^\\]]*)\\]', 1)) AS name
 FROM nodes n JOIN descr d ON d.id = n.id),
named AS (SELECT name, arg_max(id, ord) AS id FROM nodes GROUP BY name),
mention AS (SELECT s.id AS node_id, m.id AS mentioned, s.pos FROM said s JOIN named a ON a.name = s.name JOIN nodes m ON m.id = a.id
 WHERE s.id <> m.id AND m.parent_id IS DISTINCT FROM s.id AND s.parent_id IS DISTINCT FROM m.id AND coalesce(s.parent_id <> m.parent_id, true)),
unlinked AS (SELECT m.* FROM mention m WHERE NOT EXISTS (SELECT 1 FROM clo a, clo b, edges e WHERE a.descendant = m.node_id AND b.descendant = m.mentioned
 AND ((e.source = a.ancestor AND e.target = b.ancestor) OR (e.source = b.ancestor AND e.target = a.ancestor))))"""


@query("v1_disconnected", VIEWS + """
SELECT view, node_id, problem FROM lonely WHERE problem IS NOT NULL""")
def v1_disconnected(f):
    return validate.disconnected_nodes(node(f), edge(f))


@query("v1a_view_members", VIEWS + """
SELECT view, node_id, role FROM member""")
def v1a_view_members(f):
    return validate.view_members(node(f), edge(f))


@query("v2_bidirectional", """SELECT a.a, a.b, a.n AS edges, a.n - 1 AS warnings FROM (SELECT least(source, target) AS a, greatest(source, target) AS b, count(*) AS n FROM edges GROUP BY 1, 2) a WHERE a.n > 1""")
def v2_bidirectional(f):
    return validate.bidirectional_edges(edge(f))


@query("v3_mention_without_edge", CLOSURE + ", " + MENTIONS + """
SELECT node_id, mentioned, CAST(pos AS INT) AS pos FROM unlinked""")
def v3_mention_without_edge(f):
    return validate.mentions_without_edge(described(f), edge(f))


@query("v4_cross_container", """SELECT e.id, e.source, e.target FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target
WHERE s.kind = 'component' AND t.kind = 'component' AND s.parent_id IS DISTINCT FROM t.parent_id""")
def v4_cross_container(f):
    return validate.cross_container_edges(node(f), edge(f))


#: Some nodes are moved to where they must not be.
MOVED = """moved AS (SELECT id, ord, kind, name, status, ext, CASE WHEN id = 'container-3' THEN 'system-4' WHEN id LIKE 'component-%1' THEN 'system-1' WHEN id LIKE 'operation-%3' THEN NULL
 WHEN id = 'system-2' THEN 'system-1' WHEN id LIKE 'operation-%5' THEN 'component-x' ELSE parent_id END AS parent_id FROM nodes)"""


def _moved(f):
    return node(f).withColumn(
        "parent_id",
        F.when(F.col("id") == "container-3", "system-4")
        .when(F.col("id").like("component-%1"), "system-1")
        .when(F.col("id").like("operation-%3"), F.lit(None))
        .when(F.col("id") == "system-2", "system-1")
        .when(F.col("id").like("operation-%5"), "component-x")
        .otherwise(F.col("parent_id")),
    )


@query("v5_child_of_external", MOVED + """
SELECT arg_min(m.id, m.ord) AS node_id FROM moved m JOIN moved p ON p.id = m.parent_id WHERE p.kind = 'system' AND p.ext HAVING count(*) > 0""")
def v5_child_of_external(f):
    return validate.children_of_external(_moved(f))


@query("v6_parent_rule", MOVED + """, judged AS (SELECT m.id AS node_id, CASE
  WHEN m.kind IN ('person', 'system') THEN CASE WHEN m.parent_id IS NOT NULL THEN 'must_be_top_level' END
  WHEN m.parent_id IS NULL THEN 'needs_parent' WHEN p.id IS NULL THEN 'unknown_parent'
  WHEN p.kind <> CASE m.kind WHEN 'container' THEN 'system' WHEN 'component' THEN 'container' ELSE 'component' END THEN 'wrong_parent_kind'
  WHEN m.kind = 'container' AND p.ext THEN 'external_parent' END AS error FROM moved m LEFT JOIN moved p ON p.id = m.parent_id)
SELECT node_id, error FROM judged WHERE error IS NOT NULL""")
def v6_parent_rule(f):
    return validate.parent_errors(_moved(f))


@query("v7_verified_gate", CLOSURE + """, owners AS (SELECT descendant AS id, ancestor AS owner_id FROM clo
 UNION ALL SELECT DISTINCT c.descendant, g.group_id FROM clo c JOIN group_member g ON g.node_id = c.ancestor),
items AS (SELECT owner_id, section, pos, passed FROM contract_item UNION ALL SELECT id, 'expect', 0, NULL FROM model_group WHERE id LIKE 'group-1%'),
unmet AS (SELECT o.id, count(*) AS n FROM owners o JOIN items i ON i.owner_id = o.owner_id WHERE i.section = 'expect' AND i.passed IS DISTINCT FROM true GROUP BY 1)
SELECT n.id, coalesce(u.n, 0) AS unmet, u.n IS NULL AS passes FROM nodes n LEFT JOIN unmet u ON u.id = n.id""")
def v7_verified_gate(f):
    items = f["contract_item"].select("model", "owner_id", "section", "pos", "text", "passed")
    on_groups = f["model_group"].where("id LIKE 'group-1%'").select(
        "model", F.col("id").alias("owner_id"), F.lit("expect").alias("section"), F.lit(0).alias("pos"), F.lit("").alias("text"), F.lit(None).cast("boolean").alias("passed")
    )
    return validate.verified_gate(node(f), items.unionByName(on_groups), f["group_member"])


@query("v8_report", VIEWS + ", " + CLOSURE + ", " + MENTIONS + """, found AS (
 SELECT 'disconnected' AS rule FROM lonely WHERE problem IS NOT NULL UNION ALL SELECT 'mention' FROM unlinked
 UNION ALL SELECT 'cross_container' FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target WHERE s.kind = 'component' AND t.kind = 'component' AND s.parent_id IS DISTINCT FROM t.parent_id)
SELECT rule, count(*) AS findings FROM found GROUP BY 1
UNION ALL SELECT 'bidirectional', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM edges GROUP BY least(source, target), greatest(source, target)) p WHERE n > 1""")
def v8_report(f):
    return validate.report(described(f), edge(f)).groupBy("model", "rule").agg(F.count("*").alias("findings"))


@query("v9_missing_externals", CLOSURE + """, ends AS (SELECT source a, target b FROM edges UNION SELECT target, source FROM edges)
SELECT DISTINCT p.id AS parent_id, x.id AS external_id FROM nodes p JOIN ends e ON e.a = p.id JOIN nodes x ON x.id = e.b
WHERE p.kind IN ('system', 'container') AND x.id <> p.id AND EXISTS (SELECT 1 FROM clo WHERE ancestor = p.id AND depth > 0)
 AND NOT EXISTS (SELECT 1 FROM clo WHERE ancestor = p.id AND descendant = x.id)
 AND NOT EXISTS (SELECT 1 FROM clo c JOIN ends i ON i.a = c.descendant WHERE c.ancestor = p.id AND c.depth > 0 AND i.b = x.id)""")
def v9_missing_externals(f):
    return validate.missing_externals(node(f), edge(f))


@query("p7_property_labels", """prop AS (SELECT concat('component-', CAST(l_suppkey AS STRING)) AS node_id, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_linenumber % 3 = 0 THEN concat('bad ', l_returnflag) ELSE concat('ok_', l_returnflag) END AS label FROM lineitem)
SELECT node_id, first(label ORDER BY pos, label) AS label FROM prop WHERE NOT regexp_full_match(label, '[A-Za-z][A-Za-z0-9_]*') GROUP BY node_id""")
def p7_property_labels(f):
    lines = f.spark.read.parquet(f"{f.sf_dir}/lineitem.parquet")
    prop = lines.select(
        F.lit("main").alias("model"),
        F.concat(F.lit("component-"), F.col("l_suppkey").cast("string")).alias("node_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("bad "), "l_returnflag")).otherwise(F.concat(F.lit("ok_"), "l_returnflag")).alias("label"),
    )
    return validate.invalid_property_labels(prop)
