"""Level views."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import views

from .registry import query
from .relations import edge, node


@query("l1_level_view", """far AS (SELECT v.id AS view, o.id, e.rel FROM nodes v JOIN (SELECT source v, target o, concat('out:', coalesce(label, '')) rel FROM edges UNION ALL SELECT target, source, concat('in:', coalesce(label, '')) FROM edges) e ON e.v = v.id
 JOIN nodes o ON o.id = e.o AND o.id <> v.id AND o.kind IN ('person', 'system', 'container') AND o.parent_id IS DISTINCT FROM v.id
 WHERE v.kind IN ('system', 'container') AND EXISTS (SELECT 1 FROM nodes c WHERE c.parent_id = v.id))
SELECT parent_id AS view, id, 'owned' AS role, '' AS relations FROM nodes WHERE parent_id IS NOT NULL UNION ALL SELECT view, id, 'reference', string_agg(rel, ';' ORDER BY rel) FROM far GROUP BY 1, 2""")
def l1_level_view(f):
    return views.level_view(node(f), edge(f))


@query("l2_injected_members", """SELECT n.id, coalesce(string_agg(c.name, ',' ORDER BY c.ord) FILTER (c.kind = 'operation'), '') AS operations, coalesce(string_agg(c.name, ',' ORDER BY c.ord) FILTER (c.kind = 'process'), '') AS processes,
 coalesce(string_agg(c.name, ',' ORDER BY c.ord) FILTER (c.kind = 'model'), '') AS models, count(c.id) > 0 AS has_children FROM nodes n LEFT JOIN nodes c ON c.parent_id = n.id WHERE n.kind = 'component' GROUP BY n.id""")
def l2_injected_members(f):
    return views.injected_members(node(f))


@query("l3_mention_candidates", """near AS (SELECT id, id AS other FROM nodes WHERE kind = 'component' UNION SELECT e.source, e.target FROM edges e WHERE e.source LIKE 'component-%' AND e.target LIKE 'component-%'
 UNION SELECT e.target, e.source FROM edges e WHERE e.source LIKE 'component-%' AND e.target LIKE 'component-%')
SELECT DISTINCT n.id, m.id AS candidate FROM near n JOIN nodes m ON m.parent_id = n.other AND m.kind = 'operation'""")
def l3_mention_candidates(f):
    return views.mention_candidates(node(f), edge(f))


@query("l4_decorations", """SELECT n.id, (SELECT max(group_id) FROM group_member m WHERE m.node_id = n.id) AS group_id, (SELECT count(*) FROM contract_item c WHERE c.owner_id = n.id AND c.passed IS NOT DISTINCT FROM false) AS hints,
 EXISTS (SELECT 1 FROM baseline b WHERE b.id = n.id AND b.status IS DISTINCT FROM n.status) AS changed, EXISTS (SELECT 1 FROM source_map s WHERE s.owner_id = n.id AND s.pattern LIKE '%mod3%') AS drifted FROM nodes n""")
def l4_decorations(f):
    n = node(f)
    changed = n.join(f["baseline"].select("model", "id", F.col("status").alias("old")), ["model", "id"]).where("NOT (old <=> status)").select("model", "id")
    drifted = f["source_map"].where("pattern LIKE '%mod3%'").select("model", F.col("owner_id").alias("id"))
    hint = f["contract_item"].where("passed <=> false").select("model", F.col("owner_id").alias("node_id"))
    return views.decorations(n, f["group_member"], changed, drifted, hint)


@query("l5_visible_groups", """lvl AS (SELECT m.group_id, min(n.parent_id) AS view FROM group_member m LEFT JOIN nodes n ON n.id = m.node_id GROUP BY 1 HAVING count(DISTINCT n.parent_id) = 1 AND count(*) = count(n.parent_id)),
shown AS (SELECT l.view, g.id, g.parent_group_id FROM model_group g JOIN lvl l ON l.group_id = g.id)
SELECT s.view, s.id, u.id AS parent_group_id FROM shown s LEFT JOIN shown u ON u.id = s.parent_group_id AND u.view = s.view""")
def l5_visible_groups(f):
    return views.visible_groups(f["model_group"], f["group_member"], node(f))


@query("l6_open_hints", """SELECT owner_id AS node_id, text AS message, pos FROM contract_item WHERE NOT EXISTS (SELECT 1 FROM contract_item d WHERE d.pos % 3 = 0 AND d.owner_id = contract_item.owner_id AND d.text = contract_item.text)""")
def l6_open_hints(f):
    hints = f["contract_item"].select("model", F.col("owner_id").alias("node_id"), F.col("text").alias("message"), "pos")
    return views.open_hints(hints, hints.where("pos % 3 = 0")).select("node_id", "message", "pos")


@query("o3_chips", """r AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY CASE kind WHEN 'process' THEN 0 WHEN 'model' THEN 1 ELSE 2 END, ord) AS n FROM nodes WHERE kind IN ('operation', 'process', 'model'))
SELECT parent_id AS id, string_agg(name, ',' ORDER BY n) FILTER (n <= 8) AS chips, greatest(count(*) - 8, 0) AS overflow FROM r GROUP BY 1""")
def o3_chips(f):
    return views.chips(node(f))


@query("w5_grid", """c AS (SELECT parent_id AS view, id, ord, 100 + ord % 7 * 10 AS width, 50 + ord % 5 * 10 AS height, row_number() OVER (PARTITION BY parent_id ORDER BY ord) - 1 AS i, least(4, CAST(ceil(sqrt(count(*) OVER (PARTITION BY parent_id))) AS INT)) AS cols FROM nodes WHERE kind IN ('container', 'component')),
p AS (SELECT *, i % cols AS col, i // cols AS row FROM c), cw AS (SELECT view, col, max(width) AS w FROM p GROUP BY 1, 2), rh AS (SELECT view, row, max(height) AS h FROM p GROUP BY 1, 2)
SELECT p.view, p.id, CAST(coalesce((SELECT sum(w + 40) FROM cw WHERE cw.view = p.view AND cw.col < p.col), 0) AS BIGINT) AS x, CAST(coalesce((SELECT sum(h + 40) FROM rh WHERE rh.view = p.view AND rh.row < p.row), 0) AS BIGINT) AS y FROM p""")
def w5_grid(f):
    cells = node(f).where("kind IN ('container', 'component')").select(
        "model", F.col("parent_id").alias("view"), "id", "ord", (100 + F.col("ord") % 7 * 10).alias("width"), (50 + F.col("ord") % 5 * 10).alias("height")
    )
    return views.grid(cells)


@query("o6_by_distance", """pt AS (SELECT id, ord % 97 AS x, ord % 31 AS y FROM nodes)
SELECT e.id, CAST((s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y) AS DOUBLE) AS d, row_number() OVER (ORDER BY (s.x - t.x) * (s.x - t.x) + (s.y - t.y) * (s.y - t.y), e.id) AS place FROM edges e JOIN pt s ON s.id = e.source JOIN pt t ON t.id = e.target""")
def o6_by_distance(f):
    placed = node(f).select("model", "id", (F.col("ord") % 97).cast("double").alias("x"), (F.col("ord") % 31).cast("double").alias("y"))
    return views.by_distance(edge(f), placed).withColumn("place", F.col("place").cast("long"))


@query("a11_contract_tallies", """SELECT owner_id, section, count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, count(*) FILTER (passed IS NULL) AS unchecked,
 CASE WHEN count(*) FILTER (NOT passed) > 0 THEN 'failed' WHEN count(*) FILTER (passed IS NULL) > 0 THEN 'unchecked' ELSE 'passed' END AS colour FROM contract_item GROUP BY 1, 2""")
def a11_contract_tallies(f):
    n = F.count_if
    rows = f["contract_item"].groupBy("model", "owner_id", "section").agg(
        F.count("*").alias("total"), n(F.expr("passed <=> true")).alias("passed"), n(F.expr("passed <=> false")).alias("failed"), n(F.expr("passed IS NULL")).alias("unchecked")
    )
    return rows.withColumn("colour", F.when(F.col("failed") > 0, "failed").when(F.col("unchecked") > 0, "unchecked").otherwise("passed"))
