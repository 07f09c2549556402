"""The task planner."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import tasks

from .registry import query
from .relations import edge, node

STATES = """kid AS (SELECT p.id, bool_and(c.status IN ('implemented', 'verified', 'vagrant')) AS done FROM nodes p JOIN nodes c ON c.parent_id = p.id AND c.status IS NOT NULL
  AND ((p.kind = 'container' AND c.kind = 'component') OR (p.kind = 'system' AND c.kind = 'container')) GROUP BY p.id),
state AS (SELECT n.*, k.done IS NOT NULL AS has_kids, coalesce(k.done, true) AS kids_done, coalesce(p.ext, false) AS under_ext,
  CASE WHEN n.ext THEN true WHEN k.done IS NOT NULL THEN k.done ELSE n.status IS NULL OR n.status IN ('implemented', 'verified', 'vagrant') END AS sat
  FROM nodes n LEFT JOIN kid k ON k.id = n.id LEFT JOIN nodes p ON p.id = n.parent_id),
progress AS (SELECT * FROM state WHERE kind IN ('container', 'component') AND status IS NOT NULL AND NOT under_ext AND NOT (kind = 'container' AND has_kids)),
task AS (SELECT * FROM progress WHERE status <> 'vagrant'),
block AS (SELECT DISTINCT s.id, t.id AS blocker FROM edges e JOIN state s ON s.id = e.source JOIN state t ON t.id = e.target
  WHERE s.kind = 'component' AND t.kind = 'component' AND s.parent_id IS NOT DISTINCT FROM t.parent_id AND NOT t.sat),
todo AS (SELECT t.*, CASE WHEN t.id IN (SELECT id FROM block) THEN 'blocked' ELSE 'ready' END AS ready FROM task t WHERE NOT sat),
unit AS (SELECT id, ord FROM todo WHERE ready = 'ready' AND CASE WHEN EXISTS (SELECT 1 FROM todo WHERE ready = 'ready' AND kind = 'container') THEN kind = 'container'
  ELSE parent_id IS NOT DISTINCT FROM (SELECT arg_min(parent_id, ord) FROM todo WHERE ready = 'ready') END)"""


@query("a3_a5_states", STATES + """
SELECT id, has_kids AS has_status_children, kids_done AS children_done, sat AS satisfied, under_ext AS under_external FROM state""")
def a3_a5_states(f):
    return tasks.with_states(node(f)).select("id", "has_status_children", "children_done", "satisfied", "under_external")


@query("a6_progress", STATES + """
SELECT 'scoped' AS form, count(*) FILTER (sat) AS completed, count(*) AS total FROM task UNION ALL SELECT 'global', count(*) FILTER (sat), count(*) FROM progress""")
def a6_progress(f):
    n = node(f)
    return tasks.progress(n).withColumn("form", F.lit("scoped")).unionByName(tasks.progress(n, keep_vagrant=True).withColumn("form", F.lit("global")))


@query("a7_roll_up", STATES + """
SELECT id, name FROM state WHERE kind IN ('container', 'system') AND NOT coalesce(status IN ('implemented', 'verified'), false) AND has_kids AND kids_done""")
def a7_roll_up(f):
    return tasks.roll_up(node(f))


@query("a8_pending_members", """SELECT c.id, c.parent_id, p.status IN ('implemented', 'verified') AS of_done FROM nodes c JOIN nodes p ON p.id = c.parent_id AND p.kind = 'component'
WHERE c.kind IN ('operation', 'process', 'model') AND c.status = 'proposed'""")
def a8_pending_members(f):
    n = node(f)
    done = tasks.pending_members(n, "done").select("model", "id", F.lit(True).alias("d"))
    every = tasks.pending_members(n).join(n.select("model", F.col("id").alias("parent_id"), F.col("status").alias("p_status")), ["model", "parent_id"])
    return every.join(done, ["model", "id"], "left").select("model", "id", "parent_id", F.when(F.col("p_status").isNotNull(), F.col("d").isNotNull()).alias("of_done"))


@query("j7_blocking", STATES + """
SELECT id, blocker FROM block""")
def j7_blocking(f):
    return tasks.blocking(node(f), edge(f))


@query("t1_eligible", STATES + """
SELECT id, kind, status, sat AS satisfied FROM task""")
def t1_eligible(f):
    return tasks.eligible(node(f)).select("id", "kind", "status", "satisfied")


@query("t1_eligible_scoped", STATES + """
SELECT t.id FROM task t LEFT JOIN nodes p ON p.id = t.parent_id WHERE t.id = 'system-1' OR t.parent_id = 'system-1' OR p.parent_id = 'system-1'""")
def t1_eligible_scoped(f):
    return tasks.eligible(node(f), "system-1").select("id")


@query("t2_work", STATES + """
SELECT id, ready AS state FROM todo""")
def t2_work(f):
    return tasks.work(node(f), edge(f)).select("id", "state")


#: Every proposed component also needs its own container's next proposed one, in a ring.
RING = """ring AS (SELECT id AS source, coalesce(lead(id) OVER w, first_value(id) OVER w) AS target FROM todo WHERE kind = 'component' WINDOW w AS (PARTITION BY parent_id ORDER BY ord)),
rest AS (SELECT t.id FROM todo t WHERE NOT EXISTS (SELECT 1 FROM ring r WHERE r.source = t.id))"""


@query("t3_stall", STATES + ", " + RING + """
SELECT string_agg(t.id, ',' ORDER BY t.id) AS ids FROM todo t HAVING count(*) > 0 AND (SELECT count(*) FROM rest) = 0""")
def t3_stall(f):
    from pyspark.sql import Window

    n, e = node(f), edge(f)
    w = Window.partitionBy("model", "parent_id").orderBy("ord")
    open_ones = tasks.work(n, e).where("kind = 'component'")
    ring = open_ones.select("model", F.lit("ring").alias("id"), F.col("id").alias("source"), F.coalesce(F.lead("id").over(w), F.first("id").over(w)).alias("target"), F.lit("").alias("label"))
    return tasks.stalled(n, e.unionByName(ring))


@query("t4_scaffolds", """SELECT g.id AS group_id FROM model_group g WHERE NOT EXISTS (SELECT 1 FROM group_member m LEFT JOIN nodes n ON n.id = m.node_id
 WHERE m.group_id = g.id AND (n.kind IS DISTINCT FROM 'container' OR n.status IS DISTINCT FROM 'proposed'))""")
def t4_scaffolds(f):
    return tasks.scaffolds(node(f), f["model_group"], f["group_member"])


@query("t5_menu", STATES + """, rows AS (SELECT s.id FROM state s WHERE kind = 'container' AND status IS NOT NULL AND NOT ext AND NOT under_ext
 AND (NOT sat OR EXISTS (SELECT 1 FROM nodes c WHERE c.parent_id = s.id AND c.status = 'proposed')))
SELECT coalesce((SELECT min(group_id) FROM group_member m WHERE m.node_id = r.id), '') AS group_id, r.id FROM rows r WHERE (SELECT count(*) FROM rows) > 1""")
def t5_menu(f):
    return tasks.menu(node(f), f["model_group"], f["group_member"])


@query("t6_work_unit", STATES + """
SELECT id, row_number() OVER (ORDER BY ord) AS place FROM unit""")
def t6_work_unit(f):
    return tasks.numbered(tasks.work_unit(node(f), edge(f))).select("id", F.col("place").cast("long").alias("place"))


@query("t7_payload", STATES + """
SELECT u.id, coalesce((SELECT string_agg(DISTINCT c.id, ',' ORDER BY c.id) FROM nodes c WHERE c.parent_id = u.id AND c.kind IN ('operation', 'process', 'model')), '') AS members,
 coalesce((SELECT string_agg(DISTINCT t.name, ',' ORDER BY t.name) FROM edges e JOIN nodes t ON t.id = e.target WHERE e.source = u.id), '') AS depends_on,
 coalesce((SELECT string_agg(DISTINCT t.name, ',' ORDER BY t.name) FROM edges e JOIN nodes t ON t.id = e.source WHERE e.target = u.id), '') AS needed_by FROM unit u""")
def t7_payload(f):
    return tasks.payload(node(f), edge(f))


@query("t8_completion", STATES + """
SELECT 'roll_up' AS kind, id FROM state WHERE kind IN ('container', 'system') AND NOT coalesce(status IN ('implemented', 'verified'), false) AND has_kids AND kids_done
UNION ALL SELECT 'pending', c.id FROM nodes c JOIN nodes p ON p.id = c.parent_id AND p.kind = 'component' AND p.status IN ('implemented', 'verified')
WHERE c.kind IN ('operation', 'process', 'model') AND c.status = 'proposed'""")
def t8_completion(f):
    return tasks.completion(node(f))


@query("t9_decision", STATES + """
SELECT CASE WHEN (SELECT count(*) FROM task) = 0 THEN 'done' WHEN (SELECT count(*) FROM todo) = 0 THEN 'complete' WHEN NOT EXISTS (SELECT 1 FROM todo WHERE ready = 'ready') THEN 'stall'
 WHEN EXISTS (SELECT 1 FROM model_group g WHERE NOT EXISTS (SELECT 1 FROM group_member m LEFT JOIN nodes n ON n.id = m.node_id WHERE m.group_id = g.id AND (n.kind IS DISTINCT FROM 'container' OR n.status IS DISTINCT FROM 'proposed'))) THEN 'scaffold'
 ELSE 'other' END AS decision""")
def t9_decision(f):
    return tasks.decision(node(f), edge(f), f["model_group"], f["group_member"])


@query("w3_next_up", STATES + """
SELECT arg_min(id, CASE WHEN ready = 'ready' THEN 0 ELSE 10000000000 END + ord) AS id FROM todo WHERE ready = 'blocked' OR id NOT IN (SELECT id FROM unit) HAVING count(*) > 0""")
def w3_next_up(f):
    return tasks.next_up(node(f), edge(f))
