"""Flows: flattening, counting, numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import flows

from .registry import query

TREE = """ranked AS (SELECT *, row_number() OVER (PARTITION BY flow_id, parent_step_id, branch_idx ORDER BY pos, step_id) AS n FROM flow_step),
tree AS (SELECT flow_id, step_id, 0 AS depth, CAST(n AS STRING) AS label, lpad(CAST(pos AS STRING), 6, '0') AS path FROM ranked WHERE parent_step_id IS NULL
 UNION ALL SELECT r.flow_id, r.step_id, t.depth + 1, concat(t.label, chr(97 + r.branch_idx), '.', CAST(r.n AS STRING)), concat(t.path, '/', CAST(r.branch_idx AS STRING), '/', lpad(CAST(r.pos AS STRING), 6, '0'))
 FROM tree t JOIN ranked r ON r.flow_id = t.flow_id AND r.parent_step_id = t.step_id)"""


@query("r9_flow_flatten", TREE + """
SELECT flow_id, step_id, depth, CAST(row_number() OVER (PARTITION BY flow_id ORDER BY path) AS INT) AS place FROM tree""")
def r9_flow_flatten(f):
    return flows.flatten(f["flow_step"])


@query("r10_step_counts", """SELECT flow_id, count(*) AS steps FROM flow_step GROUP BY 1""")
def r10_step_counts(f):
    return flows.step_counts(f["flow_step"])


@query("r11_outline", TREE + """
SELECT flow_id, step_id, label FROM tree""")
def r11_outline(f):
    return flows.outline(f["flow_step"])


@query("r14_label_migration", """SELECT flow_id, step_id, coalesce(description, label) AS description, CASE WHEN description IS NOT NULL THEN label END AS label FROM flow_step""")
def r14_label_migration(f):
    return flows.labels_to_descriptions(f["flow_step"]).select("flow_id", "step_id", "description", "label")


@query("r13_duplicate_steps", """SELECT flow_id, step_id FROM (SELECT flow_id, concat('step-', CAST(length(label) % 5 AS STRING)) AS step_id FROM flow_step) s GROUP BY 1, 2 HAVING count(*) > 1""")
def r13_duplicate_steps(f):
    return flows.duplicate_steps(f["flow_step"].withColumn("step_id", F.concat(F.lit("step-"), (F.length("label") % 5).cast("string"))))


@query("r12_update_steps", """SELECT flow_id, step_id, parent_step_id, branch_idx, pos, CASE WHEN length(flow_id) % 2 = 0 AND step_id IN ('step-1', 'step-2') THEN concat('new ', label) ELSE label END AS label,
 CASE WHEN length(flow_id) % 2 = 0 AND step_id IN ('step-1', 'step-2') THEN NULL ELSE description END AS description FROM flow_step""")
def r12_update_steps(f):
    step = f["flow_step"]
    change = step.where("length(flow_id) % 2 = 0 AND step_id IN ('step-1', 'step-2')").select(
        "model", "flow_id", "step_id", F.concat(F.lit("new "), "label").alias("label"), F.lit(None).cast("string").alias("description")
    )
    return flows.update_steps(step, change).select("flow_id", "step_id", "parent_step_id", "branch_idx", "pos", "label", "description")
