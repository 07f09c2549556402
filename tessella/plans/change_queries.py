"""Snapshot differences, drift and event streams, in batch form and live."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessella.lineage import shared_dir
from tessella.operators import diff, drift
from tessella.sources import ignore, store
from tessella.streaming import events as ev
from tessella.streaming import live

from .registry import query
from .relations import edge, node


def _base(f):
    return f["baseline"].withColumnRenamed("ext", "external")


NODE_DIFF = """nd AS (SELECT coalesce(n.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'modified' END AS change,
 CASE WHEN b.id IS NULL OR n.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN n.name IS DISTINCT FROM b.name THEN 'name' END, CASE WHEN n.kind IS DISTINCT FROM b.kind THEN 'kind' END,
  CASE WHEN n.ext IS DISTINCT FROM b.ext THEN 'external' END, CASE WHEN n.status IS DISTINCT FROM b.status THEN 'status' END, CASE WHEN n.parent_id IS DISTINCT FROM b.parent_id THEN 'parent_id' END) END AS fields,
 coalesce(n.name, b.name) AS name FROM nodes n FULL OUTER JOIN baseline b ON b.id = n.id),
node_diff AS (SELECT * FROM nd WHERE change <> 'modified' OR fields <> '')"""


@query("d1_node_diff", NODE_DIFF + """
SELECT id, change, fields FROM node_diff""")
def d1_node_diff(f):
    return diff.nodes(_base(f), node(f))


@query("d2_edge_diff", """SELECT coalesce(n.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'modified' END AS change,
 CASE WHEN b.id IS NULL OR n.id IS NULL THEN '' ELSE 'label' END AS fields FROM edges n FULL OUTER JOIN edge_baseline b ON b.id = n.id
WHERE b.id IS NULL OR n.id IS NULL OR coalesce(n.label, '') <> coalesce(b.label, '')""")
def d2_edge_diff(f):
    return diff.edges(f["edge_baseline"], edge(f))


@query("d3_flow_diff", """o AS (SELECT flow_id, count(*) AS c, string_agg(step_id, ',' ORDER BY step_id) AS s FROM flow_baseline GROUP BY 1), n AS (SELECT flow_id, count(*) AS c, string_agg(step_id, ',' ORDER BY step_id) AS s FROM flow_step GROUP BY 1)
SELECT coalesce(n.flow_id, o.flow_id) AS flow_id, CASE WHEN o.c IS NULL THEN 'added' WHEN n.c IS NULL THEN 'removed' WHEN o.c <> n.c THEN 'modified' END AS change,
 o.c AS steps_before, n.c AS steps_after, o.s IS DISTINCT FROM n.s AS differs FROM n FULL OUTER JOIN o ON o.flow_id = n.flow_id WHERE o.s IS DISTINCT FROM n.s""")
def d3_flow_diff(f):
    return diff.flows(f["flow_baseline"], f["flow_step"].select("model", "flow_id", "step_id"))


@query("d4_sync_summary", """d AS (SELECT CASE WHEN b.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'modified' END AS change, coalesce(n.name, b.name) AS name
 FROM nodes n FULL OUTER JOIN baseline b ON b.id = n.id WHERE b.id IS NULL OR n.id IS NULL OR n.name IS DISTINCT FROM b.name OR n.kind IS DISTINCT FROM b.kind OR n.status IS DISTINCT FROM b.status OR n.parent_id IS DISTINCT FROM b.parent_id)
SELECT change, string_agg(name, ',' ORDER BY name) AS names FROM d GROUP BY 1""")
def d4_sync_summary(f):
    return diff.sync_summary(_base(f), node(f))


@query("d5_touched_parents", NODE_DIFF + """, ed AS (SELECT coalesce(n.source, b.source) AS source, coalesce(n.target, b.target) AS target FROM edges n FULL OUTER JOIN edge_baseline b ON b.id = n.id
 WHERE b.id IS NULL OR n.id IS NULL OR coalesce(n.label, '') <> coalesce(b.label, '')),
hit AS (SELECT id FROM node_diff UNION SELECT source FROM ed UNION SELECT target FROM ed)
SELECT DISTINCT parent_id FROM (SELECT id, parent_id FROM nodes UNION ALL SELECT id, parent_id FROM baseline) p WHERE parent_id IS NOT NULL AND id IN (SELECT id FROM hit)""")
def d5_touched_parents(f):
    return diff.touched_parents(_base(f), node(f), f["edge_baseline"], edge(f))


HISTORY = """history AS (SELECT concat('component-', CAST(l_suppkey AS STRING)) AS id, l_orderkey * 10 + l_linenumber AS version, l_returnflag AS old, l_linestatus = 'F' AS acknowledged FROM lineitem)"""


def _history(f):
    lines = f.spark.read.parquet(f"{f.sf_dir}/lineitem.parquet")
    return lines.select(
        F.lit("main").alias("model"),
        F.concat(F.lit("component-"), F.col("l_suppkey").cast("string")).alias("id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version"),
        F.col("l_returnflag").alias("old"),
        (F.col("l_linestatus") == "F").alias("acknowledged"),
    )


@query("d6_oldest_unacknowledged", HISTORY + """
SELECT id, first(old ORDER BY version, old) AS old FROM history WHERE NOT acknowledged GROUP BY id""")
def d6_oldest_unacknowledged(f):
    return diff.oldest_unacknowledged(_history(f))


@query("a14_focus", NODE_DIFF + """, depth AS (SELECT n.id, CASE WHEN n.parent_id IS NULL THEN 0 WHEN p.parent_id IS NULL THEN 1 WHEN g.parent_id IS NULL THEN 2 ELSE 3 END AS depth
 FROM nodes n LEFT JOIN nodes p ON p.id = n.parent_id LEFT JOIN nodes g ON g.id = p.parent_id),
busy AS (SELECT n.parent_id, count(*) AS c FROM node_diff d JOIN nodes n ON n.id = d.id WHERE d.change = 'modified' AND n.parent_id IS NOT NULL GROUP BY 1)
SELECT b.parent_id FROM busy b JOIN depth ON depth.id = b.parent_id ORDER BY depth, c DESC, b.parent_id LIMIT 1""")
def a14_focus(f):
    from tessella.operators.graph import closure

    n = node(f)
    depth = closure(n).groupBy("model", F.col("descendant").alias("id")).agg(F.max("depth").alias("depth"))
    changed = diff.nodes(_base(f), n).where("change = 'modified'").join(n.select("model", "id", "parent_id"), ["model", "id"])
    return diff.focus(changed, depth)


SINCE = "TIMESTAMP '2024-01-30 12:00:00'"
GLOBBED = """hit AS (SELECT m.owner_id, m.pattern, f.path, f.mtime FROM source_map m JOIN file f ON f.path LIKE replace(m.pattern, '**', '%'))"""


@query("s15_glob_join", GLOBBED + """
SELECT owner_id, pattern, path FROM hit""")
def s15_glob_join(f):
    return drift.glob_join(f["source_map"], f["file"]).select("owner_id", "pattern", "path")


@query("f1_source_drift", GLOBBED + f"""
SELECT h.owner_id AS id, coalesce(n.name, '') AS name, string_agg(DISTINCT h.pattern, ',') AS patterns FROM hit h LEFT JOIN nodes n ON n.id = h.owner_id WHERE h.mtime > {SINCE} GROUP BY 1, 2""")
def f1_source_drift(f):
    return drift.source_drift(f["source_map"], f["file"], node(f), F.expr(SINCE))


@query("f2_structure_drift", f"""SELECT bool_or(created > {SINCE}) AS changed FROM file""")
def f2_structure_drift(f):
    return drift.structure_drift(f["file"], F.expr(SINCE))


@query("f3_drift_report", GLOBBED + f"""
SELECT DISTINCT owner_id AS id, CAST(NULL AS BOOLEAN) AS structure_changed FROM hit WHERE mtime > {SINCE} UNION ALL SELECT '', bool_or(created > {SINCE}) FROM file""")
def f3_drift_report(f):
    lock = f["file"].groupBy("model").agg(F.lit(False).alias("locked"))
    return drift.drift_report(f["source_map"], f["file"], node(f), F.expr(SINCE), lock)


MODEL_EVENTS = """good AS (SELECT * FROM file_event WHERE kind IN ('create', 'modify') AND path LIKE '%.scry' AND path NOT LIKE '%.baseline.scry')"""


@query("k1_file_events", MODEL_EVENTS + """
SELECT seq, kind, path FROM good""")
def k1_file_events(f):
    return ev.model_events(f["file_event"]).select("seq", "kind", "path")


@query("k2_first_seen", MODEL_EVENTS + """
SELECT path, min(ts) AS created FROM good GROUP BY path""")
def k2_first_seen(f):
    return ev.first_seen(ev.model_events(f["file_event"]))


@query("k3_debounce", MODEL_EVENTS + """, gap AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 1 MINUTE THEN 0 ELSE 1 END AS fresh FROM good),
grp AS (SELECT *, sum(fresh) OVER (ORDER BY ts) AS g FROM gap)
SELECT max(ts) + INTERVAL 1 MINUTE AS fires, last(path ORDER BY ts, path) AS path, count(*) AS events FROM grp GROUP BY g""")
def k3_debounce(f):
    return ev.debounced_log(ev.model_events(f["file_event"]), 60).select("fires", "path", "events")


@query("k5_self_writes", MODEL_EVENTS + """, prev AS (SELECT seq, path, CAST(floor(value) AS BIGINT) % 3 AS content, lag(CAST(floor(value) AS BIGINT) % 3) OVER (PARTITION BY path ORDER BY seq) AS before FROM good)
SELECT seq, path FROM prev WHERE content IS DISTINCT FROM before""")
def k5_self_writes(f):
    rows = ev.model_events(f["file_event"]).withColumn("content", F.floor("value") % 3)
    return ev.changed_content(rows).select("seq", "path")


@query("k6_event_log", """lines AS (SELECT event_id AS seq, concat(event_type, ' ', CAST(event_id // 4 % 2 AS STRING)) AS text FROM events),
lag_ AS (SELECT *, CASE WHEN text IS DISTINCT FROM lag(text) OVER (ORDER BY seq) THEN 1 ELSE 0 END AS fresh FROM lines), runs AS (SELECT *, sum(fresh) OVER (ORDER BY seq) AS run FROM lag_)
SELECT CAST(run AS BIGINT) AS run, first(text ORDER BY seq) AS text, count(*) AS times FROM runs GROUP BY run HAVING run > (SELECT max(run) FROM runs) - 200""")
def k6_event_log(f):
    from tessella.operators.views import collapsed_log

    e = f.spark.read.parquet(f"{f.sf_dir}/events.parquet")
    log = e.select(F.lit("main").alias("model"), F.col("event_id").alias("seq"), F.concat("event_type", F.lit(" "), F.expr("CAST(event_id div 4 % 2 AS STRING)")).alias("text"))
    return collapsed_log(log)


@query("k7_single_session", """s AS (SELECT user_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'done' END AS kind FROM events WHERE event_type IN ('signup', 'purchase')),
p AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY seq) AS before FROM s)
SELECT CAST(user_id AS STRING) AS session_key, seq, before IS DISTINCT FROM 'start' AS accepted FROM p WHERE kind = 'start'""")
def k7_single_session(f):
    e = f.spark.read.parquet(f"{f.sf_dir}/events.parquet").where("event_type IN ('signup', 'purchase')")
    rows = e.select(
        F.lit("main").alias("model"), F.col("user_id").cast("string").alias("session_key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "start").otherwise("done").alias("kind")
    )
    return ev.accepted_starts(rows).select("session_key", "seq", "accepted")


def _live(f, content: str = "CAST(NULL AS STRING)"):
    """The fixture's model events as a change log; its timestamps become instants."""
    rows = ev.model_events(f["file_event"])
    return rows.select("model", "seq", F.col("ts").cast("timestamp").alias("ts"), "kind", "path", F.expr(content).alias("content"))


@query("k2_first_seen_live", MODEL_EVENTS + """
SELECT path, min(ts) AS created FROM good GROUP BY path""")
def k2_first_seen_live(f):
    told = live.replayed(_live(f), lambda e: live.first_seen(ev.model_events(e)))
    return told.select("path", F.col("created").cast(f["file_event"].schema["ts"].dataType).alias("created"))


@query("k3_debounce_live", MODEL_EVENTS + """, gap AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 1 MINUTE THEN 0 ELSE 1 END AS fresh FROM good),
grp AS (SELECT *, sum(fresh) OVER (ORDER BY ts) AS g FROM gap)
SELECT max(ts) + INTERVAL 1 MINUTE AS fires, last(path ORDER BY ts, path) AS path, count(*) AS events FROM grp GROUP BY g""")
def k3_debounce_live(f):
    told = live.replayed(_live(f), lambda e: ev.debounced_by_model(ev.model_events(e), "1 minute", "1 minute"))
    return told.select(F.col("fires").cast(f["file_event"].schema["ts"].dataType).alias("fires"), "path", "events")


@query("k4_debounce_by_model_live", MODEL_EVENTS + """, gap AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM good),
grp AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts) AS g FROM gap)
SELECT path, max(ts) + INTERVAL 1 HOUR AS fires, count(*) AS events FROM grp GROUP BY path, g""")
def k4_debounce_by_model_live(f):
    by_path = _live(f).withColumn("model", F.col("path"))
    told = live.replayed(by_path, lambda e: ev.debounced_by_model(ev.model_events(e), "1 hour", "1 minute"))
    return told.select("path", F.col("fires").cast(f["file_event"].schema["ts"].dataType).alias("fires"), "events")


@query("k5_self_writes_live", MODEL_EVENTS + """, prev AS (SELECT seq, path, CAST(floor(value) AS BIGINT) % 3 AS content, lag(CAST(floor(value) AS BIGINT) % 3) OVER (PARTITION BY path ORDER BY ts, seq) AS before FROM good)
SELECT seq, path, CAST(content AS STRING) AS content FROM prev WHERE content IS DISTINCT FROM before""")
def k5_self_writes_live(f):
    told = live.replayed(_live(f, "CAST(floor(value) % 3 AS STRING)"), lambda e: live.changed_content(ev.model_events(e)))
    return told.select("seq", "path", "content")


@query("k7_single_session_live", """s AS (SELECT user_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'done' END AS kind FROM events WHERE event_type IN ('signup', 'purchase')),
p AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY ts, seq) AS before FROM s)
SELECT CAST(user_id AS STRING) AS session_key, seq, before IS DISTINCT FROM 'start' AS accepted FROM p WHERE kind = 'start'""")
def k7_single_session_live(f):
    e = f.spark.read.parquet(f"{f.sf_dir}/events.parquet").where("event_type IN ('signup', 'purchase')")
    rows = e.select(
        F.lit("main").alias("model"), F.col("user_id").cast("string").alias("session_key"), F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "signup", "start").otherwise("done").alias("kind"),
    )
    return live.replayed(rows, live.accepted_starts).select("session_key", "seq", "accepted")


@query("s13_visible_files", """lines AS (SELECT n_nationkey AS k, n_nationkey % 10 AS m, concat(CAST(n_nationkey AS STRING), '.rs') AS ending, n_nationkey % 4 <> 1 AS closes FROM nation),
hits AS (SELECT path, max_by(closes, k) AS closes FROM file JOIN lines ON path LIKE concat('src/mod', CAST(m AS STRING), '/%') AND path LIKE concat('%', ending) GROUP BY path)
SELECT path FROM file LEFT JOIN hits USING (path) WHERE path NOT LIKE 'src/mod7/%' AND NOT coalesce(closes, false)""")
def s13_visible_files(f):
    """One directory closed from above; in the others the last line that fits a file decides."""
    folder = F.concat(F.lit("src/mod"), (F.col("n_nationkey") % 10).cast("string"), F.lit("/"))
    line = F.concat(F.when(F.col("n_nationkey") % 4 == 1, "!").otherwise(""), F.lit("*"), F.col("n_nationkey").cast("string"), F.lit(".rs"))
    told = f._source("nation").groupBy(folder.alias("dir")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))).alias("l"))
    texts = told.select("dir", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    texts = texts.unionByName(texts.limit(1).select(F.lit("").alias("dir"), F.lit("# whole\nmod7/\n").alias("text")))
    rules = ignore.rules(texts.select(F.lit("main").alias("model"), "dir", F.lit(len(ignore.KINDS) - 1).alias("kind"), "text"))
    files = f["file"].select("model", "path", F.lit(False).alias("is_dir"))
    above = files.select("model", F.explode(drift.directories(F.col("path"))).alias("path")).where("path <> ''").distinct()
    entries = files.unionByName(above.select("model", F.regexp_replace("path", "/\\z", "").alias("path"), F.lit(True).alias("is_dir")))
    return ignore.visible(entries, rules).where("NOT is_dir").select("path")


@query("s12_store", """SELECT CASE s_suppkey % 5 WHEN 1 THEN regexp_replace(lower(concat('New ', s_name)), '[^a-z0-9_-]', '-', 'g') ELSE s_name END AS name, kind,
 CASE WHEN s_suppkey % 5 = 2 AND kind = 'model' THEN concat('again ', CAST(s_nationkey AS STRING)) ELSE concat(kind, ' ', CAST(s_nationkey AS STRING)) END AS text
FROM supplier, (SELECT unnest(['model', 'baseline']) AS kind) WHERE s_suppkey % 5 <> 0""")
def s12_store(f):
    """Documents created, written anew, renamed and deleted in a store, a commit each, and compacted."""
    supplier = f._source("supplier").select("s_suppkey", F.col("s_name").alias("model"), F.col("s_nationkey").cast("string").alias("at"))
    docs = supplier.select("s_suppkey", "model", "at", F.explode(F.array(F.lit("model"), F.lit("baseline"))).alias("kind"))
    held = store.Store(f.spark, f"{shared_dir(f.spark).rstrip('/')}/store-{uuid.uuid4().hex}")
    held.create(docs.select("model", "kind", F.concat_ws(" ", "kind", "at").alias("text")))
    held.write(docs.where("kind = 'model' AND s_suppkey % 5 = 2").select("model", "kind", F.concat(F.lit("again "), "at").alias("text")))
    held.rename(supplier.where("s_suppkey % 5 = 1").select(F.col("model").alias("old"), F.concat(F.lit(" New "), "model").alias("new")))
    held.delete(supplier.where("s_suppkey % 5 = 0").select("model"))
    held.compact()
    return held.documents().withColumnRenamed("model", "name")
