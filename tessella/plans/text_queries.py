"""Scalar functions over columns of the fixture tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessella.functions import predicates as p
from tessella.functions import text as t
from tessella.operators import fuzzy

from .registry import query
from .relations import described, edge, node


def _table(f, name):
    return f.spark.read.parquet(f"{f.sf_dir}/{name}.parquet").withColumn("model", F.lit("main"))


@query("p2_labels", """SELECT id, coalesce(status, 'none') AS status, 'default' AS shape FROM nodes""")
def p2_labels(f):
    return node(f).select("id", p.status_label(F.col("status")).alias("status"), p.shape_label(F.lit(None).cast("string")).alias("shape"))


@query("p3_strip", """SELECT id, parent_id, kind, name FROM nodes""")
def p3_strip(f):
    return node(f).withColumn("x", F.lit(1.0)).withColumn("node_type", F.lit("c4")).select("id", "parent_id", "kind", "name")


NAMES = """names AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT replace(p_name, ' ', '_') FROM part UNION SELECT p_brand FROM part UNION SELECT c_mktsegment FROM customer UNION SELECT '9 ' || s_name FROM supplier)"""


def _names(f):
    part = _table(f, "part")
    out = part.select(F.col("p_name").alias("name")).union(part.select(F.replace("p_name", F.lit(" "), F.lit("_")))).union(part.select("p_brand"))
    return out.union(_table(f, "customer").select("c_mktsegment")).union(_table(f, "supplier").select(F.concat(F.lit("9 "), "s_name"))).distinct()


@query("p5_p6_p9_identifiers", NAMES + """
SELECT name, regexp_full_match(name, '[a-z][A-Za-z0-9_]*') AS identifier, regexp_full_match(name, '[A-Za-z][A-Za-z0-9_]*') AS type_name,
 concat(lower(substr(regexp_replace(regexp_replace(name, '[^A-Za-z0-9_]', '', 'g'), '^[^A-Za-z]', ''), 1, 1)), substr(regexp_replace(regexp_replace(name, '[^A-Za-z0-9_]', '', 'g'), '^[^A-Za-z]', ''), 2)) AS clean FROM names""")
def p5_p6_p9_identifiers(f):
    n = F.col("name")
    return _names(f).select("name", p.is_identifier(n).alias("identifier"), p.is_type_name(n).alias("type_name"), p.sanitized_identifier(n).alias("clean"))


@query("p8_length_limits", """SELECT doc_id, CASE WHEN lang <> 'en' AND strlen(text) > 200 THEN 'description' ELSE '' END AS too_long, coalesce(strlen(text) > 30, false) AS label_too_long FROM documents""")
def p8_length_limits(f):
    kind = F.when(F.col("lang") == "en", "operation").otherwise("component")
    return _table(f, "documents").select(
        "doc_id", p.too_long(kind, F.col("text"), F.lit("short")).alias("too_long"), p.label_too_long(F.col("text")).alias("label_too_long")
    )


@query("p10_matches", NAMES + """
SELECT name, starts_with(lower(name), 're') AS starts FROM names WHERE contains(lower(name), 're')""")
def p10_matches(f):
    return t.ranked_matches(_names(f), "RE")


@query("p11_veto", """SELECT e.event_type, CASE WHEN event_type = 'click' THEN 'mcp__x__get_task' ELSE concat('get_task__', event_type) END AS title, event_type = 'click' AS vetoed FROM (SELECT DISTINCT event_type FROM events) e""")
def p11_veto(f):
    title = F.when(F.col("event_type") == "click", "mcp__x__get_task").otherwise(F.concat(F.lit("get_task__"), "event_type"))
    return _table(f, "events").select("event_type").distinct().select("event_type", title.alias("title"), p.is_vetoed(title).alias("vetoed"))


@query("x1_mentions", """SELECT id, CAST(len(regexp_extract_all(description, '@\\[([^\\]]*)\\]', 1)) AS INT) AS mentions, array_to_string(regexp_extract_all(description, '@\\[([^\\]]*)\\]', 1), '|') AS names FROM descr""")
def x1_mentions(f):
    from tessella.operators.validate import mentions

    m = mentions(F.col("description"))
    return f["descr"].select("id", F.size(m).alias("mentions"), F.array_join(m, "|").alias("names"))


@query("x2_bullets", """SELECT doc_id, regexp_matches(text, '(^|\\n) *[-*]\\s') AS bullets FROM documents""")
def x2_bullets(f):
    return _table(f, "documents").select("doc_id", t.has_bullets(F.col("text")).alias("bullets"))


@query("x3_contract_lines", """SELECT owner_id, pos, concat(CASE WHEN passed IS NULL THEN '' WHEN passed THEN '[x] ' ELSE '[ ] ' END, text, CASE WHEN pos % 4 = 0 THEN concat(' (http://x/', CAST(pos AS STRING), ')') ELSE '' END) AS line FROM contract_item""")
def x3_contract_lines(f):
    rows = f["contract_item"]
    plain = F.to_json(F.struct("text", "passed", F.when(F.col("pos") % 4 == 0, F.concat(F.lit("http://x/"), F.col("pos").cast("string"))).alias("url")))
    as_text = F.when(F.col("passed").isNull() & (F.col("pos") % 4 != 0), F.to_json(F.array("text"))).otherwise(F.concat(F.lit("["), plain, F.lit("]")))
    item = t.contract_item(F.try_variant_get(F.parse_json(as_text), "$[0]", "variant"))
    return rows.select("owner_id", "pos", t.contract_line(item).alias("line"))


@query("x5_severity", """SELECT DISTINCT event_type, CASE WHEN event_type LIKE 'v%' THEN 'warning' ELSE 'info' END AS severity FROM events""")
def x5_severity(f):
    return _table(f, "events").select("event_type").distinct().select("event_type", p.severity(F.when(F.col("event_type").like("v%"), "W").otherwise(F.col("event_type"))).alias("severity"))


@query("x6_node_lines", """SELECT n.ord, concat(CASE n.kind WHEN 'person' THEN '[P]' WHEN 'system' THEN CASE WHEN n.ext THEN '[S!]' ELSE '[S]' END WHEN 'container' THEN '[C]' WHEN 'component' THEN '[K]' ELSE '[M]' END, ' ', n.id, ' "', n.name, '" (', n.kind,
 CASE WHEN n.ext THEN ',external' ELSE '' END, CASE WHEN n.parent_id IS NULL THEN '' ELSE concat(',parent=', coalesce(p.name, n.parent_id)) END, ')', CASE WHEN n.status IS NULL THEN '' ELSE concat(' status=', n.status) END,
 CASE WHEN d.description IS NULL THEN '' ELSE concat(' | "', CASE WHEN strlen(d.description) > 80 THEN concat(substr(d.description, 1, 80), '...') ELSE d.description END, '"') END) AS line
FROM nodes n LEFT JOIN nodes p ON p.id = n.parent_id LEFT JOIN descr d ON d.id = n.id""")
def x6_node_lines(f):
    return t.node_lines(described(f)).select("ord", "line")


@query("x6_edge_lines", """SELECT e.id, concat(e.source, ' "', s.name, '" --[', coalesce(e.label, 'uses'), ']--> ', e.target, ' "', t.name, '"') AS line FROM edges e JOIN nodes s ON s.id = e.source JOIN nodes t ON t.id = e.target""")
def x6_edge_lines(f):
    return t.edge_lines(edge(f), node(f)).select("id", "line")


@query("x7_contract_blocks", """part AS (SELECT owner_id, section, string_agg(concat('    - ', text, chr(10)), '' ORDER BY pos) AS lines FROM contract_item GROUP BY 1, 2),
body AS (SELECT owner_id, string_agg(concat('  ', CASE section WHEN 'expect' THEN 'MUST' WHEN 'ask' THEN 'ASK USER FIRST' ELSE 'NEVER' END, ':', chr(10), lines), '' ORDER BY CASE section WHEN 'expect' THEN 0 WHEN 'ask' THEN 1 ELSE 2 END) AS b FROM part GROUP BY 1)
SELECT owner_id AS id, concat(chr(10), owner_id, ' — Contract (MUST follow):', chr(10), b) AS block FROM body""")
def x7_contract_blocks(f):
    def listed(section):
        rows = F.sort_array(F.collect_list(F.when(F.col("section") == section, F.struct("pos", "text"))))
        return F.transform(rows, lambda x: x["text"])

    parts = f["contract_item"].groupBy("model", "owner_id").agg(*[listed(s).alias(s) for s in ("expect", "ask", "never")])
    block = t.contract_block(F.col("owner_id"), F.col("expect"), F.col("ask"), F.col("never"), F.array().cast("array<string>"))
    return parts.select(F.col("owner_id").alias("id"), block.alias("block"))


FILES = """paths(k, name, path) AS (VALUES (0, 'package.json', 'package.json'), (1, 'x.csproj', 'a/x.csproj'), (2, 'Dockerfile.builder', 'Dockerfile.builder'), (3, 'deploy.yml', '.github/workflows/deploy.yml'), (4, 'main.tf', 'infra/main.tf'),
 (5, '.env.example', '.env.example'), (6, 'README.md', 'README.md'), (7, 'index.ts', 'src/index.ts'), (8, 'config.yml', '.circleci/config.yml'), (9, 'svc.yaml', 'k8s/svc.yaml'), (10, 'svc.yaml', 'app/k8s/svc.yaml'), (11, '.gitlab-ci.yml', '.gitlab-ci.yml'))"""


@query("x8_file_categories", FILES + """
SELECT e.user_id, name, path, CASE WHEN k < 2 THEN 'manifest' WHEN k IN (2, 3, 4, 8, 9, 11) THEN 'infrastructure' WHEN k = 5 THEN 'environment' END AS category FROM (SELECT DISTINCT user_id FROM events) e JOIN paths ON k = e.user_id % 12""")
def x8_file_categories(f):
    from tessella.fixtures import CLASSIFIED

    users = _table(f, "events").select("user_id").distinct()
    pick = F.get(F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("path")) for a, b in CLASSIFIED]), (F.col("user_id") % len(CLASSIFIED)).cast("int"))
    rows = users.select("user_id", pick.alias("p")).select("user_id", "p.name", "p.path")
    return rows.withColumn("category", t.file_category(F.col("name"), F.col("path")))


@query("x10_event_summaries", """SELECT turn, conv_id, CASE turn % 4 WHEN 0 THEN NULLIF(CASE WHEN strlen(f) > 120 THEN concat(substr(f, 1, 120), '…') ELSE f END, '') WHEN 1 THEN concat('-> ', role) WHEN 2 THEN concat('Done (', role, ')') END AS summary
FROM (SELECT *, trim(string_split(trim(text), chr(10))[1]) AS f FROM conversations) c""")
def x10_event_summaries(f):
    content = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    line = (
        F.when(F.col("turn") % 4 == 0, F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(content.alias("content")).alias("message"))))
        .when(F.col("turn") % 4 == 1, F.to_json(F.struct(F.lit("tool_use").alias("type"), F.col("role").alias("name"))))
        .when(F.col("turn") % 4 == 2, F.to_json(F.struct(F.lit("result").alias("type"), F.col("role").alias("subtype"))))
        .otherwise("not json {")
    )
    return _table(f, "conversations").select("turn", "conv_id", t.event_summary(line).alias("summary"))


@query("x12_elapsed", """SELECT p_partkey, CASE WHEN p_size * 7 < 60 THEN concat(CAST(p_size * 7 AS STRING), 's') ELSE concat(CAST(p_size * 7 // 60 AS STRING), 'm ', CAST(p_size * 7 % 60 AS STRING), 's') END AS text FROM part""")
def x12_elapsed(f):
    return _table(f, "part").select("p_partkey", t.elapsed(F.col("p_size") * 7).alias("text"))


@query("o4_truncated", """SELECT doc_id, CASE WHEN strlen(text) > 80 THEN concat(substr(text, 1, 77), '...') ELSE text END AS short FROM documents""")
def o4_truncated(f):
    return _table(f, "documents").select("doc_id", t.truncated(F.col("text")).alias("short"))


HINTS = """hint(k, name) AS (VALUES (1, 'container-3'), (2, 'EUROPE'), (3, 'europe'), (4, 'AMER'), (5, 'nothing like it'), (6, 'xx ASIA xx'))"""


@query("j8_fuzzy_match", HINTS + """, hits AS (SELECT h.k, n.id, n.ord, CASE WHEN n.id = h.name THEN 1 WHEN n.name = h.name THEN 3 WHEN lower(n.name) = lower(h.name) THEN 4 ELSE 5 END AS tier FROM hint h JOIN nodes n
 ON n.id = h.name OR lower(n.name) = lower(h.name) OR contains(lower(n.name), lower(h.name)) OR contains(lower(h.name), lower(n.name)))
SELECT k, id, tier FROM hits QUALIFY row_number() OVER (PARTITION BY k ORDER BY tier, ord) = 1""")
def j8_fuzzy_match(f):
    rows = [(1, "container-3"), (2, "EUROPE"), (3, "europe"), (4, "AMER"), (5, "nothing like it"), (6, "xx ASIA xx")]
    hints = f.spark.createDataFrame([("main", *r) for r in rows], "model string, k int, name string")
    return fuzzy.resolve(hints, node(f))


ASKED = """asked(k, name) AS (
 SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN concat('container-', CAST(s_nationkey AS STRING)) WHEN 1 THEN s_name WHEN 2 THEN lower(s_name) WHEN 3 THEN substr(s_name, 10, 8)
  WHEN 4 THEN concat('the ', lower(n_name), ' store') WHEN 5 THEN substr(n_name, 1, 2) WHEN 6 THEN concat(s_name, ' and ', n_name) ELSE concat('no ', s_name) END FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT 1000000000 + p_partkey, CASE p_size % 3 WHEN 0 THEN upper(substr(p_name, 3, 9)) WHEN 1 THEN p_brand ELSE concat('a ', p_name) END FROM part)"""


@query("j8_fuzzy_table", ASKED + """, exact AS (SELECT k, n.id, n.ord, CASE WHEN n.id = h.name THEN 1 WHEN n.name = h.name THEN 3 ELSE 4 END AS tier FROM asked h JOIN nodes n ON n.id = h.name UNION ALL
 SELECT k, n.id, n.ord, CASE WHEN n.name = h.name THEN 3 ELSE 4 END FROM asked h JOIN nodes n ON lower(n.name) = lower(h.name)),
rest AS (SELECT * FROM asked WHERE k NOT IN (SELECT k FROM exact)),
hits AS (SELECT * FROM exact UNION ALL SELECT k, n.id, n.ord, 5 FROM rest h JOIN nodes n ON contains(lower(n.name), lower(h.name)) OR contains(lower(h.name), lower(n.name)))
SELECT k, id, tier FROM hits QUALIFY row_number() OVER (PARTITION BY k ORDER BY tier, ord) = 1""")
def j8_fuzzy_table(f):
    tables = {t: f._source(t) for t in ("supplier", "nation", "part")}
    text = re.sub(r"\b(FROM|JOIN) (supplier|nation|part)\b", r"\1 {\2}", ASKED.removeprefix("asked(k, name) AS (").removesuffix(")")).replace("SELECT s_suppkey, CASE", "SELECT s_suppkey AS k, CASE").replace("ELSE concat('no ', s_name) END FROM", "ELSE concat('no ', s_name) END AS name FROM")
    return fuzzy.resolve(f.spark.sql(text, **tables).withColumn("model", F.lit("main")), node(f))


@query("o1_name_rank", """SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY name, id) AS place FROM nodes WHERE kind IN ('system', 'container', 'component')""")
def o1_name_rank(f):
    from pyspark.sql import Window

    w = Window.partitionBy("model", "kind").orderBy(F.expr("name COLLATE UNICODE"), "id")
    return node(f).where("kind IN ('system', 'container', 'component')").select("kind", "id", F.row_number().over(w).cast("long").alias("place"))
