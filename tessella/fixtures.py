"""Projection of star-schema tables to the relations of one model.

The same SQL serves as the head of every oracle query, so that the operators,
not the projection, are what is compared.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.lineage import cut

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

#: Common table expressions by name, in dependency order. {x} stands for a table.
PROJECTION: dict[str, str] = {
    "nodes": """
 SELECT concat('person-',CAST(user_id AS STRING)) id, CAST(NULL AS STRING) parent_id, 'person' kind, CAST(NULL AS STRING) status, false ext, concat('U',CAST(user_id AS STRING)) name, user_id ord FROM (SELECT DISTINCT user_id FROM {events}) u
 UNION ALL SELECT concat('system-',CAST(r_regionkey AS STRING)), NULL, 'system', CASE WHEN r_regionkey=4 THEN NULL ELSE 'proposed' END, r_regionkey=4, r_name, 1000000000 + r_regionkey FROM {region}
 UNION ALL SELECT concat('container-',CAST(n_nationkey AS STRING)), concat('system-',CAST(n_regionkey AS STRING)), 'container', 'proposed', false, n_name, 2000000000 + n_nationkey FROM {nation} WHERE n_regionkey<>4
 UNION ALL SELECT concat('component-',CAST(s_suppkey AS STRING)), concat('container-',CAST(s_nationkey AS STRING)), 'component',
   CASE WHEN s_nationkey % 6 = 0 THEN 'implemented' WHEN s_acctbal < 0 THEN NULL WHEN s_suppkey % 4 = 0 THEN 'verified' WHEN s_suppkey % 4 = 1 THEN 'implemented' WHEN s_suppkey % 11 = 0 THEN 'vagrant' ELSE 'proposed' END, false, s_name, 3000000000 + s_suppkey
   FROM {supplier} JOIN {nation} ON s_nationkey=n_nationkey WHERE n_regionkey<>4
 UNION ALL SELECT concat('operation-',CAST(p_partkey AS STRING)), concat('component-',CAST(sk AS STRING)), 'operation', CASE WHEN p_size % 2 = 0 THEN 'proposed' ELSE 'implemented' END, false, p_name, 4000000000 + p_partkey
   FROM {part} JOIN (SELECT l_partkey, min(l_suppkey) sk FROM {lineitem} GROUP BY l_partkey) m ON p_partkey=l_partkey JOIN {supplier} ON s_suppkey=sk JOIN {nation} ON s_nationkey=n_nationkey WHERE n_regionkey<>4""",
    "pairs": """
 SELECT DISTINCT concat('component-',CAST(a.l_suppkey AS STRING)) source, concat('component-',CAST(b.l_suppkey AS STRING)) target FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey=b.l_orderkey AND b.l_linenumber=a.l_linenumber+1 WHERE a.l_quantity>=49 AND a.l_suppkey<>b.l_suppkey
 UNION SELECT concat('person-',CAST(user_id AS STRING)), concat('system-',CAST(user_id % 4 AS STRING)) FROM {events}
 UNION SELECT concat('container-',CAST(n_nationkey AS STRING)), concat('container-',CAST((n_nationkey*7+3)%25 AS STRING)) FROM {nation}
 UNION SELECT concat('system-',CAST(r_regionkey AS STRING)), concat('system-',CAST((r_regionkey+1)%5 AS STRING)) FROM {region} WHERE r_regionkey<3""",
    "edges": """
 SELECT concat('edge-',source,'-',target) id, source, target, CASE WHEN length(target) % 3 = 0 THEN CAST(NULL AS STRING) ELSE concat('uses ',target) END label FROM pairs p WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.id=p.source) AND EXISTS (SELECT 1 FROM nodes n WHERE n.id=p.target)""",
    "descr": """
 SELECT n.id, concat('Uses @[', m.name, '] and @[missing] daily') description FROM nodes n JOIN {supplier} a ON n.id=concat('component-',CAST(a.s_suppkey AS STRING))
  JOIN nodes m ON m.id=concat('component-',CAST((a.s_suppkey*7+3)%100 AS STRING))""",
    "contract_item": """
 SELECT concat(CASE WHEN o_orderkey % 100 = 0 THEN 'container-' WHEN o_orderkey % 10 = 5 THEN 'component-' ELSE 'operation-' END, CAST(CASE WHEN o_orderkey % 100 = 0 THEN c_nationkey WHEN o_orderkey % 10 = 5 THEN (o_orderkey*3) % 97 ELSE o_custkey END AS STRING)) owner_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'expect' WHEN 1 THEN 'expect' WHEN 2 THEN 'ask' ELSE 'never' END section, o_orderkey pos, o_orderpriority text,
  CASE WHEN o_orderkey % 5 < 3 THEN true WHEN o_orderkey % 5 = 3 THEN false ELSE CAST(NULL AS BOOLEAN) END passed
 FROM {orders} JOIN {customer} ON o_custkey=c_custkey""",
    "group_member": """
 SELECT concat('group-',CAST(n_regionkey AS STRING),'-',CAST(n_nationkey % 2 AS STRING)) group_id, concat('container-',CAST(n_nationkey AS STRING)) node_id, n_nationkey pos FROM {nation} WHERE n_regionkey<>4 AND n_nationkey % 5 <> 0""",
    "model_group": """
 SELECT DISTINCT group_id id, CASE WHEN group_id LIKE '%-1' THEN concat(substr(group_id,1,8),'0') ELSE CAST(NULL AS STRING) END parent_group_id FROM group_member""",
    "flow_step": """
 SELECT concat('scenario-',CAST(conv_id AS STRING)) flow_id, concat('step-',CAST(turn AS STRING)) step_id,
  CASE WHEN turn % 2 = 1 THEN concat('step-',CAST(turn-1 AS STRING)) ELSE CAST(NULL AS STRING) END parent_step_id, CASE WHEN turn % 2 = 1 THEN 0 ELSE CAST(NULL AS INT) END branch_idx,
  CASE WHEN turn % 2 = 1 THEN 0 ELSE turn END pos, role label, CASE WHEN turn % 3 = 0 THEN CAST(NULL AS STRING) ELSE role END description FROM {conversations}""",
    "file": """
 SELECT concat('src/mod',CAST(user_id % 10 AS STRING),'/f',CAST(user_id AS STRING),'.rs') path, max(ts) mtime, min(ts) created FROM {events} GROUP BY user_id""",
    "source_map": """
 SELECT concat('component-',CAST(s_suppkey AS STRING)) owner_id, concat('src/mod',CAST(s_suppkey % 12 AS STRING),'/**') pattern, 0 pos FROM {supplier}""",
    "baseline": """
 SELECT id, parent_id, kind, CASE WHEN id LIKE '%7' THEN 'implemented' ELSE status END status, ext, CASE WHEN id LIKE '%13' THEN concat(name,' old') ELSE name END name FROM nodes WHERE id NOT LIKE '%99'
 UNION ALL SELECT concat('operation-gone-',CAST(r_regionkey AS STRING)), 'component-1', 'operation', 'proposed', false, r_name FROM {region}""",
    "edge_baseline": """
 SELECT id, source, target, CASE WHEN id LIKE '%3' THEN concat(coalesce(label,''),' old') ELSE label END label FROM edges WHERE id NOT LIKE '%5'
 UNION ALL SELECT concat('edge-gone-',CAST(r_regionkey AS STRING)), 'component-1', 'component-2', CAST(NULL AS STRING) FROM {region}""",
    "flow_baseline": """
 SELECT flow_id, step_id FROM flow_step WHERE NOT (flow_id LIKE '%7' AND step_id = 'step-3') AND flow_id NOT LIKE '%9'
 UNION ALL SELECT 'scenario-gone', 'step-0' FROM {region} WHERE r_regionkey = 0""",
    "file_event": """
 SELECT event_id seq, ts, CASE event_type WHEN 'view' THEN 'modify' WHEN 'click' THEN 'create' ELSE 'remove' END kind,
  concat('models/m',CAST(user_id % 50 AS STRING),CASE WHEN event_id % 7 = 0 THEN '.baseline.scry' WHEN event_id % 11 = 0 THEN '.txt' ELSE '.scry' END) path, value FROM {events}""",
}


def _with(names: dict[str, str]) -> str:
    return ",\n".join(f"{name} AS ({sql.format(**names)})" for name, sql in PROJECTION.items())


#: Head of an oracle query; more expressions or a SELECT follow.
ORACLE_HEAD = "WITH RECURSIVE " + _with({t: t for t in TABLES})


#: Relations that are written once for each fixture; the others are views over them and the tables.
STORED = ("nodes", "edges")


class Fixture:
    """Relations by name with ``model`` = 'main', as if read from stored model tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._known: dict[str, DataFrame] = {}

    def _source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet") if name in TABLES else self[name].drop("model")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(PROJECTION)})\b", r"\1 {\2}", PROJECTION[name])
            sources = {t: self._source(t) for t in dict.fromkeys(re.findall(r"{(\w+)}", text))}
            rows = self.spark.sql(text, **sources).withColumn("model", F.lit("main"))
            self._known[name] = cut(rows) if name in STORED else rows
        return self._known[name]


#: (name, path) pairs for the file classifier.
CLASSIFIED = (
    ("package.json", "package.json"),
    ("x.csproj", "a/x.csproj"),
    ("Dockerfile.builder", "Dockerfile.builder"),
    ("deploy.yml", ".github/workflows/deploy.yml"),
    ("main.tf", "infra/main.tf"),
    (".env.example", ".env.example"),
    ("README.md", "README.md"),
    ("index.ts", "src/index.ts"),
    ("config.yml", ".circleci/config.yml"),
    ("svc.yaml", "k8s/svc.yaml"),
    ("svc.yaml", "app/k8s/svc.yaml"),
    (".gitlab-ci.yml", ".gitlab-ci.yml"),
)
