"""Model documents (``*.scry``, one JSON document a file) as relations, and back.

Documents are read whole and decoded with an explicit schema: schema inference
would turn maps into structs and mixed items into strings. Unions (contract
items, notes) and the recursive flow steps are read as VARIANT. Document order
is kept in ``ord`` or ``pos``. The key ``model`` is the file name without its
ending.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.predicates import parsed_shape, parsed_status
from tessella.operators.graph import first_by

_CONTRACT = "struct<expect: array<variant>, always: array<variant>, ask: array<variant>, never: array<variant>>"
_FLOW = (
    "struct<id: string, name: string, description: string, steps: variant, "
    "transitions: array<struct<source: string, target: string, label: string>>>"
)
_DATA = (
    "struct<name: string, description: string, kind: string, technology: string, external: boolean, expanded: boolean, shape: string, "
    "sources: array<struct<pattern: string, comment: string>>, status: string, statusReason: string, "
    f"contract: {_CONTRACT}, notes: variant, properties: array<struct<label: string, description: string>>>"
)
DOCUMENT = (
    f"struct<nodes: array<struct<id: string, type: string, position: struct<x: double, y: double>, parentId: string, data: {_DATA}>>, "
    "edges: array<struct<id: string, source: string, target: string, data: struct<label: string, method: string>>>, "
    "startingLevel: string, projectPath: string, "
    "sourceMap: map<string, array<struct<pattern: string, line: int, endLine: int, command: string>>>, "
    "refPositions: map<string, struct<x: double, y: double>>, "
    f"groups: array<struct<id: string, name: string, description: string, memberIds: array<string>, parentGroupId: string, contract: {_CONTRACT}>>, "
    f"flows: array<{_FLOW}>, scenarios: array<{_FLOW}>>"
)
ENDING = ".scry"
#: Code-level kinds of older files, all of them operations now.
OLD_KINDS = ("function", "unit", "member")


def _file_name(path: Column) -> Column:
    return F.url_decode(F.element_at(F.split(path, "/"), -1))


def list_models(spark: SparkSession, folder: str) -> DataFrame:
    """(model) of every document in a folder, baselines left out, in byte order. Only file listings are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ENDING}").load(folder).select(_file_name(F.col("path")).alias("name"))
    model = F.substring(F.col("name"), F.lit(1), F.length("name") - len(ENDING))
    return files.select(model.alias("model")).where(~F.endswith("model", F.lit(".baseline"))).orderBy("model")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(model, text, doc): one row for each document, baselines left out. Broken JSON gives a null ``doc``."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", f"*{ENDING}").text(folder)
    name = _file_name(F.col("_metadata.file_path"))
    rows = files.select(F.substring(name, F.lit(1), F.length(name) - len(ENDING)).alias("model"), F.col("value").alias("text"))
    return rows.where(~F.endswith("model", F.lit(".baseline"))).withColumn("doc", F.from_json("text", DOCUMENT))


def parsed(documents: DataFrame) -> DataFrame:
    """(model, text, doc) from (model, text)."""
    return documents.withColumn("doc", F.from_json("text", DOCUMENT))


def current_kind(kind: Column) -> Column:
    """Missing kinds are systems; kinds of older files become operations."""
    return F.when(kind.isin(*OLD_KINDS), "operation").otherwise(F.coalesce(kind, F.lit("system")))


def _lines(notes: Column) -> Column:
    """Notes as a list: a string of older files is cut into lines."""
    as_text = F.try_variant_get(notes, "$", "string")
    lines = F.when(as_text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(as_text, "\\r?\\n\\z", ""), "\\r?\\n"))
    return F.coalesce(F.try_variant_get(notes, "$", "array<string>"), lines)


def nodes(documents: DataFrame) -> DataFrame:
    """(model, ord, id, parent_id, node_type, kind, name, ..., x, y); unknown statuses and shapes are null."""
    d = F.col("n.data")
    return documents.select("model", F.posexplode("doc.nodes").alias("ord", "n")).select(
        "model",
        F.col("ord").cast("long").alias("ord"),
        "n.id",
        F.col("n.parentId").alias("parent_id"),
        F.when(d["kind"].isin(*OLD_KINDS), "operation").otherwise(F.coalesce("n.type", F.lit("c4"))).alias("node_type"),
        current_kind(d["kind"]).alias("kind"),
        d["name"].alias("name"),
        F.coalesce(d["description"], F.lit("")).alias("description"),
        d["technology"].alias("technology"),
        d["external"].alias("external"),
        parsed_shape(d["shape"]).alias("shape"),
        parsed_status(d["status"]).alias("status"),
        d["statusReason"].alias("status_reason"),
        F.col("n.position.x").alias("x"),
        F.col("n.position.y").alias("y"),
    )


def edges(documents: DataFrame) -> DataFrame:
    """(model, ord, id, source, target, label, method)."""
    return documents.select("model", F.posexplode("doc.edges").alias("ord", "e")).select(
        "model", F.col("ord").cast("long").alias("ord"), "e.id", "e.source", "e.target", F.col("e.data.label").alias("label"), F.col("e.data.method").alias("method")
    )


def _items(owners: DataFrame, owner_type: str) -> DataFrame:
    """Contract items of (model, owner_id, contract); an item is a text or an object."""
    sections = (("expect", F.coalesce("contract.expect", "contract.always")), ("ask", F.col("contract.ask")), ("never", F.col("contract.never")))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), items.alias("items")) for s, items in sections]))
    rows = owners.select("model", "owner_id", each.alias("s")).select("model", "owner_id", "s.section", F.posexplode("s.items").alias("pos", "v"))
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    image = F.struct(get("$.image.filename").alias("filename"), get("$.image.mimeType").alias("mimeType"), F.unbase64(get("$.image.data")).alias("data"))
    return rows.select(
        "model",
        F.lit(owner_type).alias("owner_type"),
        "owner_id",
        "section",
        F.col("pos").cast("long").alias("pos"),
        F.coalesce(get("$.text"), get("$")).alias("text"),
        get("$.passed", "boolean").alias("passed"),
        get("$.url").alias("url"),
        F.when(get("$.image.filename").isNotNull(), image).alias("image"),
    )


def contract_items(documents: DataFrame) -> DataFrame:
    """Contract items of nodes and groups; ``always`` of older files reads as ``expect``."""
    of_nodes = documents.select("model", F.explode("doc.nodes").alias("n")).select("model", F.col("n.id").alias("owner_id"), F.col("n.data.contract").alias("contract"))
    of_groups = documents.select("model", F.explode("doc.groups").alias("g")).select("model", F.col("g.id").alias("owner_id"), F.col("g.contract").alias("contract"))
    return _items(of_nodes, "node").unionByName(_items(of_groups, "group"))


def notes(documents: DataFrame) -> DataFrame:
    """(model, node_id, pos, text)."""
    rows = documents.select("model", F.explode("doc.nodes").alias("n"))
    return rows.select("model", F.col("n.id").alias("node_id"), F.posexplode(_lines(F.col("n.data.notes"))).alias("pos", "text"))


def properties(documents: DataFrame) -> DataFrame:
    """(model, node_id, pos, label, description)."""
    rows = documents.select("model", F.explode("doc.nodes").alias("n"))
    each = rows.select("model", F.col("n.id").alias("node_id"), F.posexplode("n.data.properties").alias("pos", "p"))
    return each.select("model", "node_id", "pos", "p.label", F.coalesce("p.description", F.lit("")).alias("description"))


def source_map(documents: DataFrame) -> DataFrame:
    """(model, owner_id, pos, pattern, line, end_line, command) of nodes and flows."""
    rows = documents.select("model", F.explode("doc.sourceMap").alias("owner_id", "v")).select("model", "owner_id", F.posexplode("v").alias("pos", "s"))
    return rows.select("model", "owner_id", "pos", "s.pattern", "s.line", F.col("s.endLine").alias("end_line"), "s.command")


def groups(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(model, ord, id, name, description, parent_group_id) and (model, group_id, pos, node_id)."""
    rows = documents.select("model", F.posexplode("doc.groups").alias("ord", "g"))
    group = rows.select("model", F.col("ord").cast("long").alias("ord"), "g.id", "g.name", "g.description", F.col("g.parentGroupId").alias("parent_group_id"))
    return group, rows.select("model", F.col("g.id").alias("group_id"), F.posexplode("g.memberIds").alias("pos", "node_id"))


def flows(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flows, their steps as an adjacency list, and transitions of older files; ``scenarios`` reads as flows.

    Steps nest in branches without a bound. Each level is one more explode of
    the level above, without a shuffle; the loop ends at the deepest level.
    """
    rows = documents.select("model", F.posexplode(F.coalesce("doc.flows", "doc.scenarios")).alias("ord", "f"))
    flow = rows.select("model", F.col("ord").cast("long").alias("ord"), "f.id", "f.name", "f.description")
    moves = rows.select("model", F.col("f.id").alias("flow_id"), F.posexplode("f.transitions").alias("pos", "t")).select("model", "flow_id", "pos", "t.source", "t.target", "t.label")
    listed = lambda column, path: F.try_variant_get(column, path, "array<variant>")
    text = lambda path: F.try_variant_get("step", path, "string")
    level = rows.select(
        "model",
        F.col("f.id").alias("flow_id"),
        F.lit(None).cast("string").alias("parent_step_id"),
        F.lit(None).cast("int").alias("branch_idx"),
        F.lit(None).cast("string").alias("condition"),
        F.posexplode(listed("f.steps", "$")).alias("pos", "step"),
    )
    step: DataFrame | None = None
    while True:
        here = level.select(
            "model", "flow_id", text("$.id").alias("step_id"), "parent_step_id", "branch_idx", F.col("pos").cast("long").alias("pos"), "condition",
            text("$.description").alias("description"), text("$.label").alias("label"),
        )
        step = here if step is None else step.unionByName(here)
        branches = level.select("model", "flow_id", text("$.id").alias("parent_step_id"), F.posexplode(listed("step", "$.branches")).alias("branch_idx", "branch"))
        level = branches.select(
            "model",
            "flow_id",
            "parent_step_id",
            "branch_idx",
            F.coalesce(F.try_variant_get("branch", "$.condition", "string"), F.lit("")).alias("condition"),
            F.posexplode(listed("branch", "$.steps")).alias("pos", "step"),
        )
        if level.isEmpty():
            return flow, step, moves


def relations(documents: DataFrame) -> dict[str, DataFrame]:
    """All relations of decoded documents by name."""
    group, member = groups(documents)
    flow, step, moves = flows(documents)
    return {
        "node": nodes(documents), "edge": edges(documents), "contract_item": contract_items(documents), "note": notes(documents), "property": properties(documents),
        "source_map": source_map(documents), "group": group, "group_member": member, "flow": flow, "flow_step": step, "flow_transition": moves,
    }


def for_display(node: DataFrame, edge: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes typed by kind without statuses on persons and external systems, edges by their first id, and (model, needs_layout)."""
    bare = (F.col("kind") == "person") | ((F.col("kind") == "system") & F.coalesce("external", F.lit(False)))
    shown = node.withColumn("node_type", F.when(F.col("kind").isin("operation", "process", "model"), F.col("kind")).otherwise("c4")).withColumn("status", F.when(~bare, F.col("status")))
    lost = node.groupBy("model").agg((F.count_if(F.col("x").isNull() | F.col("y").isNull()) > 0).alias("needs_layout"))
    return shown, first_by(edge, ["model", "id"], "ord"), lost


def project_of(documents: DataFrame) -> DataFrame:
    """(model, project_path)."""
    return documents.select("model", F.col("doc.projectPath").alias("project_path"))


def registered(registry: DataFrame, added: DataFrame, existing: DataFrame) -> DataFrame:
    """(project_path): the registry with new projects, each once, without those whose model file is gone."""
    return registry.select("project_path").unionByName(added.select("project_path")).distinct().join(existing.select("project_path"), "project_path", "left_semi")


def all_models(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """(ref, name, project_path, is_local): global models, and registered projects that no global model claims."""
    known = project_of(documents)
    own = known.select(F.col("model").alias("ref"), F.col("model").alias("name"), "project_path", F.col("project_path").isNotNull().alias("is_local"))
    rest = registry.select("project_path").distinct().join(known.select("project_path"), "project_path", "left_anti")
    return own.unionByName(
        rest.select(F.concat(F.lit("project:"), "project_path").alias("ref"), F.element_at(F.split("project_path", "/"), -1).alias("name"), "project_path", F.lit(True).alias("is_local"))
    )


def resolved(wanted: DataFrame, local: DataFrame, documents: DataFrame) -> DataFrame:
    """(project_path, ref): the project's own file, else the first global model that names the project, else null."""
    w = Window.partitionBy("project_path").orderBy("model")
    first = project_of(documents).where("project_path IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("project_path", "model")
    here = local.select("project_path", F.lit(True).alias("_here")).distinct()
    rows = wanted.select("project_path").join(here, "project_path", "left").join(first, "project_path", "left")
    return rows.select("project_path", F.when(F.col("_here"), F.concat(F.lit("project:"), "project_path")).otherwise(F.col("model")).alias("ref"))


def blank(spark: SparkSession, model: str, project_path: str | None = None) -> DataFrame:
    """(model, text) of an empty document."""
    rows = spark.range(1).select(F.lit(model).alias("model"), F.lit(project_path).cast("string").alias("projectPath"))
    return rows.select("model", F.to_json(F.struct(F.array().cast("array<string>").alias("nodes"), F.array().cast("array<string>").alias("edges"), "projectPath")).alias("text"))


def slug(name: Column) -> Column:
    """File name of a template: lower case, anything but ASCII letters, digits, ``_`` and ``-`` as ``-``."""
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_-]", "-")


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _listed(order: Column, json: Column) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), json.alias("j"))))
    return F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["j"]), ","), F.lit("]"))


def _with(json: Column, *fields: tuple[str, Column]) -> Column:
    """An object with more fields, each already JSON; null ones are left out."""
    inner = F.concat_ws(",", F.nullif(F.substring(json, F.lit(2), F.length(json) - 2), F.lit("")), *[F.concat(F.lit(f'"{name}":'), value) for name, value in fields])
    return F.concat(F.lit("{"), inner, F.lit("}"))


def _contracts(item: DataFrame) -> DataFrame:
    """(model, owner_type, owner_id, contract) as JSON; an item that is only a text is written as one."""
    image = F.when(F.col("image").isNotNull(), F.struct("image.filename", "image.mimeType", F.base64("image.data").alias("data")))
    plain = F.col("passed").isNull() & F.col("url").isNull() & F.col("image").isNull()
    json = F.when(plain, _quoted(F.col("text"))).otherwise(F.to_json(F.struct("text", "passed", "url", image.alias("image"))))
    sections = item.groupBy("model", "owner_type", "owner_id", "section").agg(_listed(F.col("pos"), json).alias("j"))
    own = lambda s: F.max(F.when(F.col("section") == s, F.col("j")))
    whole = sections.groupBy("model", "owner_type", "owner_id").agg(*[own(s).alias(s) for s in ("expect", "ask", "never")])
    return whole.select("model", "owner_type", "owner_id", _with(F.lit("{}"), ("expect", F.col("expect")), ("ask", F.col("ask")), ("never", F.col("never"))).alias("contract"))


def _step_lists(step: DataFrame) -> DataFrame:
    """(model, flow_id, steps) as JSON: the deepest steps are folded into their branches first."""
    depth = step.where("parent_step_id IS NULL").select("model", "flow_id", "step_id").withColumn("depth", F.lit(0))
    found, n = depth, 0
    while True:
        n += 1
        below = step.join(depth.select("model", "flow_id", F.col("step_id").alias("parent_step_id")), ["model", "flow_id", "parent_step_id"]).select("model", "flow_id", "step_id", F.lit(n).alias("depth"))
        if below.isEmpty():
            break
        depth, found = below, found.unionByName(below)
    rows = step.join(found, ["model", "flow_id", "step_id"])
    folded: DataFrame | None = None  # (model, flow_id, step_id, branches) of the level below
    for d in range(n - 1, -1, -1):
        level = rows.where(F.col("depth") == d)
        base = F.to_json(F.struct(F.col("step_id").alias("id"), "label", "description"))
        if folded is None:
            level = level.withColumn("j", base)
        else:
            level = level.join(folded, ["model", "flow_id", "step_id"], "left").withColumn("j", _with(base, ("branches", F.col("branches"))))
        if d == 0:
            return level.groupBy("model", "flow_id").agg(_listed(F.col("pos"), F.col("j")).alias("steps"))
        branch = level.groupBy("model", "flow_id", "parent_step_id", "branch_idx").agg(F.first("condition", True).alias("condition"), _listed(F.col("pos"), F.col("j")).alias("j"))
        one = _with(F.to_json(F.struct(F.coalesce("condition", F.lit("")).alias("condition"))), ("steps", F.col("j")))
        folded = branch.groupBy("model", "flow_id", F.col("parent_step_id").alias("step_id")).agg(_listed(F.col("branch_idx"), one).alias("branches"))
    return rows.select("model", "flow_id", F.lit("[]").alias("steps")).limit(0)


def documents(rel: dict[str, DataFrame], model: DataFrame) -> DataFrame:
    """(model, text): relations as JSON documents, one group for each model; ``model`` has (model, project_path)."""
    item = _contracts(rel["contract_item"])
    of = lambda kind: item.where(F.col("owner_type") == kind).select("model", F.col("owner_id").alias("id"), "contract")
    note = rel["note"].groupBy("model", F.col("node_id").alias("id")).agg(_listed(F.col("pos"), _quoted(F.col("text"))).alias("notes"))
    prop = rel["property"].groupBy("model", F.col("node_id").alias("id")).agg(_listed(F.col("pos"), F.to_json(F.struct("label", "description"))).alias("properties"))
    n = rel["node"]
    for part in (of("node"), note, prop):
        n = n.join(part, ["model", "id"], "left")
    data = F.to_json(F.struct("name", "description", "kind", "technology", "external", "shape", "status", F.col("status_reason").alias("statusReason")))
    data = _with(data, ("contract", F.col("contract")), ("notes", F.col("notes")), ("properties", F.col("properties")))
    place = F.when(F.col("x").isNotNull(), F.struct("x", "y"))
    node_json = _with(F.to_json(F.struct("id", F.col("node_type").alias("type"), place.alias("position"), F.col("parent_id").alias("parentId"))), ("data", data))
    edge_data = F.when(F.col("label").isNotNull(), F.struct("label", "method"))
    member = rel["group_member"].groupBy("model", F.col("group_id").alias("id")).agg(_listed(F.col("pos"), _quoted(F.col("node_id"))).alias("memberIds"))
    g = rel["group"].join(member, ["model", "id"], "left").join(of("group"), ["model", "id"], "left")
    group_json = _with(F.to_json(F.struct("id", "name", "description", F.col("parent_group_id").alias("parentGroupId"))), ("memberIds", F.coalesce("memberIds", F.lit("[]"))), ("contract", F.col("contract")))
    f = rel["flow"].join(_step_lists(rel["flow_step"]).withColumnRenamed("flow_id", "id"), ["model", "id"], "left")
    flow_json = _with(F.to_json(F.struct("id", "name", "description")), ("steps", F.coalesce("steps", F.lit("[]"))))
    s = rel["source_map"].groupBy("model", "owner_id").agg(_listed(F.col("pos"), F.to_json(F.struct("pattern", "line", F.col("end_line").alias("endLine"), "command"))).alias("j"))
    entries = F.array_sort(F.collect_list(F.struct("owner_id", "j")))
    mapped = s.groupBy("model").agg(F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_quoted(e["owner_id"]), F.lit(":"), e["j"])), ","), F.lit("}")).alias("sourceMap"))
    parts = {
        "nodes": n.groupBy("model").agg(_listed(F.col("ord"), node_json).alias("nodes")),
        "edges": rel["edge"].groupBy("model").agg(_listed(F.col("ord"), F.to_json(F.struct("id", "source", "target", edge_data.alias("data")))).alias("edges")),
        "sourceMap": mapped,
        "groups": g.groupBy("model").agg(_listed(F.col("ord"), group_json).alias("groups")),
        "flows": f.groupBy("model").agg(_listed(F.col("ord"), flow_json).alias("flows")),
    }
    out = model.select("model", F.to_json(F.struct(F.col("project_path").alias("projectPath"))).alias("head"))
    for part in parts.values():
        out = out.join(part, "model", "left")
    fields = [(name, F.coalesce(name, F.lit("[]")) if name in ("nodes", "edges") else F.col(name)) for name in parts]
    return out.select("model", _with(F.col("head"), *fields).alias("text"))


# What a project's folder of models leaves out of version control, and the marks that go with a model.
PROJECT_IGNORE = "*.baseline.scry\n.implementing\n.sync\n.tmp.*\n"
MARKS = (".implementing", ".sync")


def _put(folder: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for frame in frames:
            for model, text in zip(frame["model"], frame["text"], strict=True):
                draft = f"{base}/.{model}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(draft) as file:
                    file.write((text or "").encode("utf-8"))
                if store.type_name == "local":  # a checksum of the file before would not fit
                    Path(f"{base}/.{model}{ENDING}.crc").unlink(missing_ok=True)
                store.move(draft, f"{base}/{model}{ENDING}")
            yield frame[["model"]]

    return put


def write_documents(docs: DataFrame, folder: str, project: bool = False) -> int:
    """Write (model, text) as one file for each model and tell how many; ``folder`` is a URI or an absolute path.

    Tasks write each text beside its place and move it there in one step, so a
    reader sees the old document or the new one; a task that runs twice writes
    the same. A ``project``'s folder gets an ignore file if it has none. For
    commits over several documents and refusals see ``store``.
    """
    if project:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        if files.get_file_info(f"{base}/.gitignore").type == fs.FileType.NotFound:
            with files.open_output_stream(f"{base}/.gitignore") as file:
                file.write(PROJECT_IGNORE.encode())
    return docs.select("model", "text").mapInPandas(_put(folder), "model string").count()


def _delete(folder: str, marks: tuple[str, ...]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def delete(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        for frame in frames:
            for model in frame["model"]:
                for name in (f"{model}{ENDING}", f"{model}.baseline{ENDING}", *marks):
                    if files.get_file_info(f"{base}/{name}").type == fs.FileType.File:
                        files.delete_file(f"{base}/{name}")
            yield frame

    return delete


def delete_documents(model: DataFrame, folder: str, project: bool = False) -> int:
    """Delete the files of the named models and their baselines, and a ``project``'s marks; what is not there does no harm."""
    return model.select("model").mapInPandas(_delete(folder, MARKS if project else ()), "model string").count()


def snapshot(history: DataFrame | None, docs: DataFrame) -> DataFrame:
    """(model, version, text): the history with one more version of every model whose text changed."""
    if history is None:
        return docs.select("model", F.lit(1).cast("long").alias("version"), "text")
    last = history.groupBy("model").agg(F.max("version").alias("_v"), F.max_by("text", "version").alias("_t"))
    fresh = docs.join(last, "model", "left").where(~F.col("text").eqNullSafe(F.col("_t")))
    return history.unionByName(fresh.select("model", (F.coalesce("_v", F.lit(0)) + 1).alias("version"), "text"))


def restored(history: DataFrame, version: Column) -> DataFrame:
    """(model, text) as of a version; models without one are absent, like a missing baseline."""
    return history.where(F.col("version") <= version).groupBy("model").agg(F.max_by("text", "version").alias("text"))


def attachments(item: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items whose images carry a file name of their content instead of bytes, and (path, data) of the distinct images."""
    name = F.concat(F.sha2("image.data", 256), F.lit("-"), "image.filename")
    light = item.withColumn("image", F.when(F.col("image").isNotNull(), F.struct("image.filename", "image.mimeType", name.alias("path"))))
    return light, item.where("image IS NOT NULL").select(name.alias("path"), F.col("image.data").alias("data")).dropDuplicates(["path"])
