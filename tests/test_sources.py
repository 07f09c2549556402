"""Model documents and project trees: hand-written goldens."""

import base64
import json

import pytest

from tessella.sources import model_files, trees

DOCUMENT = {
    "projectPath": "/work/shop",
    "surprise": {"ignored": True},
    "nodes": [
        {"id": "node-0", "type": "c4", "position": {"x": 1.5, "y": 2.0}, "data": {"name": "Shop", "kind": "system", "status": "unheard of", "notes": "one\ntwo\n"}},
        {
            "id": "node-1",
            "parentId": "node-0",
            "data": {
                "name": "Web",
                "description": "pages",
                "kind": "container",
                "status": "proposed",
                "contract": {"always": ["is fast", {"text": "is safe", "passed": True, "url": "https://x.example"}], "never": [{"text": "fails", "image": {"filename": "a.png", "mimeType": "image/png", "data": base64.b64encode(b"png").decode()}}]},
                "notes": ["kept", "in order"],
                "properties": [{"label": "port"}],
            },
        },
        {"id": "node-2", "type": "unit", "parentId": "node-1", "data": {"name": "pay", "kind": "unit"}},
        {"id": "node-3", "data": {"name": "Ann", "kind": "person", "status": "implemented"}},
        {"id": "node-4", "data": {"name": "old"}},
    ],
    "edges": [{"id": "e1", "source": "node-3", "target": "node-0", "data": {"label": "buys"}}, {"id": "e1", "source": "node-0", "target": "node-3"}],
    "sourceMap": {"node-1": [{"pattern": "src/**"}, {"pattern": "web/a.ts", "line": 3, "endLine": 9}], "scenario-0": [{"pattern": "flow.ts", "command": "run"}]},
    "groups": [{"id": "group-0", "name": "Front", "memberIds": ["node-1"], "contract": {"ask": ["who pays"]}}],
    "scenarios": [
        {
            "id": "scenario-0",
            "name": "Buy",
            "steps": [
                {"id": "step-0", "description": "look"},
                {"id": "step-1", "label": "choose", "branches": [{"condition": "rich", "steps": [{"id": "step-2", "description": "pay", "branches": [{"steps": [{"id": "step-4"}]}]}]}, {"condition": "poor", "steps": [{"id": "step-3"}]}]},
            ],
            "transitions": [{"source": "step-0", "target": "step-1"}],
        }
    ],
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("models")
    (out / "shop.scry").write_text(json.dumps(DOCUMENT))
    (out / "shop.baseline.scry").write_text("{}")
    (out / "Zoo.scry").write_text(json.dumps({"nodes": [], "edges": []}))
    (out / "broken.scry").write_text("{nodes")
    return str(out)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return model_files.read_documents(spark, folder).where("model = 'shop'")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_models_are_listed_in_byte_order_without_baselines(spark, folder):
    assert [r.model for r in model_files.list_models(spark, folder).collect()] == ["Zoo", "broken", "shop"]


def test_broken_documents_have_no_nodes(spark, folder):
    assert {r.model for r in model_files.nodes(model_files.read_documents(spark, folder)).collect()} == {"shop"}


def test_nodes_are_decoded_leniently(docs):
    got = rows(model_files.nodes(docs).orderBy("ord"), "ord", "id", "parent_id", "kind", "node_type", "status", "description", "x")
    assert got == [
        (0, "node-0", None, "system", "c4", None, "", 1.5),
        (1, "node-1", "node-0", "container", "c4", "proposed", "pages", None),
        (2, "node-2", "node-1", "operation", "operation", None, "", None),
        (3, "node-3", None, "person", "c4", "implemented", "", None),
        (4, "node-4", None, "system", "c4", None, "", None),
    ]


def test_contract_items_are_texts_or_objects(docs):
    got = rows(model_files.contract_items(docs).orderBy("owner_type", "section", "pos"), "owner_type", "owner_id", "section", "pos", "text", "passed", "url", "image.filename")
    assert got == [
        ("group", "group-0", "ask", 0, "who pays", None, None, None),
        ("node", "node-1", "expect", 0, "is fast", None, None, None),
        ("node", "node-1", "expect", 1, "is safe", True, "https://x.example", None),
        ("node", "node-1", "never", 0, "fails", None, None, "a.png"),
    ]


def test_notes_properties_and_source_map(docs):
    assert sorted(rows(model_files.notes(docs), "node_id", "pos", "text")) == [("node-0", 0, "one"), ("node-0", 1, "two"), ("node-1", 0, "kept"), ("node-1", 1, "in order")]
    assert rows(model_files.properties(docs), "node_id", "label", "description") == [("node-1", "port", "")]
    got = sorted(rows(model_files.source_map(docs), "owner_id", "pos", "pattern", "line", "end_line", "command"))
    assert got == [("node-1", 0, "src/**", None, None, None), ("node-1", 1, "web/a.ts", 3, 9, None), ("scenario-0", 0, "flow.ts", None, None, "run")]


def test_nested_steps_become_an_adjacency_list(docs):
    flow, step, moves = model_files.flows(docs)
    assert rows(flow, "id", "name") == [("scenario-0", "Buy")]
    assert rows(step.orderBy("step_id"), "step_id", "parent_step_id", "branch_idx", "pos", "condition", "description", "label") == [
        ("step-0", None, None, 0, None, "look", None),
        ("step-1", None, None, 1, None, None, "choose"),
        ("step-2", "step-1", 0, 0, "rich", "pay", None),
        ("step-3", "step-1", 1, 0, "poor", None, None),
        ("step-4", "step-2", 0, 0, "", None, None),
    ]
    assert rows(moves, "flow_id", "source", "target") == [("scenario-0", "step-0", "step-1")]


def test_display_form(docs):
    node, edge, lost = model_files.for_display(model_files.nodes(docs), model_files.edges(docs))
    assert rows(node.where("id = 'node-3'"), "status") == [(None,)]
    assert rows(edge, "id", "source") == [("e1", "node-3")]
    assert rows(lost, "needs_layout") == [(True,)]


def test_written_documents_read_back_alike(spark, docs, tmp_path):
    before = model_files.relations(docs)
    text = model_files.documents(before, model_files.project_of(docs))
    target = str(tmp_path / "out")
    model_files.write_documents(text, target)
    model_files.write_documents(text, target)  # replaces
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["shop.scry"]
    again = model_files.read_documents(spark, target)
    after = model_files.relations(again)
    for name in before:
        if name != "flow_transition":  # read for older files, never written
            assert sorted(map(str, before[name].collect())) == sorted(map(str, after[name].collect())), name
    assert rows(model_files.project_of(again), "project_path") == [("/work/shop",)]


def test_blank_model(spark):
    (row,) = model_files.blank(spark, "new", "/p").collect()
    assert json.loads(row.text) == {"nodes": [], "edges": [], "projectPath": "/p"}


def test_registry_and_lookup(spark, folder):
    docs = model_files.read_documents(spark, folder)
    registry = spark.createDataFrame([("/work/shop",), ("/work/bank",)], "project_path string")
    got = sorted(rows(model_files.all_models(docs, registry), "ref", "name", "is_local"))
    assert got == [("Zoo", "Zoo", False), ("broken", "broken", False), ("project:/work/bank", "bank", True), ("shop", "shop", True)]
    wanted = spark.createDataFrame([("/work/shop",), ("/work/bank",), ("/nowhere",)], "project_path string")
    local = spark.createDataFrame([("/work/bank",)], "project_path string")
    assert sorted(rows(model_files.resolved(wanted, local, docs), "project_path", "ref")) == [("/nowhere", None), ("/work/bank", "project:/work/bank"), ("/work/shop", "shop")]
    assert sorted(rows(model_files.registered(registry, wanted, local), "project_path")) == [("/work/bank",)]


def test_snapshots(spark):
    first = spark.createDataFrame([("a", "1"), ("b", "1")], "model string, text string")
    second = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", "1")], "model string, text string")
    history = model_files.snapshot(model_files.snapshot(None, first), second)
    assert sorted(rows(history, "model", "version", "text")) == [("a", 1, "1"), ("a", 2, "2"), ("b", 1, "1"), ("c", 1, "1")]
    from pyspark.sql import functions as F

    assert sorted(rows(model_files.restored(history, F.lit(1)), "model", "text")) == [("a", "1"), ("b", "1"), ("c", "1")]


def test_attachments_leave_the_items(docs):
    light, files = model_files.attachments(model_files.contract_items(docs))
    ((path, data),) = rows(files, "path", "data")
    assert bytes(data) == b"png" and path.endswith("-a.png")
    assert rows(light.where("image IS NOT NULL"), "image.path") == [(path,)]


def test_project_tree(spark, tmp_path):
    for name in ("package.json", "src/app/main.ts", "src/Dockerfile", "docs/guide/intro.md", "node_modules/x/package.json", "README.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    files = trees.inventory(spark, str(tmp_path))
    assert sorted(r.path for r in files.collect()) == ["README.md", "docs/guide/intro.md", "package.json", "src/Dockerfile", "src/app/main.ts"]
    assert rows(trees.is_codebase(files), "is_codebase") == [(True,)]
    got = sorted(rows(trees.tree_lines(files), "path", "is_dir", "hidden"))
    # src/app has nothing annotated and lies below the context depth
    assert got == [("", True, 1), ("docs", True, 1), ("package.json", False, None), ("src", True, 1), ("src/Dockerfile", False, None)]
