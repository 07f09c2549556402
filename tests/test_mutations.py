"""Mutations of a small model, step edits, and small functions that no query covers."""

import pytest
from pyspark.sql import functions as F

from tessella import schema
from tessella.functions import predicates, text
from tessella.operators import diff, drift, flows, mutate
from tessella.streaming import events

FLOW = "model string, ord long, id string, name string, description string"


def nodes(spark, *rows):
    """(id, parent, kind) rows in order."""
    full = [("m", k, i, p, "c4", kind, i.upper(), None, None, False, None, None, None, 1.0, 2.0) for k, (i, p, kind) in enumerate(rows)]
    return spark.createDataFrame(full, schema.NODE)


def edges(spark, *pairs):
    return spark.createDataFrame([("m", k, f"edge-{a}-{b}", a, b, None, None) for k, (a, b) in enumerate(pairs)], schema.EDGE)


@pytest.fixture
def model(spark):
    n = nodes(spark, ("node-0", None, "system"), ("node-1", "node-0", "container"), ("node-2", "node-1", "component"), ("node-3", "node-1", "component"), ("node-9", None, "person"))
    return n, edges(spark, ("node-2", "node-3"), ("node-9", "node-0"))


def ids(df, column="id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_set_model_keeps_the_first_edge_and_drops_positions(spark, model):
    n, e = model
    twice = e.unionByName(e.withColumn("label", F.lit("later")).withColumn("ord", F.col("ord") + 10))
    flat, kept = mutate.set_model(n, twice)
    assert "x" not in flat.columns and flat.count() == 5
    assert [r.label for r in kept.collect()] == [None, None]
    with pytest.raises(mutate.Rejected, match="duplicate node id"):
        mutate.set_model(n.unionByName(n.limit(1)), e)


def test_add_nodes_numbers_them_and_checks_parents(spark, model):
    n, _ = model
    after = mutate.add_nodes(n, nodes(spark, ("x", "node-1", "component"), ("y", None, "person")).withColumn("status", F.lit("proposed")))
    fresh = {r.id: (r.kind, r.status) for r in after.collect() if r.ord > 4}
    assert fresh == {"node-10": ("component", "proposed"), "node-11": ("person", None)}
    with pytest.raises(mutate.Rejected):
        mutate.add_nodes(n, nodes(spark, ("x", "node-9", "component")))


def test_delete_nodes_takes_what_is_below_and_leaves_orphans_to_be_told(spark, model):
    n, e = model
    left, links = mutate.delete_nodes(n, e, ["node-1"])
    assert ids(left) == ["node-0", "node-9"] and ids(links) == ["edge-node-9-node-0"]
    source_map = spark.createDataFrame([("m", "node-2", 0, "a/**", None, None, None), ("m", "node-0", 0, "b", None, None, None)], schema.SOURCE_MAP)
    member = spark.createDataFrame([("m", "g", 0, "node-3")], schema.GROUP_MEMBER)
    assert sorted((r.relation, r.id) for r in mutate.orphans(left, source_map, member).collect()) == [("group_member", "node-3"), ("source_map", "node-2")]
    with pytest.raises(mutate.Rejected, match="unknown nodes: node-77"):
        mutate.delete_nodes(n, e, ["node-77"])


def test_set_node_replaces_a_subtree(spark, model):
    n, e = model
    after, links = mutate.set_node(n, e, "node-1", nodes(spark, ("new", "node-1", "component")), edges(spark, ("new", "node-0")))
    assert ids(after) == ["new", "node-0", "node-1", "node-9"] and ids(links) == ["edge-new-node-0", "edge-node-9-node-0"]
    with pytest.raises(mutate.Rejected, match="id in use"):
        mutate.set_node(n, e, "node-1", nodes(spark, ("node-9", "node-1", "component")), e.limit(0))


def test_update_nodes_patches_in_order_and_guards_status(spark, model):
    n, _ = model
    items = spark.createDataFrame([("m", "node", "node-2", "expect", 0, "works", False, None, None)], schema.CONTRACT_ITEM)
    member = spark.createDataFrame([], schema.GROUP_MEMBER)
    patch = lambda *rows: spark.createDataFrame(rows, "model string, id string, seq int, reason string, name string, status string")
    after = mutate.update_nodes(n, patch(("m", "node-2", 1, None, "First", None), ("m", "node-2", 2, "done", "Second", "implemented"), ("m", "node-3", 1, "?", None, "odd")), items, member)
    got = {r.id: (r.name, r.status) for r in after.collect()}
    assert got["node-2"] == ("Second", "implemented") and got["node-3"] == ("NODE-3", None) and got["node-0"] == ("NODE-0", None)
    for rows, why in (([("m", "node-2", 1, " ", None, "implemented")], "needs a reason"), ([("m", "node-2", 1, "ok", None, "verified")], "unmet expectations"), ([("m", "gone", 1, None, "x", None)], "unknown node")):
        with pytest.raises(mutate.Rejected, match=why):
            mutate.update_nodes(n, patch(*rows), items, member)


def test_edges_are_added_patched_and_deleted(spark, model):
    n, e = model
    more = mutate.add_edges(e, edges(spark, ("node-3", "node-2")), n)
    assert "edge-node-3-node-2" in ids(more)
    patches = spark.createDataFrame([("m", "edge-node-3-node-2", "calls", None)], "model string, id string, label string, method string")
    assert {r.id: r.label for r in mutate.update_edges(more, patches).collect()}["edge-node-3-node-2"] == "calls"
    assert ids(mutate.delete_edges(more, ["edge-node-2-node-3"])) == ["edge-node-3-node-2", "edge-node-9-node-0"]
    for bad, why in ((edges(spark, ("node-2", "node-3")), "edge exists"), (edges(spark, ("node-2", "gone")), "unknown edge end"), (edges(spark, ("node-3", "node-2")).withColumn("label", F.lit("l" * 31)), "label too long")):
        with pytest.raises(mutate.Rejected, match=why):
            mutate.add_edges(e, bad, n)


def test_flows_groups_and_source_maps(spark, model):
    n, _ = model
    flow = spark.createDataFrame([("m", 0, "f", "F", None)], FLOW)
    steps = spark.createDataFrame([("m", "f", "s1", None, None, 0, None, None, "old")], schema.FLOW_STEP)
    new = spark.createDataFrame([("m", "f", "s2", None, None, 0, None, None, "label")], schema.FLOW_STEP)
    flows_, after = mutate.set_flows(flow, steps, flow.withColumn("name", F.lit("G")), new)
    assert [r.name for r in flows_.collect()] == ["G"] and [(r.step_id, r.description, r.label) for r in after.collect()] == [("s2", "label", None)]
    assert [d.count() for d in mutate.delete_flow(flow, steps, "f")] == [0, 0]
    group = spark.createDataFrame([("m", 0, "g", "G", None, None), ("m", 1, "h", "H", None, "g")], schema.GROUP)
    member = spark.createDataFrame([("m", "g", 0, "node-2"), ("m", "h", 0, "node-3")], schema.GROUP_MEMBER)
    taken = spark.createDataFrame([("m", "k", 0, "node-3")], schema.GROUP_MEMBER)
    groups, members = mutate.set_groups(group, member, spark.createDataFrame([("m", 2, "k", "K", None, None)], schema.GROUP), taken, n)
    assert ids(groups) == ["g", "k"] and sorted((r.group_id, r.node_id) for r in members.collect()) == [("g", "node-2"), ("k", "node-3")]
    rest, _ = mutate.delete_group(group, member, "g", adopt=True)
    assert [(r.id, r.parent_group_id) for r in rest.collect()] == [("h", None)]
    source_map = spark.createDataFrame([("m", "node-2", 0, "a", None, None, None)], schema.SOURCE_MAP)
    assert mutate.update_source_map(source_map, "node-2", source_map.limit(0), n, flow).isEmpty()
    with pytest.raises(mutate.Rejected, match="unknown owner"):
        mutate.update_source_map(source_map, "gone", source_map, n, flow)


def test_steps_move_flatten_and_sort(spark):
    rows = [("m", "f", s, p, b, k, None, None, None) for s, p, b, k in (("a", None, None, 0), ("b", None, None, 1), ("c", None, None, 2), ("b1", "b", 0, 0), ("b2", "b", 0, 1))]
    step = spark.createDataFrame(rows, schema.FLOW_STEP)
    top = lambda df: [r.step_id for r in df.where("parent_step_id IS NULL").orderBy("pos").collect()]
    assert top(flows.move_step(step, "f", "c", 0)) == ["c", "a", "b"]
    assert top(flows.flatten_branch(step, "f", "b", 0)) == ["a", "b", "b1", "b2", "c"]
    assert ids(flows.delete_step(step, "f", "b"), "step_id") == ["a", "c"]
    assert [r.siblings for r in flows.siblings(step, "b1", "b2").collect()] == [True] and [r.siblings for r in flows.siblings(step, "a", "b1").collect()] == [False]
    arrows = spark.createDataFrame([("m", "f", 0, "c", "a"), ("m", "f", 1, "b1", "b2"), ("m", "f", 2, "b2", "b1")], "model string, flow_id string, pos int, source string, target string")
    placed = [r.step_id for r in flows.topological(step, arrows).orderBy("place").collect()]
    assert placed.index("c") < placed.index("a") and placed[-2:] == ["b1", "b2"]  # a cycle comes last, in its own order


def test_small_functions(spark):
    kinds = spark.createDataFrame([("member", "verified", "pipe", "project:/w"), ("system", "odd", "odd", "name")], "k string, s string, h string, r string")
    got = kinds.select(
        predicates.parsed_kind(F.col("k")), predicates.parsed_status(F.col("s")), predicates.parsed_shape(F.col("h")), predicates.model_path(predicates.model_ref(F.col("r")), "/home", ".models", ".json")
    )
    assert [tuple(r) for r in got.collect()] == [("operation", "verified", "pipe", "/w/.models/model.json"), ("system", None, None, "/home/name.json")]
    with pytest.raises(Exception, match="unknown kind"):
        kinds.select(predicates.parsed_kind(F.lit("thing"))).collect()
    texts = spark.createDataFrame([(1, 'said: [{"a": 1}, {"b": 2}] done'), (2, 'x [{"a": 1}, {"b": ] {"c": 3}]'), (3, "none")], "id int, t string")
    assert sorted((r.id, r.item.replace(" ", "")) for r in text.salvaged_array(texts, "t").collect())[:2] == [(1, '{"a":1}'), (1, '{"b":2}')]
    markers = spark.createDataFrame([("a", 1, 2, 3), ("b", None, 2, 3), ("c", None, None, 3)], "model string, baseline_ns long, legacy_mtime_ns long, model_mtime_ns long")
    assert {r.model: r.baseline_ns for r in drift.drift_baseline(markers).collect()} == {"a": 1, "b": 2, "c": 3}
    history = spark.createDataFrame([("m", v, c) for v, c in enumerate("aabbbcd")], "model string, version int, content string")
    assert sorted(r.version for r in diff.retained(history, keep=3).collect()) == [2, 5, 6]
    ticks = spark.createDataFrame([("m", k, t) for k, t in (("a", 0), ("b", 30), ("c", 200))], "model string, path string, s int").withColumn("ts", F.timestamp_seconds("s"))
    want = [("b", 2), ("c", 1)]
    assert sorted((r.path, r.events) for r in events.debounced_by_model(ticks, "60 seconds").collect()) == want
    assert sorted((r.path, r.events) for r in events.debounced_log(ticks, 60, chunk_seconds=20).collect()) == want


def test_compact_strip(spark):
    n = nodes(spark, ("a", None, "system")).withColumn("notes", F.array(F.lit("n"))).withColumn("sources", F.array().cast("array<string>")).withColumn("technology", F.lit(""))
    (row,) = text.compact(n).collect()
    assert row[0] == "m" and '"technology"' not in row[1] and '"notes"' not in row[1] and '"sources"' not in row[1] and '"x"' not in row[1] and '"id":"a"' in row[1]
