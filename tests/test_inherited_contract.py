"""Contract texts of owners above a node, against a walk up in plain Python."""

import random

from tessella.operators import graph


def test_inherited_texts_by_walking_up(spark, monkeypatch):
    monkeypatch.setattr(graph, "PORTION", 3)  # several copies of each inherited text
    rng = random.Random(6)
    parent = {f"n{k}": f"n{rng.randrange(max(0, k - 12), k)}" if k > 2 else None for k in range(90)}
    items = [("m", f"n{rng.randrange(95)}", rng.choice(["ask", "expect"]), k, rng.choice(["a", "b|c", "", None])) for k in range(70)]
    node = spark.createDataFrame([("m", v, p) for v, p in parent.items()] + [("other", "n1", None)], "model string, id string, parent_id string")
    item = spark.createDataFrame(items, "model string, owner_id string, section string, pos int, text string").repartition(3)
    want = {}
    for v in parent:
        chain, at = [], v
        while at is not None:
            chain.insert(0, at)
            at = parent[at]
        for section in ("ask", "expect"):
            mine = [sorted((pos, text is None, text or "") for _, owner, s, pos, text in items if owner == a and s == section) for a in chain]
            texts = [text for own in mine for _, none, text in own if not none]
            if any(mine):
                want[v, section] = "|".join(texts) if texts else None  # of nulls alone string_agg makes null
    out = graph.inherited_contract(node, item)
    assert {(r.id, r.section): r.texts for r in out.collect()} == want
    assert len(want) > 100 and None in want.values()
    # the long results come from a join and are not moved behind it
    lines = [line.strip(" +-:") for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    assert lines[0].startswith("Project") and lines[1].startswith("Join")
