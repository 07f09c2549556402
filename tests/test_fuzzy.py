"""Loose names against a nested loop."""

import random

from tessella.operators import fuzzy


def made():
    rng = random.Random(8)
    word = lambda k: "".join(rng.choice("abéB ") for _ in range(k))
    nodes = [("m", f"n{i}", word(rng.choice([1, 2, 3, 4, 6, 9])), i) for i in range(120)] + [("k", "n0", "", 0), ("k", "n1", "tail", 1), ("x", "n7", "common name", 3)]
    hints = [("m", i, rng.choice([word(rng.choice([0, 1, 2, 3, 5, 8, 12])), f"n{rng.randrange(150)}", nodes[rng.randrange(120)][2].upper()])) for i in range(200)]
    return nodes, hints + [("k", 1, "anything"), ("k", 2, ""), ("x", 3, "NAME"), ("x", 4, "a common name here"), ("none", 5, "abc"), ("x", 6, None)]


def expected(nodes, hints):
    out = {}
    for model, k, name in hints:
        mine = sorted((n for n in nodes if n[0] == model), key=lambda n: n[3])
        if name is None:
            continue
        low = name.lower()
        tests = {1: lambda n: n[1] == name, 3: lambda n: n[2] == name, 4: lambda n: n[2].lower() == low, 5: lambda n: low in n[2].lower() or n[2].lower() in low}  # noqa: B023
        for tier, fits in tests.items():
            if got := next((n[1] for n in mine if fits(n)), None):
                out[model, k] = (got, tier)
                break
    return out


def test_equals_a_nested_loop(spark):
    nodes, hints = made()
    got = fuzzy.resolve(spark.createDataFrame(hints, "model string, k int, name string"), spark.createDataFrame(nodes, "model string, id string, name string, ord int"))
    assert {(r.model, r.k): (r.id, r.tier) for r in got.collect()} == expected(nodes, hints)
    assert got.count() == len({(r.model, r.k) for r in got.collect()})


def test_no_nested_loop(spark):
    nodes, hints = made()
    got = fuzzy.resolve(spark.createDataFrame(hints, "model string, k int, name string"), spark.createDataFrame(nodes, "model string, id string, name string, ord int"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
