"""Blocks, faces, chords and positions against brute force."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tessella.operators import planar

EDGE = "model string, view string, source string, target string"


def connected(nodes, links):
    nodes = set(nodes)
    if not nodes:
        return 0
    n = 0
    while nodes:
        n += 1
        line = [nodes.pop()]
        for v in line:
            fresh = {a + b - v for a, b in links if v in (a, b)} & nodes
            nodes -= fresh
            line += fresh
    return n


def graph(rng, n, m):
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


def flat(rng, n):
    """A random triangulation of the plane: nodes put into triangles."""
    faces = [(0, 1, 2), (0, 1, 2)]
    links = {(0, 1), (0, 2), (1, 2)}
    for v in range(3, n):
        a, b, c = faces.pop(rng.randrange(len(faces)))
        faces += [(a, b, v), (a, c, v), (b, c, v)]
        links |= {(a, v), (b, v), (c, v)}
    return sorted(links)


def subdivided(links, n):
    out = []
    for k, (a, b) in enumerate(links):
        out += [(a, n + k), (b, n + k)]
    return out


FIVE = list(combinations(range(5), 2))
UTILITIES = [(a, b) for a in range(3) for b in range(3, 6)]
RNG = random.Random(4)
PLANAR = {
    **{f"flat{i}": flat(RNG, 4 + 3 * i) for i in range(9)},
    **{f"thin{i}": [e for e in flat(RNG, 25) if RNG.random() < 0.6] for i in range(6)},
    "grid": [(10 * r + c, 10 * r + c + d) for r in range(6) for c in range(6) for d in (1, 10) if c + d % 10 < 6 and (d == 1 or r < 5)],
    "wheel": [(0, k) for k in range(1, 9)] + [(k, k % 8 + 1) for k in range(1, 9)],
    "chain": [(k, k + 1) for k in range(40)],
    "ring": [(k, (k + 1) % 40) for k in range(40)],
    "beads": [e for k in range(8) for e in ((3 * k, 3 * k + 1), (3 * k + 1, 3 * k + 2), (3 * k, 3 * k + 2), (3 * k + 2, 3 * k + 3))],
}
BENT = {
    "five": FIVE, "utilities": UTILITIES, "five_long": subdivided(FIVE, 5), "utilities_long": subdivided(UTILITIES, 6),
    **{f"dense{i}": [(0, 1), *graph(RNG, 9, 40)] for i in range(3)},
}
MIXED = {f"mix{i}": graph(RNG, RNG.randrange(4, 14), RNG.randrange(3, 22)) for i in range(25)}
ALL = PLANAR | BENT | MIXED


def links_of(view):
    return {tuple(sorted(e)) for e in ALL[view]}


@pytest.fixture(scope="module")
def edge(spark):
    rows = [("m", view, str(a), str(b)) for view, links in ALL.items() for a, b in links]
    rows += [("m", view, str(b), str(a)) for view, links in MIXED.items() for a, b in links[:3]] + [("m", "mix0", "1", "1")]
    return spark.createDataFrame(rows, EDGE).repartition(6)


@pytest.fixture(scope="module")
def drawn(edge):
    block = planar.cut(planar.blocks(edge))
    face, lost = planar.embedded(block)
    return block, face, lost


def test_blocks_by_removal(edge, drawn):
    block = drawn[0]
    got = {(r.view, int(r.id)): r.n_blocks for r in planar.block_counts(block).collect()}
    for view in {*MIXED, *BENT, "beads", "ring", "wheel"}:
        links = links_of(view)
        nodes = {v for e in links for v in e}
        for v in nodes:
            rest = [e for e in links if v not in e]
            assert got[view, v] == connected(nodes - {v}, rest) - connected(nodes, links) + 1
    assert sum(n == 2 for (view, _), n in got.items() if view == "chain") == 39
    back = {(r.view, int(r.a), int(r.b)) for r in block.collect()}
    assert {(v, *sorted(e)) for v, a, b in back for e in [(a, b)]} == {(v, *e) for v in ALL for e in links_of(v)}


def test_deep_views_without_recursion():
    chain = [(k, k + 1) for k in range(20_000)]
    assert len(planar.block_lists(chain)) == 20_000
    assert planar.block_lists([*chain, (0, 20_000)]) == [sorted([*chain, (0, 20_000)])]


def test_faces(drawn):
    block, face, lost = drawn
    halves = planar.half_edges(face)
    assert halves.count() == halves.select(*planar.BLOCK, "part", "id", "to").distinct().count()
    assert planar.counts(face).where("nodes - links + faces <> 2").isEmpty()
    # every link is drawn or lost, never both
    passed = halves.select("view", F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct()
    assert passed.unionByName(lost.select("view", "a", "b")).count() == block.count()
    assert {r.view for r in lost.collect()}.isdisjoint(PLANAR)
    n_lost = {r.view: r["count"] for r in lost.groupBy("view").count().collect()}
    assert n_lost["five"] == n_lost["utilities"] == n_lost["five_long"] == n_lost["utilities_long"] == 1
    assert all(n_lost[v] >= len(links_of(v)) - 3 * 9 + 6 for v in BENT if v.startswith("dense"))


def test_rotations_are_rings(drawn):
    by = {}
    for r in planar.rotations(drawn[1]).collect():
        by.setdefault((r.view, r.block, r.part, r.id), {})[r.neighbour] = r.next
    for ring in by.values():
        seen, at = [], next(iter(ring))
        while at not in seen:
            seen.append(at)
            at = ring[at]
        assert len(seen) == len(ring)


def test_triangles(drawn):
    tri = planar.cut(planar.triangulated(drawn[1]))
    sides = tri.groupBy(*planar.BLOCK, "part", "face", "outer").count()
    assert sides.where("NOT outer AND count <> 3").isEmpty()
    assert planar.counts(tri).where("nodes - links + faces <> 2").isEmpty()
    halves = planar.half_edges(tri)
    assert halves.count() == halves.select(*planar.BLOCK, "part", "id", "to").distinct().count()
    missing = planar.half_edges(drawn[1]).select("view", "block", "id", "to").exceptAll(halves.select("view", "block", "id", "to"))
    assert missing.isEmpty()


def crossing(p, q, r, s):
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return side(p, q, r) * side(p, q, s) < -1e-12 and side(r, s, p) * side(r, s, q) < -1e-12


def test_planar_blocks_have_no_crossing(drawn):
    block, face, lost = drawn
    bent = {(r.view, r.block) for r in lost.collect()}
    at = {}
    for r in planar.block_positions(block).collect():
        at.setdefault((r.view, r.block), {})[r.id] = (r.x, r.y)
    links = {}
    for r in block.collect():
        links.setdefault((r.view, r.block), []).append((r.a, r.b))
    assert set(at) == set(links)
    for key, spots in at.items():
        assert min(math.dist(spots[a], spots[b]) for a, b in links[key]) >= planar.SHORTEST_EDGE - 1e-6 or key in bent
        if key in bent or key[0] == "chain":
            continue
        for (a, b), (c, d) in combinations(links[key], 2):
            assert len({a, b, c, d}) < 4 or not crossing(spots[a], spots[b], spots[c], spots[d])


def test_stitched_blocks_keep_their_shape(drawn):
    block = drawn[0].where("view <> 'chain'")
    shape, at = {}, {}
    for r in planar.block_positions(block).collect():
        shape.setdefault((r.view, r.block), {})[r.id] = (r.x, r.y)
    for r in planar.stitched(planar.block_positions(block)).collect():
        at[r.view, r.id] = (r.x, r.y)
    of = {}
    for (view, _), spots in shape.items():
        ids = sorted(spots)
        # one scale for all distances of a block
        ratio = [math.dist(at[view, a], at[view, b]) / math.dist(spots[a], spots[b]) for a, b in combinations(ids, 2) if math.dist(spots[a], spots[b]) > 1e-6]
        assert max(ratio) - min(ratio) < 1e-6
        for v in ids:
            of.setdefault((view, v), set()).add((view, _))
    for (v, a), (w, b) in combinations(sorted(at), 2):
        if v == w and not of[v, a] & of[w, b]:
            assert math.dist(at[v, a], at[w, b]) >= planar.LEAST_GAP - 1e-6


def test_all_nodes_of_a_view_are_placed_apart(spark, edge):
    some = edge.where("view <> 'chain'").unionByName(spark.createDataFrame([("m", "star", "hub", f"l{i}") for i in range(30)] + [("m", "two", "a", "b"), ("m", "two", "c", "d")], EDGE))
    got = {(r.view, r.id): (r.x, r.y) for r in planar.planar_positions(some).collect()}
    ends = some.where("source <> target").select("view", F.explode(F.array("source", "target")).alias("id")).distinct()
    assert set(got) == {(r.view, r.id) for r in ends.collect()}
    leaf = {(r.view, r.id) for r in planar.leaf_parents(some).collect()}
    for (v, a), (w, b) in combinations(sorted(got), 2):
        if v == w and ((v, a) in leaf or (w, b) in leaf):
            assert math.dist(got[v, a], got[w, b]) >= planar.LEAST_GAP - 1e-6


def test_leaves_go_round_inner_faces(spark):
    # a wheel: the hub is on no outer face and has leaves, a rim node has one too
    rows = [("m", "w", a, b) for a, b in [("h", "r0"), ("h", "r1"), ("h", "r2"), ("h", "r3"), ("r0", "r1"), ("r1", "r2"), ("r2", "r3"), ("r3", "r0"), ("h", "x"), ("h", "y"), ("r0", "z")]]
    edge = spark.createDataFrame(rows, EDGE)
    leaf = planar.leaf_parents(edge)
    core = edge.join(leaf.select("model", "view", F.col("id").alias("target")), ["model", "view", "target"], "left_anti")
    face, _ = planar.embedded(planar.blocks(core))
    got = {r.id: r.face for r in planar.leaf_faces(leaf, face).collect()}
    outer = {r.face for r in face.groupBy("face").count().where("count = 4").collect()}
    assert set(got) <= {"x", "y", "z"} and len(outer) == 1
    assert got.get("x") != got.get("y") and "z" not in got and not set(got.values()) & outer


def test_tight_faces_swell_without_crossings(spark):
    # leaves of the inner nodes of a fine triangulation
    rng = random.Random(12)
    links = flat(rng, 16)
    rows = [("m", "t", str(a), str(b)) for a, b in links] + [("m", "t", str(v), f"leaf{v}") for v in range(3, 16)]
    edge = spark.createDataFrame(rows, EDGE)
    leaf = planar.cut(planar.leaf_parents(edge))
    core = edge.join(leaf.select("model", "view", F.col("id").alias("target")), ["model", "view", "target"], "left_anti")
    block = planar.cut(planar.blocks(core))
    face, _ = planar.embedded(block)
    before = planar.cut(planar.barycentric(planar.triangulated(face)))  # not spread yet, so its inner faces are tight
    after = {r.id: (r.x, r.y) for r in planar.ballooned(before, block, leaf, face).collect()}
    old = {r.id: (r.x, r.y) for r in before.collect()}
    assert set(after) == set(old) and max(math.dist(after[v], old[v]) for v in old) > 0.01
    ends = [(r.a, r.b) for r in block.collect()]
    for (a, b), (c, d) in combinations(ends, 2):
        assert len({a, b, c, d}) < 4 or not crossing(after[a], after[b], after[c], after[d])
    # with room for its leaves, nothing moves
    wide = planar.cut(planar.spread(before, block, 60.0))
    still = {r.id: (r.x, r.y) for r in planar.ballooned(wide, block, leaf, face).collect()}
    assert all(math.dist(still[r.id], (r.x, r.y)) < 1e-6 for r in wide.collect())


def test_directions_of_leaves(spark):
    edge = spark.createDataFrame([("m", "s", "a", "hub"), ("m", "s", "hub", "b"), ("m", "s", "c", "hub"), ("m", "s", "hub", "c")], EDGE)
    leaf = planar.leaf_parents(edge)
    assert {r.id: r.direction for r in planar.leaf_directions(edge, leaf).collect()} == {"a": "in", "b": "out", "c": "both"}
    at = {r.id: (r.x, r.y) for r in planar.planar_positions(edge).collect()}
    x, y = at["hub"]
    # the first leaf to be placed is in the middle of nothing and so stands on its own side
    assert any(math.isclose(math.dist(at[v], (x, y)), planar.LEAF_DISTANCE) for v in "abc") and (at["c"][0] > x or at["b"][1] > y or at["a"][1] < y)


def test_no_edges(spark):
    assert planar.planar_positions(spark.createDataFrame([], EDGE)).count() == 0
