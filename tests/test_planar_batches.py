"""Planar layout of many small views: whole views in a batch, with the same results as step by step."""

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import layout, planar, plane
from tessella.plans import catalog

TABLES = Path("/root/testdata/sf0.001")
EDGE = "model string, view string, source string, target string"


@pytest.fixture(scope="module")
def edge(spark):
    rng = random.Random(9)
    rows = []
    for k in range(60):
        n = rng.randrange(2, 13)
        rows += [("m" if k % 3 else "o", f"v{k % 50}", f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(rng.randrange(1, 34))]
    return planar.cut(spark.createDataFrame(rows, EDGE).repartition(5))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_of_whole_views(edge):
    face, lost = planar.embedded(planar.blocks(edge))
    left_out = lost.groupBy(*planar.BLOCK).agg(F.count("*").alias("lost"))
    want = planar.counts(face).join(left_out, planar.BLOCK, "left").fillna(0, ["lost"])
    got = planar.drawn_counts(edge)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert want.where("lost > 0").count() > 3


def test_triangles_of_whole_views(edge):
    want = planar.triangulated(planar.embedded(planar.blocks(edge))[0])
    got = planar.drawn_triangles(edge)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_positions_of_whole_views(edge):
    links = planar.cut(planar.pairs(edge)).select(*planar.VIEW, F.col("a").alias("source"), F.col("b").alias("target"))
    leaf = planar.cut(planar.leaf_parents(links))
    gone = leaf.select(*planar.VIEW, F.col("id").alias("source"))
    core = links.join(gone, [*planar.VIEW, "source"], "left_anti").join(gone.withColumnRenamed("source", "target"), [*planar.VIEW, "target"], "left_anti")
    block = planar.cut(planar.blocks(core))
    face, _ = planar.embedded(block)
    swollen = planar.ballooned(planar.cut(planar.block_positions(block)), block, leaf, face)
    want = {tuple(r)[:3]: (r.x, r.y) for r in planar.with_leaves(planar.stitched(swollen), leaf, face, planar.leaf_directions(edge, leaf)).collect()}
    got = {tuple(r)[:3]: (r.x, r.y) for r in planar.planar_positions(edge).collect()}
    assert set(got) == set(want) and not leaf.isEmpty()
    assert max(math.dist(got[k], want[k]) for k in want) < 1e-6


def test_blocks_relax_and_swell_together_as_alone():
    rng = random.Random(3)
    graphs, tight = [], []
    for n in (5, 6, 9, 9, 12, 14, 4):
        links = np.array([(k, (k + 1) % n) for k in range(n)] + [(a, b) for a in range(n) for b in range(a + 2, n) if b - a < n - 1 and rng.random() < 0.3])
        graphs.append((n, links))
        ring = np.array([(1.2 * math.cos(k), 1.2 * math.sin(k)) for k in (2 * math.pi * k / n for k in range(n))])
        tight.append((ring, links, [(0, np.arange(1, n - 1)), (2, np.array([0, 1, 3]))]))
    for one, all_ in zip(graphs, plane.relaxed_all(graphs), strict=True):
        assert np.abs(layout.relaxed(*one) - all_).max() < 1e-6
    for one, all_ in zip(tight, plane.swollen_all(tight), strict=True):
        assert np.abs(plane.swollen_all([one])[0] - all_).max() < 1e-6
        assert np.abs(one[0] - all_).max() > 0.01


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
def test_positions_share_batches(spark):
    assert "FlatMapGroupsInPandas" not in plan(catalog.queries()["l12_positions"](spark, str(TABLES)))


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
def test_triangles_share_batches(spark):
    assert "FlatMapGroupsInPandas" not in plan(catalog.queries()["l11_triangles"](spark, str(TABLES)))


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
def test_faces_share_batches(spark):
    # a batch for each view or block took 12 ms
    assert "FlatMapGroupsInPandas" not in plan(catalog.queries()["l11_faces"](spark, str(TABLES)))
