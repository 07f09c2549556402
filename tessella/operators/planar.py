"""Planar layout of level views as relations: blocks, faces, chords, positions.

A graph is a relation of (model, view, source, target). Its blocks, their faces
and the corners of those are relations too, so that each step below is one
grouped helper or plain joins. Groups are views, or blocks where a step needs no
more than its block; a view holds what one screen shows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.grouped import each, one_by_one
from tessella.lineage import cut, written

from .plane import LEAF_DISTANCE, LEAST_GAP, SHORTEST_EDGE, block_lists, drawing, fanned, in_middle, joined, peeled, positions, ranked, relaxed_all, swollen_all, triangles

VIEW = ["model", "view"]
BLOCK = ["model", "view", "block"]


def pairs(edge: DataFrame) -> DataFrame:
    """(model, view, a, b): each linked pair of a view once, without loops."""
    return _ordered(edge).distinct()


def _ordered(edge: DataFrame) -> DataFrame:
    return edge.where("source <> target").select(*VIEW, F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))


def blocks(edge: DataFrame) -> DataFrame:
    """(model, view, block, a, b): the links of each biconnected block; blocks of a view are numbered by their first link."""

    split = one_by_one(lambda links: [(k, a, b) for k, block in enumerate(block_lists(list(set(links)))) for a, b in block])
    return each(_ordered(edge), VIEW, ["a", "b"], split, "block long, a string, b string")


def block_nodes(block: DataFrame) -> DataFrame:
    """(model, view, block, id): a node of several blocks, a cut node, is in each of them."""
    return block.select(*BLOCK, F.explode(F.array("a", "b")).alias("id")).distinct()


def block_counts(block: DataFrame) -> DataFrame:
    """(model, view, id, n_blocks): cut nodes are those with more than one."""
    return block_nodes(block).groupBy(*VIEW, "id").agg(F.count("*").alias("n_blocks"))


def embedded(block: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces (model, view, block, part, face, place, id) and links that no drawing in the plane takes (model, view, block, a, b).

    A planar block is one part without lost links. From another, links are
    dropped until the rest is planar; the blocks of the rest are its parts.
    """

    def draw(links: list[tuple]) -> list[tuple]:
        parts, lost = drawing(links)
        rows = [(p, f, k, v) for p, faces in enumerate(parts) for f, face in enumerate(faces) for k, v in enumerate(face)]
        return rows + [(-1, n, k, v) for n, link in enumerate(lost) for k, v in enumerate(link)]

    all_ = written(each(block, BLOCK, ["a", "b"], one_by_one(draw), "part int, face int, place int, id string"), "faces")
    ends = all_.where("part < 0").groupBy(*BLOCK, "face").agg(F.min("id").alias("a"), F.max("id").alias("b")).drop("face")
    return all_.where("part >= 0").select(*BLOCK, "part", "face", "place", "id"), ends


def half_edges(face: DataFrame) -> DataFrame:
    """(model, view, block, part, face, id, to, after): each corner of a face as the half-edge that leaves it and the node behind that."""
    w = Window.partitionBy(*BLOCK, "part", "face").orderBy("place")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ring = F.collect_list("id").over(whole)
    at = lambda k: F.element_at(ring, ((F.col("place") + k) % F.size(ring)) + 1)
    return face.select(*BLOCK, "part", "face", "id", at(1).alias("to"), at(2).alias("after"))


def rotations(face: DataFrame) -> DataFrame:
    """(model, view, block, part, id, neighbour, next): around ``id``, ``next`` follows ``neighbour`` in the drawing's sense."""
    return half_edges(face).select(*BLOCK, "part", F.col("to").alias("id"), F.col("id").alias("neighbour"), F.col("after").alias("next"))


def counts(face: DataFrame) -> DataFrame:
    """(model, view, block, part, nodes, links, faces): nodes - links + faces is 2 in every part."""
    return face.groupBy(*BLOCK, "part").agg(F.count_distinct("id").alias("nodes"), (F.count("*") / 2).cast("long").alias("links"), F.count_distinct("face").alias("faces"))


def drawn_counts(edge: DataFrame) -> DataFrame:
    """(model, view, block, part, nodes, links, faces, lost): :func:`counts` of all blocks of a view and the links that each block lost, without its corners as rows."""

    def count(links: list[tuple]) -> list[tuple]:
        rows = []
        for k, block in enumerate(block_lists(list(set(links)))):
            parts, lost = drawing(block)
            rows += [(k, p, len({v for face in faces for v in face}), sum(map(len, faces)) // 2, len(faces), len(lost)) for p, faces in enumerate(parts)]
        return rows

    return each(_ordered(edge), VIEW, ["a", "b"], one_by_one(count), "block long, part int, nodes long, links long, faces long, lost long")


def triangulated(face: DataFrame) -> DataFrame:
    """(model, view, block, part, face, place, id, outer): inner faces cut into triangles by chords that double no link.

    The outer face is the longest (ties: the first) and stays as it is. Of two
    crossing chords of a face one is always new: both can't be links outside it.
    """

    def cut_up(corners: list[tuple]) -> list[tuple]:
        return [(f, k, v, o) for f, (ring, o) in enumerate(triangles(_rings(corners))) for k, v in enumerate(ring)]

    kind = "face int, place int, id string, outer boolean"
    return each(face, [*BLOCK, "part"], ["face", "place", "id"], one_by_one(cut_up), kind).select(*BLOCK, "part", "face", "place", "id", "outer")


def _rings(corners: list[tuple]) -> list[list]:
    """Ids of each face, in order, from its (face, place, id)."""
    rings: dict = {}
    for f, _, v in sorted(corners):
        rings.setdefault(f, []).append(v)
    return list(rings.values())


def drawn_triangles(edge: DataFrame) -> DataFrame:
    """(model, view, block, part, face, place, id, outer): :func:`triangulated` drawings of all blocks of a view, without its corners as rows in between."""

    def cut_up(links: list[tuple]) -> list[tuple]:
        return [
            (b, p, f, k, v, o)
            for b, block in enumerate(block_lists(list(set(links))))
            for p, faces in enumerate(drawing(block)[0])
            for f, (ring, o) in enumerate(triangles(faces))
            for k, v in enumerate(ring)
        ]

    return each(_ordered(edge), VIEW, ["a", "b"], one_by_one(cut_up), "block long, part int, face int, place int, id string, outer boolean")


def barycentric(triangle: DataFrame) -> DataFrame:
    """(model, view, block, id, x, y): outer nodes on a circle, each inner node in the middle of its neighbours.

    Over triangles that double no link and a strictly convex outer face, no two
    links cross. A single link lies flat. ``triangle`` has one part a block.
    """

    def solve(corners: list[tuple]) -> list[tuple]:
        outer = {f: o for f, _, _, o in corners}
        names, at = in_middle(list(zip(_rings([c[:3] for c in corners]), (outer[f] for f in sorted(outer)), strict=True)))
        return [(v, *p) for v, p in zip(names, at.tolist(), strict=True)]

    return each(triangle, BLOCK, ["face", "place", "id", "outer"], one_by_one(solve), "id string, x double, y double")


def stressed(block: DataFrame) -> DataFrame:
    """(model, view, block, id, x, y): blocks that are not planar, by stress on path lengths over all their links."""

    def relax(groups: list[list[tuple]]) -> list[list[tuple]]:
        links = [sorted(g) for g in groups]
        names = [sorted({v for e in g for v in e}) for g in links]
        spots = relaxed_all([(len(n), ranked(n, g)) for n, g in zip(names, links, strict=True)])
        return [[(v, *p) for v, p in zip(n, at.tolist(), strict=True)] for n, at in zip(names, spots, strict=True)]

    return each(block, BLOCK, ["a", "b"], relax, "id string, x double, y double")


def spread(position: DataFrame, block: DataFrame, least: float = SHORTEST_EDGE) -> DataFrame:
    """Positions about each block's middle, scaled up until its shortest link is ``least`` long."""
    end = lambda c: position.select(*BLOCK, F.col("id").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    long = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    scale = block.join(end("a"), [*BLOCK, "a"]).join(end("b"), [*BLOCK, "b"]).where(long > 0.001).groupBy(*BLOCK).agg(F.greatest(F.lit(1.0), least / F.min(long)).alias("_s"))
    middle = position.groupBy(*BLOCK).agg(F.avg("x").alias("_x"), F.avg("y").alias("_y"))
    moved = lambda c: ((F.col(c) - F.col(f"_{c}")) * F.coalesce("_s", F.lit(1.0))).alias(c)
    return position.join(middle, BLOCK).join(scale, BLOCK, "left").select(*BLOCK, "id", moved("x"), moved("y"))


def block_positions(block: DataFrame) -> DataFrame:
    """(model, view, block, id, x, y): each block in a plane of its own, without crossings where it is planar."""
    face, lost = embedded(block)
    bent = lost.select(*BLOCK).distinct()
    flat = barycentric(triangulated(face.join(bent, BLOCK, "left_anti")))
    return spread(flat.unionByName(stressed(block.join(bent, BLOCK, "left_semi"))), block)


def stitched(position: DataFrame, gap: float = LEAST_GAP) -> DataFrame:
    """(model, view, id, x, y): blocks joined at their cut nodes, along the tree that they form.

    The largest block of a connected part stays; every other is moved to the cut
    node that it shares, turned outward and, where a node would come nearer than
    ``gap`` to another, turned further or enlarged: blocks keep their shape.
    Parts stand side by side.
    """

    def join(spots: list[tuple]) -> list[tuple]:
        shape: dict = {}
        for k, v, x, y in sorted(spots):
            shape.setdefault(k, {})[v] = (x, y)
        return [(v, *p) for v, p in sorted(joined(list(shape.values()), gap).items())]

    return each(position, VIEW, ["block", "id", "x", "y"], one_by_one(join), "id string, x double, y double")


def leaf_parents(edge: DataFrame) -> DataFrame:
    """(model, view, id, parent, turn): nodes with one neighbour are taken off, again and again; of a tree one node stays."""

    return each(_ordered(edge), VIEW, ["a", "b"], one_by_one(lambda links: peeled(list(set(links)))), "id string, parent string, turn long")


def leaf_faces(leaf: DataFrame, face: DataFrame) -> DataFrame:
    """(model, view, id, block, part, face): the inner face that a leaf lies in; leaves of nodes on an outer face have none.

    A node's leaves go round its inner faces, larger ones first.
    """
    size = face.groupBy(*BLOCK, "part", "face").agg(F.count("*").alias("sides"))
    first = Window.partitionBy(*BLOCK).orderBy(F.desc("sides"), "part", "face")
    outer = size.where("sides > 2").withColumn("outer", F.row_number().over(first) == 1)
    corner = face.join(outer, [*BLOCK, "part", "face"]).select(*BLOCK, "part", "face", "sides", "outer", F.col("id").alias("parent")).distinct()
    edge_of = corner.where("outer").select(*VIEW, "parent").distinct()
    around = corner.where("NOT outer").join(edge_of, [*VIEW, "parent"], "left_anti")
    w = Window.partitionBy(*VIEW, "parent")
    ranked = around.withColumn("_k", F.row_number().over(w.orderBy(F.desc("sides"), "block", "part", "face")) - 1).withColumn("_n", F.count("*").over(w))
    turns = leaf.withColumn("_i", F.row_number().over(w.orderBy("turn", "id")) - 1)
    picked = turns.join(ranked, [*VIEW, "parent"]).where("_i % _n = _k")
    return picked.select(*VIEW, "id", *BLOCK[2:], "part", "face")


def ballooned(position: DataFrame, block: DataFrame, leaf: DataFrame, face: DataFrame) -> DataFrame:
    """Block positions after faces too tight for their leaves have pushed their corners away.

    Every corner of a face is pushed from the place where a leaf of another
    corner will stand, and every link pulls back to its length before, until
    nothing moves. In a block without crossings a step is shortened until it
    makes none, and the last one is where no step can be made.
    """
    held = leaf_faces(leaf, face).join(leaf.select(*VIEW, "id", "parent"), [*VIEW, "id"]).select(*BLOCK, "part", "face", "parent").distinct()
    tight = held.join(face.select(*BLOCK, "part", "face", F.col("id").alias("corner")), [*BLOCK, "part", "face"]).where("corner <> parent")
    blocks_held = cut(held.select(*BLOCK).distinct())
    row = lambda df, kind, a, b, x, y: df.select(*BLOCK, F.lit(kind).alias("kind"), F.col(a).alias("a"), b.alias("b"), x.alias("x"), y.alias("y"))
    none = F.lit(None).cast("double")
    group = F.concat_ws(" ", "part", "face", "parent")
    rows = row(position, "node", "id", F.lit(None).cast("string"), F.col("x"), F.col("y")).unionByName(row(block, "link", "a", F.col("b"), none, none))
    rows = rows.unionByName(row(tight.withColumn("_g", group), "tight", "corner", F.concat_ws("\x1f", "_g", "parent"), none, none)).join(blocks_held, BLOCK, "left_semi")

    def swell(groups: list[list[tuple]]) -> list[list[tuple]]:
        names, parts = [], []
        for g in groups:
            node = sorted((r[1], r[3], r[4]) for r in g if r[0] == "node")
            names.append([v for v, _, _ in node])
            rank = {v: k for k, v in enumerate(names[-1])}
            faces: dict = {}
            for _, corner, key, _, _ in (r for r in g if r[0] == "tight"):
                faces.setdefault(key, []).append(rank[corner])
            tight = [(rank[key.split("\x1f")[1]], np.array(sorted(corners))) for key, corners in sorted(faces.items())]
            parts.append((np.array([p for _, *p in node]), ranked(names[-1], sorted(r[1:3] for r in g if r[0] == "link")), tight))
        return [[(v, *p) for v, p in zip(n, at.tolist(), strict=True)] for n, at in zip(names, swollen_all(parts), strict=True)]

    moved = each(rows, BLOCK, ["kind", "a", "b", "x", "y"], swell, "id string, x double, y double")
    return position.join(blocks_held, BLOCK, "left_anti").unionByName(moved)


def leaf_directions(edge: DataFrame, leaf: DataFrame) -> DataFrame:
    """(model, view, id, direction) of leaves: ``in`` if an edge goes to the parent, ``out`` if one comes from it, else ``both``."""
    to = edge.select(*VIEW, F.col("source").alias("id"), F.col("target").alias("parent"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    of = edge.select(*VIEW, F.col("target").alias("id"), F.col("source").alias("parent"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    ways = leaf.join(to.unionByName(of), [*VIEW, "id", "parent"]).groupBy(*VIEW, "id").agg(F.max("up").alias("up"), F.max("down").alias("down"))
    return ways.select(*VIEW, "id", F.when(F.col("up") + F.col("down") == 2, "both").when(F.col("up") == 1, "in").otherwise("out").alias("direction"))


def with_leaves(position: DataFrame, leaf: DataFrame, face: DataFrame, direction: DataFrame, gap: float = LEAST_GAP) -> DataFrame:
    """(model, view, id, x, y): positions of the core and of all leaves around it.

    A leaf aims at the middle of its face, or away from the middle of the view,
    and takes the nearest free direction; where none is free it stands further
    away. A tree begins with the node that stays, at (0, 0); around a node in the
    middle, leaves with edges to it stand above, those with edges from it below,
    those with both to the right.
    """
    where = leaf_faces(leaf, face).join(face.select(*BLOCK, "part", "face", F.col("id").alias("corner")), [*BLOCK, "part", "face"])
    spot = position.select(*VIEW, F.col("id").alias("corner"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    aims = where.join(spot, [*VIEW, "corner"]).groupBy(*VIEW, "id").agg(F.avg("_x").alias("x"), F.avg("_y").alias("y"))
    lean = F.when(F.col("direction") == "in", -math.pi / 2).when(F.col("direction") == "out", math.pi / 2).otherwise(0.0).alias("lean")
    rows = position.select(*VIEW, "id", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("turn"), F.lit(0.0).alias("lean"), "x", "y")
    rows = rows.unionByName(leaf.join(aims, [*VIEW, "id"], "left").join(direction, [*VIEW, "id"], "left").select(*VIEW, "id", "parent", "turn", lean, "x", "y"))

    def fan(spots: list[tuple]) -> list[tuple]:
        core = {v: (x, y) for v, above, _, _, x, y in sorted(spots, key=lambda r: r[0]) if above is None}
        leaves = sorted((r for r in spots if r[1] is not None), key=lambda r: -r[2])
        return [(v, *p) for v, p in sorted(fanned(core, [(v, above, lean, *(math.nan if c is None else c for c in p)) for v, above, _, lean, *p in leaves], gap).items())]

    return each(rows, VIEW, ["id", "parent", "turn", "lean", "x", "y"], one_by_one(fan), "id string, x double, y double")


def planar_positions(edge: DataFrame) -> DataFrame:
    """(model, view, id, x, y): all nodes of a view that an edge touches, in cells.

    Leaves are taken off, the blocks of what is left are drawn without crossings
    where that is possible, widened where leaves need room, joined at their cut
    nodes, and the leaves put back: the steps above, for whole views at once.
    """
    ends = edge.where("source <> target").select(*VIEW, "source", "target")
    return each(ends, VIEW, ["source", "target"], positions, "id string, x double, y double")
