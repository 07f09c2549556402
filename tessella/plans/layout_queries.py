"""Planar layout of views: one for each customer, of the suppliers in its orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import planar

from .registry import query

#: Neighbouring lines of a customer's orders, their suppliers folded to few nodes, so that views differ in size and density.
LINKS = """SELECT DISTINCT concat('v', CAST(o_custkey AS STRING)) AS view, concat('n', CAST(a.l_suppkey % (6 + o_custkey % 25) AS STRING)) AS source, concat('n', CAST(b.l_suppkey % (6 + o_custkey % 25) AS STRING)) AS target
 FROM {orders} JOIN {lineitem} a ON a.l_orderkey = o_orderkey JOIN {lineitem} b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"""


def view_edges(f):
    tables = {t: f._source(t) for t in ("orders", "lineitem")}
    return f.spark.sql(LINKS, **tables).withColumn("model", F.lit("main"))


@query("l11_blocks", "links AS (" + LINKS.format(orders="orders", lineitem="lineitem") + """),
both_ways AS (SELECT view, source AS a, target AS b FROM links WHERE source <> target UNION SELECT view, target, source FROM links WHERE source <> target),
reach(view, gone, began, node) AS (SELECT view, a, b, b FROM both_ways UNION SELECT r.view, r.gone, r.began, e.b FROM reach r JOIN both_ways e ON e.view = r.view AND e.a = r.node AND e.b <> r.gone),
sides AS (SELECT view, gone, began, min(node) AS side FROM reach GROUP BY view, gone, began)
SELECT view, gone AS id, count(DISTINCT side) AS n_blocks FROM sides GROUP BY view, gone""")
def l11_blocks(f):
    """Blocks that hold a node: as many as the parts that its removal leaves of what it hangs together."""
    return planar.block_counts(planar.blocks(view_edges(f))).select("view", "id", "n_blocks")


@query("l11_faces", None)
def l11_faces(f):
    return planar.drawn_counts(view_edges(f)).select("view", "block", "part", "nodes", "links", "faces", "lost")


@query("l11_triangles", None)
def l11_triangles(f):
    return planar.drawn_triangles(view_edges(f)).select("view", "block", "part", "face", "place", "id", "outer")


@query("l12_positions", None)
def l12_positions(f):
    return planar.planar_positions(view_edges(f)).select("view", "id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
