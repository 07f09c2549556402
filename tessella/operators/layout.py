"""Layout of level views: bundles, connection points and placement.

A view holds what one screen shows, so the sequential parts (greedy choices
where each depends on those before) run as one group for each (model, view).
Everything that is a plain aggregation stays in DataFrame functions.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.lineage import cut

# Default size of a node, cell of the placement grid, distance of a magnet, penalties in squared pixels, corner window in degrees.
WIDTH, HEIGHT = 180.0, 160.0
CELL_WIDTH, CELL_HEIGHT = 300, 180
MAGNET_OFFSET = 60.0
CONGESTION, AXIS = 160.0**2, 60.0**2
CORNER_WINDOW = 15.0
HUB = 3


def centres(node: DataFrame) -> DataFrame:
    """(model, view, id, cx, cy, w, h) of placed nodes; missing sizes take the default."""
    w, h = F.coalesce("width", F.lit(WIDTH)), F.coalesce("height", F.lit(HEIGHT))
    return node.select("model", "view", "id", (F.col("x") + w / 2).alias("cx"), (F.col("y") + h / 2).alias("cy"), w.alias("w"), h.alias("h"))


def magnet(angle: Column) -> Column:
    """Side whose window of 60 degrees holds the angle (degrees, y downward); null in the gaps between them."""
    return F.when((angle >= -120) & (angle < -60), "top").when((angle >= -30) & (angle < 30), "right").when((angle >= 60) & (angle < 120), "bottom").when((angle >= 150) | (angle < -150), "left")


def edge_bundles(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(model, view, edge_id, hub, side, mx, my): edges that run through a magnet of a hub.

    ``node`` has (model, view, ord, id, x, y, width, height), ``edge`` (model,
    view, ord, id, source, target). A hub has at least three edge ends. Hubs
    claim in the order in which edges name them; an edge claimed by a hub is
    not counted by later ones, so the claims of a view are made in one group.
    """
    ends = edge.select(
        "model", "view", "ord", F.col("id").alias("edge_id"),
        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("source").alias("hub"), F.col("target").alias("other")), F.struct(F.lit(1).alias("side"), F.col("target").alias("hub"), F.col("source").alias("other")))).alias("e"),
    ).select("model", "view", "ord", "edge_id", "e.*")
    w = Window.partitionBy("model", "view", "hub")
    hubs = ends.withColumn("n", F.count("*").over(w)).withColumn("first", F.min(F.struct("ord", "side")).over(w)).where(F.col("n") >= HUB)
    c = centres(node)
    here = c.select("model", "view", F.col("id").alias("hub"), F.col("cx").alias("hx"), F.col("cy").alias("hy"), "w", "h")
    there = c.select("model", "view", F.col("id").alias("other"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    angle = F.degrees(F.atan2(F.col("oy") - F.col("hy"), F.col("ox") - F.col("hx")))
    aimed = hubs.join(here, ["model", "view", "hub"]).join(there, ["model", "view", "other"]).withColumn("magnet", magnet(angle)).where("magnet IS NOT NULL")

    def claim(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        out = []
        pdf = pdf.sort_values(["first_ord", "first_side", "ord", "side"], kind="stable")
        for hub, own in pdf.groupby("hub", sort=False):
            free = own[~own.edge_id.isin(taken)]
            for side, bundle in free.groupby("magnet", sort=False):
                if len(bundle) > 1:
                    out += [(e, hub, side) for e in bundle.edge_id]
            taken |= {e for e, h, _ in out if h == hub}
        return pd.DataFrame(out, columns=["edge_id", "hub", "side"]).assign(model=pdf.model.iloc[0], view=pdf["view"].iloc[0])

    rows = aimed.select("model", "view", "ord", "side", "edge_id", "hub", "magnet", F.col("first.ord").alias("first_ord"), F.col("first.side").alias("first_side"))
    claimed = rows.groupBy("model", "view").applyInPandas(claim, "edge_id string, hub string, side string, model string, view string")
    dx = F.when(F.col("side") == "right", 1).when(F.col("side") == "left", -1).otherwise(0)
    dy = F.when(F.col("side") == "bottom", 1).when(F.col("side") == "top", -1).otherwise(0)
    return claimed.join(here, ["model", "view", "hub"]).select(
        "model", "view", "edge_id", "hub", "side",
        (F.col("hx") + dx * (F.col("w") / 2 + MAGNET_OFFSET)).alias("mx"),
        (F.col("hy") + dy * (F.col("h") / 2 + MAGNET_OFFSET)).alias("my"),
    )


# Connection points by their place on a node (shares of width and height); corners come after sides.
POINTS = (
    ("top", 0.5, 0.0), ("bottom", 0.5, 1.0), ("left", 0.0, 0.5), ("right", 1.0, 0.5),
    ("top-left", 0.0, 0.0), ("top-right", 1.0, 0.0), ("bottom-left", 0.0, 1.0), ("bottom-right", 1.0, 1.0),
)
#: A direction counts as a main axis where one difference is longer by this share, and the longer one has this many pixels.
LEAN, NEAR = 0.3, 40.0


def point_pairs(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(model, view, ord, id, source, target, far, pairs): for every edge with both ends, the pairs of points it may take, with their costs.

    A side may always be taken. A corner may be where the nodes lie along a
    diagonal, to within ``CORNER_WINDOW`` degrees, and it faces the other node.
    A pair costs its squared length, and ``AXIS`` times the lean of the main
    axis for each of its points that lies across that axis.
    """
    c = centres(node)
    end = lambda key, p: c.select("model", "view", F.col("id").alias(key), *[F.col(k).alias(f"{p}_{k}") for k in ("cx", "cy", "w", "h")])
    rows = edge.join(end("source", "s"), ["model", "view", "source"]).join(end("target", "t"), ["model", "view", "target"])
    rows = rows.withColumn("dx", F.col("t_cx") - F.col("s_cx")).withColumn("dy", F.col("t_cy") - F.col("s_cy"))
    wide, high = F.abs("dx"), F.abs("dy")
    longest = F.greatest(wide, high)
    lean = F.when((longest >= NEAR) & (F.abs(wide - high) >= LEAN * longest), F.abs(wide - high) / longest).otherwise(0.0)
    rows = rows.withColumn("lean", lean).withColumn("flat", wide >= high).withColumn("diagonal", F.abs(F.degrees(F.atan2(high, wide)) - 45) <= CORNER_WINDOW)
    table = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("name"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, (n, x, y) in enumerate(POINTS)])

    def open_to(p: Column, dx: Column, dy: Column) -> Column:
        corner = (p["x"] != 0.5) & (p["y"] != 0.5)
        return ~corner | (F.col("diagonal") & ((p["x"] == 1.0) == (dx > 0)) & ((p["y"] == 1.0) == (dy > 0)))

    def across(p: Column) -> Column:
        return F.when(F.when(F.col("flat"), p["x"] == 0.5).otherwise(p["y"] == 0.5), AXIS * F.col("lean")).otherwise(0.0)

    def pair(p: Column, q: Column) -> Column:
        gap = lambda axis, size, d: F.col(d) + (q[axis] - 0.5) * F.col(f"t_{size}") - (p[axis] - 0.5) * F.col(f"s_{size}")
        length = F.pow(gap("x", "w", "dx"), F.lit(2.0)) + F.pow(gap("y", "h", "dy"), F.lit(2.0))
        return F.struct((length + across(p) + across(q)).alias("cost"), p["rank"].alias("p"), q["rank"].alias("q"), p["name"].alias("at"), q["name"].alias("to"))

    froms = F.filter(table, lambda p: open_to(p, F.col("dx"), F.col("dy")))
    tos = F.filter(table, lambda q: open_to(q, -F.col("dx"), -F.col("dy")))
    pairs = F.sort_array(F.flatten(F.transform(froms, lambda p: F.transform(tos, lambda q: pair(p, q)))))
    far = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    return rows.select("model", "view", "ord", "id", "source", "target", far.alias("far"), pairs.alias("pairs"))


def connection_points(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(model, view, edge_id, source_point, target_point): the points that each edge of a view ends at.

    Edges settle one after the other, near ones first (ties: by ``ord``): each
    takes the pair of least cost, where ``CONGESTION`` is added for every settled
    edge at either point (ties: the order of ``POINTS``). An edge whose reverse
    has settled takes the reverse's points instead. Edges with a missing end get
    none. A choice depends on those before, so a view is one group; its pairs
    and their costs are columns.
    """

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        load: Counter[tuple[str, str]] = Counter()
        settled: dict[tuple[str, str], dict] = {}
        out = []
        for e in pdf.sort_values(["far", "ord"], kind="stable").to_dict("records"):
            back = settled.get((e["target"], e["source"]))
            if back:
                best = {"at": back["to"], "to": back["at"]}
            else:
                busy = [x["cost"] + CONGESTION * (load[e["source"], x["at"]] + load[e["target"], x["to"]]) for x in e["pairs"]]
                best = min(zip(busy, e["pairs"]), key=lambda x: (x[0], x[1]["p"], x[1]["q"]))[1]
                settled[e["source"], e["target"]] = best
            load.update([(e["source"], best["at"]), (e["target"], best["to"])])
            out.append((e["id"], best["at"], best["to"]))
        return pd.DataFrame(out, columns=["edge_id", "source_point", "target_point"]).assign(model=pdf.model.iloc[0], view=pdf["view"].iloc[0])

    return point_pairs(node, edge).groupBy("model", "view").applyInPandas(settle, "edge_id string, source_point string, target_point string, model string, view string")


def isolates(node: DataFrame, edge: DataFrame) -> DataFrame:
    """Nodes of a view that no edge inside the view touches."""
    ids = node.select("model", "view", "id")
    inside = edge.join(ids.withColumnRenamed("id", "source"), ["model", "view", "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), ["model", "view", "target"], "left_semi")
    touched = inside.select("model", "view", F.explode(F.array("source", "target")).alias("id"))
    return node.join(touched, ["model", "view", "id"], "left_anti")


def relaxed(n: int, pairs: np.ndarray, rounds: int = 200, eps: float = 1e-3) -> np.ndarray:
    """Positions of a connected graph by stress majorisation on path lengths, from a circle."""
    if n == 1:
        return np.zeros((1, 2))
    dist = np.full((n, n), np.inf)
    np.fill_diagonal(dist, 0)
    dist[pairs[:, 0], pairs[:, 1]] = dist[pairs[:, 1], pairs[:, 0]] = 1
    for k in range(n):
        dist = np.minimum(dist, dist[:, k : k + 1] + dist[k : k + 1])
    with np.errstate(divide="ignore"):
        weight = np.where(dist > 0, 1 / dist**2, 0)
    lap = np.diag(weight.sum(axis=1)) - weight
    inverse = np.linalg.pinv(lap)
    turn = 2 * np.pi * np.arange(n) / n
    at = np.stack([np.cos(turn), np.sin(turn)], axis=1) * max(1.0, n / 6)
    for _ in range(rounds):
        gap = np.linalg.norm(at[:, None] - at[None], axis=2)
        ratio = np.where(gap > 1e-9, weight * dist / np.maximum(gap, 1e-9), 0)
        pull = np.diag(ratio.sum(axis=1)) - ratio
        now = inverse @ (pull @ at)
        if np.abs(now - at).max() < eps:
            return now
        at = now
    return at


def _cells(at: np.ndarray) -> np.ndarray:
    """Whole grid cells near the positions, no two alike."""
    want = np.round(at - at.min(axis=0)).astype(int)
    used: set[tuple[int, int]] = set()
    out = []
    for x, y in want.tolist():
        reach = 0
        while True:
            ring = [(x + i, y + j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if max(abs(i), abs(j)) == reach]
            free = [c for c in ring if c not in used]
            if free:
                cell = min(free, key=lambda c: ((c[0] - x) ** 2 + (c[1] - y) ** 2, c))
                break
            reach += 1
        used.add(cell)
        out.append(cell)
    cells = np.array(out)
    return cells - cells.min(axis=0)


def placed(node: DataFrame, edge: DataFrame) -> DataFrame:
    """(model, view, id, x, y): full relayout of each view.

    Connected parts are relaxed one by one to whole cells and set side by side,
    largest first; nodes without edges fill rows below. The reference's planar
    embedding is replaced by stress relaxation, so positions differ while the
    cell size, the packing of isolates and the order stay.
    """
    ids = node.select("model", "view", "id")
    inside = edge.join(ids.withColumnRenamed("id", "source"), ["model", "view", "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), ["model", "view", "target"], "left_semi")
    rows = node.select("model", "view", "ord", "id", F.lit(None).cast("string").alias("target")).unionByName(inside.select("model", "view", "ord", F.col("source").alias("id"), "target"))

    def arrange(pdf: pd.DataFrame) -> pd.DataFrame:
        names = list(dict.fromkeys(pdf[pdf.target.isna()].sort_values(["ord", "id"]).id))
        rank = {v: i for i, v in enumerate(names)}
        links = {(min(rank[a], rank[b]), max(rank[a], rank[b])) for a, b in pdf.loc[pdf.target.notna(), ["id", "target"]].itertuples(index=False) if a != b}
        near: dict[int, list[int]] = {}
        for a, b in sorted(links):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        parts, seen = [], set()
        for start in sorted(near):
            if start in seen:
                continue
            part, seen = [start], seen | {start}
            for v in part:
                fresh = [u for u in near[v] if u not in seen]
                seen.update(fresh)
                part += fresh
            parts.append(sorted(part))
        cell: dict[int, tuple[int, int]] = {}
        offset = 0
        for part in sorted(parts, key=lambda p: (-len(p), p)):
            local = {v: i for i, v in enumerate(part)}
            pairs = np.array([(local[a], local[b]) for a, b in sorted(links) if a in local])
            spots = _cells(relaxed(len(part), pairs))
            for v, (x, y) in zip(part, spots.tolist()):
                cell[v] = (x + offset, y)
            offset += int(spots[:, 0].max()) + 2
        alone = [v for v in range(len(names)) if v not in near]
        last_row = max((y for _, y in cell.values()), default=-1)
        last_column = max((x for x, _ in cell.values()), default=0)
        columns = max(1, min(last_column + 1, math.ceil(math.sqrt(len(alone) or 1))))
        for i, v in enumerate(alone):
            cell[v] = (i % columns, last_row + 2 + 2 * (i // columns))
        out = [(names[v], float(x * CELL_WIDTH), float(y * CELL_HEIGHT)) for v, (x, y) in sorted(cell.items())]
        return pd.DataFrame(out, columns=["id", "x", "y"]).assign(model=pdf.model.iloc[0], view=pdf["view"].iloc[0])

    return rows.groupBy("model", "view").applyInPandas(arrange, "id string, x double, y double, model string, view string")


def leaves_stripped(edge: DataFrame) -> DataFrame:
    """Edges of each view's core: nodes with one neighbour are taken off until none is left.

    Each round is one aggregation over all views; the rounds follow the longest
    chain, and views are small.
    """
    now = edge.where("source <> target").select("model", "view", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    size = now.count()
    while size:
        ends = now.select("model", "view", F.explode(F.array("a", "b")).alias("id"))
        inner = ends.groupBy("model", "view", "id").agg(F.count("*").alias("n")).where("n > 1").select("model", "view", "id")
        now = now.join(inner.withColumnRenamed("id", "a"), ["model", "view", "a"], "left_semi").join(inner.withColumnRenamed("id", "b"), ["model", "view", "b"], "left_semi")
        now = cut(now.select("model", "view", "a", "b"))
        left = now.count()
        if left == size:
            break
        size = left
    return now
