"""One view at a time: blocks, drawings in the plane, triangles and places, on plain lists and arrays.

In drawings, node sets are bits of an integer and nodes are numbered in the order of their ids.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np

# Node box with its margin in cells of 300 by 180, spread of the shortest edge, distance and least gap of leaves in cells.
NODE_CELL = math.hypot((180 + 80) / 300, (160 + 80) / 180)
SHORTEST_EDGE = 1.2 * NODE_CELL
LEAF_DISTANCE, LEAST_GAP = 1.8, 1.4
# Clearance of a leaf from a face's other corners, push and pull, step, rounds and the move that ends them.
CLEARANCE, PUSH, PULL, STEP, ROUNDS, STILL = 1.6, 0.5, 0.5, 0.15, 500, 0.0005


def near_lists(links: list[tuple]) -> dict:
    near: dict = {}
    for a, b in links:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    return near


def block_lists(links: list[tuple]) -> list[list[tuple]]:
    """The links of each biconnected block, from low points of a depth-first walk without recursion."""
    near = near_lists(sorted(links))
    seen: dict = {}
    low: dict = {}
    begin: dict = {}
    out, trail = [], []
    for root in sorted(near):
        if root in seen:
            continue
        seen[root] = low[root] = len(seen)
        walk = [(root, None, iter(near[root]))]
        while walk:
            v, above, rest = walk[-1]
            u = next(rest, None)
            if u is None:
                walk.pop()
                if above is not None:
                    low[above] = min(low[above], low[v])
                    if low[v] >= seen[above]:
                        out.append([(min(e), max(e)) for e in trail[begin[v] :]])
                        del trail[begin[v] :]
            elif u not in seen:
                seen[u] = low[u] = len(seen)
                begin[u] = len(trail)
                trail.append((v, u))
                walk.append((u, v, iter(near[u])))
            elif u != above and seen[u] < seen[v]:
                trail.append((v, u))
                low[v] = min(low[v], seen[u])
    return sorted(sorted(b) for b in out)


def _places(bits: int) -> list[int]:
    out = []
    while bits:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out


def _set(nodes: list[int]) -> int:
    out = 0
    for v in nodes:
        out |= 1 << v
    return out


def _path(near: list[int], start: int, inside: int, ends: int) -> list[int]:
    """A shortest path from ``start`` through one or more nodes of ``inside`` to one of ``ends``."""
    back, line = {}, [start]
    for v in line:
        hit = near[v] & ends
        if hit and v != start:
            path = [(hit & -hit).bit_length() - 1, v]
            while v != start:
                v = back[v]
                path.append(v)
            return path[::-1]
        fresh = near[v] & inside
        inside ^= fresh
        for u in _places(fresh):
            back[u] = v
            line.append(u)
    return []


def _pieces(near: list[int], inside: int) -> list[tuple[int, int]]:
    """(nodes, neighbours) of each connected piece of ``inside``."""
    out = []
    while inside:
        piece = edge = inside & -inside
        beside = 0
        while edge:
            reach = 0
            for v in _places(edge):
                reach |= near[v]
            beside |= reach
            edge = reach & inside & ~piece
            piece |= edge
        inside &= ~piece
        out.append((piece, beside))
    return out


def _drawn(near: list[int]) -> tuple[list[list[int]] | None, tuple[int, int] | None]:
    """:func:`face_lists` of a block of more than one link by its nodes' neighbours.

    What is not drawn is kept as [order, inner nodes, fixed nodes, faces that
    hold these]. The order is the number of such faces, then links before pieces
    and both by their nodes. A drawn path changes two faces only, and what it
    cuts free can lie in no other.
    """
    n = len(near)
    step = 2 * n * n
    first = near[0] & -near[0]
    cycle = _path(near, 0, (1 << n) - 2 & ~first, first)
    faces = [cycle, cycle[::-1]]
    drawn = _set(cycle)
    free = list(near)  # neighbours over links that are not drawn
    for a, b in zip(cycle, cycle[1:] + cycle[:1], strict=True):
        free[a] ^= 1 << b
        free[b] ^= 1 << a
    rest = [[2 * step + a * n + b, 0, 1 << a | 1 << b, 3] for a in cycle for b in _places(free[a] & drawn & -2 << a)]
    rest += [[2 * step + n * n + (piece & -piece).bit_length(), piece, beside & drawn, 3] for piece, beside in _pieces(near, (1 << n) - 1 & ~drawn)]
    while rest:
        best = min(rest)
        rest.remove(best)
        _, inner, fixed, spots = best
        low = fixed & -fixed
        start = low.bit_length() - 1
        if not spots:
            return None, (start, (near[start] & (inner or fixed)).bit_length() - 1)
        path = _path(near, start, inner, fixed ^ low) if inner else [start, fixed.bit_length() - 1]
        spot, new = spots & -spots, 1 << len(faces)
        face = faces[k := spot.bit_length() - 1]
        at = face.index(start)
        face = face[at:] + face[:at]
        to = face.index(path[-1])
        one, two = face[: to + 1] + path[-2:0:-1], face[to:] + path[:-1]
        faces[k] = one
        faces.append(two)
        off_one, off_two = ~_set(one), ~_set(two)
        for part in rest:
            if part[3] & spot:
                if not part[2] & off_two:
                    part[3] |= new
                    part[0] += step
                if part[2] & off_one:
                    part[3] ^= spot
                    part[0] -= step
        if not inner:
            continue
        fresh = _set(path[1:-1])
        drawn |= fresh
        for a, b in zip(path, path[1:], strict=False):
            free[a] ^= 1 << b
            free[b] ^= 1 << a
        loose = [(a * n + b, 0, 1 << a | 1 << b) for v in path[1:-1] for u in _places(free[v] & drawn & ~(fresh & (1 << v) - 1)) for a, b in [(min(u, v), max(u, v))]]
        loose += [(n * n + (piece & -piece).bit_length(), piece, beside & drawn) for piece, beside in _pieces(near, inner & ~fresh)]
        for order, piece, fixed in loose:
            spots = (0 if fixed & off_one else spot) | (0 if fixed & off_two else new)
            rest.append([spots.bit_count() * step + order, piece, fixed, spots])
    return faces, None


def face_lists(links: list[tuple]) -> tuple[list[list] | None, tuple | None]:
    """(faces, None) of a planar block, (None, a link that found no face) of another.

    A cycle is drawn first. Of what is not drawn, the part with the fewest faces
    that hold all its fixed nodes gets a path drawn through one of them, which
    splits that face in two; a part without such a face proves the block not
    planar. All faces are walked in one sense, so each link is passed once in
    each direction.
    """
    if len(links) == 1:
        return [list(links[0])], None
    names = sorted({v for e in links for v in e})
    rank = {v: k for k, v in enumerate(names)}
    near = [0] * len(names)
    for a, b in links:
        near[rank[a]] |= 1 << rank[b]
        near[rank[b]] |= 1 << rank[a]
    faces, bad = _drawn(near)
    if bad is not None:
        return None, (names[min(bad)], names[max(bad)])
    return [[names[v] for v in f] for f in faces], None


def drawing(block: list[tuple]) -> tuple[list[list[list]], list[tuple]]:
    """(faces of each part, links that no drawing in the plane takes) of a block.

    A planar block is one part without lost links. From another, links are
    dropped until the rest is planar; the blocks of the rest are its parts. Only
    the part that loses a link is taken apart and drawn again.
    """
    parts, lost = [(sorted(block), *face_lists(block))], []
    while (k := next((k for k, (_, _, bad) in enumerate(parts) if bad is not None), None)) is not None:
        links, _, bad = parts.pop(k)
        lost.append(bad)
        parts = sorted(parts + [(part, *face_lists(part)) for part in block_lists([e for e in links if e != bad])], key=lambda p: p[0])
    return [faces for _, faces, _ in parts], lost


def triangles(rings: list[list]) -> list[tuple[list, bool]]:
    """(face, is it the outer one): inner faces cut into triangles by chords that double no link, the outer face first.

    The outer face is the longest (ties: the first) and stays as it is. Of two
    crossing chords of a face one is always new: both can't be links outside it.
    """
    outer = max(range(len(rings)), key=lambda k: (len(rings[k]), -k))
    links = {(a, b) if a < b else (b, a) for r in rings for a, b in zip(r, r[1:] + r[:1], strict=True)}
    out = [(rings[outer], True)]
    for ring in rings[:outer] + rings[outer + 1 :]:
        while len(ring) > 3:
            a, b = ring[0], ring[2]
            chord = (a, b) if a < b else (b, a)
            if chord in links:
                ring = ring[1:] + ring[:1]
                continue
            links.add(chord)
            out.append((ring[:3], False))
            ring = ring[:1] + ring[2:]
        out.append((ring, False))
    return out


def peeled(links: list[tuple]) -> list[tuple]:
    """(node, parent, turn): nodes with one neighbour are taken off, again and again; of a tree one node stays."""
    near = {v: set(us) for v, us in near_lists(links).items()}
    line, rows = deque(sorted(v for v in near if len(near[v]) == 1)), []
    while line:
        v = line.popleft()
        if len(near[v]) != 1:
            continue
        (above,) = near.pop(v)
        near[above].discard(v)
        rows.append((v, above, len(rows)))
        if len(near[above]) == 1:
            line.append(above)
        near[v] = set()
    return rows


def ranked(names: list, links: list[tuple]) -> np.ndarray:
    rank = {v: k for k, v in enumerate(names)}
    return np.array([(rank[a], rank[b]) for a, b in links])


def in_middle(faces: list[tuple[list, bool]]) -> tuple[list, np.ndarray]:
    """(nodes, places) over the :func:`triangles` of a block: outer nodes on a circle, each inner node in the middle of its neighbours."""
    (outer, _), *rest = sorted(faces, key=lambda f: not f[1])
    names = outer + sorted({v for ring, _ in rest for v in ring}.difference(outer))
    n, fixed = len(names), len(outer)
    if fixed == 2:
        return names, np.array([(0.0, 0.0), (2.0, 0.0)])
    turn = 2 * np.pi * np.arange(fixed) / fixed - np.pi / 2
    at = np.zeros((n, 2))
    at[:fixed] = max(2.0, 0.4 * n) * np.stack([np.cos(turn), np.sin(turn)], axis=1)
    if n > fixed:
        rank = {v: k for k, v in enumerate(names)}
        links = np.zeros((n, n))
        for ring, _ in faces:
            for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
                links[rank[a], rank[b]] = links[rank[b], rank[a]] = 1
        pull = np.diag(links.sum(axis=1)) - links
        at[fixed:] = np.linalg.solve(pull[fixed:, fixed:], links[fixed:, :fixed] @ at[:fixed])
    return names, at


def relaxed_all(graphs: list[tuple[int, np.ndarray]], rounds: int = 200, eps: float = 1e-3) -> list[np.ndarray]:
    """``layout.relaxed`` of many connected graphs (nodes, pairs): those of about one size take their rounds together, filled up with nodes that nothing pulls."""
    out: list = [None] * len(graphs)
    sizes: dict = {}
    for k, (n, _) in enumerate(graphs):
        sizes.setdefault(-(-n // 4) * 4, []).append(k)
    for n, which in sizes.items():
        dist = np.full((len(which), n, n), np.inf)
        at = np.zeros((len(which), n, 2))
        for g, k in enumerate(which):
            own, pairs = graphs[k]
            dist[g, pairs[:, 0], pairs[:, 1]] = dist[g, pairs[:, 1], pairs[:, 0]] = 1
            turn = 2 * np.pi * np.arange(own) / own
            at[g, :own] = np.stack([np.cos(turn), np.sin(turn)], axis=1) * max(1.0, own / 6)
        dist[:, range(n), range(n)] = 0
        for k in range(n):
            dist = np.minimum(dist, dist[:, :, k : k + 1] + dist[:, k : k + 1])
        weight = np.where((dist > 0) & np.isfinite(dist), 1 / np.maximum(dist, 1) ** 2, 0)
        lap = -weight
        lap[:, range(n), range(n)] = weight.sum(axis=2)
        inverse = np.linalg.pinv(lap)
        aim = weight * np.where(weight > 0, dist, 0)
        live = np.array(which)
        for _ in range(rounds):
            x, y = at[..., 0], at[..., 1]
            gap = np.sqrt((x[:, :, None] - x[:, None]) ** 2 + (y[:, :, None] - y[:, None]) ** 2)
            ratio = np.where(gap > 1e-9, aim / np.maximum(gap, 1e-9), 0)
            now = inverse @ (at * ratio.sum(axis=2)[..., None] - ratio @ at)
            still = np.abs(now - at).max(axis=(1, 2)) < eps
            at = now
            if still.any():
                for k, spots in zip(live[still], now[still], strict=True):
                    out[k] = spots[: graphs[k][0]]
                live, at, aim, inverse = live[~still], at[~still], aim[~still], inverse[~still]
                if not len(live):
                    break
        for k, spots in zip(live, at, strict=True):
            out[k] = spots[: graphs[k][0]]
    return out


def widened(at: np.ndarray, links: np.ndarray, least: float) -> np.ndarray:
    """Places about their middle, scaled up until the shortest link is ``least`` long."""
    span = at[links[:, 0]] - at[links[:, 1]]
    long = np.hypot(span[:, 0], span[:, 1])
    long = long[long > 0.001]
    return (at - at.mean(axis=0)) * (max(1.0, least / long.min()) if len(long) else 1.0)


def faces_of_leaves(leaves: list[tuple], drawings: list[list[list[list]]]) -> dict:
    """{leaf: (block, part, face)}: the inner face that a leaf lies in; leaves of nodes on an outer face have none.

    A node's leaves go round its inner faces, larger ones first.
    """
    around: dict = {}
    edge_of: set = set()
    for b, parts in enumerate(drawings):
        sized = sorted((-len(face), p, f) for p, faces in enumerate(parts) for f, face in enumerate(faces) if len(face) > 2)
        for k, (sides, p, f) in enumerate(sized):
            if k == 0:
                edge_of.update(parts[p][f])
            else:
                for v in parts[p][f]:
                    around.setdefault(v, []).append((sides, b, p, f))
    out, begun = {}, {}
    for v, above, _ in leaves:  # in order of their turns
        if above in around and above not in edge_of:
            k = begun[above] = begun.get(above, -1) + 1
            spots = sorted(around[above])
            out[v] = spots[k % len(spots)][1:]
    return out


def _apart(links: np.ndarray) -> np.ndarray:
    """(p, q, r, s): ends of each two links without a common end."""
    one, two = np.triu_indices(len(links), 1)
    both = np.concatenate([links[one], links[two]], axis=1)
    return both[(both[:, :2, None] != both[:, None, 2:]).all(axis=(1, 2))]


def _crossing(ends: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Does each pair of links cross."""
    p, q, r, s = ends
    px, py, rx, ry = x[p], y[p], x[r], y[r]
    ux, uy, wx, wy, ax, ay = x[q] - px, y[q] - py, x[s] - rx, y[s] - ry, rx - px, ry - py
    one = (ux * ay - uy * ax) * (ux * (y[s] - py) - uy * (x[s] - px))
    two = (wy * ax - wx * ay) * (wx * (y[q] - ry) - wy * (x[q] - rx))
    return (one < 0) & (two < 0)


def swollen_all(blocks: list[tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]]) -> list[np.ndarray]:
    """Places of blocks (places, links, tight) after faces too tight for their leaves have pushed their corners away; ``tight`` has a leaf's parent and the other corners of its face.

    Every corner of a face is pushed from the place where a leaf of another
    corner will stand, and every link pulls back to its length before, until
    nothing moves. In a block without crossings a step is shortened until it
    makes none, and the last one is where no step can be made. All blocks take
    their rounds together, as stretches of the same arrays.
    """
    out: list = [None] * len(blocks)
    if not blocks:
        return out
    many = lambda rows, width: np.concatenate([np.reshape(r, (-1, width)) for r in rows]).T
    first = np.cumsum([0, *(len(at) for at, _, _ in blocks)])
    faces = [(b, first[b] + parent, first[b] + corners) for b, (_, _, tight) in enumerate(blocks) for parent, corners in tight]
    at = np.concatenate([b[0] for b in blocks])
    x, y = at.T.copy()
    of = np.repeat(np.arange(len(blocks)), np.diff(first))
    a, b = many([first[k] + links for k, (_, links, _) in enumerate(blocks)], 2)
    parent = np.array([p for _, p, _ in faces], int)
    corner, face = np.concatenate([c for _, _, c in faces]), np.repeat(np.arange(len(faces)), [len(c) for _, _, c in faces])
    ends = many([first[k] + _apart(links) for k, (_, links, _) in enumerate(blocks)], 4)
    bent = np.bincount(of[ends[0]][_crossing(ends, x, y)], minlength=len(blocks)) > 0
    ends = ends[:, ~bent[of[ends[0]]]]
    natural = np.hypot(x[b] - x[a], y[b] - y[a])
    name = np.arange(len(blocks))
    for turn in range(ROUNDS):
        n, n_faces, n_blocks = len(x), len(parent), len(name)
        sides = np.maximum(np.bincount(face, minlength=n_faces), 1)
        aim_x, aim_y = (np.bincount(face, c[corner], n_faces) / sides - c[parent] for c in (x, y))
        far = np.hypot(aim_x, aim_y)
        some = np.where(far < 0.001, 1, far)
        away_x, away_y = (c[corner] - (c[parent] + LEAF_DISTANCE * aim / some)[face] for c, aim in ((x, aim_x), (y, aim_y)))
        dist = np.maximum(np.hypot(away_x, away_y), 1e-9)
        push = np.where(far < 0.001, 0, 1)[face] * np.maximum(CLEARANCE - dist, 0) * PUSH / dist
        span_x, span_y = x[b] - x[a], y[b] - y[a]
        now = np.maximum(np.hypot(span_x, span_y), 1e-9)
        pull = (now - natural) * PULL / now
        where = np.concatenate([corner, a, b])
        force_x, force_y = (np.bincount(where, np.concatenate([away * push, span * pull, -span * pull]), n) for away, span in ((away_x, span_x), (away_y, span_y)))
        step = np.full(n_blocks, STEP)
        pairs = ends
        while True:
            hit = of[pairs[0][_crossing(pairs, x + step[of] * force_x, y + step[of] * force_y)]]
            crossed = np.bincount(hit, minlength=n_blocks) > 0
            shorter = crossed & (step > STEP / 1024)
            stuck = crossed & ~shorter
            if not shorter.any():
                break
            step[shorter] /= 2
            pairs = ends[:, crossed[of[ends[0]]]]
        go = np.where(stuck, 0, step)
        size = np.bincount(of, minlength=n_blocks)
        x, y = (c + go[of] * f for c, f in ((x, force_x), (y, force_y)))
        x, y = (c - np.where(stuck, 0, np.bincount(of, c, n_blocks) / size)[of] for c in (x, y))
        most = np.zeros(n_blocks)
        np.maximum.at(most, of, np.hypot(force_x, force_y))
        done = stuck | (step * most < STILL) | (turn + 1 == ROUNDS)
        if done.any():
            for k in np.flatnonzero(done):
                out[name[k]] = np.stack([x[of == k], y[of == k]], axis=1)
            if done.all():
                break
            stay = ~done[of]
            number = np.cumsum(stay) - 1
            keep_face = stay[parent]
            keep_corner = keep_face[face]
            corner, face, parent = number[corner[keep_corner]], (np.cumsum(keep_face) - 1)[face[keep_corner]], number[parent[keep_face]]
            keep = stay[a]
            a, b, natural = number[a[keep]], number[b[keep]], natural[keep]
            ends = number[ends[:, stay[ends[0]]]]
            x, y, of, name = x[stay], y[stay], (np.cumsum(~done) - 1)[of[stay]], name[~done]
    return out


def _hung(at: dict, shape: dict, v, gap: float) -> dict:
    """The nodes of a block but ``v``, hung at the place of ``v`` clear of what is placed."""
    names = [u for u in shape if u != v]
    own = np.array([shape[u] for u in names]) - np.array(shape[v])
    rest = np.array([p for u, p in at.items() if u != v])
    here = np.array(at[v])
    out, lean = here - np.mean(list(at.values()), axis=0), own.mean(axis=0)
    # of a node in the very middle, rounding would choose the direction
    turn = (math.atan2(out[1], out[0]) if math.hypot(*out) > 1e-9 else 0.0) - (math.atan2(lean[1], lean[0]) if math.hypot(*lean) > 1e-9 else 0.0)
    scale = 1.0
    while True:
        for k in range(24):  # outward first, then by turns to both sides
            angle = turn + (k + 1) // 2 * (-1) ** k * math.pi / 12
            c, s = math.cos(angle), math.sin(angle)
            spots = here + scale * own @ np.array([[c, s], [-s, c]])
            if not len(rest) or np.hypot(spots[:, None, 0] - rest[:, 0], spots[:, None, 1] - rest[:, 1]).min() >= gap:
                return dict(zip(names, map(tuple, spots.tolist()), strict=True))
        scale *= 1.25


def joined(shape: list[dict], gap: float) -> dict:
    """{node: (x, y)}: the blocks of a view joined at their cut nodes, along the tree that they form.

    The largest block of a connected part stays; every other is moved to the cut
    node that it shares, turned outward and, where a node would come nearer than
    ``gap`` to another, turned further or enlarged: blocks keep their shape.
    Parts stand side by side.
    """
    holds: dict = {}
    for k, nodes in enumerate(shape):
        for v in nodes:
            holds.setdefault(v, []).append(k)
    done, out, right = set(), {}, 0.0
    for anchor in sorted(range(len(shape)), key=lambda k: (-len(shape[k]), k)):
        if anchor in done:
            continue
        at, line = dict(shape[anchor]), deque([anchor])
        done.add(anchor)
        while line:
            for v in sorted(shape[line.popleft()]):
                for k in (k for k in holds[v] if k not in done):
                    done.add(k)
                    line.append(k)
                    at |= _hung(at, shape[k], v, gap)
        xs = [x for x, _ in at.values()]
        out |= {v: (x - min(xs) + right, y) for v, (x, y) in at.items()}
        right += max(xs) - min(xs) + 2 * gap
    return out


#: Directions that a leaf tries, nearest first.
FAN = np.array([(k + 1) // 2 * (-1) ** k * math.pi / 18 for k in range(36)])


def fanned(core: dict, leaves: list[tuple], gap: float) -> dict:
    """{node: (x, y)}: ``core`` and all leaves around it. ``leaves``: (leaf, parent, lean, x and y that it aims at or nan), the last that was taken off first.

    A leaf aims at the middle of its face, or away from the middle of the view,
    and takes the nearest free direction; where none is free it stands further
    away. A tree begins with the node that stays, at (0, 0); around a node in the
    middle, leaves with edges to it stand above, those with edges from it below,
    those with both to the right.
    """
    at = dict(core)
    spots = np.zeros((len(at) + 2 * len(leaves), 2))
    spots[: len(at)] = list(at.values()) or np.zeros((0, 2))
    for v, above, lean, x, y in leaves:
        if above not in at:  # the node that stays of a tree, beside all others
            at[above] = (max((p[0] for p in at.values()), default=-2 * gap) + 2 * gap, 0.0)
            spots[len(at) - 1] = at[above]
        here, others = at[above], spots[: len(at)]
        aim = (x - here[0], y - here[1])
        if math.isnan(x):
            middle = others.mean(axis=0)
            aim = (here[0] - middle[0], here[1] - middle[1])
        turn, far = math.atan2(aim[1], aim[0]) if math.hypot(*aim) > 0.001 else lean, LEAF_DISTANCE
        while True:
            xs, ys = here[0] + far * np.cos(turn + FAN), here[1] + far * np.sin(turn + FAN)
            free = np.hypot(others[:, 0] - xs[:, None], others[:, 1] - ys[:, None]).min(axis=1) >= gap
            if free[k := int(free.argmax())]:
                break
            far *= 1.25
        spots[len(at)] = xs[k], ys[k]
        at[v] = float(xs[k]), float(ys[k])
    return at


def positions(views: list[list[tuple]], gap: float = LEAST_GAP) -> list[list[tuple]]:
    """[(node, x, y)] of each view by its edges (source, target): all nodes that an edge to another node touches.

    Leaves are taken off, the blocks of what is left are drawn without crossings
    where that is possible, widened where leaves need room, joined at their cut
    nodes, and the leaves put back. Blocks that are not planar are placed by
    stress, those of all views together.
    """
    plans, bent = [], []
    for edges in views:
        links = sorted({(a, b) if a < b else (b, a) for a, b in edges if a != b})
        leaves = peeled(links)
        gone = {v for v, _, _ in leaves}
        blocks = block_lists([e for e in links if e[0] not in gone and e[1] not in gone])
        drawn = [drawing(b) for b in blocks]
        plans.append((set(edges), leaves, blocks, drawn))
        bent += [block for block, (_, lost) in zip(blocks, drawn, strict=True) if lost]
    names = [sorted({v for e in block for v in e}) for block in bent]
    stressed = iter(zip(names, relaxed_all([(len(n), ranked(n, b)) for n, b in zip(names, bent, strict=True)]), strict=True))
    shapes, tight = [], []
    for _, leaves, blocks, drawn in plans:
        home = faces_of_leaves(leaves, [parts for parts, _ in drawn])
        held: dict = {}
        for v, above, _ in leaves:
            if v in home:
                k, p, f = home[v]
                held.setdefault(k, {})[p, f, above] = None
        shape = []
        for k, (block, (parts, lost)) in enumerate(zip(blocks, drawn, strict=True)):
            ids, at = next(stressed) if lost else in_middle(triangles(parts[0]))
            links = ranked(ids, block)
            shape.append((ids, widened(at, links, SHORTEST_EDGE)))
            if k in held:
                rank = {v: i for i, v in enumerate(ids)}
                faces = [(rank[above], np.array([rank[v] for v in parts[p][f] if v != above])) for p, f, above in held[k]]
                tight.append((len(shapes), k, (shape[k][1], links, faces)))
        shapes.append((shape, home))
    for (g, k, _), at in zip(tight, swollen_all([block for _, _, block in tight]), strict=True):
        shapes[g][0][k] = shapes[g][0][k][0], at
    return [_placed(edges, leaves, [parts for parts, _ in drawn], shape, home, gap) for (edges, leaves, _, drawn), (shape, home) in zip(plans, shapes, strict=True)]


def _placed(edges: set, leaves: list[tuple], drawings: list, shape: list[tuple], home: dict, gap: float) -> list[tuple]:
    core = joined([dict(sorted(zip(ids, map(tuple, at.tolist()), strict=True))) for ids, at in shape], gap)
    rows = []
    for v, above, _ in reversed(leaves):
        up, down = (v, above) in edges, (above, v) in edges
        lean = 0.0 if up and down else -math.pi / 2 if up else math.pi / 2
        x = y = math.nan
        if v in home:
            k, p, f = home[v]
            x, y = np.mean([core[u] for u in drawings[k][p][f]], axis=0).tolist()
        rows.append((v, above, lean, x, y))
    return [(v, x, y) for v, (x, y) in sorted(fanned(core, rows, gap).items())]
