"""Gradient boosting of depth-two trees on counted cells of categorical features.

The rows are first counted by their combination of feature values, so that what
reaches the driver is bounded by the number of combinations, not by the number
of rows, and all rows are learned from. Plain Python on that table; the model is
applied as a SQL expression.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

Split = tuple[str, str]


@dataclass(frozen=True)
class Tree:
    """``root`` decides which of the two child splits is asked; leaves by (root, child)."""

    root: Split
    children: tuple[Split, Split]
    leaves: tuple[tuple[float, float], tuple[float, float]]

    def value(self, cell: dict[str, str]) -> float:
        side = int(cell[self.root[0]] == self.root[1])
        child = self.children[side]
        return self.leaves[side][int(cell[child[0]] == child[1])]

    def column(self, get) -> Column:
        def side(k: int) -> Column:
            name, value = self.children[k]
            return F.when(get(name) == value, F.lit(self.leaves[k][1])).otherwise(F.lit(self.leaves[k][0]))

        return F.when(get(self.root[0]) == self.root[1], side(1)).otherwise(side(0))


@dataclass(frozen=True)
class Model:
    base: float
    trees: tuple[Tree, ...]

    def logit(self, cell: dict[str, str]) -> float:
        return self.base + sum(t.value(cell) for t in self.trees)

    def column(self, get) -> Column:
        """Logit as an expression; ``get(name)`` gives the column of a feature."""
        out = F.lit(self.base)
        for tree in self.trees:
            out = out + tree.column(get)
        return out


def _best(rows, splits: list[Split], ridge: float) -> Split:
    """Split of the largest gain in sum(g)**2 / (sum(h) + ridge)."""
    g_all, h_all = sum(r[1] for r in rows), sum(r[2] for r in rows)
    g, h = defaultdict(float), defaultdict(float)
    for cell, gi, hi in rows:
        for item in cell.items():
            g[item] += gi
            h[item] += hi
    gain = lambda s: g[s] ** 2 / (h[s] + ridge) + (g_all - g[s]) ** 2 / (h_all - h[s] + ridge)
    return max(splits, key=lambda s: (round(gain(s), 9), s))


def fit(cells: list[tuple[dict[str, str], int, int]], rounds: int = 20, rate: float = 0.3, ridge: float = 1.0) -> Model:
    """Model of P(positive) from (cell, positives, negatives)."""
    n1, n0 = sum(c[1] for c in cells), sum(c[2] for c in cells)
    base = math.log((n1 + 0.5) / (n0 + 0.5))
    splits = sorted({item for c, _, _ in cells for item in c.items()})
    if not n1 or not n0 or not splits:
        return Model(base, ())
    logits = [base] * len(cells)
    trees = []
    for _ in range(rounds):
        rows = []
        for (cell, a, b), z in zip(cells, logits):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            rows.append((cell, a - (a + b) * p, (a + b) * p * (1 - p)))
        root = _best(rows, splits, ridge)
        children, leaves = [], []
        for side in (False, True):
            part = [r for r in rows if (r[0][root[0]] == root[1]) is side]
            child = _best(part, splits, ridge) if part else splits[0]
            sums = [[0.0, 0.0], [0.0, 0.0]]
            for cell, g, h in part:
                s = sums[int(cell[child[0]] == child[1])]
                s[0] += g
                s[1] += h
            children.append(child)
            leaves.append(tuple(rate * g / (h + ridge) for g, h in sums))
        tree = Tree(root, tuple(children), tuple(leaves))
        trees.append(tree)
        logits = [z + tree.value(c[0]) for z, c in zip(logits, cells)]
    return Model(base, tuple(trees))


def threshold(scored: list[tuple[float, int, int]], precision: float) -> float:
    """The lowest score from which on the share of positives is at least ``precision``, or infinity.

    Scores are those of cells, so the threshold lies half way to the next lower
    one; cells that the examples lack then fall to the side they are nearer to.
    """
    a = b = 0
    last, out = math.inf, math.inf
    ordered = sorted(scored, reverse=True)
    for k, (z, pos, neg) in enumerate(ordered):
        a, b = a + pos, b + neg
        lower = ordered[k + 1][0] if k + 1 < len(ordered) else z
        if a and a >= precision * (a + b) and (lower < z or k + 1 == len(ordered)):
            last, out = z, (z + lower) / 2
    return min(last, out)
