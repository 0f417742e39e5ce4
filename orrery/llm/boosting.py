"""Gradient-boosted trees small enough to run as a Column.

Trees are fitted on the driver to a bounded list of labelled feature rows (plain
Python, logistic loss, Newton leaves), then written as nested CASE expressions, so
scoring stays inside code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

Tree = float | tuple[str, float, "Tree", "Tree"]  # leaf, or (feature, cut, below, at or above)


def _leaf(grad: list[float], hess: list[float], rows: list[int], damping: float) -> float:
    return sum(grad[i] for i in rows) / (sum(hess[i] for i in rows) + damping)


def _grow(data: list[dict[str, float]], grad: list[float], hess: list[float], rows: list[int], depth: int, damping: float) -> Tree:
    if depth == 0 or len(rows) < 8:
        return _leaf(grad, hess, rows, damping)
    g_all, h_all = sum(grad[i] for i in rows), sum(hess[i] for i in rows)
    best = (g_all * g_all / (h_all + damping) + 1e-9, None, None)
    for name in data[0]:
        at: dict[float, list[float]] = {}
        for i in rows:
            sums = at.setdefault(data[i][name], [0.0, 0.0])
            sums[0] += grad[i]
            sums[1] += hess[i]
        g = h = 0.0
        values = sorted(at)
        for low, high in zip(values, values[1:]):
            g, h = g + at[low][0], h + at[low][1]
            gain = g * g / (h + damping) + (g_all - g) ** 2 / (h_all - h + damping)
            if gain > best[0]:
                best = (gain, name, (low + high) / 2)
    _, name, cut = best
    if name is None:
        return _leaf(grad, hess, rows, damping)
    below, above = [i for i in rows if data[i][name] < cut], [i for i in rows if data[i][name] >= cut]
    return name, cut, _grow(data, grad, hess, below, depth - 1, damping), _grow(data, grad, hess, above, depth - 1, damping)


def leaf_of(tree: Tree, row: dict[str, float]) -> float:
    while isinstance(tree, tuple):
        name, cut, below, above = tree
        tree = above if row[name] >= cut else below
    return tree


def fit(data: list[dict[str, float]], labels: list[int], rounds: int = 24, depth: int = 3, rate: float = 0.4, damping: float = 1.0) -> list[Tree]:
    score, trees = [0.0] * len(data), []
    for _ in range(rounds):
        p = [1.0 / (1.0 + math.exp(-s)) for s in score]
        grad, hess = [y - q for y, q in zip(labels, p)], [q * (1 - q) for q in p]
        tree = _grow(data, grad, hess, list(range(len(data))), depth, damping)
        trees.append(_scaled(tree, rate))
        score = [s + leaf_of(trees[-1], row) for s, row in zip(score, data)]
    return trees


def _scaled(tree: Tree, rate: float) -> Tree:
    return (tree[0], tree[1], _scaled(tree[2], rate), _scaled(tree[3], rate)) if isinstance(tree, tuple) else round(tree * rate, 9)


def probability(trees: list[Tree], row: dict[str, float]) -> float:
    return 1.0 / (1.0 + math.exp(-sum(leaf_of(t, row) for t in trees)))


def calibrated(scores: list[float], labels: list[int], precision: float) -> float:
    """The least threshold at which held-out precision is reached; 1.1 (nothing) where none does."""
    hits = taken = 0
    best = 1.1
    pairs = sorted(zip(scores, labels), reverse=True)
    for i, (s, y) in enumerate(pairs):
        taken, hits = taken + 1, hits + y
        if hits >= precision * taken and (i + 1 == len(pairs) or pairs[i + 1][0] < s):
            best = s
    return best


def column(trees: list[Tree], feature: dict[str, Column]) -> Column:
    """The summed leaves (log odds) as one expression."""

    def of(tree: Tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        name, cut, below, above = tree
        return F.when(feature[name] >= cut, of(above)).otherwise(of(below))

    total = F.lit(0.0)
    for tree in trees:
        total = total + of(tree)
    return total
