"""Grids: occupancy, opening, distance map, skeleton and its graph.

Cells are rows (grid key, y, x).  What looks only at neighbours is relational, and
distance maps and territories of any size are in ``cells``; the skeleton works on one
whole grid at a time in ``applyInPandas``, grids in parallel.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

SIDES = ((0, -1), (0, 1), (-1, 0), (1, 0))
CORNERS = ((-1, -1), (-1, 1), (1, -1), (1, 1))
AROUND = SIDES + CORNERS


def occupancy(points: DataFrame, key: str, res: float, x: str = "x", y: str = "y") -> DataFrame:
    """Distinct (key, y, x) cells that hold points; bounds over all keys, the last cell closed on its far side."""
    ends = points.agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))
    at = lambda c, lo, hi: F.least(F.floor((F.col(c) - F.col(lo)) / res), F.greatest(F.ceil((F.col(hi) - F.col(lo)) / res) - 1, F.lit(0))).cast("long")
    return points.join(F.broadcast(ends), F.lit(True)).select(key, at(y, "y0", "y1").alias("cy"), at(x, "x0", "x1").alias("cx")).distinct().toDF(key, "y", "x")


def _spread(cells: DataFrame, key: str) -> DataFrame:
    shifts = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 0), *AROUND)]))
    return cells.withColumn("_s", shifts).select(key, (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"))


def opening(cells: DataFrame, key: str) -> DataFrame:
    """R2: erosion, then dilation of the set cells by 3x3; off the grid counts as unset."""
    eroded = _spread(cells, key).groupBy(key, "y", "x").agg(F.count("*").alias("n")).where("n = 9").drop("n")
    return _spread(eroded, key).distinct()


def neighbour_counts(ids: DataFrame, key: str) -> DataFrame:
    """For each territory how many of its borders touch others; every border of an edge cell counts for both sides.

    ``ids`` is (key, y, x, id, is_edge).
    """
    near = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in SIDES]))
    probe = ids.where("is_edge").withColumn("_s", near).select(key, (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"), F.col("id").alias("own"))
    met = probe.join(ids.select(key, "y", "x", F.col("id").alias("other")), [key, "y", "x"]).where("own <> other")
    both = met.select(key, F.explode(F.array("own", "other")).alias("id"))
    counts = both.groupBy(key, "id").agg(F.count("*").alias("n"))
    return ids.select(key, "id").distinct().join(counts, [key, "id"], "left").select(key, "id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def touching(ids: DataFrame, key: str) -> DataFrame:
    """Unordered pairs of territories that touch at an edge cell."""
    near = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in SIDES]))
    probe = ids.where("is_edge").withColumn("_s", near).select(key, (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"), F.col("id").alias("own"))
    met = probe.join(ids.select(key, "y", "x", F.col("id").alias("other")), [key, "y", "x"]).where("own <> other")
    return met.select(key, F.least("own", "other").alias("src"), F.greatest("own", "other").alias("dst")).distinct()


# --- kernels over one grid --------------------------------------------------------


def distance_map(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, nearest obstacle as y * width + x) of every cell; exact, in two separable passes; ties to the lower index.

    Without obstacles distances are infinite and obstacles -1.
    """
    h, w = grid.shape
    big = np.iinfo(np.int64).max // 4
    ys, obst = np.arange(h), grid.astype(bool)
    # nearest obstacle in the own column, ties to the smaller row: the last one above or the first one below
    up = np.maximum.accumulate(np.where(obst, ys[:, None], -1), axis=0)
    down = np.minimum.accumulate(np.where(obst, ys[:, None], big)[::-1], axis=0)[::-1]
    row = np.where((up >= 0) & (ys[:, None] - up <= down - ys[:, None]), up, np.where(down < big, down, up))
    del up, down
    column = np.where(row >= 0, (ys[:, None] - row) ** 2, big)
    xs = np.arange(w)
    gap = (xs[:, None] - xs[None]) ** 2
    dist, near = np.empty((h, w)), np.empty((h, w), dtype=np.int64)
    for y in range(h):
        total = gap + column[y][None]
        index = row[y] * w + xs
        least = total.min(1)
        best = np.where(total == least[:, None], index[None], np.iinfo(np.int64).max).min(1)
        far = least >= big
        dist[y], near[y] = np.where(far, np.inf, np.sqrt(least)), np.where(far, -1, best)
    return dist, near


def voronoi(dist: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Cells between two obstacles that do not touch; of two neighbours the one that is nearer to the other's obstacle."""
    h, w = dist.shape
    oy, ox = near // w, near % w
    yy, xx = np.indices(dist.shape)
    out = np.zeros(dist.shape, dtype=bool)
    for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1)):
        a = np.s_[0 : h - dy, max(0, -dx) : w - max(0, dx)]
        b = np.s_[dy:h, max(0, dx) : w - max(0, -dx)]
        apart = (np.abs(oy[a] - oy[b]) > 1) | (np.abs(ox[a] - ox[b]) > 1)
        test = ((dist[a] > 1) | (dist[b] > 1)) & (near[a] >= 0) & (near[b] >= 0) & apart
        cross_a = (yy[a] - oy[b]) ** 2 + (xx[a] - ox[b]) ** 2
        cross_b = (yy[b] - oy[a]) ** 2 + (xx[b] - ox[a]) ** 2
        out[a] |= test & (cross_a <= cross_b)
        out[b] |= test & (cross_b <= cross_a)
    return out


def thinned(marks: np.ndarray, dist: np.ndarray, rule: str = "four") -> np.ndarray:
    """Holes filled, then cells removed from the obstacles inwards unless the line needs them.

    Rules name what keeps a cell: ``four``, it is a corner (two sides at a right
    angle set, the diagonal between them free) or a link (two opposite sides set,
    the other two free); ``eight``, the same with the diagonals turned into sides;
    ``both``, either of the two; ``three``, at least three of its eight neighbours
    are set.  Off the grid nothing is set or free.
    """
    h, w = marks.shape
    m = np.pad(marks.astype(np.int8), 1, constant_values=0)
    sides = m[:-2, 1:-1] + m[2:, 1:-1] + m[1:-1, :-2] + m[1:-1, 2:]
    filled = marks | (sides == 4)
    state = np.full((h + 2, w + 2), -1, dtype=np.int8)  # -1 off the grid
    state[1:-1, 1:-1] = filled
    ys, xs = np.nonzero(filled)
    for i in np.lexsort((xs, ys, dist[ys, xs])):
        y, x = ys[i] + 1, xs[i] + 1
        at = lambda dy, dx: state[y + dy, x + dx]  # noqa: E731, B023
        keep = False
        if rule in ("four", "both"):
            keep |= any(at(0, dx) == 1 and at(dy, 0) == 1 and at(dy, dx) == 0 for dy in (-1, 1) for dx in (-1, 1))
            keep |= at(0, -1) == at(0, 1) == 1 and at(-1, 0) == at(1, 0) == 0
            keep |= at(-1, 0) == at(1, 0) == 1 and at(0, -1) == at(0, 1) == 0
        if rule in ("eight", "both"):
            keep |= any(at(-d, -1) == 1 and at(-d, 1) == 1 and at(-d, 0) == 0 for d in (-1, 1))
            keep |= any(at(-1, -d) == 1 and at(1, -d) == 1 and at(0, -d) == 0 for d in (-1, 1))
        if rule == "three":
            keep = sum(at(dy, dx) == 1 for dy, dx in AROUND) >= 3
        if not keep:
            state[y, x] = 0
    return state[1:-1, 1:-1] == 1


def joints(marks: np.ndarray) -> np.ndarray:
    """Cells of the line that are nodes: ends and meetings, in scan order, none beside another; the rest are edges."""
    h, w = marks.shape
    m = np.pad(marks.astype(int), 1)
    sides = m[:-2, 1:-1] + m[2:, 1:-1] + m[1:-1, :-2] + m[1:-1, 2:]
    corners = m[:-2, :-2] + m[:-2, 2:] + m[2:, :-2] + m[2:, 2:]
    wanted = marks & ((sides >= 3) | (corners >= 3) | (sides == 1))
    nodes = np.zeros((h + 2, w + 2), dtype=bool)
    for y, x in zip(*np.nonzero(wanted)):
        if not nodes[y : y + 3, x : x + 3].any():
            nodes[y + 1, x + 1] = True
    return nodes[1:-1, 1:-1]


def territories(nodes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Ids from 1 in scan order, spread from the nodes along edge cells by sides; -1 where none reaches."""
    h, w = nodes.shape
    ids = np.full((h, w), -1, dtype=np.int64)
    queue = deque()
    for i, (y, x) in enumerate(zip(*np.nonzero(nodes)), 1):
        ids[y, x] = i
        queue.append((y, x))
    while queue:
        y, x = queue.popleft()
        for dy, dx in SIDES:
            v, u = y + dy, x + dx
            if 0 <= v < h and 0 <= u < w and edges[v, u] and ids[v, u] < 0:
                ids[v, u] = ids[y, x]
                queue.append((v, u))
    return ids


def way_between(ids: np.ndarray, nodes: np.ndarray, start: tuple[int, int], end: tuple[int, int]) -> list[tuple[int, int]]:
    """Cells from node to node through the territories of both, shortest by sides, within the two ids."""
    allowed = {int(ids[start]), int(ids[end])}
    before: dict[tuple[int, int], tuple[int, int] | None] = {start: None}
    queue = deque([start])
    h, w = ids.shape
    while queue:
        at = queue.popleft()
        if at == end:
            break
        for dy, dx in SIDES:
            to = (at[0] + dy, at[1] + dx)
            if 0 <= to[0] < h and 0 <= to[1] < w and to not in before and int(ids[to]) in allowed:
                before[to] = at
                queue.append(to)
    if end not in before:
        return []
    way, at = [], end
    while at is not None:
        way.append(at)
        at = before[at]
    return way[::-1]


def split_points(ids: np.ndarray, nodes: np.ndarray, max_dev: float, max_dist: float) -> list[tuple[int, int]]:
    """Where a way between touching territories bends too far (its farthest cell) or is too long (its cell nearest the middle)."""
    where = {int(ids[y, x]): (int(y), int(x)) for y, x in zip(*np.nonzero(nodes))}
    pairs = set()
    for a, b in ((ids[:, :-1], ids[:, 1:]), (ids[:-1], ids[1:])):
        touch = (a != b) & (a > 0) & (b > 0)
        pairs |= {tuple(sorted(p)) for p in zip(a[touch].tolist(), b[touch].tolist())}
    out = []
    for p, q in sorted(pairs):
        way = way_between(ids, nodes, where[p], where[q])
        if len(way) <= 4:
            continue
        pts = np.array(way, dtype=float)
        chord = pts[-1] - pts[0]
        length = float(np.hypot(*chord))
        if length == 0:
            continue
        off = np.abs(chord[1] * (pts[:, 0] - pts[0, 0]) - chord[0] * (pts[:, 1] - pts[0, 1])) / length
        if off.max() > max_dev:
            out.append(way[int(off.argmax())])
        elif length > max_dist:
            middle = (pts[0] + pts[-1]) / 2
            out.append(way[int(np.hypot(*(pts - middle).T).argmin())])
    return [p for p in dict.fromkeys(out) if not nodes[p]]


def skeleton_of(grid: np.ndarray, max_dev: float, max_dist: float, rounds: int = 10, rule: str = "four") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, nodes, distance) of one grid whose obstacles are 1."""
    dist, near = distance_map(grid)
    line = thinned(voronoi(dist, near), dist, rule)
    nodes = joints(line)
    for _ in range(rounds):
        new = split_points(territories(nodes, line & ~nodes), nodes, max_dev, max_dist)
        if not new:
            break
        for p in new:
            nodes[p] = True
    return territories(nodes, line & ~nodes), nodes, dist


def _grid(pdf: pd.DataFrame) -> tuple[np.ndarray, int, int]:
    y0, x0 = int(pdf["y"].min()), int(pdf["x"].min())
    grid = np.ones((int(pdf["y"].max()) - y0 + 3, int(pdf["x"].max()) - x0 + 3), dtype=np.int8)
    grid[pdf["y"] - y0 + 1, pdf["x"] - x0 + 1] = 0
    return grid, y0 - 1, x0 - 1


def skeleton(free: DataFrame, key: str, max_dev: float = 3.0, max_dist: float = 12.0, rounds: int = 10) -> DataFrame:
    """(key, y, x, id, is_edge, dist): the cells of each grid's line with the territory each belongs to."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, y0, x0 = _grid(pdf)
        ids, nodes, dist = skeleton_of(grid, max_dev, max_dist, rounds)
        ys, xs = np.nonzero(ids > 0)
        return pd.DataFrame({key: pdf[key].iloc[0], "y": ys + y0, "x": xs + x0, "id": ids[ys, xs], "is_edge": ~nodes[ys, xs], "dist": dist[ys, xs]})

    kind = dict(free.dtypes)[key]
    return free.select(key, "y", "x").groupBy(key).applyInPandas(solve, f"{key} {kind}, y long, x long, id long, is_edge boolean, dist double")

