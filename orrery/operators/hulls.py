"""Tight upright boxes (E9): hulls as a mergeable aggregate, the least rectangle around each, the ground plane.

The hull of a set is the hull of its parts' hulls.  Every task first takes hulls of what
it holds of each key, so that a key's points meet as a few corners, whatever their
number; only then are the parts brought together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Points of one key that a task holds before it takes their hull.
HELD = 100_000
UPRIGHT = "cx double, cy double, cz double, ex double, ey double, ez double, r array<double>"


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of 2-d points, counterclockwise from the least; points on its sides are no corners."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows) -> list:
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    # rows that are extreme in none of sixteen directions need not be walked when there are many
    if len(p) > 64:
        angles = np.arange(16) * np.pi / 8
        corners = hull(p[np.unique((p @ np.stack([np.cos(angles), np.sin(angles)])).argmax(0))])
        step = np.roll(corners, -1, axis=0) - corners
        outside = np.zeros(len(p), bool)
        for c, s in zip(corners, step):
            outside |= s[0] * (p[:, 1] - c[1]) - s[1] * (p[:, 0] - c[0]) <= 0
        p = p[outside]
    rows = p.tolist()
    lower, upper = chain(rows), chain(rows[::-1])
    return np.array(lower[:-1] + upper[:-1])


def least_rectangle(corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(centre, (length, width), angle) of the least rectangle around a hull: it has a side along one of the hull's.

    Length is along the angle, in [0, pi / 2); of equal areas the least angle counts.
    """
    if len(corners) == 1:
        return corners[0], np.zeros(2), 0.0
    step = np.roll(corners, -1, axis=0) - corners
    angles = np.unique(np.round(np.arctan2(step[:, 1], step[:, 0]) % (np.pi / 2), 15))
    u, v = np.stack([np.cos(angles), np.sin(angles)]), np.stack([-np.sin(angles), np.cos(angles)])
    along, across = corners @ u, corners @ v
    lo, hi = np.stack([along.min(0), across.min(0)]), np.stack([along.max(0), across.max(0)])
    area = np.prod(hi - lo, axis=0)
    i = int(np.argmax(area <= area.min() * (1 + 1e-12)))
    middle = (lo[:, i] + hi[:, i]) / 2
    return middle[0] * u[:, i] + middle[1] * v[:, i], hi[:, i] - lo[:, i], float(angles[i])


def hulls(points: DataFrame, key: str, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """(key, n, low, high, xs, ys): how many points, their least and greatest z, and the corners of their hull, counterclockwise."""
    kind = dict(points.dtypes)[key]
    schema = f"{key} {kind}, n long, low double, high double, xs array<double>, ys array<double>"
    columns = [c.split()[0] for c in schema.split(", ")]

    def partial(batches):
        held: dict = {}

        def taken(k, n, low, high, parts):
            ring = hull(np.concatenate(parts))
            return k, n, low, high, ring[:, 0], ring[:, 1]

        for pdf in batches:
            for k, own in pdf.groupby(key, dropna=False):
                k = None if pd.isna(k) else k
                n, low, high, parts = held.get(k, (0, np.inf, -np.inf, []))
                parts.append(own[["x", "y"]].to_numpy(float))
                if sum(map(len, parts)) > HELD:
                    parts = [hull(np.concatenate(parts))]
                held[k] = n + len(own), min(low, own["z"].min()), max(high, own["z"].max()), parts
            if sum(len(p) for *_, parts in held.values() for p in parts) > 10 * HELD:  # many keys: give what is there
                yield pd.DataFrame([taken(k, *v) for k, v in held.items()], columns=columns)
                held = {}
        if held:
            yield pd.DataFrame([taken(k, *v) for k, v in held.items()], columns=columns)

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = hull(np.stack([np.concatenate(pdf["xs"].to_list()), np.concatenate(pdf["ys"].to_list())], axis=1))
        return pd.DataFrame([(pdf[key].iloc[0], pdf["n"].sum(), pdf["low"].min(), pdf["high"].max(), ring[:, 0], ring[:, 1])], columns=columns)

    rows = points.select(F.col(key), *[F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))]).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    return rows.mapInPandas(partial, schema).groupBy(key).applyInPandas(merged, schema)


def tight_boxes(points: DataFrame, key: str, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """(key, n, cx, cy, cz, ex, ey, ez, r): the least upright box around each key's points; r is its rotation, rows joined.

    Points with a null coordinate take no part; a key with a single point has a box without extent.
    """
    found = hulls(points, key, x, y, z)
    kind = dict(points.dtypes)[key]

    def fit(batches):
        for pdf in batches:
            rows = []
            for k, n, low, high, xs, ys in pdf.itertuples(index=False):
                centre, size, angle = least_rectangle(np.stack([xs, ys], axis=1))
                c, s = float(np.cos(angle)), float(np.sin(angle))
                rows.append((k, n, centre[0], centre[1], (low + high) / 2, size[0], size[1], high - low, [c, -s, 0.0, s, c, 0.0, 0.0, 0.0, 1.0]))
            yield pd.DataFrame(rows, columns=[key, "n", "cx", "cy", "cz", "ex", "ey", "ez", "r"])

    return found.mapInPandas(fit, f"{key} {kind}, n long, {UPRIGHT}")


def ground_plane(up: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> tuple[Column, Column]:
    """(centre, normal) of the face a box of columns cx..ez, r stands on, whatever its rotation: the one whose outward normal points most against ``up``.

    Both are arrays of three; the normal points up, into the box.  Of equal faces the first axis counts.
    """
    axis = lambda k: F.array(*[F.col("r")[3 * i + k] for i in range(3)])
    lift = [sum((F.col("r")[3 * i + k] * u for i, u in enumerate(up)), F.lit(0.0)) for k in range(3)]
    steep = [F.abs(l) for l in lift]
    k = F.when((steep[0] >= steep[1]) & (steep[0] >= steep[2]), 0).when(steep[1] >= steep[2], 1).otherwise(2)
    pick = lambda values: F.when(k == 0, values[0]).when(k == 1, values[1]).otherwise(values[2])
    sign = F.when(pick(lift) < 0, -1.0).otherwise(1.0)
    normal = F.transform(pick([axis(i) for i in range(3)]), lambda v: v * sign)
    half = pick([F.col("ex"), F.col("ey"), F.col("ez")]) / 2
    centre = F.zip_with(F.array("cx", "cy", "cz"), normal, lambda c, v: c - v * half)
    return centre, normal


def volume() -> Column:
    """Of a box of columns ex, ey, ez."""
    return F.col("ex") * F.col("ey") * F.col("ez")


def inside(px: Column, py: Column, pz: Column) -> Column:
    """Whether a point lies in a box of columns cx..ez, r, its faces included up to a part in 10^9 of an extent."""
    gap = [px - F.col("cx"), py - F.col("cy"), pz - F.col("cz")]
    local = [sum((F.col("r")[3 * i + k] * gap[i] for i in range(3)), F.lit(0.0)) for k in range(3)]
    tests = [F.abs(l) <= F.col(e) / 2 + 1e-9 * (1 + F.col(e)) for l, e in zip(local, ("ex", "ey", "ez"))]
    return tests[0] & tests[1] & tests[2]


def transformed(boxes: DataFrame, rotation: list[list[float]], shift: list[float]) -> DataFrame:
    """Boxes after a rigid motion: centre moved, rotation composed, extents kept."""
    centre = [sum((F.col(c) * rotation[i][j] for j, c in enumerate(("cx", "cy", "cz"))), F.lit(float(shift[i]))) for i in range(3)]
    r = F.array(*[sum((F.col("r")[3 * k + j] * rotation[i][k] for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)])
    return boxes.select(*[{"cx": centre[0], "cy": centre[1], "cz": centre[2], "r": r}.get(c, F.col(c)).alias(c) for c in boxes.columns])
