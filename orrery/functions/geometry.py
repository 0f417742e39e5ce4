"""Geometry expressions: projections, rotations, boxes, lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

Matrix = Sequence[Sequence[Column | float]]


def half_space(axis: str, x: Column, y: Column) -> Column:
    """The half of space that a camera facing ``axis`` can see."""
    rules = {"+x": x >= 0, "-x": x < 0, "+y": y >= 0, "-y": y < 0}
    if axis not in rules:
        raise ValueError(f"axis must be one of {sorted(rules)}, not {axis!r}")
    return rules[axis]


def rotate(r: Matrix, p: Sequence[Column]) -> list[Column]:
    return [sum((r[i][j] * p[j] for j in range(1, 3)), r[i][0] * p[0]) for i in range(3)]


def rigid(r: Matrix, t: Sequence[Column | float], p: Sequence[Column]) -> list[Column]:
    """R p + t."""
    return [a + b for a, b in zip(rotate(r, p), t)]


def inverse_rigid(r: Matrix, t: Sequence[Column | float]) -> tuple[list[list], list]:
    """the transform back, (R', -R' t)."""
    back = [[r[j][i] for j in range(3)] for i in range(3)]
    return back, [-(back[i][0] * t[0] + back[i][1] * t[1] + back[i][2] * t[2]) for i in range(3)]


def quaternion(x: Column, y: Column, z: Column, w: Column) -> list[list[Column]]:
    """rotation of the normalised quaternion (x, y, z, w)."""
    n = x * x + y * y + z * z + w * w
    s = 2.0 / n
    return [
        [1.0 - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w)],
        [s * (x * y + z * w), 1.0 - s * (x * x + z * z), s * (y * z - x * w)],
        [s * (x * z - y * w), s * (y * z + x * w), 1.0 - s * (x * x + y * y)],
    ]


def euler_flipped(roll: Column, pitch: Column, yaw: Column) -> list[list[Column]]:
    """rotation of x-y-z angles in degrees about fixed axes, in the frame mirrored in y and z."""
    cx, sx = F.cos(F.radians(roll)), F.sin(F.radians(roll))
    cy, sy = F.cos(F.radians(pitch)), F.sin(F.radians(pitch))
    cz, sz = F.cos(F.radians(yaw)), F.sin(F.radians(yaw))
    r = [
        [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx],
        [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx],
        [-sy, cy * sx, cy * cx],
    ]
    sign = (1.0, -1.0, -1.0)
    return [[r[i][j] * (sign[i] * sign[j]) for j in range(3)] for i in range(3)]


def pinhole(k: Sequence[float], c: Sequence[Column]) -> tuple[Column, Column]:
    """Pixel of camera point c under the row-major 3x3 matrix k, rounded half to even."""
    p = [k[3 * i] * c[0] + k[3 * i + 1] * c[1] + k[3 * i + 2] * c[2] for i in range(3)]
    return F.bround(p[0] / p[2]).cast("long"), F.bround(p[1] / p[2]).cast("long")


def in_frame(u: Column, v: Column, width: int, height: int, left: int = 0, top: int = 0) -> Column:
    """Within the half-open rectangle."""
    return (u >= left) & (u < left + width) & (v >= top) & (v < top + height)


def visible(k: Sequence[float], c: Sequence[Column], width: int, height: int) -> Column:
    """P20: in front of the camera, and its truncated pixel inside the image."""
    p = [k[3 * i] * c[0] + k[3 * i + 1] * c[1] + k[3 * i + 2] * c[2] for i in range(3)]
    front = c[2] > 1e-6
    return F.coalesce(F.when(front, in_frame((p[0] / p[2]).cast("long"), (p[1] / p[2]).cast("long"), width, height)), F.lit(False))


def box_corners(centre: Sequence[Column], r: Matrix, extent: Sequence[Column]) -> Column:
    """The eight corners of an oriented box of full side lengths ``extent``, as array<struct<x,y,z>>."""
    corners = []
    for sx in (-0.5, 0.5):
        for sy in (-0.5, 0.5):
            for sz in (-0.5, 0.5):
                p = rigid(r, centre, [extent[0] * sx, extent[1] * sy, extent[2] * sz])
                corners.append(F.struct(p[0].alias("x"), p[1].alias("y"), p[2].alias("z")))
    return F.array(*corners)


def in_box(p: Sequence[Column], centre: Sequence[Column | float], r: Matrix, extent: Sequence[Column | float]) -> Column:
    """inside the oriented box, its faces included."""
    d = [a - b for a, b in zip(p, centre)]
    local = [r[0][i] * d[0] + r[1][i] * d[1] + r[2][i] * d[2] for i in range(3)]
    return (F.abs(local[0]) <= extent[0] / 2) & (F.abs(local[1]) <= extent[1] / 2) & (F.abs(local[2]) <= extent[2] / 2)


def thick(extent: Column, least: float = 1e-6) -> Column:
    """a degenerate side gets ``least`` more."""
    return F.when(extent < least, extent + least).otherwise(extent)


def point_line(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """F16: distance of p to the line through a and b; infinite where a is b."""
    length = F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))
    area = F.abs((bx - ax) * (ay - py) - (ax - px) * (by - ay))
    return F.when(length > 0, area / length).otherwise(F.lit(float("inf")))


def line_crossing(p1: Sequence[Column], p2: Sequence[Column], p3: Sequence[Column], p4: Sequence[Column]) -> tuple[Column, Column]:
    """where line p1p2 meets line p3p4; the middle of p1p2 where they are parallel."""
    (x1, y1), (x2, y2), (x3, y3), (x4, y4) = p1, p2, p3, p4
    den = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
    a, b = x1 * y2 - y1 * x2, x3 * y4 - y3 * x4
    cut = F.abs(den) > 1e-12
    return (
        F.when(cut, (a * (x3 - x4) - (x1 - x2) * b) / den).otherwise((x1 + x2) / 2),
        F.when(cut, (a * (y3 - y4) - (y1 - y2) * b) / den).otherwise((y1 + y2) / 2),
    )


def in_polygon(x: Column, y: Column, corners: Sequence[tuple[Column | float, Column | float]]) -> Column:
    """Crossing number over the polygon's sides."""
    odd = F.lit(0)
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]]):
        ax, ay, bx, by = (c if isinstance(c, Column) else F.lit(float(c)) for c in (ax, ay, bx, by))
        crosses = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.when(by != ay, by - ay) + ax)
        odd = odd + F.when(crosses, 1).otherwise(0)
    return odd % 2 == 1


def seconds(sec: Column, nanosec: Column) -> Column:
    """F20"""
    return sec + nanosec * 1e-9


def surface_cost(weight: Column, src: Column, dst: Column, preferred: Sequence[int], forbidden: Sequence[int], penalties: dict[int, float]) -> Column:
    """infinite at a forbidden end; else the weight (1 if missing) plus both ends' penalties, unless both are preferred."""
    table = F.create_map(*[F.lit(x) for kv in penalties.items() for x in (kv[0], float(kv[1]))]) if penalties else None
    penalty = lambda c: F.coalesce(table[c], F.lit(0.0)) if table is not None else F.lit(0.0)
    base = F.coalesce(weight, F.lit(1.0))
    return (
        F.when(src.isin(*forbidden) | dst.isin(*forbidden), F.lit(float("inf")))
        .when(src.isin(*preferred) & dst.isin(*preferred), base)
        .otherwise(base + penalty(src) + penalty(dst))
    )


def entropy(p: Column) -> Column:
    """Shannon entropy in bits of an array of probabilities; zero terms count 0."""
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log2(x)).otherwise(0.0))


def jensen_shannon(p: Column, q: Column, wp: Column | float, wq: Column | float) -> Column:
    """divergence of two distributions with prior weights."""
    mixed = F.zip_with(p, q, lambda a, b: wp * a + wq * b)
    return entropy(mixed) - (wp * entropy(p) + wq * entropy(q))


def information_term(joint: Column, px: Column, py: Column) -> Column:
    """one term of mutual information in bits."""
    return F.when(joint > 0, joint * F.log2(joint / (px * py))).otherwise(0.0)


#: Rotation rows and shift from a recording's own frame to the world's, by layout.
WORLD_FRAMES = {
    "sparse": (((0.0, 1.0, 0.0), (-1.0, 0.0, 0.0), (0.0, 0.0, 1.0)), (5.0, -10.0, 8.49)),
    "dense": (((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)), (5.0, -27.0, 8.49)),
}


def to_world(layout: str, p: Sequence[Column]) -> list[Column]:
    """p in the world's frame; another layout is an error."""
    if layout not in WORLD_FRAMES:
        raise ValueError(f"layout must be one of {sorted(WORLD_FRAMES)}, not {layout!r}")
    r, t = WORLD_FRAMES[layout]
    return rigid(r, t, p)
