"""Distance maps and territories as cell tables (R3, R4, R6, R7, R11): no grid is ever one group.

A grid is rows (key, y, x, obst).  The distance map is exact and comes in two passes
over lines: a column's nearest obstacle by two running windows, then each row's least
sum of squares, a row of cells at a time.  Changes touch only the columns they lie in
and the rows where a column's answer moved.  Territories spread inside tiles, and tiles
exchange their borders in staged rounds until nothing moves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orrery.operators.lineage import staged

#: Sides of a tile of cells.
TILE = 256
#: Above any id of a territory: steps come first in a label.
STEP = 1 << 40


def grid_of(free: DataFrame, key: str) -> DataFrame:
    """(key, y, x, obst): the free cells' box with a rim of one cell; what is not free is obstacle."""
    free = free.select(key, "y", "x").distinct()
    box = free.groupBy(key).agg(*[f(c).alias(f"_{c}{n}") for c in "yx" for f, n in ((F.min, 0), (F.max, 1))])
    rows = box.withColumn("y", F.explode(F.sequence(F.col("_y0") - 1, F.col("_y1") + 1)))
    every = rows.select(key, "y", F.explode(F.sequence(F.col("_x0") - 1, F.col("_x1") + 1)).alias("x"))
    return every.join(free.withColumn("_free", F.lit(True)), [key, "y", "x"], "left").select(key, "y", "x", F.col("_free").isNull().alias("obst"))


def with_columns_nearest(grid: DataFrame, key: str) -> DataFrame:
    """The grid with gy, the row of the nearest obstacle in a cell's own column (the upper of equals), null without one."""
    own = F.when(F.col("obst"), F.col("y"))
    running = lambda *order: W.partitionBy(key, "x").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = grid.withColumns({"_up": F.last(own, ignorenulls=True).over(running("y")), "_down": F.last(own, ignorenulls=True).over(running(F.desc("y")))})
    up = F.col("_down").isNull() | (F.col("y") - F.col("_up") <= F.col("_down") - F.col("y"))
    return out.withColumn("gy", F.when(up, F.col("_up")).otherwise(F.col("_down"))).drop("_up", "_down")


def row_nearest(x: np.ndarray, y: int, cx: np.ndarray, cy: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(oy, ox, d2) of the cells x of row y, from the nearest obstacles (cy, cx) of its columns; ties to the lesser (oy, ox)."""
    order = np.lexsort((cx, cy))  # the first of equals is the least obstacle
    ox, oy = cx[order], cy[order]
    tall = (y - oy) ** 2
    pick = np.concatenate([np.argmin((x[i : i + block, None] - ox) ** 2 + tall, axis=1) for i in range(0, len(x), block)])
    return oy[pick], ox[pick], (x - ox[pick]) ** 2 + tall[pick]


def with_rows_nearest(lines: DataFrame, key: str) -> DataFrame:
    """(key, y, x, obst, gy, oy, ox, d2): the nearest obstacle of every cell and its squared distance; null in a row that no column's obstacle reaches."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf["gy"].notna().to_numpy()
        out = pdf.assign(oy=pd.array([None] * len(pdf), "Int64"), ox=pd.array([None] * len(pdf), "Int64"), d2=pd.array([None] * len(pdf), "Int64"))
        if known.any():
            x = pdf["x"].to_numpy()
            oy, ox, d2 = row_nearest(x, int(pdf["y"].iloc[0]), x[known], pdf["gy"].to_numpy()[known].astype(np.int64))
            out = pdf.assign(oy=oy, ox=ox, d2=d2)
        return out

    kind = dict(lines.dtypes)[key]
    lines = lines.select(key, "y", "x", "obst", "gy")
    return lines.groupBy(key, "y").applyInPandas(solve, f"{key} {kind}, y long, x long, obst boolean, gy long, oy long, ox long, d2 long")


def distance_cells(grid: DataFrame, key: str) -> DataFrame:
    """The distance map of a grid (key, y, x, obst) as a cell table (key, y, x, obst, gy, oy, ox, d2)."""
    return with_rows_nearest(with_columns_nearest(grid, key), key)


def distances(free: DataFrame, key: str) -> DataFrame:
    """(key, y, x, dist) of the free cells; what is not free is obstacle, a rim around the grid included."""
    return distance_cells(grid_of(free, key), key).where("NOT obst").select(key, "y", "x", F.sqrt("d2").alias("dist"))


def middle_lines(free: DataFrame, key: str) -> DataFrame:
    """(key, y, x) of the cells between two obstacles that do not touch; of two neighbours the one that is nearer to the other's obstacle, or both."""
    cells = staged(distance_cells(grid_of(free, key), key).where("d2 IS NOT NULL").select(key, "y", "x", "oy", "ox", "d2"))
    shift = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, 0), (1, 1), (1, -1))]))
    left = cells.withColumn("_s", shift).select(key, F.col("y").alias("ay"), F.col("x").alias("ax"), (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"), F.col("oy").alias("py"), F.col("ox").alias("px"), F.col("d2").alias("a2"))
    both = left.join(cells, [key, "y", "x"])
    apart = (F.abs(F.col("py") - F.col("oy")) > 1) | (F.abs(F.col("px") - F.col("ox")) > 1)
    both = both.where(((F.col("a2") > 1) | (F.col("d2") > 1)) & apart)
    square = lambda a, b, c, d: (F.col(a) - F.col(b)) ** 2 + (F.col(c) - F.col(d)) ** 2
    to_other, from_other = square("ay", "oy", "ax", "ox"), square("y", "py", "x", "px")
    ends = F.array(F.when(to_other <= from_other, F.struct(F.col("ay").alias("y"), F.col("ax").alias("x"))), F.when(from_other <= to_other, F.struct("y", "x")))
    return both.select(key, F.explode(F.array_compact(ends)).alias("_c")).select(key, "_c.y", "_c.x").distinct()


def updated(cells: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(the distance map after changes (key, y, x, obst), the rows (key, y) that were computed anew).

    Cells that are free again raise the distances around them, new obstacles lower
    them.  Only columns that hold a change are looked through, and only rows in which
    a column's nearest obstacle moved are computed; all other cells stay as they are.
    Changes off the grid change nothing; of two for one cell an obstacle counts.
    ``cells`` should be a written table.
    """
    changes = changes.groupBy(key, "y", "x").agg(F.max("obst").alias("_new"))
    columns = changes.select(key, "x").distinct()
    old = cells.join(columns, [key, "x"], "left_semi").join(changes, [key, "y", "x"], "left")
    fresh = with_columns_nearest(old.select(key, "y", "x", F.coalesce("_new", "obst").alias("obst"), F.col("obst").alias("_was"), F.col("gy").alias("_gy")), key)
    moved = staged(fresh.where("obst <> _was OR NOT gy <=> _gy").select(key, "y", "x", F.col("obst").alias("_obst"), F.col("gy").alias("_gy")))
    rows = staged(moved.select(key, "y").distinct())
    touched = cells.join(rows, [key, "y"], "left_semi").join(moved.withColumn("_moved", F.lit(True)), [key, "y", "x"], "left")
    pick = lambda c: F.when(F.col("_moved"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    again = with_rows_nearest(touched.select(key, "y", "x", pick("obst"), pick("gy")), key)
    return cells.join(rows, [key, "y"], "left_anti").select(*again.columns).unionByName(again), rows


def combined(cells: DataFrame, other: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The map with the cells freed that are free in the other one, as ``updated`` gives it; the map of the joint obstacles where both cover the same cells."""
    freed = cells.where("obst").join(other.where("NOT obst").select(key, "y", "x"), [key, "y", "x"], "left_semi")
    return updated(cells, freed.select(key, "y", "x", F.lit(False).alias("obst")), key)


# --- territories ------------------------------------------------------------------------


def in_scan_order(nodes: DataFrame, key: str) -> DataFrame:
    """nodes with id, from 1 by (y, x) within a key: places in a row, after the counts of the rows before it."""
    rows = nodes.groupBy(key, "y").agg(F.count("*").alias("_n"))
    rows = rows.select(key, "y", (F.sum("_n").over(W.partitionBy(key).orderBy("y").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy(key, "y").orderBy("x"))
    return nodes.withColumn("_place", place).join(rows, [key, "y"]).withColumn("id", F.col("_before") + F.col("_place")).drop("_before", "_place")


def tile_of(c: str, by: int = 0) -> Column:
    return F.floor((F.col(c) + by) / TILE).cast("long")


def settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """One tile's labels (steps * STEP + id) after spreading by sides through its cells; rows beyond its border only give theirs."""
    none = np.iinfo(np.int64).max // 2
    y0, x0 = int(pdf["y"].min()) - 1, int(pdf["x"].min()) - 1
    label = np.full((int(pdf["y"].max()) - y0 + 2, int(pdf["x"].max()) - x0 + 2), none)
    at = pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0
    label[at] = pdf["label"].fillna(none).to_numpy(np.int64)
    open_ = np.zeros(label.shape, bool)
    inside = ~pdf["beyond"].to_numpy(bool)
    open_[at[0][inside], at[1][inside]] = True
    while True:
        near = np.full(label.shape, none)
        near[1:-1, 1:-1] = np.minimum.reduce([label[:-2, 1:-1], label[2:, 1:-1], label[1:-1, :-2], label[1:-1, 2:]])
        better = open_ & (near < none) & (near + STEP < label)
        if not better.any():
            break
        label[better] = near[better] + STEP
    out = pdf[inside].copy()
    found = label[at][inside]
    before = out["label"].fillna(none).to_numpy(np.int64)
    return out.assign(label=pd.Series(found, index=out.index, dtype="Int64").where(found < none), moved=found < before)


def territories(cells: DataFrame, key: str, rounds: int = 10_000) -> DataFrame:
    """(key, y, x, is_edge, id, steps) of cells (key, y, x, is_edge): the node that reaches a cell in the fewest steps by sides along edge cells.

    Nodes are numbered from 1 in scan order; ties go to the lesser number; id and
    steps are null where none reaches.  Tiles settle by themselves; those beside a
    border that moved settle again, until none does.
    """
    nodes = in_scan_order(cells.where("NOT is_edge").select(key, "y", "x").distinct(), key)
    every = cells.groupBy(key, "y", "x").agg(F.min("is_edge").alias("is_edge"))
    now = every.join(nodes, [key, "y", "x"], "left").select(key, "y", "x", "is_edge", F.col("id").cast("long").alias("label"), F.lit(True).alias("moved"), tile_of("y").alias("ty"), tile_of("x").alias("tx"))
    kind, names = dict(cells.dtypes)[key], now.columns
    schema = f"{key} {kind}, y long, x long, is_edge boolean, label long, moved boolean, ty long, tx long, beyond boolean"
    settled = lambda df: df.groupBy(key, "ty", "tx").applyInPandas(lambda pdf: settle(pdf), schema).select(*names)
    now = staged(settled(now.withColumn("beyond", F.lit(False))).withColumn("moved", F.col("label").isNotNull()))
    sides = F.array(*[F.struct(tile_of("y", dy).alias("ty"), tile_of("x", dx).alias("tx")) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    for _ in range(rounds):
        across = now.where("moved").withColumn("_t", F.explode(F.array_distinct(sides))).where("_t.ty <> ty OR _t.tx <> tx")
        across = staged(across.select(key, "y", "x", "is_edge", "label", "moved", "_t.ty", "_t.tx", F.lit(True).alias("beyond")))
        if across.isEmpty():
            break
        tiles = F.broadcast(across.select(key, "ty", "tx").distinct()) if across.count() < 100_000 else across.select(key, "ty", "tx").distinct()
        again = now.join(tiles, [key, "ty", "tx"], "left_semi").select(*names, F.lit(False).alias("beyond")).unionByName(across)
        rest = now.join(tiles, [key, "ty", "tx"], "left_anti").select(*names).withColumn("moved", F.lit(False))
        now = staged(rest.unionByName(settled(again)))
    else:
        raise RuntimeError(f"territories still move after {rounds} rounds")
    return now.select(key, "y", "x", "is_edge", (F.col("label") % STEP).alias("id"), F.floor(F.col("label") / STEP).cast("long").alias("steps"))
