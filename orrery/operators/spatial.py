"""Spatial joins by grid cells."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orrery.operators.lineage import staged

#: Pairs up to which all are compared: the right side is then broadcast (both sides counted, at most this many rows).
ALL_PAIRS = 1_000_000
#: Right rows of a grid cell from which it is split.
CELL_ROWS = 50_000
#: Right rows that a right row shares its first cell with, on average and for each neighbour asked for, at most.
SHARED = 8


def cell(x: Column | str, size: float) -> Column:
    return F.floor((F.col(x) if isinstance(x, str) else x) / size)


def distance2(dims: Sequence[str], left: str = "l", right: str = "r") -> Column:
    total = F.lit(0.0)
    for d in dims:
        total = total + (F.col(f"{left}.{d}") - F.col(f"{right}.{d}")) * (F.col(f"{left}.{d}") - F.col(f"{right}.{d}"))
    return total


def radius_join(left: DataFrame, right: DataFrame, radius: float, dims: Sequence[str], salt: int | None = None, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """Pairs within ``radius``, the border included, as l.* and r.* with d2; equal in the columns ``by``.

    With ``digits`` the square of the distance, d2, is rounded first, so that pairs on
    the border count whatever their coordinates' last bits.

    The left side is copied to the neighbouring cells, so give the smaller one
    there; the right is dealt by cell alone.  Crowded cells, and only they, are split:
    their right rows are dealt into parts of about CELL_ROWS, and left rows go to
    each of the parts; with ``salt`` every cell is dealt into that many.
    """
    most = radius * radius
    if digits is not None:
        radius = (most + 10.0**-digits) ** 0.5 * (1 + 1e-12)  # of the cells: what rounds down to the border lies within
    cells, keys = [f"_c{i}" for i in range(len(dims))], [f"_k{i}" for i in range(len(by))]
    around = F.array(*[F.struct(*[(cell(F.col(d), radius) + o).alias(c) for d, o, c in zip(dims, offset, cells)]) for offset in product((-1, 0, 1), repeat=len(dims))])
    far = right.select(F.struct(*[F.col(c) for c in right.columns]).alias("r"), *[cell(d, radius).alias(c) for d, c in zip(dims, cells)], *[F.col(b).alias(k) for b, k in zip(by, keys)])
    full = far.groupBy(*cells, *keys).count()
    crowded = staged(full.where(F.col("count") > CELL_ROWS if salt is None else F.lit(salt > 1)).select(*cells, *keys, (F.floor(F.col("count") / CELL_ROWS) + 1 if salt is None else F.lit(salt)).cast("int").alias("_parts")))
    near = left.select(F.struct(*[F.col(c) for c in left.columns]).alias("l"), F.explode(around).alias("_cell"), *[F.col(b).alias(k) for b, k in zip(by, keys)]).select("l", "_cell.*", *keys)
    if crowded.isEmpty():
        pairs = near.join(far, [*cells, *keys])
    else:
        parts = F.coalesce("_parts", F.lit(1))
        near = near.join(crowded, [*cells, *keys], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
        far = far.join(crowded, [*cells, *keys], "left").withColumn("_salt", F.pmod(F.xxhash64("r"), parts).cast("int")).drop("_parts")
        pairs = near.join(far, [*cells, *keys, "_salt"])
    pairs = pairs.withColumn("d2", distance2(dims) if digits is None else F.round(distance2(dims), digits))
    return pairs.where(F.col("d2") <= most).select("l", "r", "d2")


def first_size(right: DataFrame, dims: Sequence[str], by: Sequence[str], size: float, k: int) -> float:
    """The largest of ``size`` and its halves at which a right position shares its cell with at most SHARED * k others on average.

    Sizes are tried eight at a time, each by counts of its cells, so that far
    outliers or dense spots do not put all rows into one cell.  Equal positions
    count once, since no size parts them.
    """
    right = staged(right.select(*dims, *by).distinct())
    for _ in range(8):
        sizes = F.array(*[F.lit(size / 2**j) for j in range(8)])
        rows = right.select(*dims, *by, F.posexplode(sizes).alias("_j", "_size"))
        counts = rows.groupBy("_j", *by, *[F.floor(F.col(d) / F.col("_size")).alias(f"_c{i}") for i, d in enumerate(dims)]).count()
        found = {r["_j"]: r["shared"] for r in counts.groupBy("_j").agg((F.sum(F.col("count") * F.col("count").cast("double")) / F.sum("count")).alias("shared")).collect()}
        for j in range(8):
            if found.get(j, 0.0) <= SHARED * k:
                return size / 2**j
        size /= 2**8
    return size


def nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, dims: Sequence[str], by: Sequence[str] = (), k: int = 1, start: float | None = None, apart: str | None = None) -> DataFrame:
    """The k nearest right rows of each left row: (key, right_key, rank, d2); ties to the least right_key.

    ``by`` columns must be equal on both sides, the column ``apart`` must differ.  A grid is searched in rounds: cells
    are joined with their neighbours until k rows lie within one cell's size of a
    left row; rows that lack them go on to larger cells, up to a size that holds
    everything, or until what is left comes to ALL_PAIRS.  The first size follows from how full cells are, not from the
    whole extent alone.  Only up to ALL_PAIRS pairs (counted) are all compared.  Rows
    without a position match nothing.
    """
    by = list(by)
    differ = (lambda pairs: pairs.where(F.col(f"l.{apart}") != F.col(f"r.{apart}"))) if apart else lambda pairs: pairs
    placed = lambda df: df.where(" AND ".join(f"{d} IS NOT NULL" for d in dims))
    left, right = placed(left), placed(right)
    at = list(dict.fromkeys([*dims, *by, *([apart] if apart else [])]))
    left, right = left.select(key, *at), right.select(right_key, *at)
    n_left, n_right = left.count(), right.count()
    if k == 1 and n_left * n_right > ALL_PAIRS:  # of equal positions the least right_key is nearest, and what is nearest to one left row is so to its copies
        right = staged(right.groupBy(*at).agg(F.min(right_key).alias(right_key)))
        spots = staged(left.groupBy(*at).agg(F.min(key).alias(key)))
        n_right, n_spots = right.count(), spots.count()
        if 2 * n_spots <= n_left:
            found = nearest(spots, right, key, right_key, dims, by, start=start, apart=apart)
            return left.join(spots.withColumnRenamed(key, "_spot"), at).join(found.withColumnRenamed(key, "_spot"), "_spot").select(key, right_key, "rank", "d2")
    if n_left * n_right <= ALL_PAIRS:
        l, r = left.alias("l"), F.broadcast(right).alias("r")
        on = [F.col(f"l.{b}") == F.col(f"r.{b}") for b in by]
        pairs = differ(l.join(r, on if on else None, "inner" if on else "cross"))
        pairs = pairs.select(F.col(f"l.{key}").alias(key), F.col(f"r.{right_key}").alias(right_key), distance2(dims).alias("d2"))
        return _ranked(pairs, key, right_key, k)
    ends = left.select(*dims).unionByName(right.select(*dims)).agg(*[f(d).alias(f"{name}{d}") for d in dims for name, f in (("low", F.min), ("high", F.max))]).first()
    spans = [max(float(ends[f"high{d}"] - ends[f"low{d}"]), 1e-9) for d in dims]
    volume = 1.0
    for span in spans:
        volume *= span
    size, whole = start or first_size(right, dims, by, (volume * k / max(n_right, 1)) ** (1 / len(dims)), k), sum(span * span for span in spans) ** 0.5
    todo, done, rounds = left, None, 0
    while True:
        last = size >= whole  # all pairs lie within the size
        pairs = differ(radius_join(todo, right, size * (1 + 1e-9), dims, by=by))
        found = _ranked(pairs.select(F.col(f"l.{key}").alias(key), F.col(f"r.{right_key}").alias(right_key), "d2"), key, right_key, k)
        if not last:
            found = found.join(found.where(F.col("rank") == k).select(key), key, "left_semi")
        found = staged(found)
        done = found if done is None else done.unionByName(found)
        todo = staged(todo.join(found.select(key).distinct(), key, "left_anti"))
        rest = todo.count()
        if last or not rest:
            return done
        if rest * n_right <= ALL_PAIRS:
            return done.unionByName(nearest(todo, right, key, right_key, dims, by, k, apart=apart))
        size, rounds = size * (2 if rounds < 3 else 4), rounds + 1


def _ranked(pairs: DataFrame, key: str, right_key: str, k: int) -> DataFrame:
    if k == 1:
        best = pairs.groupBy(key).agg(F.min(F.struct("d2", right_key)).alias("m"))
        return best.select(key, F.col(f"m.{right_key}").alias(right_key), F.lit(1).cast("long").alias("rank"), F.col("m.d2").alias("d2"))
    rank = F.row_number().over(W.partitionBy(key).orderBy("d2", right_key)).cast("long")
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select(key, right_key, "rank", "d2")


def images_of_nearest(ranked: DataFrame, within: DataFrame, closest: DataFrame, key: str, point: str, strict: bool = True) -> DataFrame:
    """Of a point's k nearest, the first with images in range gives them; else the last with a closest image gives that.

    ``ranked`` has (key, point, rank); ``within`` (point, imgs); ``closest`` (point,
    img).  A key with neither raises when read, or has null if not ``strict``.
    """
    found = ranked.join(within, point, "left").join(closest, point, "left").groupBy(key).agg(
        F.min(F.when(F.col("imgs").isNotNull(), F.struct("rank", "imgs"))).alias("first"),
        F.max(F.when(F.col("img").isNotNull(), F.struct("rank", "img"))).alias("last"),
    )
    images = F.coalesce(F.col("first.imgs"), F.when(F.col("last").isNotNull(), F.array("last.img")))
    if not strict:
        return found.select(key, images.alias("imgs"))
    return found.select(key, F.when(images.isNull(), F.raise_error(F.lit("no image near the node"))).otherwise(images).alias("imgs"))
