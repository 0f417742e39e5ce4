"""Nearest-in-time joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orrery.operators.lineage import staged

#: Rows of one chunk of a timeline, and the most chunks.
CHUNK_ROWS, MOST_CHUNKS = 500_000, 256


def chunk_of(rows: DataFrame, on: str) -> Column | None:
    """The number of a row's chunk, or None if one is enough: chunks follow in time, hold about CHUNK_ROWS rows each, and equal times share one."""
    chunks = min(MOST_CHUNKS, rows.count() // CHUNK_ROWS + 1)
    if chunks == 1:
        return None
    bounds = sorted(set(rows.agg(F.percentile_approx(on, [k / chunks for k in range(1, chunks)], 4 * MOST_CHUNKS)).first()[0]))
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(on)))


def beyond(out: DataFrame, both: DataFrame, by: list[str]) -> DataFrame:
    """out with _b and _a filled from the chunks before and after."""
    ends = both.where("_side = 0").groupBy(*by, "_chunk").agg(F.min("_mark").alias("_first"), F.max("_mark").alias("_last"))
    # every chunk of a key that has a left row, with the last mark before and the first after it
    ends = ends.unionByName(both.where("_side = 1").select(*by, "_chunk").distinct(), allowMissingColumns=True)
    ends = ends.groupBy(*by, "_chunk").agg(F.max("_first").alias("_first"), F.max("_last").alias("_last"))
    chunks = W.partitionBy(*by)
    ends = ends.withColumn("_before", F.max("_last").over(chunks.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)))
    ends = ends.withColumn("_after", F.min("_first").over(chunks.orderBy(F.desc("_chunk")).rowsBetween(W.unboundedPreceding, -1))).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("_chunk").alias("_c"), "_before", "_after")
    same = F.col("_chunk") == F.col("_c")
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = out.join(ends, same, "left")
    return out.withColumn("_b", F.coalesce("_b", "_before")).withColumn("_a", F.coalesce("_a", "_after"))


def around(left: DataFrame, marks: DataFrame, on: str, by: Sequence[str] = ()) -> DataFrame:
    """left with _b and _a, structs (t, the other columns of marks): the last mark at or before a row and the first at or after it.

    Both sides are tagged, unioned and dealt by key and chunk of time; within a chunk
    two running windows, one in each direction, carry the last mark along.  The first
    and last mark of each chunk, a small table, fill in what lies beyond a chunk's
    ends, so neither one timeline nor one hot key is one task.
    """
    by = list(by)
    carried = [c for c in marks.columns if c != on and c not in by]
    marks = marks.where(F.col(on).isNotNull()).select(*by, on, F.struct(F.col(on).alias("t"), *carried).alias("_mark"), F.lit(0).alias("_side"))
    both = left.withColumn("_side", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    chunk = chunk_of(both.select(on), on)
    both = both.withColumn("_chunk", F.lit(0)) if chunk is None else staged(both.withColumn("_chunk", chunk))
    running = lambda *order: W.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = both.withColumn("_b", F.last("_mark", ignorenulls=True).over(running(F.col(on), F.col("_side"))))
    out = out.withColumn("_a", F.last("_mark", ignorenulls=True).over(running(F.col(on).desc(), F.col("_side")))).where("_side = 1")
    return beyond(out, both, by) if chunk is not None else out


def nearest_asof(left: DataFrame, right: DataFrame, on: str, value: str, tolerance: float | None = None, by: Sequence[str] = (), keep: bool = False) -> DataFrame:
    """Each left row with the right row nearest in ``on``; on equal gaps the earlier.

    ``on`` is numeric.  Rows of the left whose nearest gap exceeds ``tolerance``
    (equality passes) are dropped, or kept with nulls if ``keep``.  Added are
    ``match_<on>``, ``match_<value>`` and ``gap``.  Of right rows at one time the one
    with the least ``value`` counts; a null key is one of its own, and null times
    match nothing.
    """
    out = around(left, right.groupBy(*by, on).agg(F.min(value).alias("v")), on, by)
    gap_b, gap_a = F.col(on) - F.col("_b.t"), F.col("_a.t") - F.col(on)
    pick = F.when(F.col("_a").isNull() | (gap_b <= gap_a), F.col("_b")).otherwise(F.col("_a"))
    out = out.withColumn("_m", pick).withColumn("gap", F.abs(F.col("_m.t") - F.col(on)))
    near = F.col("gap").isNotNull() if tolerance is None else F.col("gap") <= tolerance
    if keep:
        out = out.withColumn("_m", F.when(near, F.col("_m"))).withColumn("gap", F.when(near, F.col("gap")))
    else:
        out = out.where(near)
    return out.select(*left.columns, F.col("_m.t").alias(f"match_{on}"), F.col("_m.v").alias(f"match_{value}"), "gap")


def align(frames: DataFrame, streams: dict[str, DataFrame], on: str, value: str, tolerance: float) -> DataFrame:
    """Frames with the nearest row of every stream; a frame goes if any stream is beyond the tolerance."""
    out = frames
    for name, stream in streams.items():
        out = staged(nearest_asof(out, stream, on, value, tolerance))
        out = out.withColumnsRenamed({f"match_{on}": f"{name}_{on}", f"match_{value}": f"{name}_{value}", "gap": f"{name}_gap"})
    return out


def best_frame(frames: DataFrame, gaps: Sequence[Column], limit: float, order: str) -> DataFrame:
    """Of the aligned frames the one whose largest gap is least, if within the limit; ties to the first."""
    worst = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    return frames.withColumn("skew", worst).where(F.col("skew") <= limit).orderBy("skew", order).limit(1)
