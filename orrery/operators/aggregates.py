"""Group aggregates over vectors and labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from orrery.functions.vectors import cosine, normalised
from orrery.operators import similarity


def width_of(df: DataFrame, vector: str) -> int:
    """Length of the vectors, from one row."""
    row = df.where(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
    return row["n"] if row else 0


def mode(counts: DataFrame, key: str, value: str, count: str, support: int = 1) -> DataFrame:
    """Each key's most counted value, ties to the least; -1 where that has less than ``support``."""
    best = counts.groupBy(key).agg(F.max(F.struct(F.col(count), (-F.col(value)).alias("_neg"))).alias("_best"))
    return best.select(key, F.when(F.col(f"_best.{count}") >= support, -F.col("_best._neg")).otherwise(-1).alias(value), F.col(f"_best.{count}").alias(count))


def weighted_mean(df: DataFrame, key: str, vector: str, weight: Column | float = 1.0, unit: bool = True) -> DataFrame:
    """sum(w v) / sum(w) of each key, of length 1 if ``unit``.

    One sum per dimension in a single aggregation: partial sums combine before the
    shuffle, and nothing is exploded.
    """
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    n = width_of(df, vector)
    sums = df.groupBy(key).agg(*[F.sum(F.col(vector)[i] * w).alias(f"_s{i}") for i in range(n)], F.sum(w).alias("_w"))
    mean = F.array(*[F.col(f"_s{i}") / F.col("_w") for i in range(n)])
    out = sums.select(key, mean.alias("emb"))
    return out.select(key, normalised(F.col("emb")).alias("emb")) if unit else out


def medoid(df: DataFrame, key: str, item: str, vector: str, weight: Column | float = 1.0) -> DataFrame:
    """Each key's item of the largest weighted sum of cosines to all of its items; ties to the least item.

    Sum over j of w_j cos(x_i, x_j) is the product of x_i / |x_i| with the sum of
    w_j x_j / |x_j|, so one mean and one join replace the self join.
    """
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    kinds = dict(df.dtypes)
    names = f"`{key}` {kinds[key]}, `{item}` {kinds[item]}"

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def unit_vectors(batches):
        """Vectors of length 1, by Arrow batch: as expressions over arrays they cost more than the sums themselves."""
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column("_v"))
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                u = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(item), u, batch.column("_wt")], names=[key, item, "_u", "_wt"])

    def products(batches):
        for batch in batches:
            if batch.num_rows:
                s = np.einsum("ij,ij->i", matrix(batch.column("_u")), matrix(batch.column("_total")))
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(item), pa.array(s)], names=[key, item, "s"])

    rows = df.where(F.col(vector).isNotNull()).select(key, item, F.col(vector).cast("array<double>").alias("_v"), w.cast("double").alias("_wt"))
    unit = rows.mapInArrow(unit_vectors, f"{names}, _u array<double>, _wt double")
    total = weighted_mean(unit, key, "_u", F.col("_wt"), unit=False).withColumnRenamed("emb", "_total")
    scored = unit.join(total, key).select(key, item, "_u", "_total").mapInArrow(products, f"{names}, s double")
    best = scored.groupBy(key).agg(F.max(F.struct(F.round("s", 12).alias("s"), (-F.col(item)).alias("neg"))).alias("_b"))
    return best.select(key, (-F.col("_b.neg")).alias(item))


def trimmed_mean(df: DataFrame, key: str, item: str, vector: str, weight: str, trim: float) -> DataFrame:
    """Weighted mean of the int(n (1 - trim)) items nearest (cosine) to the group's mean; null if none is kept; not of length 1."""
    centre = weighted_mean(df, key, vector, F.col(weight)).withColumnRenamed("emb", "_centre")
    far = df.join(centre, key).withColumn("_d", F.round(1 - cosine(F.col(vector), F.col("_centre")), 12))
    order = W.partitionBy(key).orderBy("_d", item)
    ranked = far.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count("*").over(W.partitionBy(key)))
    kept = ranked.where(F.col("_r") <= F.floor(F.col("_n") * (1 - trim)))
    return df.select(key).distinct().join(weighted_mean(kept, key, vector, F.col(weight), unit=False), key, "left")


def outliers(df: DataFrame, key: str, vector: str, weight: str, limit: float = 0.3) -> DataFrame:
    """How many of each key's items are farther than ``limit`` (cosine) from its mean."""
    centre = weighted_mean(df, key, vector, F.col(weight)).withColumnRenamed("emb", "_centre")
    return df.join(centre, key).groupBy(key).agg(F.count(F.when(1 - cosine(F.col(vector), F.col("_centre")) > limit, 1)).alias("n_outliers"))


def geometric_median(df: DataFrame, key: str, vector: str, weight: str, tol: float = 1e-6, rounds: int = 100) -> DataFrame:
    """Weiszfeld's iteration under cosine distance, from the weighted mean; the iterate before the last small step."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x, w = np.stack(pdf[vector].to_numpy()).astype(float), pdf[weight].to_numpy(dtype=float)
        m = (w[:, None] * x).sum(0) / w.sum()
        for _ in range(rounds):
            d = 1 - (x @ m) / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(m), 1e-8)
            v = w / (d + 1e-12)
            step = (v[:, None] * x).sum(0) / v.sum()
            if np.linalg.norm(step - m) < tol:
                break
            m = step
        return pd.DataFrame({key: [pdf[key].iloc[0]], "emb": [m.tolist()]})

    return df.select(key, vector, weight).groupBy(key).applyInPandas(solve, f"{key} {dict(df.dtypes)[key]}, emb array<double>")


def spread(df: DataFrame, key: str, item: str, vector: str) -> DataFrame:
    """1 less the least cosine between two items of a key; every two blocks of a key's items are one matrix product."""
    kind = dict(df.dtypes)[key]
    rows = df.where(F.col(key).isNotNull() & F.col(item).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(item).alias("item"), F.col(vector).alias("v"))

    def least(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = similarity.sides(pdf)
        if not len(a) or not len(b):
            return pd.DataFrame({"key": [], "least": []})
        c = similarity.cosines(a["v"], b["v"])
        c[a["item"].to_numpy()[:, None] == b["item"].to_numpy()] = np.inf
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "least": [c.min()]}).query("least < inf")

    found = similarity.in_blocks(rows, "item", ["key"], similarity.BLOCK).groupBy("key", "lo", "hi").applyInPandas(least, f"key {kind}, least double")
    return found.groupBy(F.col("key").alias(key)).agg((1 - F.min("least")).alias("spread"))


def majority_vote(points: DataFrame, cluster: str, task: str, scores: str) -> DataFrame:
    """Each cluster's most frequent task (ties to the least), and the mean of that task's score vectors, largest first."""
    n = width_of(points, scores)
    each = points.groupBy(cluster, task).agg(F.count("*").alias("n"), *[F.avg(F.col(scores)[i]).alias(f"_s{i}") for i in range(n)], F.avg(F.array_max(scores)).alias("top_score"))
    best = F.max_by(F.struct(F.col(task).alias("task_idx"), "n", "top_score", F.array(*[F.col(f"_s{i}") for i in range(n)]).alias("scores")), F.struct("n", (-F.col(task)).alias("t")))
    return each.groupBy(cluster).agg(best.alias("b")).select(cluster, "b.*")


def argmin_first(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """A4: the value at the least of ``order``, the first of equals."""
    return df.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias(value))


def minmax(df: DataFrame, key: str, score: str) -> DataFrame:
    """Scores of each key stretched to 0..1; null where all are equal."""
    w = W.partitionBy(key)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn("scaled", F.when(hi > lo, (F.col(score) - lo) / (hi - lo)))


def histogram(df: DataFrame, score: str, bins: int = 50) -> DataFrame:
    """Counts in equal bins between the least and the largest score, the top included in the last."""
    ends = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor((F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("long")
    return df.join(F.broadcast(ends), F.lit(True)).groupBy(F.coalesce(at, F.lit(0)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
