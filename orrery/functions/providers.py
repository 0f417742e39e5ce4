"""Where vectors and masks come from (M1-M7): pluggable models as vectorised functions, or tables of their results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

Model = Callable[[Sequence[object]], np.ndarray]


def embedder(model: Model) -> Callable[[Column | str], Column]:
    """M1-M3: a column function that gives unit vectors for texts or image bytes, a batch at a time; null for null.

    ``model`` maps a list of inputs to an array of one row each.
    """

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(values: pd.Series) -> pd.Series:
        out: list[list[float] | None] = [None] * len(values)
        known = [i for i, v in enumerate(values) if v is not None]
        if known:
            rows = np.asarray(model([values.iloc[i] for i in known]), dtype=float)
            rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
            for i, row in zip(known, rows):
                out[i] = row.astype(np.float32).tolist()
        return pd.Series(out)

    return embed


def looked_up(inputs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """M1 by a table of results (key, emb): what is not in it gets null."""
    return inputs.join(known.select(key, "emb"), key, "left")


def merged_masks(masks: DataFrame, of: Sequence[str]) -> DataFrame:
    """M4: one mask for each class: the distinct pixels of all its masks."""
    return masks.select(*of, "y", "x").distinct()


def dilated(masks: DataFrame, of: Sequence[str], radius: int = 2, times: int = 1) -> DataFrame:
    """M7: the pixels within ``radius`` (square) of a mask, ``times`` over."""
    reach = radius * times
    near = F.sequence(F.lit(-reach), F.lit(reach))
    rows = masks.withColumn("_dy", F.explode(near)).withColumn("_dx", F.explode(near))
    return rows.select(*of, (F.col("y") + F.col("_dy")).alias("y"), (F.col("x") + F.col("_dx")).alias("x")).distinct()


def uncovered(masks: DataFrame, cover: DataFrame, frame: Sequence[str], mask: str, share: float = 0.5) -> DataFrame:
    """The pixels of masks of which at least ``share`` lies outside ``cover``; only those pixels; empty masks give none."""
    total = masks.groupBy(*frame, mask).agg(F.count("*").alias("_all"))
    left = masks.join(cover.select(*frame, "y", "x").distinct(), [*frame, "y", "x"], "left_anti")
    kept = left.groupBy(*frame, mask).agg(F.count("*").alias("_left")).join(total, [*frame, mask]).where(F.col("_left") >= share * F.col("_all"))
    return left.join(kept.select(*frame, mask), [*frame, mask], "left_semi")
