"""All-pairs cosine with a threshold, by blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Rows of one block: a pair of blocks is one matrix product in one task.
BLOCK = 2048
#: Blocks up to which they stay that small, and how many times that their rows may become beyond.
FEW, LARGE = 16, 16
#: Rows of a block where every pair is a row of the result.
DENSE_BLOCK = 1024


def in_blocks(rows: DataFrame, key: str, by: Sequence[str], block: int) -> DataFrame:
    """The rows with block, lo and hi, once for each two blocks of their group: its rows are dealt by hash of the key into blocks of about ``block``."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    dealt = rows.join(sizes, list(by)) if by else rows.join(F.broadcast(sizes), F.lit(True))
    dealt = dealt.withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(key), "_blocks").cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.select(*rows.columns, "block", F.least("block", "_other").alias("lo"), F.greatest("block", "_other").alias("hi"))


def sides(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The rows of block lo and of block hi, which may be the same."""
    lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
    return pdf[pdf["block"] == lo], pdf[pdf["block"] == hi]


def cosines(a: pd.Series, b: pd.Series) -> np.ndarray:
    """The cosine of every two vectors; a product of norms below 1e-8 counts as that."""
    x, y = np.stack(a.to_numpy()).astype(float), np.stack(b.to_numpy()).astype(float)
    return x @ y.T / np.maximum(np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1), 1e-8)


def blocks_of(n: int, block: int) -> int:
    """How many blocks n rows make: of ``block`` rows while they are few, then of up to LARGE times that."""
    return max(min(max(1, -(-n // block)), FEW), -(-n // (block * LARGE)))


def best_matches(left: DataFrame, right: DataFrame, key: str, right_key: str, vector: str, above: float, digits: int = 9, block: int = BLOCK) -> DataFrame:
    """(key, right_key, c): each left row's right row of the largest cosine, rounded, if that exceeds ``above``; ties to the least right_key.

    A block of each side meets in one task, which keeps one row for each of the left's.
    """
    kinds = dict(left.dtypes)[key], dict(right.dtypes)[right_key]
    side = lambda df, k, name: df.where(F.col(k).isNotNull() & F.col(vector).isNotNull()).select(F.col(k).alias("id"), F.col(vector).alias("v"), F.lit(name).alias("side"))
    n_left, n_right = blocks_of(left.count(), block), blocks_of(right.count(), block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    placed = side(left, key, "l").withColumns({"i": own(n_left), "j": every(n_right)}).unionByName(side(right, right_key, "r").withColumns({"i": every(n_left), "j": own(n_right)}))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True)
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
        ids, is_left = pdf["id"].to_numpy(), (pdf["side"] == "l").to_numpy()
        lefts, rights = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        rights = rights[np.argsort(ids[rights], kind="stable")]
        for a in range(0, len(lefts), block):
            rows = lefts[a : a + block]
            top, at = np.full(len(rows), -np.inf), np.zeros(len(rows), dtype=int)
            for b in range(0, len(rights), block):
                c = np.round(x[rows] @ x[rights[b : b + block]].T, digits)
                j = c.argmax(1)  # the first of equals, as ids rise
                c = c[np.arange(len(rows)), j]
                more = c > top
                top[more], at[more] = c[more], rights[b + j[more]]
            good = top > above
            if good.any():
                yield pd.DataFrame({"l": ids[rows][good], "r": ids[at][good], "c": top[good]})

    found = placed.groupBy("i", "j").applyInPandas(best, f"l {kinds[0]}, r {kinds[1]}, c double")
    return found.groupBy(F.col("l").alias(key)).agg(F.max(F.struct("c", (-F.col("r")).alias("n"))).alias("m")).select(key, (-F.col("m.n")).alias(right_key), F.col("m.c").alias("c"))


def similar_pairs(df: DataFrame, key: str, vector: str, above: float, digits: int = 9, block: int = BLOCK, carry: Sequence[str] = (), raw: bool = False) -> DataFrame:
    """(src, dst, c) of every two rows whose cosine, rounded, exceeds ``above``; src < dst.

    Rows are dealt into blocks by hash of the key and every two blocks meet in one
    task, so a row is sent once for each block and only pairs above the threshold
    leave the product.  Blocks are of ``block`` rows while they are few; beyond FEW
    they grow up to LARGE times that, and a task goes through its two in tiles of
    ``block`` rows.  Vectors travel as they are given, floats as floats.  The
    columns ``carry`` of both ends come along as <column>_src and <column>_dst, with
    ``raw`` the cosine as it is too.  Zero vectors have similarity 0; null vectors take no part.
    """
    kinds = dict(df.dtypes)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), *carry).where("id IS NOT NULL AND v IS NOT NULL")
    n = rows.count()
    blocks = blocks_of(n, block)
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", other)
    placed = placed.select("id", "v", *carry, "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches), ignore_index=True)
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        x = np.stack(pdf["v"].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
        ids, left = pdf["id"].to_numpy(), (pdf["block"] == lo).to_numpy()
        tiles = lambda own: [own[i : i + block] for i in range(0, len(own), block)]
        lefts, rights = tiles(np.flatnonzero(left)), tiles(np.flatnonzero(left if lo == hi else ~left))
        ends = {c: pdf[c].to_numpy() for c in carry}
        for a in range(len(lefts)):
            for b in range(a if lo == hi else 0, len(rights)):
                c = x[lefts[a]] @ x[rights[b]].T
                i, j = np.nonzero(c > above - 10.0**-digits)  # few are rounded
                exact = c[i, j]
                c, i, j = np.round(exact, digits), lefts[a][i], rights[b][j]
                keep = (c > above) & ((ids[i] < ids[j]) if lo == hi and a == b else (ids[i] != ids[j]))
                exact, c, i, j = exact[keep], c[keep], i[keep], j[keep]
                turned = ids[i] > ids[j]
                i, j = np.where(turned, j, i), np.where(turned, i, j)
                if len(i):
                    out = {"src": ids[i], "dst": ids[j], "c": c}
                    out |= {f"{name}_{end}": v[at] for name, v in ends.items() for end, at in (("src", i), ("dst", j))}
                    yield pd.DataFrame(out | ({"cosine": exact} if raw else {}))

    schema = ["src long", "dst long", "c double", *[f"{c}_{end} {kinds[c]}" for c in carry for end in ("src", "dst")], *(["cosine double"] if raw else [])]
    return placed.groupBy("lo", "hi").applyInPandas(product, ", ".join(schema))
