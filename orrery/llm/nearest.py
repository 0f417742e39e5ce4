"""Approximate nearest neighbours: stable projections of few dimensions, searched by kd-tree until a chi-square test holds.

Largest inner product becomes nearest Euclidean by one more coordinate
sqrt(M^2 - |x|^2), M the largest norm of all rows; queries get 0 there.  Vectors
are projected on DIMS random normal directions: for a pair at distance d, the
squared projected distance over d^2 is chi-square with DIMS degrees.  A kd-tree over
the projections, its upper splits fitted on at most SAMPLE rows, deals every row to
a cell; within a cell it goes on to leaves.  A query first meets its own cell.  What
it found there bounds the distance of its k-th, and by the chi-square test every
cell whose box lies beyond is left out: only the others are visited, in a second
round.  In a cell the nearest leaf comes first and the rest in order, each only for
the queries whose test it does not fail; a leaf's rows are verified on the original
vectors in double precision.  So a query stops when a row nearer than its present
k-th would, with probability CONFIDENCE, have been met already.

What a query costs follows the cells that the test cannot exclude.  Vectors without
any structure in many dimensions leave nearly all of them, and the work then grows
with queries times rows, as it must for any exclusion by distance.  Cells above
BLOCK_ROWS rows and sets above QUERY_ROWS queries are split.

Vectors that are null, empty, zero or hold null or non-finite components, or whose
length is not the table's most common one, take no part; nor do rows without id.
Equal scores go to the smaller id.  Rows that repeat an id are candidates each; as
queries they are one, asked with the least of their vectors, and none of them is its
own candidate.  A query with fewer candidates than k gets them all; an empty table
gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from orrery.llm.common import columns_of, staged, table

DIMS = 8
CONFIDENCE = 0.98
LEAF = 256
#: Rows that the upper splits are fitted on, rows aimed at in a cell, and the most cells.
SAMPLE, CELL_ROWS, MOST_CELLS = 65536, 8192, 4096
BLOCK_ROWS = 16384
QUERY_ROWS = 8192
SEED = 23


@lru_cache(maxsize=None)
def chi_square_limit(dims: int, confidence: float) -> float:
    """The value that chi-square with an even number of degrees stays below with ``confidence`` (bisection on its closed form)."""
    import math

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1.0 - math.exp(-x / 2) * total

    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < confidence else (lo, mid)
    return hi


def directions(width: int, dims: int = DIMS) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, dims))


def kd_leaves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Leaves of a kd-tree: halve at the median of the widest dimension until a part has ``leaf`` rows."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            done.append(rows)
            continue
        part = points[rows]
        axis = int(np.argmax(part.max(0) - part.min(0)))
        order = np.argpartition(part[:, axis], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return done


class Cells:
    """The upper splits of the kd-tree, a full binary tree in heap order."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.at = np.zeros(1 << depth, dtype=np.int64), np.full(1 << depth, np.inf)
        parts = {1: points}
        for node in range(1, 1 << depth):
            part = parts.pop(node)
            if len(part):
                axis = int(np.argmax(part.max(0) - part.min(0)))
                self.axis[node], self.at[node] = axis, np.median(part[:, axis])
            right = part[:, self.axis[node]] >= self.at[node]
            parts[2 * node], parts[2 * node + 1] = part[~right], part[right]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.at[node])
        return node - (1 << self.depth)


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def projected(vectors: np.ndarray, top: float | None) -> np.ndarray:
    """Projections of rows with their added coordinate, or, without ``top``, of queries."""
    last = np.zeros(len(vectors)) if top is None else np.sqrt(np.maximum(top * top - np.einsum("ij,ij->i", vectors, vectors), 0.0))
    return np.column_stack([vectors, last]) @ directions(vectors.shape[1] + 1)


def gaps(aims: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared projected distance of each aim to each box."""
    out = np.zeros((len(aims), len(low)))
    for d in range(aims.shape[1]):
        a = aims[:, d : d + 1]
        gap = np.maximum(np.maximum(low[:, d] - a, a - high[:, d]), 0.0)
        out += gap * gap
    return out


def reach(vectors: np.ndarray, worst: np.ndarray, top: float, confidence: float = CONFIDENCE) -> np.ndarray:
    """The squared projected distance beyond which no row can matter to each query, but with small probability."""
    far = chi_square_limit(DIMS, confidence) * np.maximum(top * top + np.einsum("ij,ij->i", vectors, vectors) - 2 * worst, 0.0) * (1 + 1e-9)
    return np.where(np.isfinite(worst), far, np.inf)


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, worst: np.ndarray, k: int, top: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best in this block, under the stopping test; ``worst`` is the score to beat, or -inf."""
    points, aims = projected(vectors, top), projected(queries, None)
    leaves = kd_leaves(points)
    order, size = np.concatenate(leaves), np.array([len(x) for x in leaves])
    bounds = np.concatenate([[0], np.cumsum(size)])
    ids, vectors, points = ids[order], vectors[order], points[order]
    away = gaps(aims, np.minimum.reduceat(points, bounds[:-1]), np.maximum.reduceat(points, bounds[:-1]))
    slack = 1e-12 * (1.0 + top * np.sqrt(np.einsum("ij,ij->i", queries, queries)))
    worst, state, pending = worst.copy(), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), []

    def meet(leaf: int, asked: np.ndarray) -> None:
        rows = slice(bounds[leaf], bounds[leaf + 1])
        score = queries[asked] @ vectors[rows].T
        score[query_ids[asked][:, None] == ids[rows]] = -np.inf
        least = worst[asked]
        if score.shape[1] > k:
            least = np.maximum(least, np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k])
        a, b = np.nonzero((score >= (least - slack[asked])[:, None]) & (score > -np.inf))
        # products of matrices differ in the last bit by place: what counts is summed row by row
        pending.append((asked[a], ids[rows][b], np.einsum("ij,ij->i", queries[asked[a]], vectors[rows][b])))

    def settle() -> None:
        nonlocal state
        q, i, s = (np.concatenate([state[x], *[p[x] for p in pending]]) for x in range(3))
        by = np.lexsort((i, -s, q))
        q, i, s = q[by], i[by], s[by]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        full = place == k - 1
        worst[q[full]] = np.maximum(worst[q[full]], s[full])
        state = q[place < k], i[place < k], s[place < k]
        pending.clear()

    nearest_leaf = away.argmin(1)
    for leaf in np.unique(nearest_leaf):
        meet(int(leaf), np.flatnonzero((nearest_leaf == leaf) & (away[:, leaf] <= reach(queries, worst, top))))
    settle()
    for leaf in np.argsort(away.mean(0), kind="stable").tolist():
        asked = np.flatnonzero((nearest_leaf != leaf) & (away[:, leaf] <= reach(queries, worst, top)))
        if len(asked):
            meet(leaf, asked)
            if sum(len(p[0]) for p in pending) > 2 * k * len(queries):
                settle()
    settle()
    return query_ids[state[0]], state[1], state[2]


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


FOUND = "query_id long, vec_id long, score double"


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product for each query, other than itself.

    ``is_query`` is a condition on the id, here called ``id``.
    """
    spark = rows.sparkSession
    good = columns_of(rows, id_column, vector).toDF("id", "v").withColumn("v", F.col("v").cast("array<double>")).where(F.col("id").isNotNull() & usable(F.col("v")))
    facts = good.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).orderBy(F.desc("n"), "width").first()
    if facts is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, top = facts["width"], float(np.sqrt(facts["top"]))
    good = good.where(F.size("v") == width)
    depth = max(0, int(np.ceil(np.log2(min(facts["n"] / CELL_ROWS, MOST_CELLS)))))
    sample = np.array([r["v"] for r in good.orderBy(F.xxhash64("id")).limit(SAMPLE).select("v").toLocalIterator()]) if depth else np.zeros((0, width))
    cells = Cells(projected(sample, top), depth)

    def place(batches):
        for batch in batches:
            points = projected(matrix(batch.column("v"), width), top)
            p = pa.ListArray.from_arrays(pa.array(np.arange(len(points) + 1) * DIMS, pa.int32()), pa.array(points.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cells.of(points).astype(np.int32)), p, batch.column("v")], names=["id", "cell", "p", "v"])

    placed = staged(good.mapInArrow(place, "id long, cell int, p array<double>, v array<double>"))
    # one row for each cell, of which there are at most MOST_CELLS
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *[f(F.col("p")[d]).alias(f"{name}{d}") for d in range(DIMS) for name, f in (("low", F.min), ("high", F.max))]).orderBy("cell").collect()
    low, high = (np.array([[r[f"{name}{d}"] for d in range(DIMS)] for r in boxes]) for name in ("low", "high"))
    numbers = np.array([r["cell"] for r in boxes], dtype=np.int32)
    # a query's own cell is that of its projection as a query
    asked = placed.where(is_query).groupBy("id").agg(F.min("v").alias("v"))

    def in_reach(batches):
        """The cells that a query has still to visit: a new one (worst is NaN) the nearest, then all others that its test does not exclude."""
        for batch in batches:
            vectors, worst = matrix(batch.column("v"), width), batch.column("worst").to_numpy(zero_copy_only=False)
            away = gaps(projected(vectors, None), low, high)
            nearest_cell = away.argmin(1)
            new = np.isnan(worst)
            visit = away <= reach(vectors, np.where(new, -np.inf, worst), top)[:, None]
            visit[new] = False
            visit[np.arange(len(away)), nearest_cell] = new
            q, c = np.nonzero(visit)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(q)), batch.column("v").take(pa.array(q)), pa.array(numbers[c]), pa.array(np.where(new, -np.inf, worst)[q])], names=["id", "v", "cell", "worst"])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            number = lambda t, c: t.column(c).to_numpy()
            found = search_block(number(left, "id"), matrix(left.column("v"), width), number(right, "id"), matrix(right.column("v"), width), number(right, "worst"), k, top)
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    def visited(queries: DataFrame) -> DataFrame:
        """FOUND of the queries, a row for each cell to visit, with the score to beat."""
        queries = staged(queries.mapInArrow(in_reach, "id long, v array<double>, cell int, worst double"))
        sizes = {r["cell"]: r["n"] for r in boxes}
        split = [(r["cell"], -(-sizes[r["cell"]] // BLOCK_ROWS), -(-r["count"] // QUERY_ROWS)) for r in queries.groupBy("cell").count().collect()]
        split = F.broadcast(spark.createDataFrame(split, "cell int, blocks int, sets int"))
        dealt = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        data = placed.join(split, "cell").select("cell", dealt("blocks", 1).alias("block"), every("sets").alias("set"), "id", "v")
        put = queries.join(split, "cell").select("cell", every("blocks").alias("block"), dealt("sets", 2).alias("set"), "id", "v", "worst")
        by = ("cell", "block", "set")
        return data.groupBy(*by).cogroup(put.groupBy(*by)).applyInArrow(work, FOUND)

    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    home = staged(ranked(visited(asked.withColumn("worst", F.lit(float("nan"))))).drop("rank"))
    bound = home.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("worst"))
    rest = asked.join(bound, "id", "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf"))))
    return ranked(home.unionByName(visited(rest))).select("query_id", "rank", "vec_id", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


OP2_SQL = """
WITH good AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
  FROM good q JOIN good c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored) WHERE rank <= 20
"""
