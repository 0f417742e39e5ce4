"""Nearest rows and radius joins where cells are crowded or rows far apart."""

import numpy as np
import pytest

from orrery.operators import graph, spatial


def frame(spark, points, key):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], f"{key} long, x double, y double")


def plain(left, right, k):
    out = {}
    for i, p in enumerate(left):
        d = ((right - p) ** 2).sum(1)
        out[i] = [int(j) for j in np.lexsort((np.arange(len(right)), d))[:k]]
    return out


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_with_outliers_and_dense_spots(spark, monkeypatch, k):
    monkeypatch.setattr(spatial, "ALL_PAIRS", 1_000)
    rng = np.random.default_rng(k)
    left = np.concatenate([rng.uniform(0, 1, (150, 2)), rng.normal(1e6, 1e-3, (20, 2)), [[-1e7, 5.0]]])
    right = np.concatenate([rng.uniform(0, 1, (200, 2)), np.full((30, 2), 0.5), [[1e6, 1e6], [3e7, 0.0]]])
    l, r = frame(spark, left, "a"), frame(spark, right, "b")
    got = {}
    for row in spatial.nearest(l, r, "a", "b", ["x", "y"], k=k).collect():
        got.setdefault(row["a"], {})[row["rank"]] = row["b"]
    assert {i: [m[j] for j in sorted(m)] for i, m in got.items()} == plain(left, right, k)
    size = spatial.first_size(r, ["x", "y"], [], 1e6, k)
    assert size < 1


def test_the_first_size_ends_where_rows_are_equal(spark):
    r = frame(spark, np.ones((500, 2)), "b")
    assert spatial.first_size(r, ["x", "y"], [], 4.0, 1) == 4.0


def test_crowded_cells_alone_are_split(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CELL_ROWS", 20)
    rng = np.random.default_rng(2)
    left, right = rng.uniform(0, 5, (60, 2)), np.concatenate([rng.uniform(0, 1, (150, 2)), rng.uniform(0, 5, (60, 2))])
    got = sorted((r["a"], r["b"]) for r in spatial.radius_join(frame(spark, left, "a"), frame(spark, right, "b"), 0.7, ["x", "y"]).select("l.a", "r.b").collect())
    want = sorted((i, j) for i, p in enumerate(left) for j, q in enumerate(right) if ((p - q) ** 2).sum() <= 0.49)
    assert got == want and len(got) == len(set(got)) > 100


def test_rounds_that_do_not_end_are_told(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)], "src long, dst long, weight double")
    with pytest.raises(RuntimeError, match="components still change"):
        graph.components(chain, rounds=1)
    with pytest.raises(RuntimeError, match="still getting cheaper"):
        graph.shortest_path(chain, 0, 40, rounds=5)
    levels = spark.createDataFrame([(i, i + 1) for i in range(8)], "id long, level int")
    with pytest.raises(RuntimeError, match="levels deep"):
        graph.closure(levels, chain.limit(7), depth=3)
