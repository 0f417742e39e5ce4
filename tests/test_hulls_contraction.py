"""Contraction of edges, hulls and tight boxes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import graph, hulls


def plain_contraction(edges, most):
    """The cheapest edge first, one at a time; parallel edges summed."""
    table, parent = {}, {}
    for a, b, w in edges:
        parent |= {a: a, b: b}
        if a != b:
            k = (min(a, b), max(a, b))
            table[k] = table.get(k, 0) + w
    while table:
        (a, b), w = min(table.items(), key=lambda e: (e[1], e[0]))
        if w > most:
            break
        new = {}
        for (x, y), v in table.items():
            x, y = (a if n == b else n for n in (x, y))
            if x != y:
                k = (min(x, y), max(x, y))
                new[k] = new.get(k, 0) + v
        table = new
        parent = {n: a if p == b else p for n, p in parent.items()}
    return parent, table


def test_contraction_of_edges_apart(spark):
    """Summed weights only grow, so that what is contracted in rounds is what the sequential choice takes."""
    rng = random.Random(6)
    for most in (9.0, 30.0):
        edges = [(rng.randint(0, 30), rng.randint(0, 30), float(w)) for w in rng.sample(range(1, 200), 45)]
        parents, left = graph.contract(spark.createDataFrame(edges, "src long, dst long, weight double"), most=most)
        want, table = plain_contraction(edges, most)
        got = {r["id"]: r["parent"] for r in parents.collect()}
        assert got == want and {(r["src"], r["dst"]): r["weight"] for r in left.collect()} == table


def test_a_round_takes_no_two_edges_that_meet(spark):
    rows = [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 5, 0.5), (6, 7, 9.0), (7, 7, 0.1)]
    edges = spark.createDataFrame(rows[:-1], "src long, dst long, weight double")
    assert sorted((r["src"], r["dst"]) for r in graph.cheapest_apart(edges).collect()) == [(1, 2), (4, 5), (6, 7)]
    parents, left = graph.contract(spark.createDataFrame(rows, "src long, dst long, weight double"), most=100.0)
    assert {r["id"]: r["parent"] for r in parents.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6} and left.isEmpty()
    assert graph.contract(edges.limit(0))[0].isEmpty()
    with pytest.raises(RuntimeError, match="still contracted"):
        graph.contract(edges, rounds=1)


def inside_hull(ring, p):
    step = np.roll(ring, -1, axis=0) - ring
    return all(s[0] * (p[1] - c[1]) - s[1] * (p[0] - c[0]) >= -1e-9 for c, s in zip(ring, step))


def least_area(p):
    """Over every direction between two points."""
    best = math.inf
    for i in range(len(p)):
        for j in range(i):
            a = math.atan2(*(p[i] - p[j])[::-1])
            u = p @ np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
            best = min(best, float(np.prod(np.ptp(u, axis=0))))
    return best


@pytest.mark.parametrize("n", [3, 12, 60, 90])
def test_hull_and_rectangle(n):
    rng = np.random.default_rng(n)
    for p in (rng.normal(size=(n, 2)), rng.integers(0, 4, (n, 2)).astype(float), np.stack([np.arange(n), 2.0 * np.arange(n)], axis=1)):
        ring = hulls.hull(p)
        assert all(inside_hull(ring, q) for q in p) if len(ring) > 2 else len(ring) == 2
        parts = hulls.hull(np.concatenate([hulls.hull(p[: n // 2]), hulls.hull(p[n // 2 :])]))
        assert np.array_equal(parts, ring)
        _, size, angle = hulls.least_rectangle(ring)
        assert np.prod(size) == pytest.approx(least_area(p), abs=1e-9) and 0 <= angle < math.pi / 2


def test_tight_boxes(spark, monkeypatch):
    monkeypatch.setattr(hulls, "HELD", 50)
    rng = np.random.default_rng(4)
    rows = []
    for k in range(4):
        a = rng.uniform(0, 3)
        p = rng.uniform(-1, 1, (500, 3)) * [6, 2, 1]
        p[:4, :2] = [[-6, -2], [-6, 2], [6, -2], [6, 2]]
        q = p @ np.array([[math.cos(a), math.sin(a), 0], [-math.sin(a), math.cos(a), 0], [0, 0, 1]]) + [10 * k, 5, k]
        rows += [(k, *map(float, x)) for x in q]
    rows += [(9, 1.0, 2.0, 3.0), (9, None, 2.0, 3.0), (8, 0.0, 0.0, 0.0), (8, 3.0, 4.0, 1.0), (None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k long, x double, y double, z double").repartition(5)
    boxes = hulls.tight_boxes(df, "k")
    found = {r["k"]: r for r in boxes.collect()}
    for k in range(4):
        b = found[k]
        assert b["n"] == 500 and sorted((b["ex"], b["ey"])) == pytest.approx([4, 12]) and (b["cx"], b["cy"]) == pytest.approx((10 * k, 5))
    assert (found[9]["ex"], found[9]["ey"], found[9]["ez"], found[9]["n"]) == (0, 0, 0, 1) and found[8]["ex"] + found[8]["ey"] == pytest.approx(5) and found[None]["n"] == 1
    placed = df.where("x IS NOT NULL AND k IS NOT NULL").join(boxes.drop("n"), "k").select(hulls.inside(F.col("x"), F.col("y"), F.col("z")).alias("i"))
    assert placed.where("NOT i").count() == 0 and placed.count() == 2003
    centre, normal = hulls.ground_plane()
    r = boxes.where("k = 2").select(centre.alias("c"), normal.alias("n"), (F.col("cz") - F.col("ez") / 2).alias("low"), hulls.volume().alias("v")).first()
    assert r["c"] == pytest.approx([20, 5, r["low"]]) and r["n"] == pytest.approx([0, 0, 1]) and r["v"] == pytest.approx(48 * found[2]["ez"])


def test_ground_plane_of_turned_boxes(spark):
    upright = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 2.0, 4.0, 6.0, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0])], f"k int, {hulls.UPRIGHT}")
    lying = hulls.transformed(upright, [[1.0, 0.0, 0.0], [0.0, 0.0, -1.0], [0.0, 1.0, 0.0]], [0.0, 0.0, 10.0])  # the y axis now points up
    centre, normal = hulls.ground_plane()
    r = lying.select(centre.alias("c"), normal.alias("n"), "ex", "ey", "ez").first()
    assert list(r["c"]) == [0.0, 0.0, 8.0] and list(r["n"]) == [0.0, 0.0, 1.0] and (r["ex"], r["ey"], r["ez"]) == (2.0, 4.0, 6.0)
    flipped = hulls.transformed(upright, [[1.0, 0.0, 0.0], [0.0, -1.0, 0.0], [0.0, 0.0, -1.0]], [0.0, 0.0, 0.0])
    assert list(flipped.select(centre.alias("c")).first()["c"]) == [0.0, 0.0, -3.0]
