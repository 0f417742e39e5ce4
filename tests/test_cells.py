"""Cell tables against whole grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import cells as C, raster


def table(spark, grids):
    rows = [(k, y, x, bool(g[y, x])) for k, g in enumerate(grids) for y in range(g.shape[0]) for x in range(g.shape[1])]
    return spark.createDataFrame(rows, "g int, y long, x long, obst boolean")


def whole(grids):
    out = {}
    for k, g in enumerate(grids):
        dist, near = raster.distance_map(g)
        for y in range(g.shape[0]):
            for x in range(g.shape[1]):
                out[k, y, x] = (bool(g[y, x]), None, None, None) if near[y, x] < 0 else (bool(g[y, x]), *divmod(int(near[y, x]), g.shape[1]), round(dist[y, x] ** 2))
    return out


def collected(df):
    return {(r["g"], r["y"], r["x"]): (r["obst"], r["oy"], r["ox"], r["d2"]) for r in df.collect()}


def some_grids(seed=3):
    rng = np.random.default_rng(seed)
    return [(rng.random((23, 31)) < share).astype(np.int8) for share in (0.02, 0.2, 0.9)] + [np.zeros((4, 5), np.int8), np.ones((3, 3), np.int8), np.zeros((1, 9), np.int8)]


def test_distance_map_by_lines(spark):
    grids = some_grids()
    grids[5][0, 4] = 1
    assert collected(C.distance_cells(table(spark, grids), "g")) == whole(grids)


def test_changes_equal_a_rebuild_and_touch_few_rows(spark):
    rng = np.random.default_rng(8)
    grids = some_grids(9)
    walled = np.zeros((60, 60), np.int8)
    walled[::6] = 1  # walls keep a change between them
    grids.append(walled)
    cells = C.staged(C.distance_cells(table(spark, grids), "g"))
    for _ in range(2):
        changes = []
        for k, g in enumerate(grids):
            for _ in range(3 if k < 6 else 1):
                y, x = (int(rng.integers(n)) for n in g.shape)
                g[y, x] = 1 - g[y, x]
                changes.append((k, y, x, bool(g[y, x])))
        last = {(k, y, x): bool(grids[k][y, x]) for k, y, x, _ in changes}
        df = spark.createDataFrame([(*p, o) for p, o in last.items()] + [(0, 500, 500, True)], "g int, y long, x long, obst boolean")
        after, rows = C.updated(cells, df, "g")
        cells = C.staged(after)
        assert collected(cells) == whole(grids)
        touched = [r["y"] for r in rows.collect() if r["g"] == 6]
        assert len(touched) <= 12
    none, rows = C.updated(cells, df.limit(0), "g")
    assert rows.count() == 0 and collected(none) == whole(grids)


def test_combined_maps(spark):
    a, b = some_grids(1)[:3], some_grids(2)[:3]
    cells, other = (C.staged(C.distance_cells(table(spark, x), "g")) for x in (a, b))
    got, _ = C.combined(cells, other, "g")
    assert collected(got) == whole([np.minimum(x, y) for x, y in zip(a, b)])


@pytest.mark.parametrize("tile", [4, 256])
def test_territories_in_tiles(spark, monkeypatch, tile):
    monkeypatch.setattr(C, "TILE", tile)
    rng = np.random.default_rng(tile)
    rows, want = [], {}
    for k, share in enumerate((0.5, 0.75, 1.0)):
        free = rng.random((19, 22)) < share
        nodes = free & (rng.random(free.shape) < 0.03)
        nodes[0, 0] = free[0, 0] = True
        ids = raster.territories(nodes, free & ~nodes)
        for y, x in zip(*np.nonzero(free)):
            rows.append((k, int(y) - 3, int(x) - 7, not nodes[y, x]))
            want[k, int(y) - 3, int(x) - 7] = None if ids[y, x] < 0 else int(ids[y, x])
    cells = spark.createDataFrame([(k, y, x, bool(e)) for k, y, x, e in rows], "g int, y long, x long, is_edge boolean")
    got = C.territories(cells, "g").collect()
    assert {(r["g"], r["y"], r["x"]): r["id"] for r in got} == want
    assert all((r["steps"] == 0) == (not r["is_edge"]) for r in got if r["id"] is not None)


def test_a_cycle_of_rounds_that_does_not_end_is_told(spark, monkeypatch):
    monkeypatch.setattr(C, "TILE", 2)
    line = spark.createDataFrame([(0, 0, x, x > 0) for x in range(30)], "g int, y long, x long, is_edge boolean")
    with pytest.raises(RuntimeError, match="still move"):
        C.territories(line, "g", rounds=3)
    assert C.territories(line, "g").agg(F.max("steps")).first()[0] == 29


def test_distance_map_of_a_long_grid_in_little_memory():
    """One column's rows by its obstacles would be 800 million distances."""
    import tracemalloc

    grid = (np.random.default_rng(4).random((40_000, 3)) < 0.5).astype(int)
    tracemalloc.start()
    dist, near = raster.distance_map(grid)
    assert tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()
    part, own = raster.distance_map(grid[:300])
    np.testing.assert_array_equal(dist[:250], part[:250])
    np.testing.assert_array_equal(near[:250], own[:250])
    for y in range(0, 250, 7):
        for x in range(3):
            d2 = [((y - a) ** 2 + (x - b) ** 2, a * 3 + b) for a, b in np.argwhere(grid[:300])]
            assert (dist[y, x] ** 2, near[y, x]) == pytest.approx(min(d2))
