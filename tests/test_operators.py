"""Hand-computed cases of single operators."""

import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import geometry as G
from orrery.functions.vectors import cosine, normalised
from orrery.operators import aggregates as A, asof, boxes, cluster, graph, raster, spatial
from orrery.plans import scene as P


def test_asof_takes_the_earlier_of_equals(spark):
    left, right = spark.createDataFrame([(10,)], "t int"), spark.createDataFrame([(8, 1), (12, 2)], "t int, v int")
    assert asof.nearest_asof(left, right, "t", "v", 2).first()["match_t"] == 8
    assert asof.nearest_asof(left, right, "t", "v", 1).count() == 0
    assert asof.nearest_asof(left, right, "t", "v", 1, keep=True).first()["match_t"] is None


def test_a_frame_goes_with_one_stream(spark):
    frames, near, far = spark.createDataFrame([(10,)], "t int"), spark.createDataFrame([(11, 1)], "t int, v int"), spark.createDataFrame([(30, 1)], "t int, v int")
    assert asof.align(frames, {"a": near}, "t", "v", 5).count() == 1
    assert asof.align(frames, {"a": near, "b": far}, "t", "v", 5).count() == 0


def test_asof_over_chunks_equals_a_plain_search(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, int(k), int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 400), rng.integers(0, 500, 400)))]
    marks = [(1000 + i, int(k), int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 2, 60), rng.integers(100, 380, 60)))]
    left = spark.createDataFrame(rows + [(900, 0, None), (901, None, 5)], "i int, k int, t int")
    right = spark.createDataFrame(marks + [(2000, 0, None)], "v int, k int, t int")
    for size in (asof.CHUNK_ROWS, 40):
        monkeypatch.setattr(asof, "CHUNK_ROWS", size)
        for by in ([], ["k"]):
            want = {}
            for i, k, t in rows:
                near = [(abs(u - t), u, v) for v, q, u in marks if not by or q == k]
                if near:
                    want[i] = min(near)
            if not by:
                want[901] = min((abs(u - 5), u, v) for v, _, u in marks)
            got = {r["i"]: (r["gap"], r["match_t"], r["match_v"]) for r in asof.nearest_asof(left, right.select(*by, "t", "v"), "t", "v", by=by).collect()}
            assert got == want


def test_mode_ties_and_support(spark):
    c = spark.createDataFrame([(1, 5, 2), (1, 3, 2), (2, 9, 1)], "g int, id int, n int")
    assert {r["g"]: r["id"] for r in A.mode(c, "g", "id", "n").collect()} == {1: 3, 2: 9}
    assert {r["g"]: r["id"] for r in A.mode(c, "g", "id", "n", 2).collect()} == {1: 3, 2: -1}


def test_trimmed_mean_keeps_whole_items(spark):
    rows = [(1, i, [math.cos(i / 10), math.sin(i / 10)], 1) for i in range(5)]
    df = spark.createDataFrame(rows, "g int, id int, v array<double>, n int")
    assert A.trimmed_mean(df, "g", "id", "v", "n", 0.2).first()["emb"] is not None
    assert A.trimmed_mean(df, "g", "id", "v", "n", 0.9).first()["emb"] is None


def test_medoid(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [1.0, 0.0]), (1, 3, [1.0, 0.0]), (1, 4, [0.0, 1.0])], "g int, id int, v array<double>")
    assert A.medoid(df, "g", "id", "v").first()["id"] == 1


def test_geometric_median_of_equal_vectors(spark):
    df = spark.createDataFrame([(1, [0.6, 0.8], 1)] * 3, "g int, v array<double>, n int")
    assert A.geometric_median(df, "g", "v", "n").first()["emb"] == pytest.approx([0.6, 0.8])


def test_zero_vectors(spark):
    row = spark.range(1).select(cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))).alias("c"), normalised(F.array(F.lit(0.0))).alias("n")).first()
    assert row["c"] == 0.0 and row["n"] is None


def test_radius_includes_the_border(spark):
    a, b = spark.createDataFrame([(1, 0.0, 0.0)], "a int, x double, y double"), spark.createDataFrame([(1, 3.0, 4.0), (2, 3.1, 4.0)], "b int, x double, y double")
    for salt in (1, 3):
        assert [r["r"]["b"] for r in spatial.radius_join(a, b, 5.0, ["x", "y"], salt).collect()] == [1]


def test_grid_search_equals_exhaustive(spark, monkeypatch):
    rng = np.random.default_rng(1)
    left = spark.createDataFrame([(i, *map(float, rng.random(2))) for i in range(40)], "l int, x double, y double")
    right = spark.createDataFrame([(i, *map(float, rng.random(2))) for i in range(200)], "r int, x double, y double")
    plain = {(r["l"], r["rank"]): r["r"] for r in spatial.nearest(left, right, "l", "r", ["x", "y"], k=3).collect()}
    monkeypatch.setattr(spatial, "ALL_PAIRS", 10)
    assert {(r["l"], r["rank"]): r["r"] for r in spatial.nearest(left, right, "l", "r", ["x", "y"], k=3).collect()} == plain


def test_nearest_prefers_images_in_range_then_the_farthest(spark):
    ranked = spark.createDataFrame([(1, p, p) for p in range(1, 6)], "k int, p int, rank int")
    closest = spark.createDataFrame([(2, 20), (4, 40)], "p int, img int")
    none = spark.createDataFrame([], "p int, imgs array<int>")
    assert spatial.images_of_nearest(ranked, none, closest, "k", "p").first()["imgs"] == [40]
    some = spark.createDataFrame([(3, [7, 8])], "p int, imgs array<int>")
    assert spatial.images_of_nearest(ranked, some, closest, "k", "p").first()["imgs"] == [7, 8]
    with pytest.raises(Exception, match="no image"):
        spatial.images_of_nearest(ranked, none, closest.limit(0), "k", "p").collect()


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 60), (60, 55), (70, 70)], "src long, dst long")
    got = {r["id"]: r["component"] for r in graph.components(e).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[55] == got[60] == got[50] == 50 and got[70] == 70
    assert graph.components(e.limit(0)).count() == 0


def test_bridge_joins_all(spark):
    nodes = spark.createDataFrame([(i, float(x), 0.0) for i, x in enumerate((0, 1, 10, 11, 30))], "id long, x double, y double")
    new = graph.bridge(nodes, spark.createDataFrame([(0, 1), (2, 3)], "src long, dst long"), ["x", "y"]).collect()
    assert {(r["src"], r["dst"]): r["weight"] for r in new} == {(1, 2): 900.0, (3, 4): 1900.0}


def test_shortest_path(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, float("inf"))], "src long, dst long, weight double")
    assert [(r["node"], r["cost"]) for r in graph.shortest_path(e, 1, 3).orderBy("seq").collect()] == [(1, 0.0), (2, 1.0), (3, 2.0)]
    assert graph.shortest_path(e, 1, 4).count() == 0


def test_descent(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 1), (10, 2), (11, 2), (20, 3)], "id long, level int")
    edges = spark.createDataFrame([(1, 10), (2, 11), (10, 20), (11, 20), (1, 2)], "src long, dst long")
    roots = spark.createDataFrame([(20,), (10,)], "root long")
    assert {(r["root"], r["id"]) for r in graph.descend(nodes, edges, roots).collect()} == {(20, 1), (20, 2), (10, 1)}
    assert {(r["root"], r["id"]) for r in graph.bottom_regions(nodes, edges, roots).collect()} == {(20, 10), (20, 11), (10, 10)}


def test_surface_cost(spark):
    def cost(u, v):
        return spark.range(1).select(G.surface_cost(F.lit(2.0), F.lit(u), F.lit(v), [1], [9], {1: 3.0, 2: 4.0})).first()[0]

    assert (cost(1, 1), cost(1, 2), cost(2, 2), cost(9, 1), cost(5, 5)) == (2.0, 9.0, 10.0, math.inf, 2.0)


def test_linkage_and_cuts():
    d = np.abs(np.subtract.outer([0.0, 1.0, 3.0, 13.0, 14.5], [0.0, 1.0, 3.0, 13.0, 14.5]))
    m = cluster.average_linkage(d)
    assert m[:, 2].tolist() == pytest.approx([1.0, 1.5, 2.5, (13 + 14.5 + 12 + 13.5 + 10 + 11.5) / 6])
    assert cluster.auto_cuts(m[:, 2], 1) == [2.0]
    assert cluster.cut_at(m, 5, 2.5).tolist() == [0, 0, 0, 3, 3]
    assert cluster.cut_at(m, 5, 1.0).tolist() == [0, 0, 2, 3, 4]
    with pytest.raises(ValueError):
        cluster.average_linkage(np.zeros((cluster.MATRIX_NODES + 1, 1)))


def test_dbscan_against_plain_search(spark):
    rng = np.random.default_rng(4)
    p = np.round(rng.random((120, 2)) * 6, 3)
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id long, x double, y double"), "id", ["x", "y"], 0.5, 4).collect()}
    near = ((p[:, None] - p[None]) ** 2).sum(-1) <= 0.25
    core = near.sum(1) >= 4
    label = {}
    for i in np.flatnonzero(core):
        if i not in label:
            todo = [i]
            while todo:
                j = todo.pop()
                if label.setdefault(int(j), int(i)) == i:
                    todo += [k for k in np.flatnonzero(near[j] & core) if k not in label]
    want = {i: label.get(i, min((label[j] for j in np.flatnonzero(near[i] & core)), default=None)) for i in range(len(p))}
    assert got == want


def test_bottleneck_needs_relevance():
    low = np.full((4, 2), 0.1)
    assert cluster.bottleneck(low, [(0, 1)], 0.2, 2) == []
    high = np.array([[0.9, 0.0], [0.9, 0.0], [0.0, 0.8], [0.1, 0.1]])
    found = cluster.bottleneck(high, [(0, 1), (1, 2), (2, 3)], 0.2, 1)
    assert (0, 0, [0, 1]) in found and all(rows != [3] for _, _, rows in found)


def test_box_overlap():
    eye = np.eye(3)
    unit = (np.zeros(3), np.ones(3), eye)
    assert boxes.iou(unit, (np.array([0.5, 0, 0]), np.ones(3), eye)) == pytest.approx(1 / 3)
    assert boxes.iou(unit, unit) == pytest.approx(1.0) and boxes.iou(unit, (np.array([2.0, 0, 0]), np.ones(3), eye)) == 0
    turn = np.array([[math.sqrt(0.5), -math.sqrt(0.5), 0], [math.sqrt(0.5), math.sqrt(0.5), 0], [0, 0, 1]])
    octagon = 2 * (math.sqrt(2) - 1)
    assert boxes.iou(unit, (np.zeros(3), np.ones(3), turn)) == pytest.approx(octagon / (2 - octagon), abs=1e-6)
    a = (np.array([0.2, 0.1, 0]), np.array([1.0, 2.0, 1.5]), turn)
    assert boxes.iou(unit, a) == pytest.approx(boxes.iou(a, unit)) and abs(boxes.sampled_iou(unit, a) - boxes.iou(unit, a)) < 0.03


def test_fitted_box_holds_its_points():
    rng = np.random.default_rng(0)
    p = rng.random((50, 3)) * [5, 2, 1]
    c, e, r = boxes.fitted_box(p)
    assert (np.abs((p - c) @ r) <= e / 2 + 1e-9).all() and np.linalg.det(r) == pytest.approx(1)
    assert len(boxes.box_edges(boxes.corners(c, e, r))) == 12
    assert boxes.half_extents(np.abs(r) @ np.array([1.0, 2.0, 3.0]), r) == pytest.approx([1, 2, 3])


def test_distance_map_is_exact():
    grid = np.zeros((20, 20), dtype=int)
    grid[5, 5] = grid[15, 15] = 1
    dist, near = raster.distance_map(grid)
    for y, x in itertools.product(range(20), repeat=2):
        assert dist[y, x] == pytest.approx(min(math.hypot(y - 5, x - 5), math.hypot(y - 15, x - 15)))
    line = raster.voronoi(dist, near)
    assert line.any() and all(abs(math.hypot(y - 5, x - 5) - math.hypot(y - 15, x - 15)) < 3 for y, x in zip(*np.nonzero(line)))
    assert np.isinf(raster.distance_map(np.zeros((3, 3)))[0]).all()


def test_skeleton_around_two_blocks():
    """Loops stay and meet in nodes; a dead end is thinned away."""
    grid = np.ones((31, 45), dtype=int)
    grid[2:29, 2:43] = 0
    grid[11:20, 10:18] = grid[11:20, 27:35] = 1
    ids, nodes, _ = raster.skeleton_of(grid, 2.0, 8.0)
    assert nodes.sum() >= 2 and (ids[nodes] > 0).all() and (ids > 0).sum() > 40
    corridor = np.ones((9, 30), dtype=int)
    corridor[2:7, 2:28] = 0
    assert raster.skeleton_of(corridor, 2.0, 8.0)[1].sum() == 0


def test_scene_methods_are_checked(spark):
    with pytest.raises(ValueError):
        P.predict_objects({}, None, "best")
    with pytest.raises(ValueError):
        P.predict_regions({}, None, "best")


def test_threshold_is_strict_and_surfaces_win(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "q_idx long, emb array<double>")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, emb array<double>")
    assert [r["id"] for r in P.relevant(rows, q, 1, 0.5).collect()] == [2]
    assert P.relevant(rows, q, 1, 1.0).count() == 0


def test_staged_tables_can_be_cleared(spark, tmp_path):
    from orrery.operators import lineage

    assert lineage.staged(spark.range(3)).count() == 3
    folders = list(lineage._written)
    lineage.clear(spark)
    assert folders and not any(os.path.exists(f) for f in folders)


def test_similar_pairs_in_blocks(spark):
    from orrery.operators.similarity import similar_pairs

    rng = np.random.default_rng(7)
    x = rng.standard_normal((60, 6))
    x[5] = 0
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] > 0.5}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(100, None)], "id long, v array<double>")
    for block in (2048, 13):
        assert {(r["src"], r["dst"]) for r in similar_pairs(df, "id", "v", 0.5, block=block).collect()} == want


def plain_territories(nodes: set, edges: set) -> dict:
    """Ids from 1 in scan order, spread one step at a time along edge cells."""
    ids = {cell: i for i, cell in enumerate(sorted(nodes), 1)}
    queue = sorted(nodes)
    while queue:
        y, x = queue.pop(0)
        for to in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)):
            if to in edges and to not in ids:
                ids[to] = ids[y, x]
                queue.append(to)
    return ids


def test_skeletons_of_grids_as_tables(spark):
    """Two grids in one table: each line is in the middle between obstacles, and its territories are a plain flood's."""
    grids = {}
    for g, blocks in ((1, [(11, 20, 10, 18), (11, 20, 27, 35)]), (2, [(8, 12, 8, 30)])):
        free = {(y, x) for y in range(2, 29) for x in range(2, 43)}
        for y0, y1, x0, x1 in blocks:
            free -= {(y, x) for y in range(y0, y1) for x in range(x0, x1)}
        grids[g] = free
    rows = [(g, y, x) for g, free in grids.items() for y, x in free]
    out = raster.skeleton(spark.createDataFrame(rows, "g long, y long, x long"), "g", 2.0, 8.0).toPandas()
    assert set(out["g"]) == {1, 2}
    for g, part in out.groupby("g"):
        free = grids[g]
        walls = {(y, x) for y in range(1, 30) for x in range(1, 44)} - free
        for r in part.itertuples():
            far = sorted(math.hypot(r.y - a, r.x - b) for a, b in walls)
            assert (r.y, r.x) in free and r.dist == pytest.approx(far[0])
        nodes = {(r.y, r.x) for r in part.itertuples() if not r.is_edge}
        edges = {(r.y, r.x) for r in part.itertuples() if r.is_edge}
        assert {(r.y, r.x): r.id for r in part.itertuples()} == plain_territories(nodes, edges) and len(nodes) >= 2
        # the line closes around each block: every ray from a block outwards meets it before the rim
        cells = nodes | edges
        for y0, y1, x0, x1 in ([(11, 20, 10, 18), (11, 20, 27, 35)] if g == 1 else [(8, 12, 8, 30)]):
            y, x = (y0 + y1) // 2, (x0 + x1) // 2
            for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
                assert any((y + k * dy, x + k * dx) in cells for k in range(1, 40))


def test_boxes_of_a_hand_made_scene(spark):
    """Two blocks of points that match two tasks, a third block that matches the surface, and a lonely point."""
    corners = [(sx, sy, sz) for sx in (0.0, 4.0) for sy in (0.0, 2.0) for sz in (0.0, 1.0)]
    points, counts_ = [], []
    for i, (dx, dy, clip) in enumerate(((0.0, 0.0, 11), (50.0, 10.0, 12), (100.0, 0.0, 10))):
        for j, (x, y, z) in enumerate(corners):
            points.append((100 * i + j, x + dx, y + dy, z))
            counts_ += [(100 * i + j, clip, 3), (100 * i + j, 10, 1)]
    points.append((900, 200.0, 200.0, 0.0))
    counts_.append((900, 11, 1))
    scene = {
        "points": spark.createDataFrame(points, "gidx long, x double, y double, z double"),
        "counts": spark.createDataFrame(counts_, "gidx long, clip_id long, cnt long"),
        "segments": spark.createDataFrame([(10, [1.0, 0.0, 0.0]), (11, [0.0, 1.0, 0.0]), (12, [0.0, 0.6, 0.8])], "clip_id long, emb array<double>"),
    }
    queries = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 0.0, 1.0])], "q_idx long, emb array<double>")
    params = P.Params(n_surface=1, alpha=0.3, radius=4.5, eps=4.5, min_samples=3)
    got = {r["object"]: r for r in P.predict_objects(scene, queries, "ms_max", params).collect()}
    assert set(got) == {0, 100}  # named by the least core point; the surface's block and the lonely point give none
    for name, task, score, centre in ((0, 0, 1.0, (2.0, 1.0, 0.5)), (100, 1, 0.8, (52.0, 11.0, 0.5))):
        r = got[name]
        assert (r["task_idx"], r["n_points"]) == (task, 8) and r["top_score"] == pytest.approx(score)
        assert (r["cx"], r["cy"], r["cz"]) == pytest.approx(centre) and sorted((r["ex"], r["ey"], r["ez"])) == pytest.approx([1.0, 2.0, 4.0])
    inside = P.Params(n_surface=1, alpha=0.3, radius=4.5, eps=4.5, min_samples=3, bounds=((0.0, 10.0), (-1e9, 1e9), (-1e9, 1e9)), offset=5)
    assert [(r["object"], r["task_idx"]) for r in P.predict_objects(scene, queries, "ms_max", inside).collect()] == [(0, 5)]
