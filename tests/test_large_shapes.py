"""Small inputs of the shapes that failed on large tables: many edges, many ids, many copies at one place."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from orrery.operators import cluster, graph, similarity, spatial


def test_state_of_many_edges(spark):
    edges = spark.range(20_000_000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert graph._state(edges)[0] == 20_000_000 and graph._state(edges) == graph._state(edges)
    assert graph._state(edges.where("u > 0"))[1] != graph._state(edges)[1]


def spied(monkeypatch, module, seen):
    whole = module.radius_join

    def join(left, right, *rest, **named):
        seen.append((left.count(), right.count(), set(left.columns) | set(right.columns)))
        return whole(left, right, *rest, **named)

    monkeypatch.setattr(module, "radius_join", join)


def test_copies_meet_once_in_density_clusters(spark, monkeypatch):
    at = [(0.0, 0.0)] * 300 + [(0.5, 0.0)] * 300 + [(1.2, 0.0)] + [(9.0, 9.0)] * 3 + [(5.0, 5.0)]
    rows = [("m", 700 - i, x, y) for i, (x, y) in enumerate(at)] + [("m", 1000, None, 0.0)]
    points = spark.createDataFrame(rows, "mask string, id long, x double, y double")
    seen: list = []
    spied(monkeypatch, cluster, seen)
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(points, "id", ["x", "y"], 1.0, 3).collect()}
    want = {700 - i: (100 if y == 0 else 97 if x == 9 else None) for i, (x, y) in enumerate(at)}
    assert got == want | {1000: None}
    best = cluster.largest_cluster(points, "mask", "id", ["x", "y"], 1.0, 3).collect()
    assert sorted(r["id"] for r in best) == list(range(100, 701))
    assert all(left <= 6 and right <= 6 for left, right, _ in seen)


def test_blocks_that_grow_find_the_same_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, float(i % 7), x.tolist()) for i, x in enumerate(v)], "id long, w double, v array<float>")
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    c = u @ u.T
    want = {(i, j, i % 7, j % 7) for i in range(400) for j in range(i + 1, 400) if round(c[i, j], 9) > 0.5}
    for few, large in ((16, 16), (2, 4), (1, 100)):
        monkeypatch.setattr(similarity, "FEW", few)
        monkeypatch.setattr(similarity, "LARGE", large)
        got = similarity.similar_pairs(df, "id", "v", 0.5, block=16, carry=("w",), raw=True).collect()
        assert {(r["src"], r["dst"], int(r["w_src"]), int(r["w_dst"])) for r in got} == want and len(got) == len(want)
        assert all(abs(r["cosine"] - c[r["src"], r["dst"]]) < 1e-12 for r in got)


def test_nearest_sends_positions_alone(spark, monkeypatch):
    right = spark.range(4000).select(F.col("id").alias("r"), (F.col("id") % 50).cast("double").alias("x"), F.floor(F.col("id") % 1000 / 50).cast("double").alias("y"), F.array_repeat(F.lit(1.0), 64).alias("emb"))
    left = spark.range(2000).select(F.col("id").alias("l"), (F.col("id") % 90 * 0.7).alias("x"), (F.col("id") % 45 * 1.3).alias("y"), F.lit("wide").alias("name"))
    seen: list = []
    spied(monkeypatch, spatial, seen)
    got = {r["l"]: (r["r"], r["d2"]) for r in spatial.nearest(left, right, "l", "r", ["x", "y"]).collect()}
    at = {i: (i % 50, i % 1000 // 50) for i in range(1000)}  # copies from 1000 on have greater ids
    for i in range(0, 2000, 37):
        x, y = i % 90 * 0.7, i % 45 * 1.3
        d, r = min(((x - a) * (x - a) + (y - b) * (y - b), r) for r, (a, b) in at.items())
        assert got[i][0] == r and abs(got[i][1] - d) < 1e-9
    assert len(got) == 2000 and all(cols == {"l", "r", "x", "y"} and n <= 90 and m <= 1000 for n, m, cols in seen)


def test_regions_are_no_places_however_many_there_are(spark, tmp_path):
    from orrery.plans import queries_composed as Q
    from orrery.plans.tables import Tables

    sf = "/root/testdata/sf0.001"
    for name in ("part", "lineitem"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    vec = spark.read.parquet(f"{sf}/embeddings.parquet")
    vec.withColumn("vec_id", F.when(F.col("vec_id") < 8, F.col("vec_id")).otherwise(F.col("vec_id") + 99_900)).write.parquet(f"{tmp_path}/embeddings.parquet")
    scene = Q.scene_of(Tables(spark, str(tmp_path)))
    assert scene["nodes"].select("id").distinct().count() == scene["nodes"].count()
    places = {r["place_id"] for r in Q.q8(Tables(spark, str(tmp_path))).collect()}
    assert places and min(places) >= 99_908


def test_matches_by_blocks_and_numbers_by_ranges(spark, monkeypatch):
    from orrery.operators.lineage import numbered
    from orrery.streaming import frames as T

    rng = np.random.default_rng(8)
    known, masks = rng.normal(size=(150, 6)), rng.normal(size=(90, 6))
    known[100:] = known[:50]  # copies: the least id counts
    monkeypatch.setattr(similarity, "FEW", 3)
    monkeypatch.setattr(similarity, "LARGE", 2)
    frame = lambda m, name: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], f"{name} long, emb array<double>")
    c = np.round((masks / np.linalg.norm(masks, axis=1, keepdims=True)) @ (known / np.linalg.norm(known, axis=1, keepdims=True)).T, 9)
    found = similarity.best_matches(frame(masks, "mask"), frame(known, "clip_id"), "mask", "clip_id", "emb", 0.8, block=16).collect()
    assert {(r["mask"], r["clip_id"]) for r in found} == {(i, int(c[i].argmax())) for i in range(90) if c[i].max() > 0.8}
    matches, after = T.match_or_insert(frame(masks, "mask"), frame(known, "clip_id"), 0.8)
    new = [i for i in range(90) if c[i].max() <= 0.8]
    got = {r["mask"]: r["clip_id"] for r in matches.collect()}
    assert [got[i] for i in new] == list(range(150, 150 + len(new))) and after.count() == 150 + len(new) and len(got) == 90
    rows = numbered(spark.range(1000).select((F.col("id") * 7 % 1009).alias("k")), "k", "n").orderBy("k").collect()
    assert [r["n"] for r in rows] == list(range(1, 1001))


def test_poses_of_a_slot_are_searched_not_joined(spark):
    from orrery.streaming import ticks

    rng = np.random.default_rng(3)
    times, x, scans = rng.integers(0, 60, 80), rng.integers(0, 9, 80).astype(float), rng.integers(-5, 65, 50)
    good, (got,) = ticks.poses_at(scans, times, [x], 2)
    for t, ok, value in zip(scans, good, got):
        before = [p for p in zip(times, x) if t - 2 <= p[0] <= t]
        after = [(u, -v) for u, v in zip(times, x) if t <= u <= t + 2]
        assert ok == bool(before and after)
        if ok:
            (t0, x0), (t1, x1) = max(before), min(after)
            assert abs(value - (x0 if t0 == t1 else x0 + (t - t0) / (t1 - t0) * (-x1 - x0))) < 1e-12
    rate = spark.readStream.format("rate").load().select(F.lit(1).alias("k"), F.col("timestamp").alias("at"), F.col("value").cast("double").alias("px"))
    plan = ticks.exact_poses(rate.select("k", "at"), rate, "k", ("px",), 3)._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan


def test_a_tick_reads_its_own_rows_alone(monkeypatch):
    import pandas as pd

    from orrery.streaming import ticks

    class State(dict):
        def __getattr__(self, name):
            value = lambda: super(State, self).get(0)
            return {"exists": lambda: 0 in self, "getValue": self.__getitem__, "containsKey": self.__contains__, "updateValue": self.__setitem__, "removeKey": self.pop}[name]

        def get(self):
            return self[0]

        def update(self, value):
            self[0] = value

    class Handle:
        timers: set = set()
        getMapState = getValueState = lambda self, *_: State()

        def registerTimer(self, at):
            self.timers.add(at)

    class Timer:
        def __init__(self, at):
            self.getExpiryTimeInMs = lambda: at

    read, whole = [], ticks.unpacked
    monkeypatch.setattr(ticks, "unpacked", lambda value: read.append(len(whole(value))) or whole(value))
    buffers = ticks.TickBuffers("k", "s", ["a"], 1.0, 0.5, float("inf"), "event")
    buffers.init(Handle())
    rows = pd.DataFrame({"stream": ["s", "a"] * 500, "ts": np.arange(1000) / 10, "ref": [str(i) for i in range(1000)]})
    list(buffers.handleInputRows((1,), iter([rows.iloc[:300], rows.iloc[300:]]), None))
    out = [f for at in sorted(Handle.timers) for f in buffers.handleExpiredTimer((1,), None, Timer(at))]
    assert len(pd.concat(out)) == 100 and sum(read) == 1000  # lists of all buffered rows were read at each of the 100 ticks before
