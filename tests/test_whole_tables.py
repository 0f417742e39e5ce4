"""Queries without SQL take part with every row of their tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.plans.registry import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def segments(spark):
    return {r["vec_id"]: (r["label"] % 3, r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label").collect()}


def test_scene_clusters_hold_every_segment(spark, segments):
    sizes = {s: sum(v[0] == s for v in segments.values()) for s in (0, 1, 2)}
    assert {r["scene"]: r["count"] for r in QUERIES["c3_linkage"](spark, SF).groupBy("scene").count().collect()} == {s: n - 1 for s, n in sizes.items()}
    for name in ("c5_cut", "c7_spectral"):
        assert {r["id"] for r in QUERIES[name](spark, SF).select("id").distinct().collect()} == set(segments)


def test_bridge_joins_every_segment(spark, segments):
    from orrery.operators import graph
    from orrery.plans import queries_spatial
    from orrery.plans.registry import Tables

    edges = queries_spatial.similar_edges(Tables(spark, SF), 0.35).select("src", "dst")
    label = graph.components(edges.unionByName(QUERIES["g3_bridge"](spark, SF).select("src", "dst"))).collect()
    assert {r["id"] for r in label} == set(segments) and len({r["component"] for r in label}) == 1


def test_bottlenecks_start_from_every_place(spark, segments, monkeypatch):
    from orrery.operators import cluster

    seen = {}
    whole = cluster.bottleneck_of

    def spied(scores, edges, *rest, **named):
        seen["places"] = {r["id"] for r in scores.select("id").collect()}
        return whole(scores, edges, *rest, **named)

    monkeypatch.setattr(cluster, "bottleneck_of", spied)
    for name, first in (("c10_aib", 20), ("q10_regions_aib", 8)):  # smaller ids are the queries
        assert QUERIES[name](spark, SF).count() >= 0
        assert seen.pop("places") == {i for i in segments if i >= first}


def test_geometric_median_of_every_part(spark):
    sf = "/root/testdata/sf0.01"
    parts = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_partkey").alias("gidx")).distinct()
    got = QUERIES["a12_geomedian"](spark, sf).select("gidx").distinct()
    assert parts.where("gidx > 300").join(got, "gidx").count() > 0


def test_mask_clusters_of_all_events(spark):
    """Against a plain version over all events of the second smallest tables."""
    sf = "/root/testdata/sf0.01"
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "event_id", "value", F.col("user_id").cast("double").alias("y")).toPandas()
    want = set()
    for kind, part in events.groupby("event_type"):
        ids, xy = part["event_id"].to_numpy(), part[["value", "y"]].to_numpy()
        near = ((xy[:, None] - xy[None]) ** 2).sum(-1) <= 4.0
        core = near.sum(1) >= 4
        label, clusters = np.full(len(ids), -1), 0
        for i in np.flatnonzero(core):
            if label[i] < 0:
                label[i], todo = clusters, [i]
                while todo:
                    for j in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                        label[j] = clusters
                        todo.append(j)
                clusters += 1
        # a border point may lie in reach of several clusters: only core points are compared
        if clusters:
            sizes = [(int((near[:, label == c].any(1)).sum()), c) for c in range(clusters)]
            top = max(sizes)[0]
            if sum(s == top for s, _ in sizes) == 1:
                want |= {(kind, int(i)) for i in ids[label == max(sizes)[1]]}
    got = {(r["event_type"], r["event_id"]) for r in QUERIES["c1_mask_cluster"](spark, sf).withColumnRenamed("id", "event_id").collect()}
    assert want and want <= got and max(i for _, i in want) > 3000


def test_every_event_has_its_nearest_place(spark):
    sf = "/root/testdata/sf0.01"
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id")
    got = QUERIES["j4_nearest_place"](spark, sf)
    assert got.count() == events.count() == events.join(got, "event_id").count()


def test_dense_pairs_go_to_few_blocks(spark, monkeypatch):
    """Blocks grow once there are FEW: a segment is not sent once for each DENSE_BLOCK of the others."""
    from orrery.operators import similarity

    sf, made = "/root/testdata/sf0.001", []
    whole = similarity.blocks_of
    monkeypatch.setattr(similarity, "DENSE_BLOCK", 8)
    monkeypatch.setattr(similarity, "blocks_of", lambda *n: made.append(whole(*n)) or made[-1])
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert QUERIES["j16_dense_pairs"](spark, sf).distinct().count() == n * (n - 1) // 2
    assert len(made) == 1 and made[0] < n / 8
