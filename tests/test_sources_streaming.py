"""Files, saved scenes and streams."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.sources import scene_files as S
from orrery.streaming import frames as T


def test_newest_cloud(spark, tmp_path):
    for ts, n in ((1.5, 3), (12.25, 5)):
        np.save(tmp_path / f"map_{ts}.npy", np.full((n, 4), ts))
    assert S.latest_cloud(spark, str(tmp_path)).count() == 5
    assert S.read_arrays(spark, str(tmp_path), ("x", "y", "z", "i")).count() == 8


def test_names(spark):
    df = spark.createDataFrame([("a/x_1.50.npy",), ("a/none.npy",)], "path string")
    assert [r[0] for r in df.select(S.number_in_name(F.col("path"))).collect()] == [1.5, float("inf")]
    cam, ts = S.camera_and_stamp(F.lit("d/cam2_img_3.25.jpg"))
    assert tuple(spark.range(1).select(cam, ts).first()) == (1, 3.25)
    cam, ts = S.camera_and_stamp(F.lit("other"))
    with pytest.raises(Exception, match="not an image name"):
        spark.range(1).select(cam).collect()


def test_iterations(spark, tmp_path):
    assert S.load_iteration(spark, str(tmp_path / "none"), ["a"]) == (-1, {})
    for i in (1, 10):
        S.save_iteration({"a": spark.range(i)}, str(tmp_path), i)
    itr, tables = S.load_iteration(spark, str(tmp_path), ["a"])
    assert itr == 10 and tables["a"].count() == 10


def test_scene_round_trip(spark, tmp_path):
    scene = {"nodes": spark.createDataFrame([(1, 1)], "id long, level int"), "edges": spark.createDataFrame([(1, 2)], "src long, dst long")}
    S.save_scene(scene, {"alpha": 0.3}, str(tmp_path / "s"))
    back, params = S.load_scene(spark, str(tmp_path / "s"))
    assert back["nodes"].collect() == scene["nodes"].collect() and params == {"alpha": "0.3"}
    assert S.load_scenes(spark, {"a": str(tmp_path / "s")}).first()["scene"] == "a"


def test_transforms(spark, tmp_path):
    (tmp_path / "tf_7.5.txt").write_text("1 2 3 0 0 0 1")
    row = S.read_transforms(spark, str(tmp_path)).first()
    assert (row["ts"], row["tx"], row["qw"]) == (7.5, 1.0, 1.0)


def test_parameter_files(tmp_path):
    (tmp_path / "p.json").write_text('[{"a": 1}, {"a": 2}]')
    assert [p["a"] for p in S.read_params(str(tmp_path / "p.json"))] == [1, 2]


def test_match_or_insert_compares_with_the_old_dictionary(spark):
    batch = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "mask long, emb array<double>")
    known = spark.createDataFrame([(0, [1.0, 0.0])], "clip_id long, emb array<double>")
    matches, after = T.match_or_insert(batch, known, 0.9)
    assert {r["mask"]: r["clip_id"] for r in matches.collect()} == {1: 1, 2: 2, 3: 0} and after.count() == 3
    matches, _ = T.match_or_insert(batch, known.limit(0), 0.9)
    assert {r["mask"]: r["clip_id"] for r in matches.collect()} == {1: 0, 2: 1, 3: 2}


def test_best_frame_of_a_tick(spark, tmp_path):
    rows = [("lidar", 1.0), ("lidar", 2.0), ("a", 1.04), ("a", 2.01), ("b", 1.0), ("b", 2.02)]
    spark.createDataFrame(rows, "stream string, ts double").write.parquet(str(tmp_path / "in"))
    seen = []
    stream = T.source(spark, str(tmp_path / "in"), "stream string, ts double", 10)
    T.aligned_ticks(stream, ("a", "b"), 0.05, lambda df, i: seen.extend(df.collect()), str(tmp_path / "ck")).awaitTermination()
    assert [r["ts"] for r in seen] == [2.0]


def test_counts_resume(spark, tmp_path):
    folder = str(tmp_path / "in")
    for part in range(2):
        spark.createDataFrame([(1, 5), (1, 5), (2, part)], "gidx long, clip_id long").write.mode("append").parquet(folder)
        stream = spark.readStream.schema("gidx long, clip_id long").parquet(folder)
        T.incremental_counts(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {(r["gidx"], r["clip_id"]): r["cnt"] for r in T.total_counts(spark, str(tmp_path / "out")).collect()}
    assert got == {(1, 5): 4, (2, 0): 1, (2, 1): 1}


def test_running_length(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    spark.createDataFrame([("a", t(0), 0.0, 0.0), ("a", t(1), 3.0, 4.0), ("a", t(2), 3.0, 5.0)], "k string, ts timestamp, x double, y double").write.parquet(str(tmp_path / "in"))
    stream = T.source(spark, str(tmp_path / "in"), "k string, ts timestamp, x double, y double", 10)
    q = T.running_length(stream, "k").writeStream.format("memory").queryName("way").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["length"] for r in spark.sql("SELECT * FROM way").collect()) == [0.0, 5.0, 6.0]


def test_pose_interpolated(spark):
    scans = spark.createDataFrame([(1, 1.5), (2, 9.0)], "scan int, ts double")
    poses = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0)], "ts double, px double")
    got = T.with_interpolated(scans, poses, ("px",)).collect()
    assert [(r["scan"], r["px"]) for r in got] == [(1, 15.0)]
    assert T.with_latest(scans, poses).first()["pose"]["ts"] == 2.0


def test_save_on_arrival(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "in"))
    T.save_on_arrival(T.source(spark, str(tmp_path / "in"), "id long"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
