"""Buffers over ticks, exact poses and the newest map, as streams."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from orrery.streaming import frames as T, ticks

ROWS = "robot string, stream string, ts double, ref string"


def plain_frames(rows, cameras, period, max_dt, keep=float("inf")):
    """Tick by tick with plain lists."""
    out = []
    for robot in sorted({r[0] for r in rows}):
        held = {s: [] for s in ("lidar", *cameras)}
        mine = sorted((r for r in rows if r[0] == robot and r[1] in held), key=lambda r: (r[2], r[3]))
        last = int(max(r[2] for r in mine) // period) + 1
        for k in range(int(min(r[2] for r in mine) // period) + 1, last + 1):
            for r in mine:
                if (k - 1) * period <= r[2] < k * period:
                    held[r[1]].append(r)
            if all(held.values()):
                best = None
                for scan in held["lidar"]:
                    near = [min(held[c], key=lambda r: (abs(r[2] - scan[2]), r[2], r[3])) for c in cameras]
                    skew = max(abs(n[2] - scan[2]) for n in near)
                    if skew <= max_dt and (best is None or skew < best[0]):
                        best = skew, scan, near
                if best:
                    out.append((robot, k * period, best[1][2], best[1][3], best[0], [n[2] for n in best[2]], [n[3] for n in best[2]]))
                held = {s: [] for s in held}
            else:
                held = {s: [r for r in x if r[2] >= k * period - keep] for s, x in held.items()}
    return out


def recording(seed=2, n=400):
    rng = random.Random(seed)
    rows = []
    for robot in ("r1", "r2"):
        for i in range(n):
            stream = rng.choice(["lidar", "lidar", "a", "a", "a", "b", "other"])
            rows.append((robot, stream, round(rng.uniform(0, 60), 3), f"{robot}-{i}"))
    return rows


def run(spark, tmp_path, rows, parts, name, **options):
    """The rows through files in the order of parts, then a row far ahead that closes every tick."""
    folder = tmp_path / name
    for i, part in enumerate(parts):
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    closing = [(r, "other", 1e6, "") for r in sorted({r[0] for r in rows})]
    spark.createDataFrame(closing, ROWS).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    stream = T.source(spark, str(folder / "in"), ROWS)
    out = ticks.best_frames(stream.withColumn("stream", F.when(F.col("ts") < 1e6, F.col("stream")).otherwise("other")), "robot", "lidar", ("a", "b"), 2.0, **options)
    q = out.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(out.schema).parquet(str(folder / "out")).collect()
    return sorted((r["robot"], r["tick"], r["ts"], r["ref"], round(r["skew"], 6), list(r["image_ts"]), list(r["image_refs"])) for r in got)


def rounded(frames):
    return sorted((a, b, c, d, round(e, 6), f, g) for a, b, c, d, e, f, g in frames)


def test_frames_do_not_depend_on_files(spark, tmp_path):
    rows = recording()
    want = rounded(plain_frames(rows, ("a", "b"), 2.0, 0.4))
    assert len(want) > 20
    by_time = sorted(rows, key=lambda r: r[2])
    late = sorted(rows, key=lambda r: r[2] + random.Random(r[3]).uniform(0, 5))
    assert run(spark, tmp_path, rows, [by_time[i : i + 130] for i in range(0, len(rows), 130)], "some", max_dt=0.4) == want
    assert run(spark, tmp_path, rows, [late[i : i + 160] for i in range(0, len(rows), 160)], "late", max_dt=0.4, lateness="6 seconds") == want


def test_a_camera_of_one_tick_meets_a_scan_of_a_later_one(spark, tmp_path):
    rows = [("r", "a", 1.9, "a0"), ("r", "b", 1.95, "b0"), ("r", "lidar", 2.01, "s0"), ("r", "a", 30.0, "a1"), ("r", "b", 50.0, "b1"), ("r", "lidar", 50.0, "s1"), ("r", "lidar", 70.1, "s2")]
    assert run(spark, tmp_path, rows, [[r] for r in rows], "all", max_dt=0.5) == [("r", 4.0, 2.01, "s0", 0.11, [1.9, 1.95], ["a0", "b0"])]
    # a1 was held from tick 32 to tick 52, where nothing is near enough, and went with the rest
    kept = run(spark, tmp_path, rows, [[r] for r in rows], "wide", max_dt=25.0)
    assert [x[3] for x in kept] == ["s0", "s1"] and kept[1][5] == [30.0, 50.0]
    assert [x[3] for x in run(spark, tmp_path, rows, [[r] for r in rows], "short", max_dt=25.0, keep=10.0)] == ["s0"]


def test_rows_of_a_tick_that_is_over(spark, tmp_path):
    rows = [("r", "a", 1.0, "a"), ("r", "b", 1.0, "b"), ("r", "lidar", 1.2, "s"), ("r", "a", 9.0, "x"), ("r", "lidar", 1.0, "late")]
    assert [x[3] for x in run(spark, tmp_path, rows, [[r] for r in rows], "late", max_dt=0.5)] == ["s"]


def seconds(t: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=t)


@pytest.mark.parametrize("files", [1, 4])
def test_exact_poses(spark, tmp_path, files):
    rng = random.Random(files)
    poses = sorted((rng.choice("ab"), round(rng.uniform(0, 100), 2), rng.random()) for _ in range(150))
    poses = list({(k, t): (k, t, x) for k, t, x in poses}.values())
    scans = [(rng.choice("ab"), i, round(rng.uniform(0, 100), 2)) for i in range(80)] + [(k, 900 + i, t) for i, (k, t, _) in enumerate(poses[:3])]
    want = {}
    for k, i, t in scans:
        before = [(u, x) for q, u, x in poses if q == k and t - 3 <= u <= t]
        after = [(u, x) for q, u, x in poses if q == k and t <= u <= t + 3]
        if before and after:
            (t0, x0), (t1, x1) = max(before), min(after)
            want[i] = x0 if t0 == t1 else x0 + (t - t0) / (t1 - t0) * (x1 - x0)
    sides = {}
    for name, rows, kind in (("scans", [(k, i, seconds(t)) for k, i, t in scans], "k string, scan int, at timestamp"), ("poses", [(k, seconds(t), x) for k, t, x in poses], "k string, at timestamp, px double")):
        rows = sorted(rows, key=lambda r: [x for x in r if isinstance(x, dt.datetime)][0])
        step = -(-len(rows) // files)
        closing = [("z", -1, seconds(5000))] if name == "scans" else [("z", seconds(5000), 0.0)]
        for part in [*(rows[i : i + step] for i in range(0, len(rows), step)), closing]:
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        sides[name] = T.source(spark, str(tmp_path / name), kind)
    out = ticks.exact_poses(sides["scans"], sides["poses"], "k", ("px",), 3, "2 minutes")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["scan"]: r["px"] for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).where("scan >= 0").collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want) and len(want) > 40


def test_newest_map_stands(spark, tmp_path):
    for stamp, n in ((5.0, 3), (9.5, 7), (7.0, 100), (9.5, 4)):
        spark.range(n).select(F.lit(stamp).alias("stamp"), "id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = ticks.LatestTable(spark, str(tmp_path / "map"))
    assert table.read() is None
    ticks.latest_map(T.source(spark, str(tmp_path / "in"), "stamp double, id long"), table, str(tmp_path / "ck")).awaitTermination()
    assert table.current()[0] == 9.5 and table.read().count() in (4, 7)
    before = table.read()
    n = before.count()
    assert table.put(spark.range(2).select(F.lit(11.0).alias("stamp"), "id"), 11.0, 50)
    assert before.count() == n and table.read().count() == 2  # a reader keeps its version
    assert not table.put(spark.range(9).select(F.lit(10.0).alias("stamp"), "id"), 10.0, 51) and table.read().count() == 2
    assert table.put(spark.range(8).select(F.lit(11.0).alias("stamp"), "id"), 11.0, 52) and table.read().count() == 8
    assert len([p for p in (tmp_path / "map").iterdir() if p.name.startswith("version-")]) == 2
