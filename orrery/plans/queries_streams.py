"""Recordings in files and streams with state over the stand-in tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orrery.operators.lineage import shared_dir
from orrery.plans.tables import Tables, query
from orrery.sources import recordings
from orrery.streaming import frames, ticks

#: Six hours a tick, ten minutes of skew; the end of time, after every row.
TICK, SKEW, END = 21_600, 600.0, 4_000_000_000
ROLES = "CASE event_type WHEN 'view' THEN 'lidar' WHEN 'click' THEN 'a' WHEN 'purchase' THEN 'b' END"


def replayed(t: Tables, rows: DataFrame, closing: DataFrame, root: str, name: str, files: int = 3) -> DataFrame:
    """The rows as a stream of files, a file a tick, and at last a row that moves the watermark past them all."""
    rows.repartition(files).write.parquet(f"{root}/{name}")
    closing.select(*rows.columns).coalesce(1).write.mode("append").parquet(f"{root}/{name}")
    kind = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    return frames.source(t.spark, f"{root}/{name}", kind)


def collected(stream: DataFrame, root: str) -> DataFrame:
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


TICKS = f"""
st AS (SELECT (user_id % 4)::BIGINT AS robot, {ROLES} AS stream, floor(epoch(ts))::DOUBLE AS ts, event_id::VARCHAR AS ref FROM events WHERE event_type IN ('view', 'click', 'purchase')),
tk AS (SELECT robot, floor(ts / {TICK}) + 1 AS k, count(*) FILTER (stream = 'lidar') AS l, count(*) FILTER (stream = 'a') AS a, count(*) FILTER (stream = 'b') AS b FROM st GROUP BY 1, 2),
cu AS (SELECT robot, k, row_number() OVER w AS i, sum(l) OVER w AS l, sum(a) OVER w AS a, sum(b) OVER w AS b FROM tk WINDOW w AS (PARTITION BY robot ORDER BY k)),
run(robot, i, k, l, a, b, since, upto, done) AS (
  SELECT DISTINCT robot, 0::BIGINT, 0::DOUBLE, 0::HUGEINT, 0::HUGEINT, 0::HUGEINT, 0::DOUBLE, 0::DOUBLE, FALSE FROM tk
  UNION ALL
  SELECT cu.robot, cu.i, cu.k, CASE WHEN full_ THEN cu.l ELSE run.l END, CASE WHEN full_ THEN cu.a ELSE run.a END, CASE WHEN full_ THEN cu.b ELSE run.b END, run.upto, CASE WHEN full_ THEN cu.k * {TICK} ELSE run.upto END, full_
  FROM run JOIN cu ON cu.robot = run.robot AND cu.i = run.i + 1, LATERAL (SELECT cu.l > run.l AND cu.a > run.a AND cu.b > run.b AS full_))
"""


@query("t5_buffers_over_ticks", f"""
WITH RECURSIVE {TICKS},
hd AS (SELECT run.robot, run.k * {TICK} AS tick, st.stream, st.ts, st.ref FROM run JOIN st ON st.robot = run.robot AND st.ts >= run.since AND st.ts < run.k * {TICK} WHERE run.done),
nr AS (SELECT s.robot, s.tick, s.ts, s.ref, c.stream, arg_min({{'ts': c.ts, 'ref': c.ref}}, (abs(c.ts - s.ts), c.ts, c.ref)) AS m FROM hd s JOIN hd c ON c.robot = s.robot AND c.tick = s.tick AND c.stream <> 'lidar' WHERE s.stream = 'lidar' GROUP BY ALL),
fr AS (SELECT robot, tick, ts, ref, max(abs(m.ts - ts)) AS skew, any_value(m) FILTER (stream = 'a') AS a, any_value(m) FILTER (stream = 'b') AS b FROM nr GROUP BY 1, 2, 3, 4)
SELECT robot, tick, ts, ref, skew, a.ts AS a_ts, a.ref AS a_ref, b.ts AS b_ts, b.ref AS b_ref FROM fr WHERE skew <= {SKEW} QUALIFY row_number() OVER (PARTITION BY robot, tick ORDER BY skew, ts, ref) = 1
""")
def t5_buffers(t: Tables) -> DataFrame:
    """Views as scans, clicks and purchases as images of two cameras; buffers last over ticks, ticks over files."""
    root = shared_dir(t.spark)
    rows = t.events.where("event_type IN ('view', 'click', 'purchase')")
    rows = rows.select((F.col("user_id") % 4).alias("robot"), F.expr(ROLES).alias("stream"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("ts"), F.col("event_id").cast("string").alias("ref"))
    closing = t.spark.range(1).select(F.lit(0).cast("long").alias("robot"), F.lit("end").alias("stream"), F.lit(float(END)).alias("ts"), F.lit("").alias("ref"))
    stream = replayed(t, rows, closing, root, "in")
    found = collected(ticks.best_frames(stream, "robot", "lidar", ("a", "b"), float(TICK), SKEW, lateness="10000 days"), root)
    return found.select("robot", "tick", "ts", "ref", "skew", *[F.col(f"image_{x}")[i].alias(f"{c}_{n}") for i, c in enumerate("ab") for x, n in (("ts", "ts"), ("refs", "ref"))])


@query("t4_exact_poses", """
WITH sc AS (SELECT user_id % 4 AS robot, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
po AS (SELECT user_id % 4 AS robot, epoch_us(ts) AS t, max(value) AS x FROM events WHERE event_type = 'click' GROUP BY 1, 2),
b AS (SELECT sc.*, po.t AS bt, po.x AS bx FROM sc ASOF JOIN po ON po.robot = sc.robot AND po.t <= sc.t),
a AS (SELECT b.*, po.t AS at_, po.x AS ax FROM b ASOF JOIN po ON po.robot = b.robot AND po.t >= b.t)
SELECT event_id, round(CASE WHEN at_ > bt THEN bx + (t - bt) / (at_ - bt) * (ax - bx) ELSE bx END, 6) + 0.0 AS px FROM a WHERE t - bt <= 3600 * 1000000::BIGINT AND at_ - t <= 3600 * 1000000::BIGINT
""")
def t4_stream(t: Tables) -> DataFrame:
    """T4 as a stream: each view with the clicks' value at its own time, from the clicks within an hour before and after."""
    root = shared_dir(t.spark)
    rows = t.events.select((F.col("user_id") % 4).alias("robot"), "event_id", F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("px"), "event_type")
    closing = t.spark.range(1).select(F.lit(0).cast("long").alias("robot"), F.lit(-1).cast("long").alias("event_id"), F.timestamp_seconds(F.lit(END)).alias("at"), F.lit(0.0).alias("px"))
    scans = replayed(t, rows.where("event_type = 'view'").select("robot", "event_id", "at"), closing, root, "scans")
    poses = replayed(t, rows.where("event_type = 'click'").select("robot", "at", "px"), closing, root, "poses")
    found = collected(ticks.exact_poses(scans, poses, "robot", ("px",), 3600, "10000 days"), root)
    return found.where("event_id >= 0").select("event_id", (F.round("px", 6) + F.lit(0.0)).alias("px"))


@query("t9_newest_map", "SELECT event_id, value FROM events WHERE date_trunc('day', ts) = (SELECT max(date_trunc('day', ts)) FROM events)")
def t9(t: Tables) -> DataFrame:
    """Each day's events as a map message; whatever order the files come in, the newest stands."""
    root = shared_dir(t.spark)
    rows = t.events.select("event_id", "value", F.unix_timestamp(F.date_trunc("day", F.col("ts").cast("timestamp"))).cast("double").alias("stamp"))
    rows.repartition(4, "stamp").write.parquet(f"{root}/in")
    table = ticks.LatestTable(t.spark, f"{root}/map")
    ticks.latest_map(frames.source(t.spark, f"{root}/in", "event_id long, value double, stamp double"), table, f"{root}/state").awaitTermination()
    return table.read().select("event_id", "value")


# --- recordings ------------------------------------------------------------------------


@query("k5_clouds_as_files", "SELECT epoch(date_trunc('day', ts))::DOUBLE AS stamp, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY event_id) - 1 AS idx, event_id::DOUBLE AS id, value AS x FROM events WHERE date_trunc('day', ts) >= TIMESTAMP '2024-01-11' AND date_trunc('day', ts) < TIMESTAMP '2024-01-21'")
def k5(t: Tables) -> DataFrame:
    """Each day's events as one array file, written, then read for ten days; the other files stay closed."""
    root = shared_dir(t.spark)
    day = F.unix_timestamp(F.date_trunc("day", F.col("ts").cast("timestamp"))).cast("double")
    clouds = recordings.clouds_as_files(t.events.select(day.alias("day"), "event_id", F.col("value").alias("x")), "day", ("event_id", "x"), "lidar_pc", "event_id")
    recordings.write_frames(clouds, f"{root}/clouds")
    lo, hi = (F.unix_timestamp(F.lit(d), "yyyy-MM-dd").cast("double") for d in ("2024-01-11", "2024-01-21"))
    return recordings.read_files(t.spark, f"{root}/clouds", names=("id", "x")).where((F.col("stamp") >= lo) & (F.col("stamp") < hi)).select("stamp", "idx", "id", "x")


@query("s5_transforms", "SELECT s_suppkey::DOUBLE AS stamp, s_acctbal AS tx, s_nationkey::DOUBLE AS tz, 1.0::DOUBLE AS qw FROM supplier")
def s5(t: Tables) -> DataFrame:
    """Suppliers as transforms of seven numbers, a file each, read back with a choice of columns."""
    root = shared_dir(t.spark)
    numbers = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("s_acctbal", "zero", "s_nationkey", "zero", "zero", "zero", "one")])
    rows = t.supplier.withColumns({"zero": F.lit(0), "one": F.lit(1)})
    recordings.write_frames(rows.select(F.concat(F.lit("tf_"), "s_suppkey", F.lit(".txt")).alias("name"), numbers.cast("binary").alias("content")), f"{root}/tf")
    return recordings.read_files(t.spark, f"{root}/tf", "transform", columns=("tx", "tz", "qw")).select("stamp", "tx", "tz", "qw")


@query("s18_topics", "SELECT event_type AS topic, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1)::BIGINT AS seq, event_id::DOUBLE AS ts, user_id::VARCHAR AS payload FROM events")
def s18(t: Tables) -> DataFrame:
    """The events of each type as a recorded topic, streamed 700 messages of a topic a tick, through a stop and a start."""
    root = shared_dir(t.spark)
    rows = t.events.select(F.concat(F.lit("of-"), "event_type").alias("topic"), F.col("event_id").cast("double").alias("ts"), F.col("user_id").cast("string").cast("binary").alias("payload"))
    # the topic first: the writer would otherwise sort by it anew, and a sort that spills does not keep the order of ts
    rows.repartitionByRange(4, "ts").sortWithinPartitions("topic", "ts").write.partitionBy("topic").parquet(f"{root}/bag")
    stream = recordings.read_topics(t.spark, f"{root}/bag", per_tick=700)
    collected(stream, root)  # one tick, then a stop; the next start goes on from there
    again = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(processingTime="0 seconds").start()
    try:
        again.processAllAvailable()
    finally:
        again.stop()
    found = t.spark.read.parquet(f"{root}/out")
    return found.select(F.element_at(F.split("topic", "-"), -1).alias("topic"), "seq", "ts", F.col("payload").cast("string").alias("payload"))
