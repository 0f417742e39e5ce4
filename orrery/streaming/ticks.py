"""Frames over ticks (T4-T6, T9): buffers that outlive a micro-batch, exact poses, the newest map.

Buffers are values in the state store, one for each tick of a key (a robot, a
recording), and one for what earlier ticks left.  Ticks are marks on the rows' own time, so which file or micro-batch a row
comes in changes nothing as long as it is not later than the watermark allows; for
live use ticks can follow the clock instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HELD = pa.schema([("stream", pa.string()), ("ts", pa.float64()), ("ref", pa.string())])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAMES = "tick double, ts double, ref string, skew double, image_ts array<double>, image_refs array<string>"
#: Rows of a key in one micro-batch that are held in the worker before they go to the state store.
HELD_ROWS = 500_000


def best_of(scans: pd.DataFrame, images: Sequence[pd.DataFrame], max_dt: float) -> tuple | None:
    """(ts, ref, skew, image_ts, image_refs) of the scan whose worst camera gap is least, None if that is beyond max_dt.

    Each camera gives its nearest image, the earlier of equals; ties between scans
    go to the earlier one, between refs to the lesser.
    """
    scans = scans.sort_values(["ts", "ref"], ignore_index=True)
    t = scans["ts"].to_numpy()
    picks, gaps = [], []
    for own in images:
        own = own.sort_values(["ts", "ref"], ignore_index=True).drop_duplicates("ts", ignore_index=True)
        c = own["ts"].to_numpy()
        after = np.clip(np.searchsorted(c, t), 0, len(c) - 1)
        before = np.clip(after - 1, 0, None)
        pick = np.where(np.abs(t - c[before]) <= np.abs(t - c[after]), before, after)
        picks.append(own.iloc[pick])
        gaps.append(np.abs(t - c[pick]))
    skew = np.max(gaps, axis=0)
    i = int(skew.argmin())
    if skew[i] > max_dt:
        return None
    return float(t[i]), scans["ref"][i], float(skew[i]), [float(p["ts"].iloc[i]) for p in picks], [p["ref"].iloc[i] for p in picks]


def packed(rows: pd.DataFrame) -> bytes:
    """Buffered rows (stream, ts, ref) as one value of the state store: seconds and what they refer to (a file, a message), not the images themselves."""
    table, sink = pa.Table.from_pandas(rows[["stream", "ts", "ref"]].astype({"ts": float}), HELD, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, HELD) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(value: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(bytes(value))).read_all().to_pandas()


class TickBuffers(StatefulProcessor):
    """At every tick the best frame of what is buffered.

    A tick without a scan, or without an image of some camera, leaves the buffers as
    they are: their rows meet those of later ticks, but for rows older than ``keep``
    seconds at the tick before, which go.  Otherwise the buffers are emptied up to the tick, whether a
    scan was within max_dt or not.
    """

    def __init__(self, key: str, scan: str, cameras: Sequence[str], period: float, max_dt: float, keep: float, clock: str):
        self.key, self.streams, self.period, self.max_dt, self.keep, self.clock = key, [scan, *cameras], period, max_dt, keep, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ticks = handle.getMapState("ticks", "tick double", "rows binary")
        self.rest = handle.getValueState("rest", "rows binary")
        self.done = handle.getValueState("done", "tick double")

    def tick_after(self, ts: np.ndarray) -> np.ndarray:
        return (np.floor(ts / self.period) + 1) * self.period

    def keep_rows(self, parts: list[pd.DataFrame]) -> None:
        """The rows to what is held for their ticks, one value a tick."""
        pdf = pd.concat(parts, ignore_index=True)
        marks = self.tick_after(pdf["ts"].to_numpy()) if self.clock == "event" else np.zeros(len(pdf))
        for tick, own in pdf.groupby(marks):
            old = [unpacked(self.ticks.getValue((float(tick),))[0])] if self.ticks.containsKey((float(tick),)) else []
            if not old and self.clock == "event":
                self.handle.registerTimer(int(np.ceil(tick * 1000)))
            self.ticks.updateValue((float(tick),), (packed(pd.concat([*old, own], ignore_index=True)),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.done.get()[0] if self.done.exists() else -np.inf
        parts, n = [], 0
        for pdf in rows:
            pdf = pdf.loc[pdf["ts"].notna() & pdf["stream"].isin(self.streams), ["stream", "ts", "ref"]]
            if self.clock == "event":
                pdf = pdf[self.tick_after(pdf["ts"].to_numpy()) > done]  # later than allowed: the tick is over
            elif len(pdf) and not list(self.handle.listTimers()):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.period * 1000))
            if len(pdf):
                parts, n = [*parts, pdf], n + len(pdf)
            if n > HELD_ROWS:
                self.keep_rows(parts)
                parts, n = [], 0
        if parts:
            self.keep_rows(parts)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        # a tick's rows are read at that tick alone; what ticks without a frame left is kept apart
        marks = sorted(k[0] for k in self.ticks.keys())
        marks = [m for m in marks if m <= now + 1e-9] if self.clock == "event" else marks
        if not marks and (self.clock == "event" or not self.rest.exists()):
            return
        held = unpacked(self.rest.get()[0]) if self.rest.exists() else None
        out = []
        for tick in marks or [now]:
            if marks:
                held = pd.concat([x for x in (held, unpacked(self.ticks.getValue((tick,))[0])) if x is not None], ignore_index=True)
                self.ticks.removeKey((tick,))
            tick = tick if self.clock == "event" else now
            oldest = tick - self.period if self.clock == "event" else held["ts"].max()
            held = held[held["ts"] >= oldest - self.keep]  # what the tick before would have left
            own = {s: held.loc[held["stream"] == s, ["ts", "ref"]] for s in self.streams}
            if all(len(x) for x in own.values()):
                scan, *cameras = own.values()
                if (best := best_of(scan, cameras, self.max_dt)) is not None:
                    out.append((key[0], tick, *best))
                held = held.iloc[:0]
        self.done.update((tick,))
        self.rest.update((packed(held),)) if len(held) else self.rest.clear()
        if self.clock != "event" and len(held):
            self.handle.registerTimer(int((now + self.period) * 1000))
        if out:
            yield pd.DataFrame(out, columns=[self.key, *(c.split()[0] for c in FRAMES.split(", "))])


def best_frames(
    stream: DataFrame, key: str, scan: str, cameras: Sequence[str], period: float, max_dt: float, keep: float = float("inf"), lateness: str = "0 seconds", clock: str = "event"
) -> DataFrame:
    """(key, tick, ts, ref, skew, image_ts, image_refs): a stream of the best frame of each tick, from rows (key, stream, ts, ref).

    ``clock`` is event (ticks at multiples of ``period`` seconds on the rows' own time,
    fired as the watermark passes them) or processing (every period of the wall clock).
    Rows without ts, of other streams, or of a tick that is over are left out.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kind = dict(stream.dtypes)[key]
    rows = stream.select(key, "stream", F.col("ts").cast("double").alias("ts"), F.col("ref").cast("string").alias("ref"))
    if clock == "event":
        rows = rows.withColumn("_at", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))).withWatermark("_at", lateness)
    return rows.groupBy(key).transformWithStateInPandas(
        TickBuffers(key, scan, cameras, period, max_dt, keep, clock), f"{key} {kind}, {FRAMES}", "append", "EventTime" if clock == "event" else "ProcessingTime"
    )


def poses_at(scans: np.ndarray, times: np.ndarray, columns: Sequence[np.ndarray], reach: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which scans (microseconds) have a pose within ``reach`` microseconds at or before them and one at or after, and the columns interpolated there; of poses at one time the greatest counts."""
    order = np.lexsort([np.where(np.isnan(c), -np.inf, c) for c in columns[::-1]] + [times])
    times, columns = times[order], [c[order] for c in columns]
    last = np.append(times[1:] != times[:-1], True) if len(times) else np.zeros(0, dtype=bool)
    times, columns = times[last], [c[last] for c in columns]
    if not len(times):
        return np.zeros(len(scans), dtype=bool), [np.zeros(len(scans)) for _ in columns]
    before, after = np.searchsorted(times, scans, "right") - 1, np.searchsorted(times, scans, "left")
    good = (before >= 0) & (after < len(times))
    b, a = np.clip(before, 0, None), np.clip(after, None, len(times) - 1)
    good &= (scans - times[b] <= reach) & (times[a] - scans <= reach)
    gap = times[a] - times[b]
    part = np.where(gap > 0, (scans - times[b]) / np.where(gap > 0, gap, 1), 0.0)
    return good, [c[b] + part * (c[a] - c[b]) for c in columns]


def exact_poses(scans: DataFrame, poses: DataFrame, key: str, columns: Sequence[str], reach: float, lateness: str = "0 seconds") -> DataFrame:
    """T4: scans (key, at, ...) with the poses' columns (key, at, columns) interpolated at their own time, as a stream.

    Time is cut into slots of ``reach`` seconds: a scan lies in its own, a pose is sent to
    its own and to the one on either side, so every pose that a scan may need is in
    the scan's slot.  An aggregation by key and slot gathers both until the
    watermark says that no other can come, and one search over sorted times then
    serves all scans of a slot: no row for each pair of a scan and a pose.  Scans
    without a pose on both sides are left out, as are rows later than ``lateness``.
    Equal scans are one; of poses at one time the greatest counts.
    """
    own = [c for c in scans.columns if c not in (key, "at")]
    kinds = dict(scans.dtypes)
    scan = F.struct(F.col("at"), *[F.col(c) for c in own])
    pose = F.struct(F.unix_micros("at").alias("t"), *[F.col(c).cast("double").alias(c) for c in columns])
    scan_kind = f"struct<at: timestamp{''.join(f', `{c}`: {kinds[c]}' for c in own)}>"
    pose_kind = f"struct<t: bigint{''.join(f', `{c}`: double' for c in columns)}>"
    span = F.make_dt_interval(secs=F.lit(reach))
    # a pose's last slot begins ``reach`` after its own: the watermark waits for as much more, and for what a scan needs beyond its slot
    wait = f"{lateness} {2 * reach} seconds"
    left = scans.where(F.col(key).isNotNull() & F.col("at").isNotNull()).select(key, F.col("at").alias("_slot"), scan.alias("_scan"), F.lit(None).cast(pose_kind).alias("_pose")).withWatermark("_slot", wait)
    right = poses.where(F.col(key).isNotNull() & F.col("at").isNotNull()).select(F.col(key), F.explode(F.array(F.col("at") - span, F.col("at"), F.col("at") + span)).alias("_slot"), F.lit(None).cast(scan_kind).alias("_scan"), pose.alias("_pose"))
    both = left.unionByName(right.withWatermark("_slot", wait))
    slots = both.groupBy(key, F.window("_slot", f"{reach} seconds").alias("_w")).agg(F.collect_set("_scan").alias("_scans"), F.collect_list("_pose").alias("_poses"))
    micros = 1_000_000 * reach

    def kernel(times: pd.Series, at: pd.Series, values: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i in range(len(times)):
            good, got = poses_at(np.asarray(times.iloc[i], dtype=np.int64), np.asarray(at.iloc[i], dtype=np.int64), [np.asarray(values[c].iloc[i], dtype=float) for c in values.columns], micros)
            out.append((good, *got))
        return pd.DataFrame(dict(zip(["_good", *columns], zip(*out)))) if out else pd.DataFrame({c: [] for c in ["_good", *columns]})

    answer = F.pandas_udf(kernel, f"_good array<boolean>, {', '.join(f'`{c}` array<double>' for c in columns)}")
    with_scans = slots.where(F.size("_scans") > 0).withColumn("_f", answer(F.transform("_scans", lambda x: F.unix_micros(x["at"])), F.col("_poses.t"), F.struct(*[F.col(f"_poses.{c}").alias(c) for c in columns])))
    rows = with_scans.select(key, F.explode(F.arrays_zip("_scans", F.col("_f._good").alias("_good"), *[F.col(f"_f.{c}").alias(f"_{c}") for c in columns])).alias("_r")).where("_r._good")
    return rows.select(key, "_r._scans.at", *[F.col(f"_r._scans.{c}").alias(c) for c in own], *[F.col(f"_r._{c}").alias(c) for c in columns])


class LatestTable:
    """A table of which only the newest version stands, by stamp, and readers see one version whole.

    A version is a folder of its own; the file CURRENT names it, put in place by one
    rename.  A reader resolves the name first, so that a write beside it changes
    nothing; versions before the last ``keep`` are removed.  A batch that runs again
    writes the same version again.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> tuple[float, str] | None:
        """(stamp, folder) of the version that stands; names sort by stamp and batch."""
        name = self.path(f"{self.folder}/CURRENT")
        if not self.fs.exists(name):
            return None
        version = self.spark.read.text(str(name)).first()[0]
        return float(version.split("-")[1]), f"{self.folder}/{version}"

    def put(self, rows: DataFrame, stamp: float, batch: int) -> bool:
        """Make rows the current version unless a newer one stands; equal stamps: the later batch."""
        now = self.current()
        if now and (now[0], int(now[1].rsplit("-", 1)[1])) > (stamp, batch):
            return False
        version = f"version-{stamp:020.6f}-{batch}"
        rows.write.mode("overwrite").parquet(f"{self.folder}/{version}")
        draft, name = self.path(f"{self.folder}/.CURRENT-{batch}"), self.path(f"{self.folder}/CURRENT")
        out = self.fs.create(draft, True)
        out.write(bytearray(version.encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(name.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(draft, name, overwrite)
        found = sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(self.folder)) if s.getPath().getName().startswith("version-"))
        for old in [v for v in found if v < version][: -self.keep + 1 or None]:
            self.fs.delete(self.path(f"{self.folder}/{old}"), True)
        return True

    def read(self) -> DataFrame | None:
        """The version that stands now; the frame keeps reading it whatever comes after."""
        now = self.current()
        return None if now is None else self.spark.read.parquet(now[1])


def latest_map(stream: DataFrame, table: LatestTable, checkpoint: str, period: str | None = None):
    """Of the points (stamp, ...) that come, those of the newest stamp replace the table."""

    def tick(batch: DataFrame, batch_id: int) -> None:
        newest = batch.agg(F.max("stamp")).first()[0]
        if newest is not None:
            table.put(batch.where(F.col("stamp") == newest), float(newest), batch_id)

    writer = stream.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=period) if period else writer.trigger(availableNow=True)).start()
