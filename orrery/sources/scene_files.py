"""Scans and sinks of scene data."""

from __future__ import annotations

import io
from collections.abc import Iterable
from functools import reduce
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

POINTS = "gidx long, x double, y double, z double, intensity double"


# --- names of files ---------------------------------------------------------------


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def number_in_name(path: Column) -> Column:
    """The first decimal number of the file's stem; names without one come last."""
    return F.coalesce(F.nullif(F.regexp_extract(stem(path), r"(\d+\.\d+)", 1), F.lit("")).cast("double"), F.lit(float("inf")))


def trailing_stamp(path: Column) -> Column:
    """The number after the last underscore of the stem."""
    return F.element_at(F.split(stem(path), "_"), -1).try_cast("double")


def camera_and_stamp(path: Column) -> tuple[Column, Column]:
    """(camera from 0, time) of ``camN_img_T``; other names raise when read."""
    pattern = r"cam(\d+)_img_([0-9]+\.[0-9]+)"
    ok = F.regexp_like(path, F.lit(pattern))
    bad = F.raise_error(F.concat(F.lit("not an image name: "), path))
    return (
        F.when(ok, F.regexp_extract(path, pattern, 1).try_cast("int") - 1).otherwise(bad.cast("int")),
        F.when(ok, F.regexp_extract(path, pattern, 2).try_cast("double")).otherwise(bad.cast("double")),
    )


def latest_iteration(files: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """The largest number that ``pattern`` captures, -1 if none."""
    found = F.regexp_extract(F.element_at(F.split(F.col(path), "/"), -1), pattern, 1).try_cast("long")
    return files.agg(F.coalesce(F.max(found), F.lit(-1)).cast("long").alias("itr"))


def latest_file(files: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """The file of that number, null if none."""
    found = F.regexp_extract(F.element_at(F.split(F.col(path), "/"), -1), pattern, 1).try_cast("long")
    return files.agg(F.max_by(F.when(found.isNotNull(), F.col(path)), found).alias("file"))


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length) of a folder's files, contents unread."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length")


# --- contents ----------------------------------------------------------------------


def read_arrays(spark: SparkSession, folder: str, columns: Iterable[str], glob: str = "*.npy") -> DataFrame:
    """Rows of 2-d .npy arrays: (path, idx, columns...), files in parallel."""
    names = list(columns)

    def decode(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = np.load(io.BytesIO(content), allow_pickle=False).reshape(-1, len(names)).astype(float)
                yield pd.DataFrame({"path": path, "idx": np.arange(len(rows)), **{n: rows[:, i] for i, n in enumerate(names)}})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")
    return files.mapInPandas(decode, ", ".join(["path string", "idx long", *[f"{n} double" for n in names]]))


def latest_cloud(spark: SparkSession, folder: str) -> DataFrame:
    """The points of the newest map file."""
    newest = listing(spark, folder, "*.npy").agg(F.max_by("path", F.struct(number_in_name(F.col("path")), "path")).alias("path")).first()["path"]
    if newest is None:
        return spark.createDataFrame([], POINTS)
    return read_arrays(spark, newest, ("x", "y", "z", "intensity")).select(F.col("idx").alias("gidx"), "x", "y", "z", "intensity")


def read_transforms(spark: SparkSession, folder: str) -> DataFrame:
    """(path, ts, tx, ty, tz, qx, qy, qz, qw) of text files of seven numbers."""
    rows = spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.transform(F.regexp_extract_all("value", F.lit(r"([-+0-9.eE]+)")), lambda s: s.cast("double")).alias("v"))
    return rows.select("path", trailing_stamp(F.col("path")).alias("ts"), *[F.col("v")[i].alias(n) for i, n in enumerate(("tx", "ty", "tz", "qx", "qy", "qz", "qw"))])


def synced_frames(frames: DataFrame, scans: DataFrame, images: DataFrame, transforms: DataFrame) -> DataFrame:
    """Aligned frames with their scan, image and transform rows, by the matched times."""
    return frames.join(scans, "lidar_ts").join(images, ["cam", "image_ts"]).join(transforms, ["cam", "transform_ts"])


def read_params(path: str) -> list[dict]:
    """The documents of a parameter file: JSON, or YAML where that library is present."""
    text = open(path, encoding="utf-8").read()
    if PurePosixPath(path).suffix == ".json":
        import json

        found = json.loads(text)
        return found if isinstance(found, list) else [found]
    import yaml

    return [d for d in yaml.safe_load_all(text) if d is not None]


def class_names(spark: SparkSession, classes: dict[int, tuple[str, tuple[int, int, int]]]) -> DataFrame:
    """(label, name, color) as a dimension table."""
    return spark.createDataFrame([(k, n, list(c)) for k, (n, c) in sorted(classes.items())], "label int, name string, color array<int>")


# --- saving and resuming -----------------------------------------------------------


def save_iteration(tables: dict[str, DataFrame], folder: str, itr: int) -> None:
    """K1, K2: every table as Parquet under ``table/itr=N``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}/itr={itr}")


def load_iteration(spark: SparkSession, folder: str, names: Iterable[str], itr: int | None = None) -> tuple[int, dict[str, DataFrame]]:
    """The newest saved iteration (or the one named) of each table; -1 and nothing if there is none."""
    names = list(names)
    if itr is None:
        try:
            itr = spark.read.parquet(f"{folder}/{names[0]}").agg(F.max("itr")).first()[0]
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
            itr = None
    if itr is None:
        return -1, {}
    return itr, {n: spark.read.parquet(f"{folder}/{n}").where(F.col("itr") == itr).drop("itr") for n in names}


def save_scene(scene: dict[str, DataFrame], params: dict[str, object], folder: str) -> None:
    """K3, K4: nodes, edges and the other tables, with the parameters they were built with."""
    spark = next(iter(scene.values())).sparkSession
    for name, df in scene.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    rows = [(k, str(v)) for k, v in sorted(params.items())]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/params")


def load_scene(spark: SparkSession, folder: str, names: Iterable[str] = ("nodes", "edges")) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """S11, S12"""
    params = {r["name"]: r["value"] for r in spark.read.parquet(f"{folder}/params").collect()}
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}, params


def load_scenes(spark: SparkSession, folders: dict[str, str], table: str = "nodes") -> DataFrame:
    """One table of several scenes, with the scene's name as a column."""
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{f}/{table}").withColumn("scene", F.lit(n)) for n, f in folders.items()])
