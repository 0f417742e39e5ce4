"""Cutting lineage: tables written to the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``; only a local session without that setting gets a folder of its own, removed at exit."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="orrery-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    _written.append(f"{root.rstrip('/')}/stage-{uuid.uuid4().hex}")
    return _written[-1]


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends there and no part is recomputed."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with ``name``, 1, 2, ... in the order of the column ``order``; rows go by ranges of it, and only the ranges' counts are summed in one place."""
    ranged = staged(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    before = F.sum("count").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = ranged.groupBy("_range").count().select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy("_range").orderBy(order))
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + rank).drop("_range", "_before")


def clear(spark: SparkSession) -> None:
    """Delete all tables staged so far; call it when no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
