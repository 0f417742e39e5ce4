"""Results that hang on ties, borders, lengths and spills, against DuckDB or by hand."""

import datetime as dt
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from orrery.operators import spatial
from orrery.plans.registry import ORACLE_SQL, QUERIES
from tests.compare import difference

SMALL = "/root/testdata/sf0.001"


def both(spark, tmp_path, name, **tables):
    """The query's difference from its SQL over the given tables."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table, df in tables.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    return difference(QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(ORACLE_SQL[name]).df())


def test_pairs_on_the_border_of_a_radius(spark):
    """A distance beyond 2 in its last bits lies on the border once rounded, in whatever cells the two are."""
    far = 2.0 + 4.4e-16
    assert far * far > 4
    left, right = spark.createDataFrame([(1, 0.0, 0.0), (2, -1e-12, 0.0)], "i long, x double, y double"), spark.createDataFrame([(1, far, 0.0), (2, 2.1, 0.0)], "j long, x double, y double")
    near = lambda **k: {(r["l"]["i"], r["r"]["j"]) for r in spatial.radius_join(left, right, 2.0, ["x", "y"], **k).collect()}
    assert near() == set() and near(digits=9) == {(1, 1), (2, 1)}


def test_radius_queries_on_the_border(spark, tmp_path):
    rows = [(50 * i, dt.datetime(2024, 1, 1), i, "view", 0.1 * i) for i in range(40)] + [(50 * i + 1, dt.datetime(2024, 1, 1), i, "view", 0.1 * i + k) for i, k in zip(range(40), [2.0, 3.0] * 20)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    for name in ("j6_radius3d", "j7_radius2d"):
        (tmp_path / name).mkdir()
        assert both(spark, tmp_path / name, name, events=events) == ""


def test_names_of_seven_digits(spark, tmp_path):
    part = spark.read.parquet(f"{SMALL}/part.parquet").withColumn("p_partkey", F.col("p_partkey") + 999_990)
    assert both(spark, tmp_path, "f21_strings", part=part) == ""


def test_length_of_ties_and_of_more_rows_than_a_batch(spark, tmp_path):
    rows = spark.range(25_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("id") * 7919 % 5_000)).cast("timestamp_ntz").alias("ts"), (F.col("id") % 2 * 0 + 3).alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") * 31 % 97).cast("double").alias("value"))
    assert both(spark, tmp_path, "t10_running_length", events=rows) == ""


def test_topics_keep_their_order_when_the_writer_spills(tmp_path):
    """In a session of its own, whose sorts spill every 100 rows."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.shuffle.spill.numElementsForceSpillThreshold", "100").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
import duckdb
from orrery.plans.registry import ORACLE_SQL, QUERIES
from tests.compare import difference
con = duckdb.connect()
con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.01/events.parquet'")
print("DIFFERENCE", repr(difference(QUERIES["s18_topics"](spark, "/root/testdata/sf0.01").toPandas(), con.execute(ORACLE_SQL["s18_topics"]).df())))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "DIFFERENCE ''" in out.stdout, out.stdout + out.stderr[-2000:]


def test_points_whose_nearest_have_no_image(spark, tmp_path):
    """All fifty nearest lack an image: null, as the SQL has it."""
    rows = [(50, dt.datetime(2024, 1, 1), 1, "view", 0.0)] + [(i, dt.datetime(2024, 1, 1), 1, "view", 0.01 * i) for i in range(51, 140) if i % 7 and i % 61 and i % 50]
    rows += [(i, dt.datetime(2024, 1, 1), 1, "view", 500.0) for i in range(140, 160) if i % 50]
    assert both(spark, tmp_path, "j5_knn_coalesce", events=spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")) == ""


def test_dense_pairs_meet_in_blocks(spark, tmp_path, monkeypatch):
    """No group holds a whole scene: blocks of twenty rows give what SQL gives."""
    from orrery.operators import similarity

    monkeypatch.setattr(similarity, "BLOCK", 20)
    monkeypatch.setattr(similarity, "DENSE_BLOCK", 20)
    segments = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    for name in ("a19_spread", "g14_weight_matrix", "j16_dense_pairs"):
        (tmp_path / name).mkdir()
        assert both(spark, tmp_path / name, name, embeddings=segments) == ""
