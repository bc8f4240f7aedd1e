"""Schemas, scans, sinks, and the literal tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDES = ("left", "right")
JOINTS = ("shoulder", "elbow", "wrist", "hip", "knee", "ankle")
AXES = ("x2", "y2", "v2", "x3", "y3", "z3")
#: Where the 12 joints stand among 33 landmarks (left, right).
LANDMARKS = {"shoulder": (11, 12), "elbow": (13, 14), "wrist": (15, 16), "hip": (23, 24), "knee": (25, 26), "ankle": (27, 28)}
#: The eight metrics in vector order, and the weights of matching.
METRICS = ("release_velocity_mps", "shot_arc_deg", "knee_angle", "elbow_angle", "kinetic_sync_ms", "fluidity_score", "hip_rotation_deg", "balance_index")
WEIGHTS = (16.6, 3.3, 1.25, 1.66, 0.33, 1.66, 2.22, 2.0)

_POINT3 = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])
_POINT2 = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "visibility")])
POSE_FRAMES = T.StructType(
    [
        T.StructField("clip_id", T.LongType()),
        T.StructField("frame_idx", T.IntegerType()),
        T.StructField("n_people", T.IntegerType()),
        T.StructField("p3", T.MapType(T.StringType(), _POINT3)),
        T.StructField("p2", T.MapType(T.StringType(), _POINT2)),
    ]
)
CLIPS = "clip_id long, fps double, total_frames int, width int, height int, start_sec string, end_sec string"
BOX_SCORES = "PLAYER_ID long, PLAYER_NAME string, TEAM_ID long, GP string, REB string, AST string, TOV string, FG3_PCT string, PTS string"
SEED_SCHEMA = "PLAYER_NAME string, PLAYER_ID long, REB double, AST double, TOV double, FG3_PCT double, PTS double, GP double"
# The rows that stand in when no season table is at hand.
SEED_ROWS = [
    ("Stephen Curry", 201939, 5.2, 6.5, 2.8, 0.429, 26.4, 69.0),
    ("Klay Thompson", 202691, 4.0, 2.2, 1.6, 0.412, 21.5, 65.0),
    ("LeBron James", 2544, 8.3, 7.1, 3.5, 0.355, 25.7, 55.0),
    ("Kevin Durant", 201142, 6.4, 5.0, 2.9, 0.389, 27.1, 47.0),
    ("Luka Doncic", 1629029, 8.0, 8.8, 4.0, 0.368, 28.4, 66.0),
    ("Nikola Jokic", 203999, 12.2, 9.8, 3.6, 0.332, 26.2, 69.0),
    ("Giannis Antetokounmpo", 203507, 11.5, 5.7, 3.2, 0.272, 30.4, 63.0),
    ("Joel Embiid", 203954, 11.0, 3.6, 3.4, 0.348, 28.7, 39.0),
    ("Jayson Tatum", 1628369, 8.1, 4.6, 2.6, 0.375, 26.9, 74.0),
    ("Devin Booker", 1626164, 4.2, 6.8, 2.9, 0.362, 27.1, 68.0),
    ("Anthony Edwards", 1630162, 5.5, 5.1, 3.0, 0.358, 25.9, 79.0),
    ("Tyrese Haliburton", 1630169, 3.9, 10.9, 2.3, 0.367, 20.1, 69.0),
    ("Damian Lillard", 203081, 4.2, 7.2, 2.8, 0.378, 25.1, 73.0),
    ("Donovan Mitchell", 1628378, 4.3, 5.3, 2.8, 0.368, 26.6, 55.0),
    ("Shai Gilgeous-Alexander", 1628983, 5.5, 6.2, 2.5, 0.353, 30.1, 75.0),
]
# Sports with their phases, and the metrics of the one that has some.
SPORTS = [
    ("basketball", "Basketball", 2.0, "16:9 landscape, 45° front-offset", ["Setup", "Dip", "Drive", "Release", "Follow-through"]),
    ("tennis", "Tennis", 3.0, "16:9 side view", ["Toss", "Racquet Drop", "Contact", "Follow-through"]),
    ("golf", "Golf", 3.0, "16:9 DTL or face-on", ["Address", "Backswing", "Downswing", "Impact", "Follow-through"]),
]
METRIC_RANGES = [
    ("release_velocity_mps", "Release Velocity", "m/s", "7–9"),
    ("shot_arc_deg", "Shot Arc", "°", "45–55"),
    ("knee_angle", "Knee Flexion", "°", "140–165"),
    ("elbow_angle", "Elbow Flexion", "°", "165–178"),
    ("hip_rotation_deg", "Hip Rotation", "°", "5–15"),
    ("kinetic_sync_ms", "Kinetic Sync", "ms", "120–250"),
    ("balance_index", "Balance Index", "/100", "85–99"),
    ("fluidity_score", "Fluidity Score", "/100", "75–99"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_pose_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSE_FRAMES).parquet(path)


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLIPS).parquet(path)


def read_box_scores(spark: SparkSession, path: str) -> DataFrame:
    """A league table as CSV; every number stays text until it is coerced."""
    return spark.read.schema(BOX_SCORES).csv(path, header=True)


def seed_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED_ROWS, SEED_SCHEMA)


def or_else(main: DataFrame, fallback: DataFrame) -> DataFrame:
    """``main``, or ``fallback`` where ``main`` has no row: an anti-join on one
    probe row, so nothing is counted."""
    probe = main.limit(1).select(F.lit(True).alias("_there"))
    return main.unionByName(fallback.join(probe, F.col("_there"), "left_anti"))


def overwrite(df: DataFrame, path: str) -> DataFrame:
    """Replace the table at ``path`` and give it back as it was written."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positions(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """``df`` with each row's place, from 0, in the order of ``order``; equal rows
    are in any order.  Rows are sorted by ranges, and a range starts after the
    counts of those before it, of which there are as many as ranges."""
    ranged = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = counts.select("_range", "_first", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    # Numbers within a task ascend one by one.
    rows = ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_at") - F.col("_first"))
    return rows.drop("_range", "_at", "_first", "_before")


def shared_folder(spark: SparkSession) -> str:
    """A fresh path in the folder all executors share (``spark.checkpoint.dir``);
    only where that is unset, as in tests, a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="stridelake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def settled(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: it is computed once,
    and filters above it do not copy its expressions.  The table goes when the
    session's driver ends.  ``options`` are the writer's."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.options(**options).parquet(path)
    place, fs = _place(spark, path)
    fs.deleteOnExit(place)
    for paths in _passing:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Tables settled inside each open ``passing``.
_passing: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that are settled inside are deleted at the end: for steps whose result
    is written by then, and that come again and again."""
    paths: list[str] = []
    _passing.append(paths)
    try:
        yield
    finally:
        _passing[:] = [other for other in _passing if other is not paths]
        for path in paths:
            place, fs = _place(spark, path)
            fs.delete(place, True)


def melt_pose(frames: DataFrame) -> DataFrame:
    """Wide pose frames to long channels ``clip_id, f, n_people, side, joint``
    and six axes; a frame without a pose keeps its twelve rows, all null."""
    names = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(j).alias("joint"), F.lit(f"{s}_{j}").alias("name")) for s in SIDES for j in JOINTS])
    rows = frames.select("clip_id", F.col("frame_idx").alias("f"), "n_people", "p2", "p3", F.explode(names).alias("c"))
    p2, p3 = F.try_element_at("p2", F.col("c.name")), F.try_element_at("p3", F.col("c.name"))
    fields = [p2["x"], p2["y"], p2["visibility"], p3["x"], p3["y"], p3["z"]]
    return rows.select("clip_id", "f", "n_people", "c.side", "c.joint", *[F.when(~F.isnan(v), v).alias(a) for a, v in zip(AXES, fields)])


def sports(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPORTS, "id string, name string, min_clip_sec double, recommended_aspect string, event_phases array<string>")


def sport_metrics(spark: SparkSession) -> DataFrame:
    """``sport, pos, key, label, unit, low, high``."""
    rows = spark.createDataFrame([("basketball", k, *m) for k, m in enumerate(METRIC_RANGES)], "sport string, pos int, key string, label string, unit string, ideal_range string")
    part = F.split("ideal_range", "–")
    return rows.withColumn("low", part[0].cast("double")).withColumn("high", part[1].cast("double"))


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    """``clip_id, metric, baseline, tolerance`` from JSON objects of two maps,
    one for each clip."""
    both = spark.read.schema("clip_id long, baseline map<string,double>, tolerances map<string,double>").json(path)
    rows = both.select("clip_id", F.explode("baseline").alias("metric", "baseline"), "tolerances")
    return rows.select("clip_id", "metric", "baseline", F.try_element_at("tolerances", F.col("metric")).alias("tolerance"))


def write_baselines(baselines: DataFrame, path: str) -> None:
    """The sink that ``read_baselines`` reads."""
    maps = baselines.groupBy("clip_id").agg(F.map_from_entries(F.collect_list(F.struct("metric", "baseline"))).alias("baseline"), F.map_from_entries(F.collect_list(F.struct("metric", "tolerance"))).alias("tolerances"))
    maps.write.mode("overwrite").json(path)
