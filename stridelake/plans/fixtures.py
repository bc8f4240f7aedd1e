"""Pose, clip, season and vector views derived from the given tables.

The tables hold no poses, so frames are derived from ``events`` by integer
arithmetic and triangle waves; both Spark and the oracle run this same text and
get the same bits.  Each user's events in time order are one clip's frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.sources import table

BASE = """
base as (
  select user_id as clip_id, event_id as e, event_type, ts,
    cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as f,
    cast(5 + user_id % 14 as int) as half,
    cast(regexp_extract(props, '([0-9]+)', 1) as int) as k
  from {events}),
wave as (
  select *, abs((f + clip_id % 7) % (2 * half) - half) / cast(half as double) as tri,
    case when e % 13 = 0 or clip_id % 97 = 0 then 1 else 0 end as gone,
    cast(1 + case when e % 29 = 0 then 1 else 0 end as int) as n_people
  from base)"""

POSE = """
named as (
  select w.*, cast(t.j as int) as j, t.joint, cast(s.s as int) as s, s.side,
    case when gone = 1 or (e + 5 * t.j + 3 * s.s) % 37 = 0 then 1 else 0 end as lost
  from wave w
  cross join (values (1, 'shoulder'), (2, 'elbow'), (3, 'wrist'), (4, 'hip'), (5, 'knee'), (6, 'ankle')) as t(j, joint)
  cross join (values (0, 'left'), (1, 'right')) as s(s, side)),
pose_all as (
  select clip_id, f, n_people, side, joint,
    case when lost = 0 then 3e-1 + 1e-1 * s + 2e-2 * j + case when j <= 3 then (f % 17) * 4e-3 else 0e0 end + ((e + j) % 7) * 1e-3 end as x2,
    case when lost = 0 then case j when 1 then 4e-1 when 2 then 4.2e-1 + 1e-1 * tri when 3 then 3e-1 + 4e-1 * tri + (e % 11) * 1e-3 when 4 then 6e-1 when 5 then 7.5e-1 else 9e-1 end + ((e * j + s) % 5) * 1e-3 end as y2,
    case when lost = 0 then 4e-1 + ((k + 10 * j + 5 * s) % 100) / 2e2 end as v2,
    case when lost = 0 then 1e-1 * s + 5e-2 * j * ((clip_id + j) % 3) + ((e + j + s) % 9) * 1e-2 end as x3,
    case when lost = 0 then j * 1.5e-1 + case when j in (2, 5) then 1e-1 * tri else 0e0 end + ((e * 3 + j) % 7) * 1e-2 end as y3,
    case when lost = 0 then ((clip_id + j) % 5) * 4e-2 + ((e + 2 * s + j) % 11) * 1e-2 end as z3
  from named)"""

CLIPS = """
clips as (
  select clip_id,
    case clip_id % 5 when 0 then 24e0 when 1 then 30e0 when 2 then 60e0 when 3 then 120e0 else 0e0 end as fps,
    cast(count(*) as int) as total_frames,
    cast(case clip_id % 4 when 0 then 1280 when 1 then 720 when 2 then 300 else 2400 end as int) as width,
    cast(case clip_id % 4 when 0 then 720 when 1 then 1280 when 2 then 200 else 1000 end as int) as height,
    case clip_id % 6 when 1 then '' when 2 then 'abc' when 3 then '0.1' when 4 then '0.2' end as start_sec,
    case clip_id % 6 when 1 then ' ' when 2 then '1.5' when 3 then '1.2' when 4 then 'x' when 5 then '0.9' end as end_sec
  from (select user_id as clip_id from {events}) group by clip_id)"""

BOX = """
box as (
  select l_suppkey as PLAYER_ID, s_name as PLAYER_NAME, l_suppkey % 30 as TEAM_ID,
    cast(count(distinct l_orderkey) as double) as GP, sum(l_quantity) / 5 as REB,
    cast(sum(case when l_discount >= 3e-2 then 1 else 0 end) as double) as AST,
    cast(sum(case when l_linestatus = 'F' then 1 else 0 end) as double) as TOV,
    sum(case when l_returnflag = 'R' then 1 else 0 end) / cast(count(*) as double) as FG3_PCT,
    sum(l_extendedprice) / 1000 as PTS
  from {lineitem} join {supplier} on l_suppkey = s_suppkey group by l_suppkey, s_name)"""


def _run(spark: SparkSession, ctes: str, select: str, sf_dir: str, *names: str) -> DataFrame:
    return spark.sql(f"with {ctes} {select}", **{n: table(spark, sf_dir, n) for n in names})


def pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long raw channels ``clip_id, f, n_people, side, joint`` and six axes."""
    return _run(spark, ",".join((BASE, POSE)), "select * from pose_all", sf_dir, "events")


def ranged_pose(spark: SparkSession, sf_dir: str, bounds: DataFrame) -> DataFrame:
    """Channels of the frames inside their clip's range.  Frames are cut before they
    become twelve rows each; ``f`` counts from the start of the file, as channels go
    by the order of their frames alone."""
    cut = bounds.select("clip_id", "start_frame", "end_frame")
    wave = _run(spark, BASE, "select * from wave", sf_dir, "events")
    kept = wave.join(cut, "clip_id").where((F.col("f") >= F.col("start_frame")) & (F.col("f") < F.col("end_frame"))).select(*wave.columns)
    return spark.sql(f"with {POSE.replace('from wave w', 'from {wave} w')} select * from pose_all", wave=kept)


def short_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole clips in pieces of 4, 5, 10, 11 or 12 frames, each a clip of its own."""
    size = F.expr("case clip_id % 5 when 0 then 4 when 1 then 5 when 2 then 10 when 3 then 11 else 12 end")
    piece = F.col("clip_id") * 100_000 + F.floor(F.col("f") / size)
    return pose(spark, sf_dir).withColumns({"clip_id": piece, "f": (F.col("f") % size).cast("int")})


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, ",".join((BASE, CLIPS)), "select * from clips", sf_dir, "events")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per frame: ``clip_id, f, n_people, e, event_type, ts``."""
    return _run(spark, BASE, "select clip_id, f, n_people, e, event_type, ts, k, tri from wave", sf_dir, "events")


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with an array of landmarks; some arrays are too short for all."""
    point = lambda i: F.struct(((F.col("e") + i) % 101 / 100.0).alias("x"), ((F.col("e") * 3 + i) % 97 / 100.0).alias("y"), (F.col("k") % 7 / 10.0).alias("z"))
    size = F.when(F.col("e") % 13 == 0, 0).when(F.col("e") % 7 == 0, 20).otherwise(33)
    return frames(spark, sf_dir).select("clip_id", "f", F.transform(F.sequence(F.lit(1), F.lit(33)), lambda i: point(i - 1)).alias("l"), size.alias("size")).select("clip_id", "f", F.slice("l", 1, F.col("size")).alias("landmarks"))


def box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, BOX, "select * from box", sf_dir, "lineitem", "supplier")


def all_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries (``vec_id`` divisible by 20) and an index of every row."""
    rows = _vectors(spark, sf_dir)
    return rows.where("vec_id % 20 = 0"), rows.withColumnRenamed("vec_id", "id")


def wide_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as a pose scan gives them: maps of landmarks, NaN where lost."""
    nan = F.lit(float("nan"))
    key = F.concat_ws("_", "side", "joint")
    point = lambda axes, names: F.struct(key, F.struct(*[F.coalesce(F.col(a), nan).alias(n) for a, n in zip(axes, names)]))
    rows = pose(spark, sf_dir).groupBy("clip_id", F.col("f").alias("frame_idx"))
    return rows.agg(F.first("n_people").alias("n_people"), F.map_from_entries(F.collect_list(point(("x3", "y3", "z3"), "xyz"))).alias("p3"), F.map_from_entries(F.collect_list(point(("x2", "y2", "v2"), ("x", "y", "visibility")))).alias("p2"))


def live_pose(spark: SparkSession, sf_dir: str, chunks: int) -> DataFrame:
    """Wide frames with the time they come: clips begin two seconds apart and run
    at 30 frames a second; ``chunk`` numbers equal spans of time."""
    second = F.col("clip_id") * 2 + F.col("frame_idx") / 30.0
    rows = wide_pose(spark, sf_dir).withColumn("ts", F.timestamp_millis((1_700_000_000_000 + F.round(second * 1000)).cast("long")))
    clip = table(spark, sf_dir, "events").agg(F.min("user_id").alias("a"), F.max("user_id").alias("b")).first()
    low, high = 2 * (clip["a"] or 0), 2 * (clip["b"] or 0) + 60
    return rows.withColumn("chunk", F.least(F.floor((second - low) * chunks / (high - low)), F.lit(chunks - 1)))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("weighted"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("weighted", F.lit(0.0), lambda t, v: t + v * v)))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON report per clip; its feedback is a list, a text, or missing."""
    feedback = F.when(F.col("clip_id") % 3 == 0, F.lit('[{"timestamp":"0:01","category":"form","observation":"steady"},{"timestamp":"0:02","category":"power","observation":"late"}]')).when(F.col("clip_id") % 3 == 1, F.concat(F.lit('"keep going '), F.col("clip_id").cast("string"), F.lit('"')))
    action = F.when(F.col("clip_id") % 4 == 0, "").otherwise(F.concat(F.lit("Jump shot "), F.col("clip_id").cast("string")))
    body = F.concat(F.lit('{"athlete_action":"'), action, F.lit('"'), F.coalesce(F.concat(F.lit(',"athlete_feedback":'), feedback), F.lit("")), F.when(F.col("clip_id") % 5 == 0, F.lit("")).otherwise(F.lit(',"scout_report":"solid","witty_catchphrase":"swish"')), F.lit("}"))
    return clips(spark, sf_dir).select("clip_id", body.alias("body"))


#: What the feedback of a report may be, by clip; it says of statistics what is not so.
SHAPES = ['"keep going"', '""', "7.5", "0", "true", "false", "null", "[]", "{}", '{"tempo":"slow"}', '[{"timestamp":"0:01","category":"form","observation":"steady"}]', '["a word",{"category":"power"},3]', "[[1,2],null]"]


def shaped_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report per clip with feedback of every shape; some bodies are no JSON."""
    made = F.array(*[F.lit(s) for s in SHAPES])[(F.col("clip_id") % len(SHAPES)).cast("int")]
    body = F.concat(F.lit('{"stats":{"knee_angle":1},"athlete_feedback":'), made, F.lit("}"))
    return clips(spark, sf_dir).select("clip_id", F.when(F.col("clip_id") % 17 == 0, "no json {").when(F.col("clip_id") % 17 == 1, "[1]").otherwise(body).alias("body"))
