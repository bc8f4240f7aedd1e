"""Clip ranges, gap filling and smoothing of pose channels.

Long channels have ``clip_id, side, joint, f`` and one column for each axis.
Everything is keyed by clip; frames meet once as channels, channels once as clips.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from stridelake.functions import fill_lists, lenient_double, means, smooth, smooth_lists, whole_groups
from stridelake.sources import AXES, JOINTS, LANDMARKS, SIDES

SMOOTH_WINDOW = 11
CHANNEL = ["clip_id", "side", "joint"]


def clip_bounds(clips: DataFrame) -> DataFrame:
    """Clips with ``fps`` (0 or null: 30), ``ar`` and their frame range
    ``start_frame <= f < end_frame``.  A missing start counts as 0."""
    fps = F.coalesce(F.when(F.col("fps") > 0, F.col("fps")), F.lit(30.0))
    rows = clips.withColumn("fps", fps).withColumn("_start", lenient_double(F.col("start_sec"))).withColumn("_end", lenient_double(F.col("end_sec")))
    total = F.when(F.col("total_frames") > 0, F.col("total_frames"))
    frame = lambda sec: (F.col(sec) * F.col("fps")).cast("int")
    # least() skips nulls, so an unknown total caps nothing.
    start = F.when(F.col("_start") >= 0, F.least(frame("_start"), total - 1)).otherwise(F.lit(0))
    end = F.when(F.col("_end") > F.coalesce("_start", F.lit(0.0)), F.least(frame("_end"), total)).otherwise(F.coalesce(total, F.lit(999999)))
    ar = F.when(F.col("height") > 0, F.col("width") / F.col("height")).otherwise(F.lit(1.0))
    return rows.withColumn("start_frame", start).withColumn("end_frame", end).withColumn("ar", ar).drop("_start", "_end")


def in_range(frames: DataFrame, bounds: DataFrame) -> DataFrame:
    """Frames inside their clip's range, counted from its start; ``ms`` is the
    absolute time in the file."""
    cut = bounds.select("clip_id", "fps", "start_frame", "end_frame")
    kept = frames.join(cut, "clip_id").where((F.col("f") >= F.col("start_frame")) & (F.col("f") < F.col("end_frame")))
    return kept.withColumn("ms", F.floor(1000 * F.col("f") / F.col("fps")).cast("int")).withColumn("f", F.col("f") - F.col("start_frame")).drop("fps", "start_frame", "end_frame")


def select_landmarks(frames: DataFrame) -> DataFrame:
    """Twelve named joints out of ``landmarks array<struct<x,y,z>>``; an index
    that is not there gives nulls."""
    names = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(j).alias("joint"), F.lit(LANDMARKS[j][k]).alias("i")) for j in JOINTS for k, s in enumerate(SIDES)])
    rows = frames.select("clip_id", "f", "landmarks", F.explode(names).alias("c"))
    point = F.get("landmarks", F.col("c.i"))
    return rows.select("clip_id", "f", "c.side", "c.joint", *[point[a].alias(a) for a in "xyz"])


def fill_gaps(channels: DataFrame) -> DataFrame:
    """One row per channel with an array for each axis in frame order, filled
    linearly between known neighbours, flat beyond them, 0 where nothing is
    known; ``n`` is the clip's number of frames, ``raw_vis`` the mean raw
    visibility.  Series shorter than the smoothing window only get zeros.

    Rows are sorted by channel and frame; each task gathers them from Arrow batches
    and holds the rows of one batch and of one open channel, so the work is linear in
    the frames."""
    return _gathered(channels, lambda lists: fill_lists(lists, SMOOTH_WINDOW))


def smoothed(channels: DataFrame) -> DataFrame:
    """``channel_arrays`` of ``fill_gaps``, in one pass."""
    return _gathered(channels, lambda lists: smooth_lists(fill_lists(lists, SMOOTH_WINDOW), SMOOTH_WINDOW))


def _gathered(channels: DataFrame, made: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """One row per channel; ``made`` gives an axis's lists from its raw ones."""
    rows = channels.select(*CHANNEL, "f", *[F.col(a).cast("double").alias(a) for a in AXES])
    keys = rows.select(*CHANNEL).schema
    schema = StructType([*keys, StructField("n", IntegerType()), StructField("raw_vis", DoubleType()), *[StructField(a, ArrayType(DoubleType())) for a in AXES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, starts in whole_groups(batches, CHANNEL):
            ends = np.append(starts, len(whole))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), whole[a]) for a in AXES]
            first = whole.select(CHANNEL).take(pa.array(starts))
            yield pa.RecordBatch.from_arrays([*first.columns, pa.array(np.diff(ends), pa.int32()), means(lists[AXES.index("v2")]), *map(made, lists)], names=schema.names)

    # Rows of the same frame are in the order of their values.
    return rows.repartition(*CHANNEL).sortWithinPartitions(*CHANNEL, "f", *AXES).mapInArrow(run, schema)


def channel_arrays(filled: DataFrame) -> DataFrame:
    """Filled channels smoothed where the series is long enough."""
    return filled.select("clip_id", "side", "joint", "n", "raw_vis", *[smooth(F.col(a), SMOOTH_WINDOW).alias(a) for a in AXES])


def long_channels(arrays: DataFrame, *more: str) -> DataFrame:
    """Arrays back to one row per frame."""
    keys = ["clip_id", "side", "joint", *more]
    return arrays.select(*keys, F.posexplode(F.arrays_zip(*AXES)).alias("f", "p")).select(*keys, "f", *[F.col(f"p.{a}").alias(a) for a in AXES])


def clip_records(arrays: DataFrame, bounds: DataFrame) -> DataFrame:
    """One row per clip: ``ch``, a map from side_joint to its arrays, ``n``, the
    pose visibility over six upper joints, and the clip's facts."""
    upper = F.col("joint").isin("shoulder", "elbow", "wrist")
    both = F.struct(F.concat_ws("_", "side", "joint").alias("k"), F.struct(*AXES).alias("v"))
    rows = arrays.groupBy("clip_id").agg(F.map_from_entries(F.collect_list(both)).alias("ch"), F.max("n").alias("n"), F.avg(F.when(upper, F.col("raw_vis"))).alias("visibility"), F.count(F.when(upper, F.col("raw_vis"))).alias("_seen"))
    # A joint that is never seen leaves the mean of the six undefined.
    rows = rows.withColumn("visibility", F.when(F.col("_seen") == 6, F.col("visibility"))).drop("_seen")
    return bounds.select("clip_id", "fps", "ar", "width", "height").join(rows, "clip_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def people(frames: DataFrame) -> DataFrame:
    """``clip_id, people_max, sampled``: most people over every
    ``max(1, n // 8)``-th frame; a clip without frames is not there."""
    step = F.greatest(F.lit(1), F.floor(F.col("n") / 8))
    one = frames.select("clip_id", "f", "n_people").distinct().withColumn("n", F.count("*").over(Window.partitionBy("clip_id")))
    return one.where(F.col("f") % step == 0).groupBy("clip_id").agg(F.max("n_people").alias("people_max"), F.count("*").alias("sampled"))
