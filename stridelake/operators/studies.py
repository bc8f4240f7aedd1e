"""Studies over many clips: shots, subjects, repeatability, accuracy, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.functions import round_off
from stridelake.sources import METRICS


def shot_segments(wrist: DataFrame) -> DataFrame:
    """``clip_id, shot, first_f, last_f, release_f`` from ``clip_id, f, y``: a
    local minimum of y (a high wrist) releases a shot; the shot runs from the
    frame after the last release to its own."""
    order = Window.partitionBy("clip_id").orderBy("f")
    rows = wrist.select("clip_id", "f", "y", F.lag("y").over(order).alias("p"), F.lead("y").over(order).alias("q"))
    rows = rows.withColumn("hit", ((F.col("y") < F.col("p")) & (F.col("y") <= F.col("q"))).cast("int"))
    rows = rows.withColumn("shot", F.coalesce(F.sum("hit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.groupBy("clip_id", "shot").agg(F.min("f").alias("first_f"), F.max("f").alias("last_f"), F.max(F.when(F.col("hit") == 1, F.col("f"))).alias("release_f"))


def primary_subject(people: DataFrame) -> DataFrame:
    """One row per clip: the subject with the largest size times centrality."""
    score = F.col("size") * (1 - 2 * F.abs(F.col("centre_x") - 0.5))
    order = Window.partitionBy("clip_id").orderBy(F.desc("score"), "subject")
    return people.withColumn("score", score).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def angle_jumps(angles: DataFrame, limit: float = 40.0) -> DataFrame:
    """Frames whose angle differs by more than ``limit`` from the frame before."""
    jump = F.abs(F.col("angle") - F.lag("angle").over(Window.partitionBy("clip_id").orderBy("f")))
    return angles.withColumn("jump", jump).where(F.col("jump") > limit)


def run_spread(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Population standard deviation of every metric over repeated runs."""
    return runs.groupBy(*keys).agg(F.count("*").alias("runs"), *[round_off(F.stddev_pop(F.col(m).cast("double")), 6).alias(m) for m in METRICS])


def joint_error(measured: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean absolute error per joint of ``clip_id, joint, f, x, y``."""
    both = measured.join(truth.select("clip_id", "joint", "f", F.col("x").alias("tx"), F.col("y").alias("ty")), ["clip_id", "joint", "f"])
    return both.groupBy("joint").agg(F.avg((F.abs(F.col("x") - F.col("tx")) + F.abs(F.col("y") - F.col("ty"))) / 2).alias("mae"), F.count("*").alias("frames"))


def precision_recall(rows: DataFrame) -> DataFrame:
    """Accuracy, precision and recall of ``predicted`` against ``actual``."""
    n = lambda p, a: F.sum(((F.col("predicted") == p) & (F.col("actual") == a)).cast("int"))
    counts = rows.agg(n(1, 1).alias("tp"), n(1, 0).alias("fp"), n(0, 1).alias("fn"), n(0, 0).alias("tn"))
    return counts.select("*", ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"), (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"), (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("recall"))


def trend(rows: DataFrame, who: str, when: str, value: str) -> DataFrame:
    """Slope over time and last three-point mean for each athlete."""
    order = Window.partitionBy(who).orderBy(when)
    moved = rows.withColumn("moving", F.avg(value).over(order.rowsBetween(-2, 0)))
    return moved.groupBy(who).agg(F.regr_slope(value, when).alias("slope"), F.max_by("moving", when).alias("last_moving"), F.count("*").alias("points"))


def cohort_percentiles(rows: DataFrame, cohort: str, value: str, bins: int = 4096) -> DataFrame:
    """``percent_rank`` of each row within its cohort.  Rows are counted per
    value first, so a cohort's window holds different values, not rows."""
    counts = rows.groupBy(cohort, value).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy(cohort))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(cohort).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select(cohort, value, F.when(total > 1, below / (total - 1)).otherwise(F.lit(0.0)).alias("percent_rank"))
    return rows.join(ranks, [cohort, value])


def confidence_tier(confidence):
    return F.when(confidence >= 80, "High").when(confidence >= 50, "Medium").otherwise("Low")


def in_ideal_range(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """``clip_id, metric, value`` with ``in_range`` by the sport's ranges (a
    dimension of a few rows)."""
    return values.join(F.broadcast(ranges.select(F.col("key").alias("metric"), "low", "high")), "metric").withColumn("in_range", F.col("value").between(F.col("low"), F.col("high")))


def phase(f, dip, release, fps):
    """Phase of a frame relative to its clip's events."""
    return F.when(f < dip, "Setup").when(f == dip, "Dip").when(f < release, "Drive").when(f == release, "Release").otherwise("Follow-through")


def key_frames(channels: DataFrame, rules: DataFrame) -> DataFrame:
    """``clip_id, key, f``: for each rule (``key, channel, pick`` with pick max
    or min) the first frame with the channel's extreme.  ``rules`` is a small
    configuration; ``channels`` has ``clip_id, channel, f, v``."""
    rows = channels.join(F.broadcast(rules), "channel")
    best = F.min_by("f", F.struct(F.when(F.col("pick") == "max", -F.col("v")).otherwise(F.col("v")), F.col("f")))
    return rows.groupBy("clip_id", "key").agg(best.alias("f"))
