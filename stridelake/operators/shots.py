"""Several shots in one clip: prominent releases, segments, and metrics of each.

A release is a local minimum of the wrist's height on screen that stands out: its
prominence is the rise to the lower of the highest points to either side, each side
reaching to where the series is lower again.  Of two that are closer than
``least_seconds`` the lower one stays (the earlier of equal ones).  A shot begins at the
lowest wrist between its release and the one before, so its dip belongs to it, and
ends before the next one begins; the first begins and the last ends with the clip.

All of it is array work on a clip's row.  Segments become rows of their own, with their
stretch of every channel, and go through the same events and metrics as a clip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.operators import metrics
from stridelake.sources import AXES

LEAST_PROMINENCE, LEAST_SECONDS = 0.08, 0.25


def releases(clips: DataFrame, least_prominence: float = LEAST_PROMINENCE, least_seconds: float = LEAST_SECONDS) -> DataFrame:
    """``clips`` (with ``y``, the wrist's heights, and ``fps``) with ``peaks``: frame ``f``,
    height ``y`` and ``prominence`` of each release, in order."""
    low = "filter(sequence(1, size(y) - 2), i -> y[i] < y[i - 1] and y[i] <= y[i + 1])"
    # The highest point of one side, from the minimum outwards, up to a lower one.
    side = "aggregate({part}, struct(y[i] as top, true as open), (a, v) -> if(a.open and {higher}, struct(greatest(a.top, v) as top, true as open), struct(a.top as top, false as open)), a -> a.top)"
    left = side.format(part="reverse(slice(y, 1, i))", higher="v > y[i]")
    right = side.format(part="slice(y, i + 2, size(y))", higher="v >= y[i]")
    found = f"if(size(y) < 3, array(), transform({low}, i -> struct(i as f, y[i] as y, least({left}, {right}) - y[i] as prominence)))"
    apart = "filter(c, p -> not exists(c, o -> o.f <> p.f and abs(o.f - p.f) < {gap} * fps and (o.y < p.y or o.y = p.y and o.f < p.f)))"
    rows = clips.withColumn("c", F.expr(f"filter({found}, p -> p.prominence >= {least_prominence!r}D)"))
    return rows.withColumn("peaks", F.expr(apart.format(gap=f"{least_seconds!r}D"))).drop("c")


def segments(found: DataFrame) -> DataFrame:
    """One row for each shot of ``releases``: ``shot`` (from 0), ``first_f``, ``last_f``,
    ``release_f`` and ``prominence``; a clip without a release is one segment without."""
    between = "transform(slice(peaks, 2, size(peaks)), (p, k) -> peaks[k].f + array_position(slice(y, peaks[k].f + 1, p.f - peaks[k].f), array_max(slice(y, peaks[k].f + 1, p.f - peaks[k].f))) - 1)"
    rows = found.withColumn("starts", F.expr(f"concat(array(0L), if(size(peaks) < 2, array(), {between}))"))
    each = rows.withColumn("s", F.explode(F.expr("transform(starts, (a, k) -> struct(k as shot, int(a) as first_f, int(coalesce(get(starts, k + 1), size(y)) - 1) as last_f, get(peaks, k) as p))")))
    return each.select(*[F.col(f"`{c}`") for c in found.columns if c != "peaks"], "s.shot", "s.first_f", "s.last_f", F.col("s.p.f").alias("release_f"), F.col("s.p.prominence").alias("prominence"))


def per_shot(records: DataFrame, **limits) -> DataFrame:
    """Metrics before rounding (``metrics.measures``) of every shot of clip records
    with their shooting side, with the shot's ``shot``, ``first_f``, ``last_f``,
    ``release_f`` and ``prominence``.  A shot of fewer than five frames has none."""
    facts = ["clip_id", "fps", "ar", "width", "height", "visibility"]
    shots = segments(releases(records.where(F.col("n") >= metrics.MIN_FRAMES).select(*facts, "ch", F.col("wrist")["y2"].alias("y")), **limits))
    cut = ", ".join(f"slice(v.{a}, first_f + 1, last_f - first_f + 1) as {a}" for a in AXES)
    rows = shots.select(*facts, "shot", "first_f", "last_f", "release_f", "prominence", F.expr(f"transform_values(ch, (k, v) -> struct({cut}))").alias("ch"), (F.col("last_f") - F.col("first_f") + 1).alias("n"))
    # The SQL joins a shot's frames to it, and adds them from the last to the first.
    sided = metrics.with_joints(metrics.sides(rows.where(F.col("n") >= metrics.MIN_FRAMES), backwards=True))
    return metrics.measures(metrics.events(sided))
