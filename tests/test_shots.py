"""Releases against a direct search, and a clip of three shots."""

import random

from pyspark.sql import functions as F

from stridelake.operators import metrics, series, shots
from stridelake.sources import JOINTS, SIDES, settled


def plain(y, fps, least_prominence, least_seconds):
    n, found = len(y), []
    for i in range(1, n - 1):
        if not (y[i] < y[i - 1] and y[i] <= y[i + 1]):
            continue
        a, left = i - 1, y[i]
        while a >= 0 and y[a] > y[i]:
            left, a = max(left, y[a]), a - 1
        b, right = i + 1, y[i]
        while b < n and y[b] >= y[i]:
            right, b = max(right, y[b]), b + 1
        if min(left, right) - y[i] >= least_prominence:
            found.append((i, y[i], min(left, right) - y[i]))
    return [p for p in found if not any(o[0] != p[0] and abs(o[0] - p[0]) < least_seconds * fps and (o[1] < p[1] or o[1] == p[1] and o[0] < p[0]) for o in found)]


def test_releases(spark):
    rng = random.Random(1)
    series_ = [[], [0.5], [0.5, 0.1], [0.5, 0.1, 0.5], [0.3] * 9]
    series_ += [[round(rng.random() * rng.choice([1, 0.1]), rng.choice([1, 2, 6])) for _ in range(rng.choice([5, 30, 120]))] for _ in range(60)]
    rows = spark.createDataFrame([(k, 30.0, y) for k, y in enumerate(series_)], "clip_id long, fps double, y array<double>")
    found = shots.releases(rows, 0.08, 0.2)
    got = {r.clip_id: [(p.f, p.y, p.prominence) for p in r.peaks] for r in found.collect()}
    assert got == {k: plain(y, 30.0, 0.08, 0.2) for k, y in enumerate(series_)}
    for r in shots.segments(found).collect():
        releases, n = got[r.clip_id], len(series_[r.clip_id])
        assert r.release_f == (releases[r.shot][0] if releases else None)
        assert r.last_f >= n - 1 if r.shot == max(0, len(releases) - 1) else r.last_f < releases[r.shot + 1][0]
        assert r.first_f == 0 if r.shot == 0 else releases[r.shot - 1][0] <= r.first_f < releases[r.shot][0]


def test_three_shots_give_three_metric_rows(spark):
    wave = [0.7, 0.66, 0.58, 0.48, 0.4, 0.34, 0.31, 0.3, 0.31, 0.35, 0.42, 0.5, 0.58, 0.64, 0.68]
    heights = (wave * 3)[:-2]
    at = {"shoulder": 0.4, "elbow": 0.45, "hip": 0.6, "knee": 0.75, "ankle": 0.9}
    rows = [(1, f, s, j, 0.3 + 0.01 * k + 0.002 * f, heights[f] if j == "wrist" else at[j], 0.9, 0.1 * k, at.get(j, heights[f]), 0.05 * k) for f in range(len(heights)) for s in SIDES for k, j in enumerate(JOINTS)]
    channels = spark.createDataFrame(rows, "clip_id long, f int, side string, joint string, x2 double, y2 double, v2 double, x3 double, y3 double, z3 double")
    clips = spark.createDataFrame([(1, 30.0, len(heights), 1280, 720, None, None)], "clip_id long, fps double, total_frames int, width int, height int, start_sec string, end_sec string")
    bounds = series.clip_bounds(clips)
    whole = settled(metrics.shooting_side(series.clip_records(series.channel_arrays(series.fill_gaps(channels)), bounds)))
    found = shots.per_shot(whole).orderBy("shot").collect()
    assert [r.shot for r in found] == [0, 1, 2]
    assert [r.first_f for r in found][0] == 0 and all(a.last_f + 1 == b.first_f for a, b in zip(found, found[1:]))
    for r in found:
        assert r.first_f <= r.first_f + r.dip < r.release_f == r.first_f + r.release <= r.last_f
        # A shot's metrics are those of its stretch, cut from the clip by hand.
        cut = whole.withColumn("ch", F.transform_values("ch", lambda k, v: F.struct(*[F.slice(v[a], r.first_f + 1, r.last_f - r.first_f + 1).alias(a) for a in ("x2", "y2", "v2", "x3", "y3", "z3")])))
        alone = metrics.measures(metrics.events(metrics.shooting_side(cut.drop("l_vis", "r_vis", "side", *JOINTS).withColumn("n", F.lit(r.last_f - r.first_f + 1))))).first()
        assert (alone.raw_knee, alone.raw_elbow, alone.velocity, alone.arc, alone.balance) == (r.raw_knee, r.raw_elbow, r.velocity, r.arc, r.balance)
