"""Configured sports on small clips, and what a configuration may not say."""

import pytest

from stridelake.operators.rules import CONFIG, Channel, Event, Metric, judge

POINTS = "struct<x2:array<double>,y2:array<double>,x3:array<double>,y3:array<double>,z3:array<double>>"
JOINTS = ("shoulder", "elbow", "wrist", "hip", "knee", "ankle")


def clip(spark, rows):
    """One clip a row: its id, sport, fps and the wrist's heights; other joints stand."""
    made = []
    for clip_id, sport, fps, y in rows:
        still = lambda v: ([v] * len(y),) * 5
        joints = [still(0.1 * k) for k in range(6)]
        joints[2] = ([0.0] * len(y), y, [0.0] * len(y), y, [1.0] * len(y))
        made.append((clip_id, sport, fps, len(y), *joints))
    return spark.createDataFrame(made, "clip_id long, sport string, fps double, n int, " + ", ".join(f"{j} {POINTS}" for j in JOINTS))


def test_events_after_and_within(spark):
    config = [
        Channel("a", "w", "axis", ("wrist", "y2")),
        Channel("a", "v", "speed", ("w",)),
        Event("a", "top", "w", "max"),
        Event("a", "low", "w", "min", "top", 1.0),
        Event("a", "fast", "v", "max", "top"),
        Metric("a", "gap", "gap_ms", ("top", "low")),
        Metric("a", "span", "range", ("w", "top", "low"), 3),
        Metric("a", "at", "value", ("v", "fast"), 2),
    ]
    y = [0.2, 0.9, 0.8, 0.5, 0.5, 0.6, 0.1]
    rows = judge(clip(spark, [(1, "a", 4.0, y), (2, "other", 100.0, y), (3, "a", 4.0, [0.1, 0.2, 0.9])]), config).collect()
    got = {(r.clip_id, r.name): r.value for r in rows}
    assert [got[1, k] for k in ("top", "low", "fast", "gap", "span", "at")] == [1, 3, 6, 500, 0.4, 2.0]
    # Of an unknown sport: by the first; a hundred frames a second reach to the end.
    assert [got[2, k] for k in ("top", "low", "fast")] == [1, 6, 6]
    # Nothing comes after the top.
    assert got[3, "top"] == 2 and all(got[3, k] is None for k in ("low", "fast", "gap", "span", "at"))
    assert {r.kind for r in rows if r.name in ("top", "low", "fast")} == {"event"}


def test_sports_have_their_own_rules(spark):
    rows = judge(clip(spark, [(1, "tennis", 30.0, [0.1, 0.4, 0.2, 0.3, 0.5]), (2, "basketball", 30.0, [0.1, 0.4, 0.2, 0.3, 0.5]), (3, None, 30.0, [0.5, 0.1])])).collect()
    for clip_id, sport in ((1, "tennis"), (2, "basketball"), (3, "basketball")):
        assert [r.name for r in rows if r.clip_id == clip_id] == [rule.name for rule in CONFIG if rule.sport == sport and not isinstance(rule, Channel)]


@pytest.mark.parametrize("wrong", [Event("a", "e", "none", "max"), Metric("a", "m", "value", ("w", "none")), Channel("a", "c", "mean", ("w",)), Event("a", "e", "w", "first"), Metric("a", "m", "mean", ("w",))])
def test_configurations_that_do_not_hold(spark, wrong):
    with pytest.raises(ValueError):
        judge(clip(spark, [(1, "a", 4.0, [0.1, 0.2])]), [Channel("a", "w", "axis", ("wrist", "y2")), wrong])
