"""Key frames and metrics of a sport by configuration.

Three kinds of rows describe a sport: channels (a joint's axis, the angle at a joint,
or the speed of another channel), events (the extreme of a channel, anywhere or after
another event, at most some seconds after it), and metrics (a channel's value at an
event, the time between two events, or a channel's range between them).  They are
compiled to columns on a clip's row, so that all sports are judged in one pass over
the clips and without a shuffle.

A clip of an unknown sport goes by the first sport of the configuration.  An event with
no frame to look at (the event before it is the last frame, or is missing) is null, and
so are the metrics that need it.  Values of channels are rounded to six places before
they are compared; of equal ones the first frame counts.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.functions import angle, round_off

DIGITS = 6
_POINT = ("x3", "y3", "z3")


class Channel(NamedTuple):
    sport: str
    name: str
    kind: str  # axis, angle, speed
    of: tuple[str, ...]  # joint and axis; three joints; a channel


class Event(NamedTuple):
    sport: str
    name: str
    channel: str
    pick: str  # max, min
    after: str | None = None
    within: float | None = None  # seconds


class Metric(NamedTuple):
    sport: str
    name: str
    kind: str  # value, gap_ms, range
    of: tuple[str, ...]  # channel and event; two events; channel and two events
    digits: int = 1


CONFIG: list[Channel | Event | Metric] = [
    Channel("basketball", "wrist", "axis", ("wrist", "y2")),
    Channel("basketball", "knee", "angle", ("hip", "knee", "ankle")),
    Channel("basketball", "elbow", "angle", ("shoulder", "elbow", "wrist")),
    Event("basketball", "dip", "wrist", "max"),
    Event("basketball", "release", "wrist", "min", "dip", 1.5),
    Metric("basketball", "knee_at_dip", "value", ("knee", "dip")),
    Metric("basketball", "elbow_at_release", "value", ("elbow", "release")),
    Metric("basketball", "lift_ms", "gap_ms", ("dip", "release")),
    Channel("tennis", "knee", "angle", ("hip", "knee", "ankle")),
    Channel("tennis", "elbow", "angle", ("shoulder", "elbow", "wrist")),
    Channel("tennis", "elbow_speed", "speed", ("elbow",)),
    Channel("tennis", "wrist", "axis", ("wrist", "y2")),
    Event("tennis", "trophy", "knee", "min"),
    Event("tennis", "contact", "elbow_speed", "max", "trophy"),
    Metric("tennis", "knee_at_trophy", "value", ("knee", "trophy")),
    Metric("tennis", "elbow_speed_at_contact", "value", ("elbow_speed", "contact")),
    Metric("tennis", "swing_ms", "gap_ms", ("trophy", "contact")),
    Metric("tennis", "reach", "range", ("wrist", "trophy", "contact"), 4),
]


def _series(rule: Channel, made: dict[str, Column]) -> Column:
    if rule.kind == "axis":
        joint, axis = rule.of
        return F.transform(F.col(joint)[axis], lambda v: round_off(v, DIGITS))
    if rule.kind == "angle":
        at = lambda i: [tuple(F.get(F.col(j)[a], i) for a in _POINT) for j in rule.of]
        return F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: round_off(angle(*at(i)), DIGITS))
    if rule.kind == "speed":
        base = made[rule.of[0]]
        return F.transform(base, lambda v, i: round_off(F.abs(v - F.get(base, F.greatest(i - 1, F.lit(0)))) * F.col("fps"), DIGITS))
    raise ValueError(f"no such kind of channel: {rule}")


def _frame(rule: Event, series: Column, events: dict[str, Column]) -> Column:
    best = {"max": F.array_max, "min": F.array_min}.get(rule.pick)
    if best is None:
        raise ValueError(f"no such pick: {rule}")
    start, size = F.lit(0), F.size(series)
    if rule.after is not None:
        start = events[rule.after] + 1
        size = size - start
        if rule.within is not None:
            size = F.least(size, (F.col("fps") * rule.within).cast("int"))
    window = F.slice(series, start + 1, F.greatest(size, F.lit(0)))
    return F.when(size > 0, (start + F.array_position(window, best(window)) - 1).cast("int"))


def _value(rule: Metric, channels: dict[str, Column], events: dict[str, Column]) -> Column:
    if rule.kind == "value":
        found = F.get(channels[rule.of[0]], events[rule.of[1]])
    elif rule.kind == "gap_ms":
        found = (events[rule.of[1]] - events[rule.of[0]]) / F.col("fps") * 1000
    elif rule.kind == "range":
        low, high = (events[e] for e in rule.of[1:])
        part = F.slice(channels[rule.of[0]], low + 1, high - low + 1)
        found = F.when(high >= low, F.array_max(part) - F.array_min(part))
    else:
        raise ValueError(f"no such kind of metric: {rule}")
    # First to six places: a tie of decimals is a tie whatever its last bits are.
    return round_off(round_off(found, DIGITS), rule.digits)


def judge(clips: DataFrame, config: list[Channel | Event | Metric] = CONFIG) -> DataFrame:
    """``clip_id, sport, kind, name, value``: the frame of each event and the value of
    each metric that the clip's sport has.  ``clips`` are clip records with their
    shooting side and a ``sport``; rules may name what stands before them."""
    sports = list(dict.fromkeys(rule.sport for rule in config))
    rows = clips.withColumn("_by", F.when(F.col("sport").isin(sports), F.col("sport")).otherwise(sports[0]))
    out: dict[str, list[Column]] = {s: [] for s in sports}
    names: dict[str, dict[str, dict[str, Column]]] = {s: {"channel": {}, "event": {}} for s in sports}
    # Each step becomes a column: what follows refers to it by name.
    for k, rule in enumerate(config):
        channels, events = names[rule.sport]["channel"], names[rule.sport]["event"]
        step, own = f"_{k}", F.col("_by") == rule.sport
        try:
            if isinstance(rule, Channel):
                rows = rows.withColumn(step, F.when(own, _series(rule, channels)))
                channels[rule.name] = F.col(step)
                continue
            found = _frame(rule, channels[rule.channel], events) if isinstance(rule, Event) else _value(rule, channels, events)
        except KeyError as missing:
            raise ValueError(f"{rule} names {missing}, which no rule before it has") from None
        rows = rows.withColumn(step, F.when(own, found))
        if isinstance(rule, Event):
            events[rule.name] = F.col(step)
        kind = "event" if isinstance(rule, Event) else "metric"
        out[rule.sport].append(F.struct(F.lit(kind).alias("kind"), F.lit(rule.name).alias("name"), F.col(step).cast("double").alias("value")))
    made = F
    for sport, found in out.items():
        made = made.when(F.col("_by") == sport, F.array(*found))
    return rows.select("clip_id", "sport", F.explode(made).alias("r")).select("clip_id", "sport", "r.*")
