"""Baselines and drift against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.sources import METRICS

#: How far each metric may drift.
TOLERANCES = {"release_velocity_mps": 0.6, "shot_arc_deg": 6.0, "knee_angle": 10.0, "elbow_angle": 10.0, "kinetic_sync_ms": 50.0, "hip_rotation_deg": 8.0, "balance_index": 15.0, "fluidity_score": 15.0}


def unpivot(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, metric, value``."""
    rows = metrics.select(*keys, *[F.col(m).cast("double").alias(m) for m in METRICS])
    return rows.unpivot(keys, list(METRICS), "metric", "value")


def capture(metrics: DataFrame) -> DataFrame:
    """``clip_id, metric, baseline, tolerance`` of clips that did not fall back."""
    tolerance = F.create_map(*[x for m, t in TOLERANCES.items() for x in (F.lit(m), F.lit(t))])
    return unpivot(metrics.where(~fell_back()), ["clip_id"]).select("clip_id", "metric", F.col("value").alias("baseline"), tolerance[F.col("metric")].alias("tolerance"))


def fell_back():
    return F.exists("warnings", lambda w: F.lower(w).contains("fallback"))


def check(actual: DataFrame, baseline: DataFrame) -> DataFrame:
    """Violations ``clip_id, metric, message``: a metric that is missing, or off
    by more than its tolerance, with the expected and the actual value; a tolerance that is zero or absent checks
    nothing.  ``actual`` has ``clip_id, metric, value``."""
    rows = baseline.join(actual, ["clip_id", "metric"], "left")
    # To nine places: off by the tolerance itself is within it, whatever the last bits are.
    off = F.round(F.abs(F.col("value") - F.col("baseline")), 9)
    message = F.when(F.col("value").isNull(), F.concat("metric", F.lit(": missing"))).when((F.col("tolerance") > 0) & (off > F.col("tolerance")), F.format_string("%s: expected %.2f, got %.2f, tolerance %.2f", "metric", "baseline", "value", "tolerance"))
    return rows.select("clip_id", "metric", message.alias("message")).where("message is not null")


def report(violations: DataFrame) -> DataFrame:
    """``clip_id, messages`` in metric order; a clip that passes is not there."""
    rows = violations.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.struct("metric", "message"))).alias("m"))
    return rows.select("clip_id", F.col("m.message").alias("messages"))
