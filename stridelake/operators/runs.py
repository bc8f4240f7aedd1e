"""Repeated runs of a pipeline over the same clips, and how far they spread.

A run is a published version of a table that only grows: its number, a hash of its
parameters, and a row of metrics for each clip.  Writing one does not read the
others, and one that fails is not there."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.operators.drift import unpivot
from stridelake.sources import METRICS
from stridelake.sources.published import every, publish


def parameters_hash(parameters: dict) -> str:
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def record(rows: DataFrame, path: str, parameters: dict, number: int | None = None) -> int:
    """Append a run of ``rows`` (``clip_id`` and the metrics); returns its number."""
    return publish(rows.select("clip_id", *METRICS).withColumn("parameters", F.lit(parameters_hash(parameters))), path, number)


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """All runs: ``clip_id``, the metrics, and ``parameters``."""
    return every(spark, path, "clip_id long, " + ", ".join(f"{m} double" for m in METRICS) + ", parameters string")


def spread(runs: DataFrame, *keys: str) -> DataFrame:
    """``clip_id, keys, metric, runs, settings, spread``: over the runs of one clip,
    their number, that of different parameters, and the population standard deviation of
    each metric; 0 where runs agree.  A metric that is null in a run does not count."""
    values = unpivot(runs, ["clip_id", "parameters"])
    made = values.groupBy("clip_id", *keys, "metric").agg(F.count("value").alias("runs"), F.countDistinct("parameters").alias("settings"), F.stddev_pop("value").alias("spread"))
    return made.select("clip_id", *[k for k in keys if k != "parameters"], "metric", "runs", "settings", "spread")
