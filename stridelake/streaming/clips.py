"""Arriving frames: sessions close clips, batch operators take over from there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.functions import round_off
from stridelake.sources import shared_folder

GAP = "3 hours"
LATENESS = "1 hour"


def closed_clips(frames: DataFrame, gap: str = GAP, lateness: str = LATENESS) -> DataFrame:
    """``clip_id, started, ended, frames, mean_value`` of each session of
    ``frames(user_id, ts, value)``.  On a stream a session is emitted once its
    gap has passed the watermark; later frames of it are dropped."""
    rows = frames.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    made = rows.agg(F.count("*").alias("frames"), round_off(F.avg("value"), 6).alias("mean_value"))
    return made.select(F.col("user_id").alias("clip_id"), F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "frames", "mean_value")


def run(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, **options):
    """Start (or resume, from the checkpoint) the stream from a folder of Parquet
    files to a folder of closed clips; returns the query."""
    frames = spark.readStream.schema(schema).options(**options).parquet(source)
    return closed_clips(frames).writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, events: DataFrame) -> DataFrame:
    """All of a table through the stream: written as a file source with one late
    row behind that closes every session, then read back."""
    base = shared_folder(spark)
    rows = events.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    rows.repartitionByRange("ts").write.parquet(f"{base}/in/a")
    last = rows.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), "ts", F.lit(0.0).alias("value"))
    last.write.parquet(f"{base}/in/b")
    query = run(spark, f"{base}/in/*", rows.schema, f"{base}/clips", f"{base}/state")
    query.awaitTermination()
    made = closed_clips(rows.limit(0))
    return spark.read.schema(made.schema).parquet(f"{base}/clips").where("clip_id >= 0")
