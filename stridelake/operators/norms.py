"""Norms of cohorts that grow day by day, without reading old clips again.

A day's clips become one row of state for each cohort: a KLL sketch of the values and
the sums that a straight line over days needs.  States merge: any set of days gives the
cohort's quantiles, the rank of a value in it, and the slope over days, from rows whose
number is that of cohorts times days.  Sums are exact; ranks are within
``RANK_ERROR`` of the whole with the sketch's size as it is, and exact as long as a
cohort has no more values than that.  Days are published one by one, and a day that is
written again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.sources.published import every, publish

#: Size of a sketch, and how far a rank may be off at that size.
SKETCH, RANK_ERROR = 200, 0.0165
SUMS = ("n", "sx", "sy", "sxx", "sxy")
STATE = "cohort long, day long, sketch binary, " + ", ".join(f"{c} double" for c in SUMS)


def states(rows: DataFrame) -> DataFrame:
    """``STATE`` of ``rows(cohort, day, value)``; null values do not count.  Partial
    sketches and sums are made where the rows are."""
    x, y = F.col("day").cast("double"), F.col("value").cast("double")
    sums = {"n": F.lit(1.0), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y}
    made = rows.where("value is not null").groupBy("cohort", "day")
    return made.agg(F.kll_sketch_agg_double(y, F.lit(SKETCH)).alias("sketch"), *[F.sum(v).alias(c) for c, v in sums.items()])


def add_day(rows: DataFrame, path: str, day: int) -> None:
    """Publish the state of one day's ``rows(cohort, day, value)``."""
    publish(states(rows).select("cohort", "day", "sketch", *SUMS), path, day)


def norms(spark: SparkSession, path: str) -> DataFrame:
    """The states of all published days, merged: ``cohort, sketch`` and the sums."""
    rows = every(spark, path, STATE)
    return rows.groupBy("cohort").agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"), *[F.sum(c).alias(c) for c in SUMS])


def quantile(share: float) -> Column:
    """The least value with at least this share at or below it."""
    return F.kll_sketch_get_quantile_double("sketch", F.lit(share))


def rank(value: Column) -> Column:
    """The share of the cohort at or below a value."""
    return F.kll_sketch_get_rank_double("sketch", value)


def slope() -> Column:
    """Least-squares slope over days; null where all values are of one day."""
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    return F.when(det > 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / det)
