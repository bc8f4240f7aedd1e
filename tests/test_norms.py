"""Merged states against the whole, and runs against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.operators import norms, runs
from stridelake.sources import METRICS


def test_merged_days_are_the_whole_within_the_rank_error(spark, tmp_path):
    path = f"file://{tmp_path}/n"
    rng = np.random.default_rng(3)
    rows = [(int(c), int(day), float(v)) for day in range(12) for c in range(2) for v in rng.normal(day, 5, 3000)]
    rows += [(2, 0, 1.0), (2, 0, None)]
    df = spark.createDataFrame(rows, "cohort long, day long, value double").repartition(8).cache()
    for day in range(12):
        norms.add_day(df.where(F.col("day") == day), path, day)
    norms.add_day(df.where(F.col("day") == 3), path, 3)  # written again
    for r in norms.norms(spark, path).withColumns({"q": norms.quantile(0.3), "r": norms.rank(F.lit(6.0)), "slope": norms.slope()}).collect():
        own = np.array([(d, v) for c, d, v in rows if c == r.cohort and v is not None])
        assert r.n == len(own)
        assert abs((own[:, 1] <= r.q).mean() - 0.3) <= norms.RANK_ERROR or len(own) == 1
        assert abs((own[:, 1] <= 6.0).mean() - r.r) <= norms.RANK_ERROR
        assert r.slope is None if len(own) == 1 else r.slope == pytest.approx(np.polyfit(own[:, 0], own[:, 1], 1)[0])
    assert norms.norms(spark, f"{path}/none").collect() == []


def test_same_runs_do_not_spread_and_a_disturbed_one_does(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    row = lambda v: spark.createDataFrame([(1, *[float(v + k) for k in range(8)]), (2, *[5.0] * 8)], "clip_id long, " + ", ".join(f"{m} double" for m in METRICS))
    assert runs.recorded(spark, path).collect() == []
    for number, (value, setting) in enumerate([(1, {"a": 1, "b": 2}), (1, {"b": 2, "a": 1}), (3, {"a": 2})]):
        runs.record(row(value), path, setting, number)
    same = runs.spread(runs.recorded(spark, path), "parameters").where("runs = 2")
    assert {r.spread for r in same.collect()} == {0.0}
    every = {(r.clip_id, r.metric): r for r in runs.spread(runs.recorded(spark, path)).collect()}
    assert len(every) == 16 and all(r.runs == 3 and r.settings == 2 for r in every.values())
    assert all(r.spread == (pytest.approx(np.std([1, 1, 3])) if c == 1 else 0) for (c, _), r in every.items())
