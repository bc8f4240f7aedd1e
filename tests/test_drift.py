from stridelake.operators import drift


def test_a_value_off_by_its_tolerance_passes(spark):
    """Values of one decimal, moved by the tolerance: the difference may have other last bits."""
    rows = [(k, "shot_arc_deg", k / 10, 6.0) for k in range(300, 751)]
    base = spark.createDataFrame(rows, "clip_id long, metric string, baseline double, tolerance double")
    assert any(abs(b + 6 - b) > 6 for _, _, b, _ in rows)
    moved = lambda by: base.selectExpr("clip_id", "metric", f"baseline + {by} as value")
    assert drift.check(moved("6"), base).count() == 0
    assert drift.check(moved("6.01"), base).count() == len(rows)
