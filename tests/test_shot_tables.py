"""Channels are written once on the way to the metrics of shots."""

from stridelake import sources
from stridelake.operators import metrics
from stridelake.plans import jobs

BASE = "/root/testdata/sf0.001"


def test_channels_are_written_once(spark, monkeypatch):
    written = []
    kept = lambda rows, **options: written.append(rows.columns) or sources.settled(rows, **options)
    monkeypatch.setattr(jobs, "settled", kept)
    jobs.Q["shot_metrics"](spark, BASE)
    assert sum("ch" in columns for columns in written) == 1
    assert not any(j in columns for columns in written for j in metrics.JOINTS)
