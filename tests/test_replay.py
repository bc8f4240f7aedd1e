"""A replayed stream loses no frame, however many files and parts it comes in."""

from pyspark.sql import functions as F

from stridelake.plans import jobs
from stridelake.plans.oracle import ORACLE
from stridelake.sources import passing, settled
from tests.oracle import compare, views

BASE = "/root/testdata/sf0.001"


def test_more_files_than_a_batch_takes(spark, monkeypatch):
    pose = jobs.fixtures.live_pose
    # Twenty times as slow, so that frames of one part are far apart in time.
    slow = lambda *a: pose(*a).withColumn("ts", F.timestamp_millis(((F.unix_millis("ts") - 1_700_000_000_000) * 20 + 1_700_000_000_000)))
    monkeypatch.setattr(jobs.fixtures, "live_pose", slow)
    monkeypatch.setattr(jobs, "CHUNKS", 1)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "25")
    try:
        compare(jobs.Q["stream_metrics"](spark, BASE), ORACLE["stream_metrics"], views(BASE))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_parts_have_bounded_frames(spark, monkeypatch):
    made = []
    monkeypatch.setattr(jobs, "CHUNK_FRAMES", 200)
    pose = jobs.fixtures.live_pose
    monkeypatch.setattr(jobs.fixtures, "live_pose", lambda s, d, chunks: made.append(chunks) or pose(s, d, chunks).where("clip_id < 2"))
    jobs.Q["stream_metrics"](spark, BASE)
    assert made == [5]


def test_passing_tables_go(spark):
    with passing(spark):
        rows = settled(spark.range(3))
        path = rows.inputFiles()[0]
        assert rows.count() == 3
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
