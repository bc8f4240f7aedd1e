"""Channels are gathered in one pass over sorted batches, and written once."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from stridelake.functions import means, whole_groups
from stridelake.operators import series
from stridelake.plans import jobs
from stridelake.sources import AXES


def test_groups_stay_whole_however_rows_are_cut():
    draw = random.Random(3)
    keys = [(c, s) for c in (None, 1, 2, 5) for s in ("left", "right")]
    rows = [(c, s, k) for c, s in keys for k in range(draw.choice((1, 2, 7, 30)))]
    for sizes in ([1], [3], [8, 1], [len(rows)], [5, 40]):
        batches, at, i = [], 0, 0
        while at < len(rows):
            part = rows[at : at + sizes[i % len(sizes)]]
            batches += [pa.record_batch([pa.array([r[j] for r in part], t) for j, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["c", "s", "k"])]
            at, i = at + len(part), i + 1
        batches.insert(1, batches[0].slice(0, 0))
        found, starts = [], []
        for whole, first in whole_groups(iter(batches), ["c", "s"]):
            assert list(first) == sorted(set(first)) and first[0] == 0
            starts += [(whole["c"][int(k)].as_py(), whole["s"][int(k)].as_py()) for k in first]
            found += list(zip(*(column.to_pylist() for column in whole.columns)))
        assert found == rows and starts == keys
    assert list(whole_groups(iter([]), ["c"])) == []


def test_means():
    assert means(pa.array([[1.0, None, 2.0], [None], [], [4.0]])).to_pylist() == [1.5, None, None, 4.0]


def test_one_pass_is_both_steps(spark):
    draw = random.Random(9)
    rows = [(c, s, j, f, *[draw.randrange(100) / 100 if draw.random() < 0.8 else None for _ in AXES]) for c in (4, 7) for s in ("left", "right") for j in ("hip", "knee") for f in range({4: 40, 7: 6}[c])]
    draw.shuffle(rows)
    channels = spark.createDataFrame(rows, "clip_id long, side string, joint string, f int, " + ", ".join(f"{a} double" for a in AXES)).repartition(3)
    want = series.channel_arrays(series.fill_gaps(channels)).orderBy("clip_id", "side", "joint").collect()
    got = series.smoothed(channels).orderBy("clip_id", "side", "joint").collect()
    assert got == want and len(got) == 8
    for r in got:
        seen = [v for c, s, j, f, *v in sorted(rows, key=lambda r: r[:4]) if (c, s, j) == (r["clip_id"], r["side"], r["joint"])]
        known = [v[AXES.index("v2")] for v in seen if v[AXES.index("v2")] is not None]
        assert r["n"] == len(seen) and np.isclose(r["raw_vis"], sum(known) / len(known))


def test_channels_are_written_once(spark):
    made = jobs.sided(spark, "/root/testdata/sf0.001")
    files = ["/" + f.split(":", 1)[1].lstrip("/") for f in made.inputFiles()]
    top = {pq.read_schema(f).names[k] for f in files for k in range(len(pq.read_schema(f).names))}
    assert "ch" in top and "wrist" not in top
    chunks = [pq.read_metadata(f).row_group(0).column(k) for f in files if pq.read_metadata(f).num_row_groups for k in range(pq.read_metadata(f).num_columns)]
    assert not any("DICTIONARY" in e for c in chunks if c.path_in_schema.startswith("ch.") for e in c.encodings)
    row = made.where("n >= 5").select("side", "ch", "wrist").first()
    assert row["wrist"] == row["ch"][f"{row['side']}_wrist"] and len(row["ch"]) == 12
    assert made.where(F.col("wrist").isNotNull()).count() == made.where("n > 0").count()
