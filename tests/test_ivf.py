"""The inverted-file index: recall, pruned scans, replacement as a whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridelake.operators import ivf, neighbours
from stridelake.plans import fixtures
from stridelake.plans.jobs import Q
from stridelake.sources.published import versions


def as_table(spark, rows, name, ids=None):
    ids = range(len(rows)) if ids is None else ids
    return spark.createDataFrame([(int(i), r.tolist(), float(np.linalg.norm(r))) for i, r in zip(ids, rows)], f"{name} long, weighted array<double>, norm double")


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_recall_over_all_rows(spark, size):
    base = f"/root/testdata/{size}"
    got = {r.vec_id: r.id for r in Q["nn_ivf"](spark, base).collect()}
    q, i = fixtures.all_vectors(spark, base)
    want = {r.vec_id: r.id for r in Q["nn_cosine"](spark, base).collect()}
    assert set(got) == set(want) == {r.vec_id for r in q.where("norm > 0").collect()}
    recall = np.mean([got[k] == want[k] for k in want])
    print("recall", size, len(want), recall)
    assert recall >= 0.95


@pytest.mark.parametrize("kind", ["cosine", "l2"])
def test_pruned_cells_and_a_hot_one(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ivf, "LEAST_PROBES", 2)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 8)) * 5
    refs = centres[rng.integers(30, size=1200)] + rng.normal(size=(1200, 8)) * 0.05
    refs[:400] = refs[0]
    asked = centres[rng.integers(30, size=40)] + rng.normal(size=(40, 8)) * 0.05
    path = f"file://{tmp_path}/i"
    ivf.write_index(as_table(spark, refs, "id"), path, kind)
    df = ivf.probe(as_table(spark, asked, "clip_id"), path, 2)
    rows = df.collect()
    exact = {(r.clip_id, r["rank"]): r.id for r in neighbours.search(as_table(spark, asked, "clip_id"), as_table(spark, refs, "id"), kind, 2).collect()}
    assert np.mean([exact[r.clip_id, r["rank"]] == r.id for r in rows]) >= 0.95
    assert sum({r.clip_id: r.compared for r in rows}.values()) < 0.6 * len(asked) * len(refs)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan.replace("\n", " ") and "dynamicpruning" in plan


def test_fewer_rows_than_asked_self_and_replacement(spark, tmp_path):
    rng = np.random.default_rng(7)
    refs, path = rng.normal(size=(9, 3)), f"file://{tmp_path}/i"
    ivf.write_index(as_table(spark, refs, "id"), path)
    rows = ivf.probe(as_table(spark, refs, "vec_id"), path, 20, "vec_id", leave_out_self=True).collect()
    assert all(sorted(r.id for r in rows if r.vec_id == q) == [i for i in range(9) if i != q] for q in range(9))
    with pytest.raises(Exception):
        broken = as_table(spark, refs, "id").withColumn("weighted", F.when(F.col("id") == 3, F.raise_error(F.lit("x")).cast("array<double>")).otherwise(F.col("weighted")))
        ivf.write_index(broken, path)
    assert list(versions(spark, f"{path}/centroids")) == [1]
    ivf.write_index(as_table(spark, refs[:2], "id"), path)
    rows = ivf.probe(as_table(spark, refs, "vec_id"), path, 20, "vec_id").collect()
    assert {r.id for r in rows} == {0, 1}
