"""Nearest rows against brute force."""

import numpy as np
import pytest

from stridelake.operators import match, neighbours
from stridelake.plans.jobs import Q

SCHEMA = "weighted array<double>, norm double"


def as_table(spark, rows, name):
    return spark.createDataFrame([(i, r.tolist(), float(np.linalg.norm(r))) for i, r in enumerate(rows)], f"{name} long, {SCHEMA}")


def brute(kind, k, asked, refs):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    d = 1 - unit(asked) @ unit(refs).T if kind == "cosine" else np.linalg.norm(asked[:, None] - refs[None], axis=2)
    return {(q, r + 1): int(i) for q in range(len(asked)) for r, i in enumerate(sorted(range(len(refs)), key=lambda i: (round(d[q, i], 9), i))[:k])}


@pytest.mark.parametrize("whole", [0, 1 << 20])
@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize("kind", ["cosine", "l2"])
def test_nearest_is_exact_at_any_index_size(spark, monkeypatch, kind, k, whole):
    monkeypatch.setattr(neighbours, "WHOLE_BYTES", whole)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 8)
    monkeypatch.setattr(neighbours, "FIRST_BLOCKS", 2)
    rng = np.random.default_rng(2)
    refs, asked = rng.normal(size=(120, 6)), rng.normal(size=(25, 6))
    refs[60:] = refs[:60]  # equal distances go by id
    got = match.nearest(as_table(spark, asked, "clip_id"), as_table(spark, refs, "id"), kind, k).collect()
    assert {(r.clip_id, r["rank"]): r.id for r in got} == brute(kind, k, asked, refs)


@pytest.mark.parametrize("whole", [0, 1 << 24])
@pytest.mark.parametrize("kind", ["cosine", "l2"])
def test_bounds_spare_pairs(spark, monkeypatch, kind, whole):
    """On clustered rows, a third of them one group of copies, most pairs are not
    compared."""
    monkeypatch.setattr(neighbours, "WHOLE_BYTES", whole)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 12)) * 4
    refs = centres[rng.integers(40, size=1500)] + rng.normal(size=(1500, 12)) * 0.1
    refs[:500] = refs[0]
    asked = centres[rng.integers(40, size=60)] + rng.normal(size=(60, 12)) * 0.1
    asked[0] = refs[0]
    rows = neighbours.search(as_table(spark, asked, "clip_id"), as_table(spark, refs, "id"), kind, 3).collect()
    assert {(r.clip_id, r["rank"]): r.id for r in rows} == brute(kind, 3, asked, refs)
    compared = sum({r.clip_id: r.compared for r in rows}.values())
    print("compared", kind, whole, compared, len(asked) * len(refs))
    assert compared < 0.5 * len(asked) * len(refs)


def test_edges(spark):
    refs = as_table(spark, np.array([[1.0, 0.0], [0.0, 0.0]]), "id")
    asked = as_table(spark, np.array([[0.0, 0.0], [3.0, 0.0]]), "clip_id")
    assert [(r.clip_id, r.id) for r in match.nearest(asked, refs, "cosine", 5).collect()] == [(1, 0)]
    assert match.nearest(asked, refs.limit(0), "l2", 1).collect() == []
    assert match.nearest(asked.limit(0), refs, "l2", 1).collect() == []


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_lsh_recall(spark, size):
    base = f"/root/testdata/{size}"
    rows = spark.read.parquet(f"{base}/embeddings.parquet").where("embedding is not null").select("vec_id", "embedding").collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T
    np.fill_diagonal(near, -np.inf)
    want = {int(i): int(ids[near[k].argmax()]) for k, i in enumerate(ids) if i % 20 == 0}
    got = {r.vec_id: r.id for r in Q["nn_lsh"](spark, base).collect()}
    recall = np.mean([got.get(q) == i for q, i in want.items()])
    print("recall", size, len(want), recall)
    assert set(got) == set(want) and recall >= 0.9
