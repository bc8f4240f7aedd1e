"""Connected components against a plain search, on shapes that are hard for
merging: paths, hubs, chains of hubs, random graphs."""

import random

import pytest

from stridelake.llm import common


def _brute(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for root in sorted(near):
        todo = [] if root in out else [root]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = root
                todo.extend(near[x])
    return out


def _edges():
    """One graph of shapes whose ids lie in ranges of their own."""
    rng = random.Random(7)
    path = rng.sample(range(-2000, -1000), 40)
    ordered = [(k, k + 1) for k in range(30)]
    hub = [(9_000_000_000, 1000 + k) for k in range(300)]
    hubs = [(2000 + 100 * i, 2000 + 100 * i + k) for i in range(6) for k in range(1, 60)] + [(2059 + 100 * i, 2100 + 100 * i) for i in range(5)]
    chance = [(rng.randrange(5000, 5300), rng.randrange(5000, 5300)) for _ in range(180)]
    return list(zip(path, path[1:])) + ordered + hub + hubs + chance + [(1, 1), (3, 2), (2, 3), (8000, 8000)]


@pytest.mark.parametrize("limit", [common.BROADCAST_BYTES, -1])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    edges = _edges()
    found = common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    expected = _brute(edges)
    assert len(found) == len(expected)
    assert {r["node"]: r["component"] for r in found} == expected


def test_no_edges(spark):
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []
    assert common.connected_components(spark.createDataFrame([(4, 4)], "src long, dst long")).collect() == []
