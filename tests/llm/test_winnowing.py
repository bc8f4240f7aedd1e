"""Winnowing against a window-by-window choice, and neighbours against a sort."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from stridelake.llm import winnowing as W


def plain(text, k, window):
    """Rightmost minimum of each window, over hashes of each gram by itself."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(codes):
        return [], []
    k = min(k, len(codes))
    hashes = [int(W.rolling(codes[i : i + k], k)[0]) for i in range(len(codes) - k + 1)]
    window = min(window, len(hashes))
    at = sorted({max(range(i, i + window), key=lambda j: (-hashes[j], j)) for i in range(len(hashes) - window + 1)})
    return [hashes[i] for i in at], at


def texts_of(rng, n):
    some = ["", "a", "ab" * 200, "x" * 500, "é😀 ü" * 60]
    return some + ["".join(rng.choices("abcde \n", k=rng.choice([5, 31, 32, 33, 94, 95, 96, 400, 900]))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [16, 1 << 20])
def test_choice(monkeypatch, chunk):
    monkeypatch.setattr(W, "CHUNK", chunk)
    rng = random.Random(1)
    for text in texts_of(rng, 25):
        for k, window in [(32, 64), (3, 5), (1, 1)]:
            hashes, at = W.winnow(text, k, window)
            assert (hashes.tolist(), at.tolist()) == plain(text, k, window)
            if k == 32:
                back = W.from_text(W.as_text((hashes, at)))
                assert back[0].tolist() == hashes.tolist() and back[1].tolist() == at.tolist()


def test_shared_stretches_are_found():
    rng = random.Random(2)
    for _ in range(50):
        shared = "".join(rng.choices("abc ", k=W.K + W.WINDOW - 1))
        a, b = ("".join(rng.choices("abcdef", k=rng.randrange(300))) + shared + "".join(rng.choices("abcdef", k=rng.randrange(300))) for _ in range(2))
        (x, p), (y, q) = W.winnow(a), W.winnow(b)
        places = [(i, j) for i, h in zip(p, x) for j, g in zip(q, y) if h == g]
        assert places and all(a[i : i + W.K] == b[j : j + W.K] for i, j in places)


def rows_of(texts, ids):
    return list(zip(ids, texts))


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for k, (doc_id, text) in enumerate(order):
        text, later = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 4
        edited = text[: len(text) - cut] + later[:cut]
        own, changed, following = (set(W.winnow(t)[0].tolist()) for t in (text, edited, later))
        near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), W.as_text(W.winnow(text)), W.as_text(W.winnow(edited)), near(own, changed), near(own, following)))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r)[:7] for r in df.collect()), key=repr)


def write(tmp_path, rows):
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "range": ["x"] * len(rows), "ghost": [1] * len(rows)})
    pq.write_table(table, tmp_path / "documents.parquet", row_group_size=50)
    return str(tmp_path)


@pytest.mark.parametrize("range_rows", [1, 7, 4096])
def test_edited_and_next(spark, tmp_path, monkeypatch, range_rows):
    monkeypatch.setattr(W, "RANGE_ROWS", range_rows)
    rng = random.Random(3)
    texts = texts_of(rng, 80)
    ids = [rng.randrange(-50, 10**12) for _ in texts]
    rows = rows_of(texts, ids)
    rows += [(ids[9], "other"), (ids[9], "other"), rows[4], (None, None), (None, "q" * 200), (7, None)]
    rng.shuffle(rows)
    assert found(W.op12_winnowing(spark, write(tmp_path, rows))) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(5, "only " * 40)], [(1, "a" * 99), (1, "b" * 99)], [(None, None)]])
def test_few_rows(spark, tmp_path, rows):
    assert found(W.op12_winnowing(spark, write(tmp_path, rows))) == expected(rows)


def test_whole_table(spark):
    base = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text").collect()]
    got = W.op12_winnowing(spark, base)
    assert found(got) == expected(rows)
    assert np.median([r.near_edited for r in got.collect() if r.n_chars > 1000]) > 0.4


def test_operator_keeps_positions(spark):
    text = "".join(random.Random(4).choices("abcdef ", k=700))
    rows = W.fingerprints(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    hashes, at = W.winnow(text)
    assert [(m["hash"] % (1 << 64), m["at"]) for m in rows[0].marks] == list(zip(hashes.tolist(), at.tolist()))
    assert rows[1].marks == [] and rows[1].n_chars == 0
