"""Periodic runs against a plain search of every period."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from stridelake.llm import periodic as P

DOCS = "doc_id long, text string, lang string, h string, words long, of long"


def plain_runs(words):
    """``(start, period, length)`` by trying every period at every place."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        x = 0
        while x < n - q:
            s = x
            while x < n - q and words[x] == words[x + q]:
                x += 1
            if x - s + q >= max(24, 3 * q):
                found.setdefault((s, x - s + q), q)
            x += 1
    return sorted((s, q, n_) for (s, n_), q in found.items())


def plain_kept(words, runs):
    drop = {i for s, q, n in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in drop]


def plain_row(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = (None,) * 4
    if runs:
        top = runs[0]
        for r in runs[1:]:
            if r[2] * top[1] > top[2] * r[1]:
                top = r
        best = (top[0], top[2], top[1], 1000 * top[2] // top[1])
    return (doc_id, len(runs), *best, sha("".join(f"{s},{n_},{q}\n" for s, q, n_ in runs)), sha(" ".join(plain_kept(words, runs))))


def repeated(rng, n, letters):
    words = [f"w{rng.randrange(letters)}" for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 30:
            a, p = rng.randrange(n), rng.randrange(1, n // 3)
            for i in range(a + p, min(n, a + p + rng.randrange(p, 5 * p + 1))):
                words[i] = words[i - p]
    return words


@pytest.mark.parametrize("low", [16, 128])
def test_pieces_of_tiles(low):
    rng = random.Random(low)
    for _ in range(300):
        words = repeated(rng, rng.choice([24, 25, 40, 100, 300, 1500]), rng.choice([1, 2, 3, 5, 300]))
        ids = np.unique(np.array(words), return_inverse=True)[1].astype(np.int64)
        n = len(ids)
        last = sum((P.TILE * low << b) < n for b in range(30))
        stretches = {}
        for b in range(last + 1):
            octave = low << b
            for k in range(1 if b == last else (n - 8 * octave - 1) // (32 * octave) + 1):
                at = k * 32 * octave
                for q, s, e in P.pieces(ids[at : at + 40 * octave], 1 if b == 0 else octave, n // 3 + 1 if b == last else 2 * octave):
                    stretches.setdefault(q, []).append((at + s, at + e))
        found = {}
        for q in sorted(stretches):
            whole = []
            for s, e in sorted(stretches[q]):
                if whole and s <= whole[-1][1]:
                    whole[-1][1] = max(whole[-1][1], e)
                else:
                    whole.append([s, e])
            for s, e in whole:
                if e - s + q >= max(24, 3 * q):
                    found.setdefault((s, e - s + q), q)
        assert sorted((s, q, n_) for (s, n_), q in found.items()) == plain_runs(words)


def write(tmp_path, rows):
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string()), "h": ["x"] * len(rows), "words": [1] * len(rows)}), tmp_path / "documents.parquet")
    return str(tmp_path)


def found(df):
    return sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in df.collect()), key=repr)


def test_query_against_every_period(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a " * 24, "a " * 23, "x y z\x0b" * 30, "é ü\r" * 400]
    texts += [rng.choice([" ", "\n", "\t\t"]).join(repeated(rng, rng.choice([24, 60, 200, 700]), rng.choice([1, 2, 4, 90]))) for _ in range(60)]
    texts += [f"{w} " * 30 + f"{w} {k} z " * 9 + "end" for k in range(8) for w in [f"v{k}"]]
    texts += [" ".join(f"p{j % (k + 3)}" for j in range(90)) + " x " + " ".join(f"r{j % (2 * k + 9)}" for j in range(150)) for k in range(8)]
    texts += [" ".join(repeated(rng, 6000, 500)), " ".join(str(k % 1700) for k in range(12000)), "only " * 7000]
    rows = [(k if k != 20 else None, t) for k, t in enumerate(texts)]
    rows += rows[30:34] + [(31, "b c " * 40)]
    base = write(tmp_path, rows)
    want = sorted((plain_row(*r) for r in rows), key=repr)
    assert found(P.op13_periodic(spark, base)) == want
    monkeypatch.setattr("stridelake.llm.common.BROADCAST_BYTES", -1)
    assert found(P.op13_periodic(spark, base)) == want
    assert sum(r[1] > 1 for r in want) > 5


def test_collapse_keeps_other_columns(spark):
    rows = [(1, "a  b\n" * 30, "de", "k", 5, 6), (2, "no  run here", None, "k", 5, 6), (2, "no  run here", None, "k", 5, 6), (None, "c " * 50, "de", None, None, None), (4, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    out = P.collapse(docs)
    assert out.columns == docs.columns
    texts = {1: "a b", 2: "no  run here", None: "c", 4: None}
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(((r[0], texts[r[0]], *r[2:]) for r in rows), key=repr)


def test_empty(spark, tmp_path):
    assert P.op13_periodic(spark, write(tmp_path, [])).collect() == []
    assert P.collapse(spark.createDataFrame([], DOCS)).collect() == []
