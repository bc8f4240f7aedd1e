import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from stridelake.llm import suffix_dedup as S

DOCS = "doc_id long, text string, lang string, k long, d string"


def slow(texts, window=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + window] for t in raw for i in range(len(t) - window + 1))
    out = []
    for t in raw:
        mask = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                mask[i : i + window] = True
        runs = int((mask[1:] & ~mask[:-1]).sum() + mask[0]) if len(t) else 0
        out.append((len(t), int(mask.sum()), runs, hashlib.sha256(bytes(b for b, m in zip(t, mask) if not m)).hexdigest()))
    return out


def corpus(rng, alphabet="abcdefgh é"):
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [word(n) for n in (150, 199, 200, 201, 260, 500, 900)]
    texts = [None, "", "short", "x" * 199, "x" * 200, "x" * 201, "ab" * 300, word(199)]
    for _ in range(30):
        texts.append(word(rng.randrange(400)) + rng.choice(passages) + word(rng.randrange(300)) + rng.choice(passages)[rng.randrange(50) :])
    for t in texts[8:16]:
        texts.append(t)
        cut = rng.randrange(1, len(t))
        texts.append(t[:cut] + "Z" + t[cut + 1 :])
    return texts


@pytest.mark.parametrize("group", [1000, 3])
def test_same_as_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(S, "GROUP", group)
    texts = corpus(random.Random(group))
    common = "".join(random.Random(0).choice("pqrstuv ") for _ in range(330))
    rng = random.Random(9)
    texts += ["".join(rng.choice("abcdef") for _ in range(rng.randrange(5, 150))) + common[rng.randrange(40) :] + "".join(rng.choice("abcdef") for _ in range(100)) for _ in range(25)]
    rows = [(i, t, "en", 1, "x") for i, t in enumerate(texts)] + [(5000, "q" * 100 + "r" * 150, "en", 1, "x")] * 2
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digest(docs).collect()))
    want = sorted((r[0], *w) for r, w in zip(rows, slow([r[1] for r in rows])))
    assert [g for g, w in zip(got, want) if g != w] == [] and len(got) == len(want)


def test_long_texts_in_segments(monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 700)
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcd") for _ in range(5000))
    texts = [text, text[100:350], b"", text[:200], text[4700:]]
    rows = [x for part in S.tuples(texts) for x in zip(*(p.tolist() for p in part))]
    windows = sorted((r[0], w) for r in rows for w in range(r[2] >> 16, (r[2] >> 16) + (r[2] & 255) + 1))
    assert windows == [(k, i) for k, t in enumerate(texts) for i in range(len(t) - 199)]
    for row, h, pos in rows:
        pick = (pos >> 16) + (pos >> 8 & 255)
        assert 0 <= pick - (pos >> 16) <= 168
    grams = {}
    for row, h, pos in rows:
        pick = (pos >> 16) + (pos >> 8 & 255)
        assert grams.setdefault(h, texts[row][pick : pick + S.GRAM]) == texts[row][pick : pick + S.GRAM]


def test_induction_against_all_suffixes():
    rng = random.Random(4)
    rows = []
    for g in range(3):
        core = bytes(rng.choice(b"ab") for _ in range(400))
        for _ in range(12):
            t = bytearray(core)
            for _ in range(rng.randrange(3)):
                t[rng.randrange(400)] = rng.choice(b"xy")
            lo = rng.randrange(60)
            hi = rng.randrange(lo, 160)
            rows.append((g, bytes(t[180 - hi : 180]), bytes(t[180 : 180 - lo + 200]), lo, hi))
    rows.sort(key=lambda r: (r[0], r[2]))
    least, most = S.induce(np.array([r[0] for r in rows]), [r[1] for r in rows], [r[2] for r in rows])
    windows = [{o: (r[0], o, r[1][len(r[1]) - o :] + r[2][: 200 - o]) for o in range(r[3], r[4] + 1)} for r in rows]
    seen = Counter(w for ws in windows for w in ws.values())
    for k, ws in enumerate(windows):
        hit = [o for o, w in ws.items() if seen[w] > 1]
        assert (least[k], most[k]) == ((min(hit), max(hit)) if hit else (-1, -1))


def test_dedup_keeps_columns(spark):
    passage = "Überaus " * 40
    rows = [(1, "Eins ä" + passage + "ende", "de", 7, "s"), (2, passage, "de", 7, "s"), (3, None, "de", 7, None), (None, "kurz", None, None, None), (2, passage, "de", 8, "t")]
    docs = spark.createDataFrame(rows, DOCS)
    out = S.dedup(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id or 0, r.text, r.k) for r in out.collect()), key=str)
    assert got == sorted([(1, "Eins äende", 7), (2, "", 7), (3, None, 7), (0, "kurz", None), (2, "", 8)], key=str)
    assert S.dedup(docs.limit(0)).collect() == [] and S.digest(docs.limit(0)).collect() == []


def test_repeated_rows_have_their_ranges_once(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    text, part = word(600), word(250)
    rows = [(7, text)] * 50 + [(8, part + text[100:400]), (8, part + text[100:400]), (9, "x" + part + "y" + word(300)), (None, text), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = S.repeated_ranges(docs).collect()
    assert len(found) == 3 and all(len(r.ranges) <= 12 for r in found)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digest(docs).collect()), key=str)
    assert got == sorted(((r[0], *w) for r, w in zip(rows, slow([r[1] for r in rows]))), key=str)


@pytest.mark.parametrize("bound", [0, 1 << 26])
def test_same_beyond_the_broadcast_bound(spark, monkeypatch, bound):
    monkeypatch.setattr(S, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(S, "HELD_PLACES", 5)
    texts = corpus(random.Random(21))
    rows = [(i, t, "en", 1, "x") for i, t in enumerate(texts)] + [(3, "q" * 260, "en", 1, "x")] * 2
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digest(spark.createDataFrame(rows, DOCS)).collect())
    assert got == sorted((r[0], *w) for r, w in zip(rows, slow([r[1] for r in rows])))


def test_dedup_with_clashing_columns(spark):
    passage = "abcdefghij" * 30
    docs = spark.createDataFrame([(1, "1" + passage, 1, "a", None), (2, passage + "2", 2, "b", 3.5)], "_k1 long, text string, doc_id long, _K2 string, _ranges double")
    out = S.dedup(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert sorted(out.collect()) == [(1, "1", 1, "a", None), (2, "2", 2, "b", 3.5)]


def test_many_copies_keep_one_range_list_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
    monkeypatch.setattr("stridelake.llm.common.BROADCAST_BYTES", 0)
    rng = random.Random(8)
    often, other = ("".join(rng.choices("abcdefgh ", k=n)) for n in (900, 500))
    texts = [often] * 10_000 + [other + often[100:600], other, other]
    docs = spark.createDataFrame([(i, t, "en", 1, "x") for i, t in enumerate(texts)], DOCS).repartition(4)
    rows = S.repeated_ranges(docs).collect()
    assert len(rows) == 3 and all(len(r.ranges) <= 8 for r in rows)
    got = {(r.n_removed, r.n_spans) for r in S.digest(docs.where("doc_id >= 9990")).collect()}
    assert got == {(900, 1), (1000, 1), (500, 1)}
