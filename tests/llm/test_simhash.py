import random
from collections import Counter

import numpy as np
import xxhash

from stridelake.llm import simhash as S
from stridelake.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long"


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hs = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(ids, fps, radius=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(ids))]


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    for text in [None, "", " \n", "One", "Two Words", "ÄÖ É x\x1cy z w", *(" ".join(rng.choice(["Ab", "c", "É", "dd"]) for _ in range(n)) for n in (3, 4, 50, 9000))]:
        assert S.fingerprint(text) == slow_fingerprint(text)


def test_near_pairs_connect_what_brute_force_links():
    rng = np.random.default_rng(3)
    for radius in (0, 1, 2, 3, 5):
        base = rng.integers(0, 2**63, 40, dtype=np.uint64)
        near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), False))) for b in base for _ in range(8)]
        fps = np.unique(np.concatenate([base, near]))
        edges = S.near_pairs(fps, radius)
        assert all(bin(int(fps[a]) ^ int(fps[b])).count("1") <= 10**9 for a, b in edges)
        label = S.merge_labels(np.arange(len(fps)), edges[:, 0], edges[:, 1]) if len(edges) else np.arange(len(fps))
        assert label.tolist() == slow_components(list(range(len(fps))), [int(x) for x in fps], radius)


def test_blocks_without_links_are_abandoned(monkeypatch):
    calls = []
    above = S._above
    monkeypatch.setattr(S, "_above", lambda *a: calls.append(1) or above(*a))
    n = 2 * S.BATCH_ROWS
    fps = np.random.default_rng(4).integers(0, 2**63, (n, 4), dtype=np.uint64)
    assert len(S.near_pairs(fps, 2)) == 0
    assert len(calls) <= 16  # of 32 steps for each of two batches


def test_groups_on_a_table(spark, monkeypatch):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    texts = [None, "", "  ", "one", "one two"] + [" ".join(rng.choice(words) for _ in range(rng.choice([3, 5, 400]))) for _ in range(60)]
    for t in texts[-20:]:
        cut = t.split(" ")
        cut[rng.randrange(len(cut))] = "omega"
        texts.append(" ".join(cut))
    texts += texts[5:25]
    rows = [(i * 7 % 1000, t, "en", "s", 1, 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in S.near_duplicate_groups(spark.createDataFrame(rows, DOCS).repartition(5)).collect()}
    fps = [slow_fingerprint(r[1]) for r in rows]
    assert [got[r[0]].fp % 2**64 for r in rows] == fps
    assert [got[r[0]].component_id for r in rows] == slow_components([r[0] for r in rows], fps)


def test_full_buckets_are_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 16)
    fps = [(0xABCD << 48) | (0x1234 << 32) | (i * 5 % 4096) for i in range(300)]
    signed = [(x - 2**64 if x >= 2**63 else x,) for x in fps]
    edges = S.links(spark.createDataFrame(signed, "fp long"))
    got = {r.node % 2**64: r.component % 2**64 for r in connected_components(edges).collect()}
    order = sorted(range(300), key=lambda i: signed[i][0])
    want = slow_components([signed[i][0] for i in order], [fps[i] for i in order])
    assert [got.get(fps[i], fps[i]) for i in order] == [w % 2**64 for w in want]


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert S.near_duplicate_groups(empty).collect() == []
    twice = spark.createDataFrame([(3, "a b c d", None, None, None, 1), (3, "a b c d", None, None, None, 1), (None, "a b c d", None, None, None, 1)], DOCS)
    assert [r.component_id for r in S.near_duplicate_groups(twice).collect()] == [3, 3, 3]


def test_similar_groups_follow_jaccard(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    texts, truth = [], []
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([60, 200, 400]))]
        for copy in range(3):
            own = list(base)
            for _ in range(copy * len(base) // 100):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            texts.append(" ".join(own))
            truth.append(3 * g)
    for g in range(20):  # half of the text shared: not near copies
        base = [rng.choice(vocab) for _ in range(200)]
        for _ in range(2):
            truth.append(len(texts))
            texts.append(" ".join(base[:100] + [rng.choice(vocab) for _ in range(100)]))
    rows = [(i, t, "en", "s", 1, 0) for i, t in enumerate(texts)] + [(900, None, "en", "s", 1, 0), (900, None, "en", "s", 1, 0), (901, "", "en", "s", 1, 0), (None, texts[0], "en", "s", 1, 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r.doc_id: r.component_id for r in S.similar_groups(docs).collect() if r.doc_id is not None}
    assert [got[i] for i in range(len(texts))] == truth and got[900] == got[901] == 900
    kept = S.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*set(truth), 900, None], key=str)
    assert S.keep_first(docs.limit(0)).collect() == []


def jaccard(a, b):
    a, b = ({tuple(t.split(" ")[k : k + 5]) for k in range(t.count(" ") - 3)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_similar_groups_are_exact_on_both_sides_of_the_limit(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 32)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    texts, linked, apart = [], 0, 0
    for k in range(300):
        n = rng.choice([*range(6, 21), 100, 150, 200])
        base = [word() for _ in range(n)]
        # Words cut off an end, added to it, or changed: similarities around 0.8.
        for step in range(1 + n // 8):
            own = list(base)
            cut = step * max(1, n // 40)
            own = own[cut:] + [word() for _ in range(k % 3 * cut // 2)]
            texts.append(" ".join(own))
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i + 1, min(i + 30, len(texts))):
            s = jaccard(texts[i], texts[j])
            linked += 0.8 <= s < 0.84
            apart += 0.74 <= s < 0.8
            if s >= 0.8:
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    assert linked > 50 and apart > 50
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0) for i, t in enumerate(texts)], DOCS).repartition(3)
    got = {r.doc_id: r.component_id for r in S.similar_groups(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_full_component_is_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 8)
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(60):
        own = list(base)
        own[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(own), "en", "s", 1, 0))
    got = {r.doc_id: r.component_id for r in S.similar_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(got.values()) == {0} and len(got) == 60


def test_parts_that_the_smallest_node_does_not_connect(spark, monkeypatch):
    """A chain: each text links with the next ones only, so the parts' common
    node leaves several components, which meet again."""
    monkeypatch.setattr(S, "CHUNK", 8)
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 120]), "en", "s", 1, 0) for i in range(60)]
    rows += [(100 + i, " ".join(words[3 * i : 3 * i + 120]), "en", "s", 1, 0) for i in range(60)]
    got = {r.doc_id: r.component_id for r in S.similar_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(got.values()) == {0} and len(got) == 120


def test_keep_first_with_clashing_columns(spark):
    rows = [(5, "a b c d e f g", 1, "x", 2), (5, "a b c d e f g", 1, "x", 2), (7, "A b c d e f g", 1, "y", 3), (8, None, 2, None, None), (9, "  ", 2, None, None), (10, "word " * 30000, 3, "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int, _Of string, _text int")
    got = S.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [5, 8, 10]


def test_near_copies_of_a_whole_table(spark):
    """Every pair of the table with a five-word Jaccard of 0.8 is found, no
    other: an exact join by prefix filtering is the measure."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: S.shingles(t).tolist() for i, t in texts.items()}
    often = Counter(x for s in sets.values() for x in s)
    index, seen, pairs = {}, {}, set()
    for i in sorted(sets):
        own = sorted(sets[i], key=lambda x: (often[x], x))
        same = tuple(own)
        if same in seen:
            pairs.add((seen[same], i))
            continue
        seen[same] = i
        near = {j for x in own[: len(own) - -(-4 * len(own) // 5) + 1] for j in index.get(x, ())}
        mine = set(own)
        for j in near:
            both = len(mine.intersection(sets[j]))
            if 5 * both >= 4 * (len(mine) + len(sets[j]) - both):
                pairs.add((j, i))
        for x in own[: len(own) - -(-4 * len(own) // 5) + 1]:
            index.setdefault(x, []).append(i)
    want = {i: i for i in texts}

    def root(i):
        while want[i] != i:
            i = want[i]
        return i

    for i, j in pairs:
        a, b = sorted((root(i), root(j)))
        want[b] = a
    got = {r.doc_id: r.component_id for r in S.similar_groups(docs).collect()}
    found = sum(got[i] == got[j] for i, j in pairs)
    print("near-copy links", len(pairs), "found", found)
    assert found >= 0.99 * len(pairs) and len(pairs) > 100
    assert sum(got[i] != root(i) for i in texts) <= 0.01 * len(pairs)
