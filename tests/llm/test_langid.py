import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from stridelake.llm import langid as L

DOCS = "doc_id long, text string, lang string, score double"


def slow_probability(grams, order, text):
    """Textbook interpolated Kneser-Ney for the last character of ``text``."""
    tables = [dict(grams)]
    for _ in range(order - 1):
        tables.append(dict(Counter(g[1:] for g in tables[-1])))
    tables.reverse()

    def p(level, gram):
        table = tables[level]
        lower = p(level - 1, gram[1:]) if level else 1.0 / (len(tables[0]) + 1)
        own = {g: n for g, n in table.items() if g[:-1] == gram[:-1]}
        if not own:
            return lower
        ones, twos = sum(n == 1 for n in table.values()), sum(n == 2 for n in table.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        total = sum(own.values())
        return max(own.get(gram, 0) - d, 0) / total + d * len(own) / total * lower

    return p(order - 1, text)


def test_model_matches_the_textbook_formula():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    grams = Counter(t[i : i + 3] for w in words for t in [L.padded(w, 3)] for i in range(len(t) - 2))
    model = L.KneserNey.fit(list(grams), list(grams.values()), 3)
    tests = list(grams) + ["zzz", "abz", "\x02\x02z", "zab", "ab\x03"]
    got = model.surprise(np.array([[ord(c) for c in g] for g in tests]))
    want = [-math.log2(slow_probability(grams, 3, g)) for g in tests]
    assert np.allclose(got, want)


def test_counts_and_predictions(spark):
    rng = random.Random(2)
    vocab = {"en": ["the", "and", "thing", "with"], "de": ["der", "und", "schön", "für"]}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randrange(1, 30))) + ".\nX1", lang, 0.0) for i, lang in enumerate(["en", "de"] * 60)]
    docs = spark.createDataFrame(rows + [(None, "the", "en", 0.0), (500, "der", None, 0.0)], DOCS).repartition(3)
    got = {(r.lang, r.word): r.n for r in L.word_counts(docs.where("lang is not null")).collect()}
    want = defaultdict(int)
    for _, text, lang, _ in [*rows, (0, "the", "en", 0)]:
        for w in L._WORDS.findall(text.lower()):
            want[lang, w] += 1
    assert got == dict(want)
    model = L.train(docs)
    edge = [(1000, None), (1001, ""), (1002, "12 $ 3"), (1003, "the thing"), (1004, "für und"), (1004, "für und"), (1005, "und " * 40000)]
    out = {(r.doc_id, r.lang_pred) for r in L.identify(spark.createDataFrame(edge, "doc_id long, text string"), model).collect()}
    assert out == {(1000, "und"), (1001, "und"), (1002, "und"), (1003, "en"), (1004, "de"), (1005, "de")}
    scores = [r.score for r in L.identify(docs, model).collect()]
    assert all(0 <= s <= 1 for s in scores)


def test_nothing_learned_and_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    model = L.train(empty)
    assert [r.lang_pred for r in L.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).collect()] == ["und"]
    assert L.identify(empty, model).collect() == []


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = L.op6_langid(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) / len(held) > 0.95


def test_tables_give_the_fitted_model(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    grams = Counter(t[i : i + 3] for w in words for t in [L.padded(w, 3)] for i in range(len(t) - 2))
    rows = [(lang, g, n) for lang in ("x", "y") for g, n in grams.items() if lang == "x" or "a" in g]
    models = L.held_models(L.fit_tables(spark.createDataFrame(rows, "lang string, gram string, n long"), 3))
    for lang, model in models.items():
        own = {g: n for k, g, n in rows if k == lang}
        want = L.KneserNey.fit(list(own), list(own.values()), 3)
        assert np.isclose(model.floor, want.floor)
        for (h, v), (h2, v2) in zip(model.grams + model.contexts, want.grams + want.contexts):
            order, order2 = np.argsort(h), np.argsort(h2)
            assert (h[order] == h2[order2]).all() and np.allclose(v[order], v2[order2])


def test_predictions_do_not_depend_on_the_size_bound(spark, monkeypatch):
    rng = random.Random(4)
    vocab = {"en": ["the", "and", "thing", "with"], "de": ["der", "und", "schön", "für"], "fr": ["le", "et", "où"]}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randrange(1, 30))) + ".\nX1", lang, 0.0) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    rows += [(900, None, "en", 0.0), (901, "12", None, 0.0), (902, "thé wïth", None, 0.0), (902, "thé wïth", None, 0.0), (None, "und", None, 0.0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    found = []
    monkeypatch.setattr(L, "HOT_ROWS", 3)  # most words are dealt in parts
    for bound in (L.MODEL_ROWS, 0):
        monkeypatch.setattr(L, "MODEL_ROWS", bound)
        got = L.identify(docs, L.train(docs)).collect()
        found.append(sorted(((r.doc_id, r.lang_pred, round(r.score, 9), r.rejected, r.bits_per_char and round(r.bits_per_char, 9)) for r in got), key=str))
    assert found[0] == found[1] and len(found[0]) == len(rows)


def test_query_against_brute_force(spark):
    """Predictions and entropies of a table, from textbook probabilities."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    grams = defaultdict(Counter)
    for r in docs:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None:
            for w in L._WORDS.findall((r.text or "").lower()):
                t = L.padded(w)
                grams[r.lang].update(t[i : i + 4] for i in range(len(t) - 3))
    got = {r.doc_id: r for r in L.op6_langid(spark, "/root/testdata/sf0.001").collect()}
    models = {lang: L.KneserNey.fit(list(own), list(own.values())) for lang, own in grams.items()}
    for r in docs[:60]:
        text = "".join(L.padded(w) for w in L._WORDS.findall((r.text or "").lower()))
        codes = [[ord(c) for c in t[i : i + 4]] for w in L._WORDS.findall((r.text or "").lower()) for t in [L.padded(w)] for i in range(len(t) - 3)]
        if not text:
            assert got[r.doc_id].lang_pred == "und"
            continue
        bits = {lang: models[lang].surprise(np.array(codes)).mean() for lang in sorted(models)}
        assert got[r.doc_id].lang_pred == min(bits, key=bits.get) and math.isclose(got[r.doc_id].bits_per_char, min(bits.values()), rel_tol=1e-9)


def test_all_training_texts_calibrate(spark):
    rng = random.Random(6)
    vocab = {"en": ["the", "and", "thing", "with"], "de": ["der", "und", "schön", "für"]}
    rows = [(i, " ".join(rng.choice(vocab[lang]) for _ in range(rng.randrange(1, 12))), lang, 0.0) for i, lang in enumerate(["en", "de"] * 1500)]
    model = L.train(spark.createDataFrame(rows, DOCS).repartition(3))
    h = np.array(model.cross_entropies([r[1] for r in rows]))
    truth = np.array([model.langs.index(r[2]) for r in rows])
    own = h[np.arange(len(rows)), truth]
    for k in range(2):
        assert math.isclose(model.limits[k], np.quantile(own[truth == k], L.REJECT_QUANTILE), rel_tol=1e-12)
    loss = {2.0**k: np.log2(np.exp2(np.minimum(-(2.0**k) * (h - own[:, None]), 500)).sum(axis=1)).mean() for k in range(-3, 7)}
    assert model.sharpness == min(loss, key=loss.get)


def test_ranks_are_exact(spark):
    rng = random.Random(7)
    values = {"a": [rng.choice([0.1, 0.25, 3.0, rng.random() * 1e-6, -rng.random()]) for _ in range(500)], "b": [2.5]}
    rows = spark.createDataFrame([(k, v) for k, own in values.items() for v in own], "lang string, v double").repartition(3)
    wanted = [("a", k) for k in (0, 1, 250, 498, 499)] + [("b", 0)]
    assert L.ranked(rows, wanted) == {(k, n): sorted(values[k])[n] for k, n in wanted}
