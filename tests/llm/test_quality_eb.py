import numpy as np

from stridelake.llm import quality_eb as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, n int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCS)


def test_logistic_recovers_a_rule():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = (x[:, 0] - x[:, 1] > 0).astype(float)
    model = Q.Logistic.fit(x, y)
    assert ((model.logit(x) > 0) == y).mean() > 0.98
    flat = Q.Logistic.fit(x, np.ones(2000))
    assert np.allclose(flat.logit(x), flat.base_logit)


def test_posteriors_follow_the_formula(spark):
    good, bad = "plain words that run on quietly and end here {}", "x$$$ y### z&&& x$$$ y### {}$$$"
    rows = [(i, (bad if i % 10 < (7 if i % 3 == 0 else 1) else good).format(i), "en" if i % 2 else None, f"s{i % 3}") for i in range(120)]
    rows += [(500, None, None, None), (501, "", "de", "s0"), (502, "word " * 60000, "en", "s1"), (502, "word " * 60000, "en", "s1")]
    docs = docs_of(spark, rows).repartition(3)
    labels = spark.createDataFrame([(i, int("$" not in rows[i][1])) for i in range(0, 120, 2)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = Q.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    host = {r[0]: r[3] for r in rows}
    path = {r[0]: (r[3], r[2]) for r in rows}
    ids = [r[0] for r in rows]
    p = np.array([by[i].p_document for i in ids])

    def strength(groups):
        n, m = len(ids), p.mean()
        spread = sum(len(g) * (p[g].mean() - m) ** 2 for g in groups) / n - sum(p[g].var() for g in groups) / n
        return min(max(m * (1 - m) / max(spread, 1e-6) - 1, 1), 1e5)

    index = lambda of: {v: [k for k, i in enumerate(ids) if of[i] == v] for v in of.values()}
    hosts, paths = index(host), index(path)
    kh, kp = strength(list(hosts.values())), strength(list(paths.values()))
    for k, i in enumerate(ids):
        h, q = hosts[host[i]], paths[path[i]]
        mh = (kh * p.mean() + p[h].sum() - p[k]) / (kh + len(h) - 1)
        assert np.isclose(by[i].host_posterior, mh)
        assert np.isclose(by[i].path_posterior, (kp * mh + p[q].sum() - p[k]) / (kp + len(q) - 1))
    model = Q.fit_classifier(docs, labels)
    featurize = Q.Featurizer()
    for k, r in enumerate(rows):
        logit = float(model.logit(featurize(r[1])))
        site = min(max(by[r[0]].path_posterior, 1e-4), 1 - 1e-4)
        score = 1 / (1 + np.exp(-(np.log(site / (1 - site)) + logit - model.base_logit)))
        assert np.isclose(by[r[0]].p_document, 1 / (1 + np.exp(-logit)))
        assert np.isclose(by[r[0]].score, score) and by[r[0]].kept == (by[r[0]].score >= 0.5)
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.classify(docs_of(spark, [(1, "a b", "en", "s")]), none).count() == 1
    assert Q.classify(docs_of(spark, [(1, "a b", "en", "s")]).limit(0), none).collect() == []


def test_held_out_accuracy(spark):
    """Fitted on even ids only, right on the odd ones, and clean pages stay."""
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = Q.classify(docs, labels.where("doc_id % 2 = 0"))
    rows = got.join(labels.where("doc_id % 2 = 1"), "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) / len(rows) > 0.98
    good = [r.kept for r in rows if r.quality]
    assert sum(good) / len(good) > 0.99


def test_features_by_hand():
    words = "A b!! CC b!! CC b!! 12 x$".split()
    triples = list(zip(words, words[1:], words[2:]))
    want = [np.log(8), 1 / 8, 2 / 8, 3 / 8, sum(map(len, words)) / 8, 2 / sum(map(len, words)), 5 / 8, 0.0, len(set(triples)) / len(triples)]
    assert np.allclose(Q.Featurizer()(" ".join(words)), want)


def test_clashing_columns_and_repeated_ids(spark):
    rows = [(i % 40, "plain words that run on " * 5 if i % 2 else "x$$$ y### " * 9, "en", f"s{i % 3}", "mine", 1, 2.0) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _host string, _eb int, _logit double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, quality int")
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for k, r in enumerate(rows) if k % 2) and {r._host for r in got} == {"mine"}
