"""The pipeline's stages on a small corpus, held against what each must do."""

import random

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(70)
    rows = []
    for i in range(120):
        rows.append([i, f"{text(150)} {passage if i % 10 == 0 else ''} {text(40)}"])
    for i in range(30):
        rows.append([200 + i, " ".join(w + rng.choice(["$$$", "###"]) for w in text(120).split())])
    rows.append([300, rows[1][1]])
    near = rows[2][1].split(" ")
    near[50] = "changed"
    rows.append([301, " ".join(near)])
    rows.append([302, text(150) + " mail me at jane.doe@host7.example.com or 10.20.30.40 " + text(30)])
    table = [{"doc_id": i, "text": t, "lang": "en", "source": f"s{i % 3}", "n_chars": len(t)} for i, t in rows]
    pq.write_table(pa.Table.from_pylist(table), tmp_path / "documents.parquet")
    pq.write_table(pa.Table.from_pylist([{"doc_id": i, "quality": int("$" not in t and "#" not in t), "toxic": 0} for i, t in rows[:140]]), tmp_path / "labels.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        seen[name] = docs.collect()
        if name != "best-fit packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: {r.doc_id for r in got} for n, got in seen.items()}
    assert ids["quality classifier"] == set(range(120)) | {300, 301, 302}
    assert ids["simhash near-dedup"] == set(range(120)) | {302}
    cut = {r.doc_id: r.text for r in seen["suffix-array dedup"]}
    assert len(cut) == 121 and all((passage[5:-5] not in t) for t in cut.values())
    assert all(cut[i] == rows[i][1] for i in range(120) if i % 10)
    private = {r.doc_id: r.text for r in seen["pii surrogates"]}
    assert "jane.doe@" not in private[302] and "10.20.30.40" not in private[302]
    assert all(private[i] == cut[i] for i in range(120))
    assert {r.doc_id for r in seen["best-fit packing"]} == set(private) and all(r.offset + r.length <= 4096 for r in seen["best-fit packing"])


def test_edges_of_every_stage(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "no id " * 9, None, "s", 54), (3, "long words " * 30000, "en", "s", 330000), (4, "same text of a few words here", "en", "s", 29), (5, "same text of a few words here", "en", "s", 29)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, table in (("some", rows), ("none", [])):
        base = tmp_path / name
        spark.createDataFrame(table, schema).write.parquet(str(base / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(base / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(base))
        assert {"doc_id", "piece", "ids", "sequence_id", "offset"} <= set(got.columns)
        found = got.collect()
        assert {r.doc_id for r in found} == ({1, None, 3, 4} if table else set())
        assert all(len(r.ids) == r.length for r in found)


def test_a_second_run_leaves_the_first_result(spark):
    base = "/root/testdata/sf0.001"
    one, two = corpus_pipeline.run(spark, base), corpus_pipeline.run(spark, base)
    key = lambda df: sorted((r.doc_id, r.piece, r.length) for r in df.select("doc_id", "piece", "length").collect())
    assert key(one) == key(two) and key(one)
