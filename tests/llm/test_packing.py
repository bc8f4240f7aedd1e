import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stridelake.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_plan(hist, limit):
    got = np.zeros(limit + 1, int)
    for lengths, times in P.plan(hist, limit):
        assert 0 < sum(lengths) <= limit and times > 0
        for v in lengths:
            got[v] += times
    assert (got == hist).all()
    return sum(t for _, t in P.plan(hist, limit))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_plan_uses_every_piece_once(lengths):
    check_plan(np.bincount(lengths, minlength=33), 32)


def test_plan_is_near_the_lower_bound():
    rng = np.random.default_rng(2)
    lengths = np.clip(rng.lognormal(6.4, 1.0, 20000).astype(int) + 1, 1, 4096)
    hist = np.bincount(lengths, minlength=4097)
    bound = max(-(-int(lengths.sum()) // 4096), (lengths > 2048).sum())
    assert check_plan(hist, 4096) <= 1.01 * bound + 1


@pytest.mark.parametrize("text", ["", " ", "Hello  WORLD", "It's 12 o'clock", "ΣΑΣ İI ẞ", "a\n\tb  c d e", "<|endoftext|> x<|startoftext|>y", "é ́x 日本 語$$$ ---", "x ́", "1²½ \x1cq\x85r"])
def test_chunks_give_the_librarys_ids(text):
    assert P.load(PATH).encode(text) == np.array(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_table(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP_BYTES", 100)
    lib = Tokenizer.from_file(PATH)
    texts = [None, "", "word " * 9000, "word " * 4095, "word " * 4096] + ["some words here " * (k % 9) for k in range(40)]
    rows = [(i, t, "x", 5) for i, t in enumerate(texts)] + [(7, "again", "x", 5), (7, "again", "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, piece int").repartition(3)
    got = P.pack_documents(docs, PATH, with_ids=True).collect()
    want = {}
    for d, t, *_ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            want.setdefault((d, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())), []).append(ids[k : k + 4096])
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(k for k, v in want.items() for _ in v)
    assert all(list(r.ids) in want[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert P.pack_documents(docs.limit(0), PATH).collect() == []


def test_memory_of_workers(spark, monkeypatch):
    """Texts come in short batches and are encoded some lines at a time; ids stay
    out of the workers that place pieces."""
    name, seen, made = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, label: (seen.setdefault(label, spark.conf.get(name)), made(df, label))[1])
    before = spark.conf.get(name)
    got = P.pack_documents(spark.createDataFrame([(k, "some words " * k) for k in range(30)], "doc_id long, text string"), PATH, with_ids=True)
    assert int(seen["pieces"]) <= 1000 and spark.conf.get(name) == before
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan
    assert sorted(len(r["ids"]) for r in got.collect()) == [2 * k + 1 for k in range(30)]

    class Library:
        most = 0

        def encode_batch_fast(self, texts, add_special_tokens):
            self.most = max(self.most, len(texts))
            return [type("Found", (), {"ids": [len(t)]}) for t in texts]

    library = Library()
    assert [int(v[0]) for v in P._encoded(library, ["x" * k for k in range(100)])] == list(range(100))
    assert library.most <= P.LINES
