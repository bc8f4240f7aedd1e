import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from stridelake.llm import bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.json")


def samples():
    rng = random.Random(7)
    pool = ["the", "Thheouble", "été", "ß", "日本語", "x1y22", "'s", "'ll", "don't", "  ", "   ", "\n", "\t", "\r\n", " \n ", "\x1c", "\x1f", "\x85", " ", " ", "​", "᠎", "﻿", "🙂", "$$$", "a" * 70, "0" * 9, "<|endoftext|>", "<|end", "²½", "ा", "é", "\x00", "_"]
    yield from ["", " ", "  ", "a ", " a", "a  ", "\n", "\n ", " \n", "a\n  b", "a \nb", "a   b"]
    for _ in range(400):
        yield "".join(rng.choice(pool) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(1, 40)))
    for _ in range(300):
        yield "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(9, 33), rng.randrange(0xA0, 0x500), rng.randrange(0x2000, 0x2070)])) for _ in range(30))


def test_same_ids_and_text_as_the_library():
    lib, own = Tokenizer.from_file(PATH), B.load(PATH)
    texts = list(samples())
    for text, ids in zip(texts, own.encode_many(texts)):
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids == want, repr(text)
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False)
    broken = [[200, 5, 50256, 188, 99], [234], [10, 233, 120]]
    assert [own.decode(x) for x in broken] == [lib.decode(x, skip_special_tokens=False) for x in broken]


def test_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(B, "CACHE_CHUNKS", 8)
    own, lib = B.PairIndexBpe(PATH), Tokenizer.from_file(PATH)
    for text in list(samples())[:60]:
        assert next(own.encode_many([text])) == lib.encode(text, add_special_tokens=False).ids


def test_table(spark):
    lib = Tokenizer.from_file(PATH)
    rows = [(1, None, 1), (2, "", 1), (3, "Hello there  you\n", 1), (3, "Hello there  you\n", 1), (None, "x " * 50000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.round_trip_digests(docs, PATH).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for d, t, _ in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.add((d, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert got == want
    back = B.decode(B.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((d or 0, t or "") for d, t, _ in rows)
    assert B.round_trip_digests(docs.limit(0), PATH).collect() == []
