"""Byte-level BPE encoding and decoding with a pair occurrence index.

A task encodes the distinct chunks of its rows together.  All their symbols
stand in one linked array; an index maps each adjacent pair (by its rank) to
all its positions.  The active ranks are taken in ascending order; each is
applied to all positions of its pair at once, and only the lists of the
neighbouring pairs are updated.  A pair can only hold what earlier merges made,
so no merge uncovers a lower rank and every chunk sees its merges in the order
of rank, then position; a file without that property is refused.

Edge cases: null text counts as empty (no ids, empty decoded text); rows are
independent, so repeated rows and ties do not matter; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import grouped, trimmed

#: The pre-tokenizer's pattern (a fixed value of the byte-level format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks remembered by one Python worker, and characters encoded together.
CACHE_CHUNKS = 800_000
GROUP_CHARS = 6_000_000
#: A space inside a run of white space: only there may a cut at spaces differ.
_RUN = re.compile(r"\s \s|\s \Z|\A \s|\A \Z")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in vocabulary files:
    printable Latin-1 stands for itself, the rest for 256 onwards."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table = {b: chr(b) for b in plain}
    for at, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + at)
    return [table[b] for b in range(256)]


class PairIndexBpe:
    """Vocabulary of one file, with encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        letters = byte_alphabet()
        value = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([vocab[c] for c in letters], np.int64)
        #: By rank: the two ids of a pair and the id they make.
        self.rules: list[tuple[int, int, int]] = []
        made: set[int] = set(self.byte_ids.tolist())
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            rule = (vocab[a], vocab[b], vocab[a + b])
            if rule[2] in made or not {rule[0], rule[1]} <= made:
                raise ValueError(f"{path}: merges are not in the order in which they were made")
            made.add(rule[2])
            self.rules.append(rule)
        keys = np.array([a << 32 | b for a, b, _ in self.rules], np.int64)
        self.pair_ranks = np.argsort(keys)
        self.pair_keys = keys[self.pair_ranks]
        self.bytes_of = {i: bytes(value[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.words = regex.compile(PATTERN)
        self.spaced: dict[str, tuple[int, ...]] = {}
        self.plain: dict[str, tuple[int, ...]] = {}
        self.word_ids: dict[str, tuple[int, ...]] = {}

    # -- merging ---------------------------------------------------------
    def merge_together(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word, all merged through one pair index."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1)
        sym = np.full(len(raw) + len(words) + 2, -1, np.int64)  # -1 stands before, between and after words
        inside = np.ones(len(raw) + len(words) + 1, bool)
        inside[0] = False
        inside[ends] = False
        sym[:-1][inside] = self.byte_ids[raw]
        after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(places: np.ndarray) -> None:
            """File positions under the rank of the pair they start."""
            first, second = sym[places], sym[after[places]]
            key = first << 32 | np.maximum(second, 0)
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            known = (self.pair_keys[at] == key) & (first >= 0) & (second >= 0)
            places, ranks = places[known], self.pair_ranks[at[known]]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for own, part in zip(ranks[np.concatenate(([0], cuts))].tolist() if len(ranks) else [], np.split(places, cuts)):
                if own in index:
                    index[own].append(part)
                else:
                    index[own] = [part]
                    heapq.heappush(active, own)

        enter(np.arange(len(sym) - 1))
        while active:
            rank = heapq.heappop(active)
            parts = index.pop(rank)
            places = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            first, second, made = self.rules[rank]
            places = places[(sym[places] == first) & (sym[after[places]] == second)]
            if first == second and len(places) > 1:
                # Of overlapping places in a row, every other one merges.
                row = np.arange(len(places))
                head = np.concatenate(([True], after[places[:-1]] != places[1:]))
                places = places[(row - np.maximum.accumulate(np.where(head, row, 0))) % 2 == 0]
            if not len(places):
                continue
            gone = after[places]
            sym[places], sym[gone] = made, -2
            beyond = after[gone]
            after[places] = beyond
            before[beyond] = places
            enter(np.unique(np.concatenate([before[places], places])))
        word_of = np.cumsum(sym[:-1] == -1)
        alive = sym[:-1] >= 0
        ids = sym[:-1][alive].tolist()
        stops = np.cumsum(np.bincount(word_of[alive], minlength=len(words) + 1)[1 : len(words) + 1]).tolist()
        return [tuple(ids[i:j]) for i, j in zip([0, *stops], stops)]

    # -- texts -----------------------------------------------------------
    def _pieces(self, text: str) -> list[tuple[dict, list[str]]]:
        """The text as runs of chunks, each with the cache that knows them."""
        if self.cut_special and any(s in text for s in self.special):
            parts = self.cut_special.split(text)
            return [x for k, p in enumerate(parts) if p for x in ([(self.special, [p])] if k % 2 else self._pieces(p))]
        if _RUN.search(text):
            return [(self.plain, self.words.findall(text))]
        head, *rest = text.split(" ")
        return ([(self.plain, [head])] if head else []) + ([(self.spaced, rest)] if rest else [])

    def _learn(self, cache: dict, new: set[str], lead: str) -> None:
        owner = [(chunk, self.words.findall(lead + chunk)) for chunk in new]
        if len(self.word_ids) > CACHE_CHUNKS:
            self.word_ids.clear()
        words = list(set().union(*(parts for _, parts in owner)).difference(self.word_ids))
        self.word_ids.update(zip(words, self.merge_together([w.encode() for w in words])))
        known = self.word_ids
        for chunk, parts in owner:
            cache[chunk] = known[parts[0]] if len(parts) == 1 else tuple(chain.from_iterable(map(known.__getitem__, parts)))

    def encode_many(self, texts: list[str]) -> Iterator[list[int]]:
        cut = [self._pieces(t) for t in texts]
        for cache, lead in ((self.plain, ""), (self.spaced, " ")):
            want: set[str] = set()
            for pieces in cut:
                for known, chunks in pieces:
                    if known is cache:
                        want.update(chunks)
            new = want.difference(cache)
            if len(cache) + len(new) > CACHE_CHUNKS:
                cache.clear()
                new = want
            self._learn(cache, new, lead) if new else None
        for pieces in cut:
            ids: list[int] = []
            for known, chunks in pieces:
                if known is self.special:
                    ids.append(known[chunks[0]])
                else:
                    ids.extend(chain.from_iterable(map(known.__getitem__, chunks)))
            yield ids

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> PairIndexBpe:
    return PairIndexBpe(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text."""

    @trimmed
    def run(batches):
        bpe = load(path)
        for batch in batches:
            done = 0
            for group in grouped((x.as_py() or "" for x in batch.column(1)), GROUP_CHARS):
                ids = list(bpe.encode_many(group))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(group)), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])
                done += len(group)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give the empty text."""

    @trimmed
    def run(batches):
        bpe = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x.as_py() or ()) for x in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode, decode, and digest both in one pass over the rows."""

    @trimmed
    def run(batches):
        bpe = load(path)
        gc.disable()  # millions of small tuples live in the caches, none in cycles
        try:
            yield from digests(bpe, batches)
        finally:
            gc.enable()

    def digests(bpe, batches):
        for batch in batches:
            done = 0
            for group in grouped((x.as_py() or "" for x in batch.column(1)), GROUP_CHARS):
                counts, of_ids, of_text = [], [], []
                for ids in bpe.encode_many(group):
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
                    of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(group)), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                done += len(group)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or public_tokenizers.path("byte_bpe_50k.json"))
