"""Sequence packing: non-negative least squares over length patterns.

Documents become token pieces of at most ``limit``; only longer ones are cut.
The histogram of piece lengths (at most ``limit`` rows) goes to the driver,
where patterns of up to three lengths that fill a sequence exactly get
non-negative repeat counts whose lengths fit the histogram best.  Counts are
rounded to what is there, and the residual histogram is packed largest first
with best fits.  The plan is a list of (lengths, repeats), so its size depends
on ``limit`` and never on the number of rows; each piece finds its place by its
rank among the pieces of its length.

Edge cases: null text counts as empty and still gives one piece, its end mark;
repeated rows are packed as often as they occur; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridelake.llm.common import materialize, small_batches, small_side, trimmed

LIMIT = 4096
END_ID = 1
#: Lengths tried as second member of a three-document pattern, for each first.
PARTNERS = 24
#: Bytes of text encoded together.
GROUP_BYTES = 6_000_000
#: Lines the library encodes at once: its encodings take many times their text.
LINES = 32


class ChunkTokenizer:
    """The library's ids, looked up by chunks between spaces.

    The vocabulary drops white space and no rule of its normaliser or its
    pattern reaches across a space, so a text's ids are those of its chunks.
    A batch's different chunks are found in Arrow.  Nearly all are one word and
    a mark or two; their words meet in lower case, and the library's model
    encodes the different ones together.  Any other chunk, and any text that
    spells a special token, goes to the library as it is.  Nothing is kept from
    batch to batch.
    """

    #: A word and what follows it, where the pattern cuts right between them;
    #: only letters whose lower case and composition do not depend on others.
    simple = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[!-&(-/:-@\[-`{-~]*)$"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return list(_encoded(self.library, texts))

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words in a row, and how many each has."""
        lines = [" ".join(words[k : k + 500]) for k in range(0, len(words), 500)]
        ids = np.concatenate([*_encoded(self.words, lines), np.empty(0, np.uint32)])
        sizes = np.diff(np.concatenate(([0], np.flatnonzero(self.ends_word[ids]) + 1)))
        if len(sizes) != len(words):
            raise ValueError("the vocabulary does not mark the ends of words")
        return ids, sizes

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of one whole text."""
        return self.encode_all(pa.array([text]))[0].astype("<u4").tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) in a row, and how many each has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.zeros(len(texts), bool)
        for token in self.special:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        lists = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        chunks, which = coded.dictionary, coded.indices.to_numpy()
        cut = pc.extract_regex(chunks, self.simple)
        whole = pc.is_null(cut).to_numpy(zero_copy_only=False)
        words = pc.utf8_lower(pc.fill_null(cut.field("word"), "")).dictionary_encode()
        marks = pc.fill_null(cut.field("mark"), "").dictionary_encode()
        rest = chunks.filter(pa.array(whole))
        # Units: the different words, marks, and other chunks; a chunk is two.
        own = words.dictionary.to_pylist()
        there = [k for k, w in enumerate(own) if w]
        ids, sizes = self._words([own[k] for k in there])
        word_sizes = np.zeros(len(own), np.int64)
        word_sizes[there] = sizes
        others = self._each(marks.dictionary.to_pylist() + rest.to_pylist())
        units = np.concatenate([ids, *others]) if others else ids
        sizes = np.concatenate([word_sizes, np.fromiter(map(len, others), np.int64, len(others))])
        first, second = words.indices.to_numpy().astype(np.int64), marks.indices.to_numpy() + len(own)
        first[whole] = len(own) + len(marks.dictionary) + np.arange(len(rest))
        flat, sizes = _gathered(units, sizes, np.stack([first, second], axis=1).ravel())
        flat, sizes = _gathered(flat, sizes.reshape(-1, 2).sum(axis=1), which)
        opens = np.diff(lists.offsets.to_numpy())
        total = np.concatenate(([0], np.cumsum(sizes)))
        at = np.concatenate(([0], np.cumsum(opens)))
        counts = total[at[1:]] - total[at[:-1]]
        if odd.any():
            parts = np.split(flat, np.cumsum(counts)[:-1])
            for k, found in zip(np.flatnonzero(odd), self._each(texts.filter(pa.array(odd)).to_pylist())):
                parts[k], counts[k] = found, len(found)
            flat = np.concatenate(parts)
        return flat, counts


def _encoded(library, texts: list[str]) -> Iterator[np.ndarray]:
    """Ids of each text, encoded ``LINES`` at a time."""
    for k in range(0, len(texts), LINES):
        for found in library.encode_batch_fast(texts[k : k + LINES], add_special_tokens=False):
            yield np.array(found.ids, np.uint32)


def _gathered(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of ``flat``, whose runs have ``sizes``, in a row."""
    starts = np.cumsum(sizes) - sizes
    own = sizes[which]
    shift = starts[which] - (np.cumsum(own) - own)
    return flat[np.repeat(shift, own) + np.arange(own.sum())], own


@lru_cache(maxsize=4)
def load(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def pieces(docs: DataFrame, path: str, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32``, if asked
    for ``ids``, and which of its task's pieces of that length it is: ``task,
    nth`` (from 0)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", task int, nth long"

    @trimmed
    def run(batches):
        tokenizer, seen = load(path), np.zeros(limit + 1, np.int64)
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(size) // GROUP_BYTES
            for at in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(group)) + 1):
                if len(at):
                    yield cut(tokenizer, seen, batch.slice(int(at[0]), len(at)))

    def cut(tokenizer, seen, batch):
        flat, counts = tokenizer.encode_all(batch.column(1))
        # Each text's ids end with the mark.
        flat = np.insert(flat, np.cumsum(counts), END_ID).astype("<u4")
        counts = counts + 1
        each = -(-counts // limit)
        doc = np.repeat(np.arange(len(counts)), each)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
        start = piece * limit
        length = np.minimum(limit, counts[doc] - start)
        place = np.concatenate(([0], np.cumsum(length)))
        raw = memoryview(flat).cast("B")
        crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(place[:-1].tolist(), place[1:].tolist())]
        columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crcs, pa.int64())]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(place, pa.int32()), pa.array(flat.astype(np.int32))))
        order = np.argsort(length, kind="stable")
        run_of, opens, counts = np.unique(length[order], return_index=True, return_counts=True)
        nth = np.empty(len(length), np.int64)
        nth[order] = np.arange(len(length)) - np.repeat(opens, counts) + np.repeat(seen[run_of], counts)
        seen[run_of] += counts
        columns += [pa.array(np.full(len(length), TaskContext.get().partitionId(), np.int32)), pa.array(nth)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "task", "nth"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


# -- the plan (driver, bounded by ``limit``) ------------------------------
def patterns(hist: np.ndarray, limit: int) -> np.ndarray:
    """Exactly filled patterns of one to three lengths that occur; rows hold
    lengths, padded with 0."""
    present = np.flatnonzero(hist)
    there = np.zeros(limit + 1, bool)
    there[present] = True
    found = [np.array([[limit, 0, 0]])] if there[limit] else []
    two = present[(present * 2 <= limit) & there[limit - present]]
    found.append(np.stack([limit - two, two, 0 * two], axis=1))
    frequent = present[np.argsort(-hist[present], kind="stable")]
    for first in present[::-1]:
        second = frequent[(frequent <= first) & (frequent < limit - first)][:PARTNERS]
        third = limit - first - second
        fits = (third > 0) & (third <= second) & there[np.clip(third, 0, limit)]
        found.append(np.stack([np.full(fits.sum(), first), second[fits], third[fits]], axis=1))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), int)


def fit_counts(pats: np.ndarray, hist: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeats x with least squares |A x - hist|, by accelerated
    projected gradient; A counts a pattern's lengths."""
    x = np.zeros(len(pats))
    if not len(pats):
        return x
    used = np.zeros(len(hist))
    np.add.at(used, pats.ravel(), 1.0)
    used[0] = 0
    step = 1.0 / max(1.0, 3.0 * used.max())
    y, momentum = x, 1.0
    for _ in range(rounds):
        got = np.bincount(pats.ravel(), np.repeat(y, 3), len(hist))
        miss = got - hist
        miss[0] = 0.0
        nxt = np.maximum(0.0, y - step * miss[pats].sum(axis=1))
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y, x, momentum = nxt + (momentum - 1) / following * (nxt - x), nxt, following
    return x


def plan(hist: np.ndarray, limit: int = LIMIT) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, repeats) that use up ``hist`` exactly."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[list[int], int]] = []
    pats = patterns(left, limit)
    counts = fit_counts(pats, left.astype(float))
    for at in np.argsort(-counts, kind="stable"):
        lengths, need = np.unique(pats[at][pats[at] > 0], return_counts=True)
        times = min(int(np.rint(counts[at])), int((left[lengths] // need).min()))
        if times > 0:
            left[lengths] -= times * need
            out.append(([int(v) for v in pats[at] if v], times))
    # Residual: the largest piece opens a sequence, the best fit follows.
    present = np.flatnonzero(left)
    while len(present):
        taken: dict[int, int] = {}
        order, room = [], limit
        while True:
            k = np.searchsorted(present, room, "right") - 1
            while k >= 0 and taken.get(int(present[k]), 0) >= left[present[k]]:
                k -= 1
            if k < 0:
                break
            length = int(present[k])
            fit = min(room // length, int(left[length]) - taken.get(length, 0))
            taken[length] = taken.get(length, 0) + fit
            order += [length] * fit
            room -= fit * length
        times = min(int(left[v]) // n for v, n in taken.items())
        for v, n in taken.items():
            left[v] -= times * n
        out.append((order, times))
        present = present[left[present] > 0]
    return out


def slots(planned: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """For each (length, first rank): the sequence and offset that rank gets;
    ranks count up with the sequence until the next row of that length."""
    at, base, rows = {}, 0, []
    for lengths, times in planned:
        offset = 0
        for v in lengths:
            rows.append((v, at.get(v, 0), base, offset))
            at[v] = at.get(v, 0) + times
            offset += v
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def pack(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Give each row of ``cut``, the written table of ``pieces``, its
    ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    counts = materialize(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    hist = np.zeros(limit + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        hist[row["length"]] = row["n"]
    length, first, sequence, offset = slots(plan(hist, limit))
    key = spark.sparkContext.broadcast((length << 40 | first, first, sequence, offset))
    # A rank among all pieces of one length: those of the tasks before, and the
    # task's own before it.  Only counts are ordered, never the pieces of a
    # length that a third of all rows may share.
    before = materialize(counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before")), "ranks")
    ranked = cut.join(small_side(before, 32), ["length", "task"])
    out = [c for c in cut.columns if c not in ("task", "nth")]

    @F.arrow_udf("sequence_id long, offset long")
    def place(own: pa.Array, rank: pa.Array) -> pa.Array:
        keys, firsts, sequences, offsets = key.value
        own, rank = own.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, own << 40 | rank, "right") - 1
        return pa.StructArray.from_arrays([pa.array(sequences[at] + rank - firsts[at]), pa.array(offsets[at])], names=["sequence_id", "offset"])

    # Only lengths and ranks go through Python, never the ids beside them.
    return ranked.withColumn("_place", place("length", F.col("before") + F.col("nth"))).select(*out, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, path: str, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """Pieces with their places; the ids themselves are there if asked for."""
    with small_batches(docs.sparkSession):
        cut = materialize(pieces(docs, path, limit, with_ids), "pieces")
    return pack(cut, limit)


def op7_packing(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or public_tokenizers.path("word_bpe_49k.json"))
