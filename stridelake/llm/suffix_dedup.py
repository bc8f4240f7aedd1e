"""Exact substring dedup: every byte that a repeated string of ``WINDOW`` bytes
covers is removed.

The suffix order is induced from sampled suffixes, as external induced sorting
does from its leftmost ones, and only where it can matter:

1. Sampling.  Each window picks its smallest hashed ``GRAM``-byte gram, so
   equal windows pick equal suffixes at equal offsets.  A run of windows with
   one pick is a suffix tuple: gram, and the bytes around it that the windows
   cover.  A distributed count of the grams leaves out tuples that cannot
   repeat; it is only a filter, and what it lets through is compared by bytes.
   Equal tuples of a batch travel as one with their places, equal tuples of the
   corpus are sorted as one with their number.
2. Sorting.  Spark's external sorter (runs on disk, merged by a priority queue)
   orders the sampled suffixes of each gram; neighbours' common prefixes are
   taken from their bytes.
3. Induction.  From the order of suffixes at one place follows the order one
   byte earlier: a stable sort by the preceding byte, with common-prefix values
   carried along as range minima plus one.  A window repeats where the value
   next to it reaches ``WINDOW``, or where its tuple occurs more than once.

A gram with more than ``GROUP`` different tuples is not sorted by one task: the
tuples are split into ranges of offsets, each keyed by the bytes all its windows
share, and the three steps recur on the ranges, down to single windows.

Edge cases: null text counts as empty; texts shorter than the window keep all;
rows with equal texts remove each other's, and are sampled once where the table
of such texts is small; a document repeats itself like any other; matches never
cross documents; an empty table gives an empty result; extra columns are ignored
or, by ``dedup``, kept whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import BROADCAST_BYTES, materialize, scratch, small_batches, small_side, trimmed, unused, written

WINDOW = 200
GRAM = 32
#: Different tuples of one gram sorted together.
GROUP = 4000
#: Offsets in one range, level by level.
SPLITS = (64, 16, 4, 1)
SEGMENT = 1 << 18
SORT_ROWS = 16_384
#: Places after which a batch's equal tuples are sent on.
HELD_PLACES = 40_000
_MASK = np.uint64((1 << 24) - 1)


class _Hasher:
    """Polynomial hashes of all grams of up to a segment, modulo 2**64."""

    def __init__(self, size: int):
        digest = lambda x: int.from_bytes(hashlib.blake2b(bytes(x), digest_size=8).digest(), "little")
        self.table = np.array([digest([b, 0]) for b in range(256)], np.uint64)
        base = digest([0]) | 5
        self.powers, self.inverses = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        for run in (self.powers, self.inverses):
            run[0] = 1
            np.cumprod(run, out=run)

    def grams(self, data: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=sums[1:])
        return mix((sums[GRAM:] - sums[:-GRAM]) * self.inverses[: len(data) - GRAM + 1])


_hasher: list[_Hasher] = []


def hasher() -> _Hasher:
    if not _hasher:
        _hasher.append(_Hasher(2 * SEGMENT + 2 * WINDOW))
    return _hasher[0]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def segments(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined bytes of about a segment, and for each part of a text in it: its
    text, its start there, and its start here.  Parts of one text overlap by
    less than a window, so each window lies in exactly one."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def joined():
        lengths = np.array([len(b) for _, _, b in held])
        return np.frombuffer(b"".join(b for _, _, b in held), np.uint8), np.array([r for r, _, _ in held]), np.array([s for _, s, _ in held]), np.cumsum(lengths) - lengths

    for row, text in enumerate(texts):
        for start in range(0, len(text) - WINDOW + 1, SEGMENT):
            part = text[start : start + SEGMENT + WINDOW - 1]
            held.append((row, start, part))
            size += len(part)
            if size >= SEGMENT:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def tuples(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Suffix tuples of some texts: row, gram hash, and place (first window <<
    16 | pick - first << 8 | last - first)."""
    own = hasher()
    for data, rows, starts, bases in segments(texts):
        grams = own.grams(data)
        picks = sliding_min((grams & ~_MASK) | np.arange(len(grams), dtype=np.uint64), WINDOW - GRAM + 1) & _MASK
        ends = np.append(bases[1:], len(data))
        edge = np.zeros(len(data) + 1, np.int32)
        edge[bases] += 1
        edge[ends - WINDOW + 1] -= 1
        at = np.flatnonzero(np.cumsum(edge[: len(picks)]))
        pick = picks[at].astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (np.diff(pick) != 0)
        cut = np.flatnonzero(new)
        first, last, pick = at[cut], at[np.append(cut[1:], len(at)) - 1], pick[cut]
        part = np.searchsorted(bases, first, "right") - 1
        yield rows[part], grams[pick].view(np.int64), (starts[part] + first - bases[part]) << 16 | (pick - first) << 8 | (last - first)


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# -- sampling ----------------------------------------------------------------
def gram_counts(texts: DataFrame) -> DataFrame:
    """``h, c``: how often each picked gram occurs, over ``texts(text)``."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, h, _ in tuples(_bytes_of(batch.column(0))):
                found, times = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times.astype(np.int64))], names=["h", "c"])

    return texts.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def own_grams(texts: DataFrame) -> DataFrame:
    """``k1, k2, h``: the grams that each text picks."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, h, _ in tuples(_bytes_of(batch.column(2))):
                pairs = np.unique(np.stack([row, h], axis=1), axis=0)
                own = pa.array(pairs[:, 0])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(pairs[:, 1])], names=["k1", "k2", "h"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, h long")


def known_grams(shared: DataFrame):
    """The sorted grams of ``shared(h)``, a written table, as a broadcast array;
    none if they are too many for one."""
    if shared.count() * 16 > BROADCAST_BYTES:
        return None
    return shared.sparkSession.sparkContext.broadcast(np.sort(shared.toPandas()["h"].to_numpy(np.int64)))


def edges(texts: DataFrame, shared: DataFrame, known, places: bool) -> DataFrame:
    """Suffix tuples whose gram is in ``shared(h)``, a written table: the bytes
    before (``l``) and from (``r``) the picked place that their windows cover,
    equal ones of a batch together, with their number ``n`` or, where ``places``
    are asked for, with the ``k1, k2, p`` of each.  ``known`` are the same grams
    as a broadcast; without it each text gets the list of its own."""
    if known is not None:
        texts = texts.select("k1", "k2", "text")
    else:
        lists = own_grams(texts).join(shared, "h", "left_semi").groupBy("k1", "k2").agg(F.collect_set("h").alias("hs"))
        texts = texts.select("k1", "k2", "text").join(lists, ["k1", "k2"])

    def sent(held: dict) -> pa.RecordBatch:
        keys, found = list(held), list(held.values())
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))]
        if not places:
            return pa.RecordBatch.from_arrays([*columns, pa.array([len(x) for x in found], pa.int64())], names=["h", "l", "r", "n"])
        columns += [pa.array([[x[i] for x in own] for own in found], pa.list_(pa.int64())) for i in range(3)]
        return pa.RecordBatch.from_arrays(columns, names=["h", "l", "r", "k1", "k2", "p"])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bytes_of(batch.column(2))
            some = known.value if known is not None else np.unique(batch.column(3).flatten().to_numpy())
            held: dict[tuple, list] = {}
            size = 0
            for row, h, pos in tuples(raw):
                there = np.flatnonzero(some[np.minimum(np.searchsorted(some, h), len(some) - 1)] == h) if len(some) else []
                for k, gram, place in zip(row[there].tolist(), h[there].tolist(), pos[there].tolist()):
                    first = place >> 16
                    p, last = first + (place >> 8 & 255), first + (place & 255)
                    held.setdefault((gram, raw[k][first:p], raw[k][p : last + WINDOW]), []).append((k1[k], k2[k], p))
                size += len(there)
                if size > HELD_PLACES:
                    yield sent(held)
                    held, size = {}, 0
            if held:
                yield sent(held)

    return texts.mapInArrow(run, "h long, l binary, r binary, " + ("k1 array<long>, k2 array<long>, p array<long>" if places else "n long"))


# -- induced sorting -------------------------------------------------------
def induce(group: np.ndarray, left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest offset before the sampled place at which a row's
    window repeats in its group (-1: none).

    Rows come sorted by (group, right).  ``left`` ends before the sampled place
    and ``right`` starts at it; both reach exactly as far as the row's windows.
    """
    count = len(group)
    back = np.fromiter(map(len, left), np.int64, count)
    ahead = np.fromiter(map(len, right), np.int64, count)
    width = int(ahead.max())
    text = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in right), np.uint8).reshape(count, width)
    depth = int(back.max())
    before = np.frombuffer(b"".join(x[::-1].ljust(depth, b"\0") for x in left), np.uint8).reshape(count, depth)
    differ = text[1:] != text[:-1]
    prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.full(count, -1, np.int64)  # with the row before; -1 opens a group
    same = group[1:] == group[:-1]
    common[1:][same] = np.minimum(prefix, np.minimum(ahead[1:], ahead[:-1]))[same]
    rows = np.arange(count)
    least, most = np.full(count, -1, np.int64), np.full(count, -1, np.int64)
    for offset in range(depth + 1):
        repeats = common >= WINDOW
        repeats[:-1] |= common[1:] >= WINDOW
        found = rows[repeats]
        most[found] = offset
        least[found[least[found] < 0]] = offset
        # Rows without an earlier byte leave; their common prefixes pass on.
        keep = np.flatnonzero(back[rows] > offset)
        if not len(keep):
            break
        common = np.minimum.reduceat(common[: keep[-1] + 1], np.concatenate(([0], keep[:-1] + 1)))
        rows = rows[keep]
        # One byte earlier: stable by that byte, prefixes by range minima.
        byte = group[rows] << 8 | before[rows, offset]
        order = np.argsort(byte, kind="stable")
        x, y, together = order[:-1], order[1:], byte[order[1:]] == byte[order[:-1]]
        common = np.append(common, -1)
        spans = np.minimum.reduceat(common, np.stack([np.minimum(x + 1, y), y + 1], axis=1).ravel())[::2] if len(rows) > 1 else np.empty(0, np.int64)
        rows = rows[order]
        common = np.full(len(rows), -1, np.int64)
        common[1:] = np.where(together, spans + 1, np.where(group[rows[1:]] == group[rows[:-1]], 0, -1))
    return least, most


def name(h: str = "h", l: str = "l", r: str = "r") -> list:
    """192 bits that name a tuple: cells are told apart by their bytes, and a
    verdict goes back to its tuple by these, so that no byte travels again."""
    return [F.col(h).alias("h"), F.xxhash64(l, r).alias("n1"), F.xxhash64(F.lit(1), l, r).alias("n2")]


_NAME = ["h", "n1", "n2"]


def sort_groups(rows: DataFrame) -> DataFrame:
    """``h, n1, n2, lo, hi`` for the tuples of ``rows(h, l, r, c)`` with windows
    that repeat: the smallest and largest offset of one before the sampled
    place.  ``c`` says how often a tuple occurs; groups ``h`` are whole."""

    def settle(held: list[tuple]) -> pa.RecordBatch:
        _, group = np.unique(np.array([x[0] for x in held]), return_inverse=True)
        least, most = induce(group.astype(np.int64), [x[1] for x in held], [x[2] for x in held])
        out = [(h, l, r, WINDOW - len(r), len(l)) if c > 1 else (h, l, r, lo, hi) for (h, l, r, c), lo, hi in zip(held, least.tolist(), most.tolist()) if c > 1 or lo >= 0]
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32()))], names=["h", "l", "r", "lo", "hi"])

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held.extend(zip(*(c.to_pylist() for c in batch.columns)))
            while len(held) > SORT_ROWS:
                stop = SORT_ROWS
                while stop < len(held) and held[stop][0] == held[stop - 1][0]:
                    stop += 1
                if stop == len(held):
                    break
                yield settle(held[:stop])
                held = held[stop:]
        if held:
            yield settle(held)

    sorted_ = rows.select("h", "l", "r", "c").repartition("h").sortWithinPartitions("h", "r")
    return sorted_.mapInArrow(run, "h long, l binary, r binary, lo int, hi int").select(*name(), "lo", "hi")


def repeats(cells: DataFrame, level: int = 0) -> DataFrame:
    """``h, n1, n2, lo, hi`` as in ``sort_groups`` for groups of any size, from
    different ``cells(h, l, r, c)``, a written table."""
    if level == len(SPLITS):
        return sort_groups(cells)
    full = materialize(cells.groupBy("h").agg(F.count("*").alias("g")).where(F.col("g") > GROUP).select("h"), "full")
    if full.isEmpty():
        return sort_groups(cells)
    full = small_side(full, 16)
    found = sort_groups(cells.join(full, "h", "left_anti"))
    crowded = cells.join(full, "h", "left_semi")
    below = split_rows(crowded, SPLITS[level]).groupBy("h2", "l2", "r2").agg(F.sum("c").alias("c"))
    below = materialize(below.select(F.col("h2").alias("h"), F.col("l2").alias("l"), F.col("r2").alias("r"), "c"), "cells")
    settled = materialize(repeats(below, level + 1), "settled")
    # Windows are longer than any two offsets are apart: what a tuple's repeated
    # windows cover is one run from the first to the last.
    owner = F.struct(*name()).alias("owner")
    parts = split_rows(crowded, SPLITS[level]).select(owner, *name("h2", "l2", "r2"))
    back = parts.join(settled, _NAME).groupBy("owner").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return found.unionByName(back.select("owner.*", "lo", "hi"))


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def split_rows(rows: DataFrame, size: int) -> DataFrame:
    """Ranges of ``size`` offsets of each of ``rows(h, l, r, c)``, keyed by the
    bytes that all windows of the range share: ``h2, l2, r2`` beside the row."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "l", "r", "c", "h2", "l2", "r2"]
        types = [pa.int64(), pa.binary(), pa.binary(), pa.int64()] + [pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            out = []
            for h, left, right, c in zip(*(x.to_pylist() for x in batch.columns)):
                lo, hi = WINDOW - len(right), len(left)
                for block in range(lo // size, hi // size + 1):
                    b0, b1 = block * size, block * size + size - 1
                    core = left[hi - b0 :] + right[: WINDOW - b1] if b1 < WINDOW else b""
                    key = f"{size},{block}".encode()
                    out.append((h, left, right, c, _hash(key, h.to_bytes(8, "little", signed=True), core), left[hi - min(hi, b1) :], right[: WINDOW - max(lo, b0)]))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)

    return rows.select("h", "l", "r", "c").mapInArrow(run, "h long, l binary, r binary, c long, h2 long, l2 binary, r2 binary")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``k1, k2, ranges``: for each different text (by its hashes) of
    ``docs(doc_id, text)`` the byte ranges that repeated windows cover; ranges
    may overlap.  A written table."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), _text().alias("text"), *[k.alias(f"k{i + 1}") for i, k in enumerate(_keys())])
    texts = texts.where(F.octet_length("text") >= WINDOW)
    groups = texts.groupBy("k1", "k2").agg(F.count("*").alias("c"), F.min("d").alias("rep"), F.max(F.octet_length("text")).alias("size"))
    copies = materialize(groups.where("c > 1").drop("c"), "copies")
    # One of each group of equal texts meets the others.
    if copies.count() * 48 <= BROADCAST_BYTES:
        texts = texts.join(F.broadcast(copies.select("k1", "k2", "rep")), ["k1", "k2"], "left").where("rep is null or rep = d")
    else:
        # Joined by the row's own id too, so that a group's copies do not meet.
        own = materialize(groups.select("k1", "k2", F.col("rep").alias("d")), "first-of-equals")
        texts = texts.join(own, ["k1", "k2", "d"], "left_semi")
    with small_batches(docs.sparkSession), scratch(docs.sparkSession) as result:
        shared = materialize(gram_counts(texts).where("c > 1").select("h"), "grams")
        known = known_grams(shared)
        # Tuples are cut twice: with their bytes for the order, and by name for
        # their places.
        cells = edges(texts, shared, known, places=False).groupBy("h", "l", "r").agg(F.sum("n").alias("c"))
        found = materialize(repeats(materialize(cells, "cells")), "repeats")
        rows = edges(texts, shared, known, places=True).select(*name(), "k1", "k2", "p")

        @trimmed
        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held: dict[tuple, set] = {}
                for k1, k2, p, lo, hi in zip(*(x.to_pylist() for x in batch.columns)):
                    for a, b, at in zip(k1, k2, p):
                        held.setdefault((a, b), set()).add((at - hi, at - lo + WINDOW))
                cut = [[{"start": a, "stop": b} for a, b in spans(list(x))] for x in held.values()]
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int64()), pa.array(cut, _RANGES)], names=["k1", "k2", "ranges"])

        met = rows.join(found, _NAME).select("k1", "k2", "p", "lo", "hi").mapInArrow(placed, "k1 long, k2 long, ranges array<struct<start:long,stop:long>>")
        whole = copies.select("k1", "k2", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("stop"))).alias("ranges"))
        # Rows that repeat with their id send the same ranges: each is kept once.
        different = met.unionByName(whole).select("k1", "k2", F.explode("ranges").alias("range")).distinct()
        return written(different.groupBy("k1", "k2").agg(F.collect_list("range").alias("ranges")), result)


_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def spans(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs that some ranges cover."""
    out: list[list[int]] = []
    for start, stop in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _text():
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _keys():
    """128 bits that name a text."""
    return F.xxhash64(_text()), F.xxhash64(F.lit(1), _text())


def _marked(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the ranges of each text, and that column's name."""
    k1, k2, ranges = unused(docs, "_k1", "_k2", "_ranges")
    found = small_side(repeated_ranges(docs), 256).toDF(k1, k2, ranges)
    keys = dict(zip((k1, k2), _keys()))
    return docs.withColumns(keys).join(found, [k1, k2], "left").drop(k1, k2), ranges


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per document."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, ranges in zip(_bytes_of(batch.column(1)), batch.column(2).to_pylist()):
                cut = spans([(r["start"], r["stop"]) for r in ranges or ()])
                rows.append((len(text), sum(b - a for a, b in cut), len(cut), hashlib.sha256(_without(text, cut)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], pa.string() if i == 3 else pa.int64()) for i in range(4)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    marked, ranges = _marked(docs.select("doc_id", "text"))
    return marked.select(F.col("doc_id").cast("long"), _text(), ranges).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _without(text: bytes, cut: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for pair in cut for x in pair), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated bytes taken out of ``text``; a character that is
    cut in two goes as a whole.  A null text stays null."""
    marked, ranges = _marked(docs)
    at = docs.columns.index("text")

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at)
            new = text.to_pylist()
            for k in np.flatnonzero(batch.column(batch.num_columns - 1).is_valid().to_numpy(zero_copy_only=False)).tolist():
                cut = spans([(r["start"], r["stop"]) for r in batch.column(batch.num_columns - 1)[k].as_py()])
                new[k] = _without(new[k].encode(), cut).decode("utf-8", "ignore")
            columns = [pa.array(new, text.type) if k == at else c for k, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return marked.mapInArrow(run, docs.schema)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
