"""Document fingerprints by winnowing.

Every ``K`` code points in a row are hashed by a rolling hash; of each ``WINDOW``
hashes in a row the least is chosen, the rightmost of equal ones, and kept with
its position.  Two texts that share ``K + WINDOW - 1`` code points in a row share a
chosen hash, and its positions say where.  Where the text is shorter than a
window, the least of its hashes is chosen; shorter than ``K``, the hash of it all.
So only the empty text has an empty fingerprint.

A fingerprint as text is base64 of its hashes (eight bytes each, big end first)
and then its positions (four bytes each): equal texts have equal ones, and
``likeness`` needs nothing else.  It is the share of different hashes that both
have among those that one has; two empty ones are alike.

**Neighbours.**  ``beside_next`` gives each document the one that follows in the
order of ids.  Ids alone are counted first: quantiles split them into ranges, and
the first document of each range is sent to the range before it as well (the very
first to the last).  Texts then move once, to their range, where they are sorted.

Edge cases: null text is empty; null doc_ids come first; rows that share a doc_id
go by their text; a single row follows itself; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.llm.common import trimmed

K, WINDOW = 32, 64
#: Code points hashed at a time, rows of a result batch.
CHUNK, ROWS = 1 << 20, 200
#: Rows meant for a range of ids, and the most ranges.
RANGE_ROWS, MAX_RANGES = 4096, 20_000
#: Fixed: an odd base and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of every ``k`` code points in a row: differences of prefix sums, each
    brought back to the power of its start."""
    out = []
    for start in range(0, len(codes) - k + 1, CHUNK):
        part = _mix(codes[start : start + CHUNK + k - 1].astype(np.uint64) + np.uint64(1))
        size = 1 << (len(part) - 1).bit_length() if len(part) > 1 else 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _powers(_BASE, size)[: len(part)], dtype=np.uint64)])
        out.append(_mix((sums[k:] - sums[:-k]) * _powers(_INVERSE, size)[: len(part) - k + 1]))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def rightmost_minima(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each window, the rightmost of equal ones, each
    place once."""
    best, span = np.arange(len(hashes)), 1
    while span < window:
        step = min(span, window - span)
        left, right = best[:-step], best[step:]
        best = np.where(hashes[right] <= hashes[left], right, left)
        span += step
    return best[np.concatenate([[True], best[1:] != best[:-1]])] if len(best) else best


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """``hashes, positions`` of a text's fingerprint, in order of position."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(codes):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = rolling(codes, min(k, len(codes)))
    at = rightmost_minima(hashes, min(window, len(hashes)))
    return hashes[at], at


def as_text(marks: tuple[np.ndarray, np.ndarray]) -> str:
    return base64.b64encode(marks[0].astype(">u8").tobytes() + marks[1].astype(">u4").tobytes()).decode()


def from_text(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    n = len(raw) // 12
    return np.frombuffer(raw, ">u8", n).astype(np.uint64), np.frombuffer(raw, ">u4", n, 8 * n).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of hashes."""
    if not len(a) and not len(b):
        return 1.0
    x, y = np.unique(a), np.unique(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, marks``: each whole text's chosen hashes (as signed longs)
    with their positions."""

    @trimmed
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                marks = [[{"hash": h, "at": p} for h, p in zip(hashes.view(np.int64).tolist(), at.tolist())] for hashes, at in map(winnow, texts)]
                kind = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(marks, kind)], ["doc_id", "n_chars", "marks"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_chars long, marks array<struct<hash:long,at:long>>")


# -- each document beside the next ------------------------------------------------
_NONE = -(1 << 63)


def _ranges(ids: DataFrame) -> tuple[np.ndarray, dict[int, list[int]]]:
    """Where ranges of ids part, and for the first id of each range the range that
    comes before it (in a circle).  Both have an entry for each range."""
    rows = ids.count()
    n = max(1, min(MAX_RANGES, -(-rows // RANGE_ROWS)))
    splits = np.empty(0, np.int64)
    if n > 1:
        shares = [k / n for k in range(1, n)]
        splits = np.unique(np.array(ids.agg(F.percentile_approx("id", shares, max(10_000, 10 * n))).first()[0], np.int64))
    firsts = sorted((r["range"], r["id"]) for r in ids.groupBy(_placed(splits, {})("id")["range"].alias("range")).agg(F.min("id").alias("id")).collect())
    before = {}
    for k, (_, first) in enumerate(firsts):
        before.setdefault(first, []).append(firsts[k - 1][0])
    return splits, before


def _placed(splits: np.ndarray, before: dict[int, list[int]]):
    """Of an id: its range, and the range before if it is the first of its own."""
    first = np.array(sorted(before), np.int64)
    of = np.array([before[f][0] for f in first.tolist()], np.int64)

    @F.pandas_udf("range int, before int")
    def place(ids: pd.Series) -> pd.DataFrame:
        values = ids.to_numpy(np.int64)
        out = np.full(len(values), -1, np.int64)
        if len(first):
            k = np.minimum(np.searchsorted(first, values), len(first) - 1)
            out = np.where(first[k] == values, of[k], -1)
        return pd.DataFrame({"range": np.searchsorted(splits, values, "right").astype(np.int32), "before": out.astype(np.int32)})

    return place


def beside_next(docs: DataFrame, work, schema: str) -> DataFrame:
    """What ``work(rows)`` yields as Arrow batches of ``schema``; ``rows`` are the
    documents of a range in order, as ``(doc_id, text, next text)``."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE))
    splits, before = _ranges(docs.select(key.alias("id")))

    def pairs(batches):
        held = None
        for batch in batches:
            for where, ghost, doc_id, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
                text = text or ""
                if held and held[0] == where:
                    yield held[1], held[2], text
                held = None if ghost else (where, doc_id, text)

    @trimmed
    def run(batches):
        yield from work(pairs(batches))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("p", _placed(splits, before)(F.coalesce("doc_id", F.lit(_NONE))))
    own = F.struct(F.col("p.range").alias("range"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.col("p.before").alias("range"), F.lit(True).alias("ghost"))
    sent = texts.select("doc_id", "text", F.explode(F.when(F.col("p.before") >= 0, F.array(own, ghost)).otherwise(F.array(own))).alias("s"))
    rows = sent.select(F.col("s.range").alias("range"), F.col("s.ghost").alias("ghost"), "doc_id", "text")
    there = rows.repartitionById(len(splits) + 1, F.col("range")).sortWithinPartitions("range", "ghost", F.asc_nulls_first("doc_id"), F.coalesce("text", F.lit("")))
    return there.mapInArrow(run, schema)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_marks long"


def edited_and_next(docs: DataFrame, share: int = 4) -> DataFrame:
    """Each document's fingerprint, beside that of its text with the last
    1/``share`` replaced by the next document's beginning, and that of the next."""

    def work(rows):
        made, last = [], (None, None)
        for doc_id, text, later in rows:
            cut = len(text) // share
            edited = text[: len(text) - cut] + later[:cut]
            own = last[1] if last[0] == text and last[1] else winnow(text)
            changed = own if edited == text else winnow(edited)
            following = own if later == text else winnow(later)
            made.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_text(own), as_text(changed), likeness(own[0], changed[0]), likeness(own[0], following[0]), len(own[0])))
            last = later, following
            if len(made) == ROWS:
                yield _batch(made)
                made = []
        yield _batch(made)

    return beside_next(docs, work, EDITED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    names = [c.split()[0] for c in EDITED.split(", ")]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return edited_and_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
