"""Periodic runs of words: maximal stretches that repeat three times or more.

A run is a stretch with smallest period ``q`` (words ``q`` apart are the same) of
at least ``max(24, 3 q)`` words that no neighbour extends.  Where ``[s, e)`` are
the places ``x`` with ``word[x] = word[x + q]``, the run is ``[s, e + q)``.

**Tiles.**  Periods fall into octaves ``[P, 2P)``.  A text is exploded into tiles
of 40 P words that overlap by 8 P, for each octave from 128 on (the octaves below
share tiles); the octaves whose tile would hold the whole text share one.  So a
long text becomes many rows of bounded work, and the words written out grow with
its length times the logarithm of it.

**Within a tile** (NumPy over word numbers, Arrow batches): a stretch of matches
at a period of the octave holds an aligned block of P words.  Hashes of all
windows of P words, made by doubling, show in one pass over the tile which blocks
recur after a period of the octave; no true place is missed.  At these
boundaries the Z-values to the right and to the left, the lengths over which the
text matches itself at that shift, are taken from the words themselves.  A
boundary whose stretch has a smaller period that divides ``q`` is left out.

**Stitching.**  Pieces meet by document and period; those that touch or overlap
are one stretch, as tiles overlap by more than a period.  Of equal stretches the
smallest period counts.

Edge cases: null and blank texts have no words and no runs; words are what ASCII
white space parts; rows that share a doc_id are judged each by its own text,
null doc_ids too; an empty table gives an empty result; extra columns are ignored
or, in ``collapse``, kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stridelake.llm.common import bounded, scratch, small_batches, trimmed, unused, written

MIN_WORDS = 24
MIN_REPEATS = 3
#: The largest P whose octave shares the smallest tiles, and the smallest block.
LOW_OCTAVE = 128
SMALLEST = 8
TILE, STRIDE = 40, 32

PIECES = "doc_id long, h long, period long, lo long, hi long"
_SPACE = r"[\\x20\\x09-\\x0D]+"


def words_of(text: str) -> Column:
    return F.expr(f"filter(split(coalesce({text}, ''), '{_SPACE}'), w -> w <> '')")


# -- one tile -----------------------------------------------------------------
def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Windows:
    """Hashes of all windows of 1, 2, 4, ... words of a tile, made when asked for."""

    def __init__(self, ids: np.ndarray):
        self.levels = [_mix(ids.astype(np.uint64) + np.uint64(1))]

    def of(self, level: int) -> np.ndarray:
        while len(self.levels) <= level:
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(_mix(last[:-half] * np.uint64(0x9E3779B97F4A7C15) + (last[half:] ^ np.uint64(0x5851F42D4C957F2D))))
        return self.levels[level]

    def same(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the windows of ``length`` words at ``a`` and ``b`` agree."""
        out = np.zeros(len(a), bool)
        level = np.frexp(length.astype(float))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            w, end = self.of(int(k)), length[at] - (1 << int(k))
            out[at] = (w[a[at]] == w[b[at]]) & (w[a[at] + end] == w[b[at] + end])
        return out


def _recurring(windows: _Windows, n: int, block: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of aligned blocks, and shifts from ``low`` up to ``high`` (not
    included) at which they recur."""
    w = windows.of(block.bit_length() - 1)
    if block > SMALLEST:  # every place after a block lies at one shift of the octave
        rows = len(w) // block
        if rows < 2:
            at, shift = np.empty(0, np.int64), np.empty(0, np.int64)
        else:
            grid = w[: rows * block].reshape(rows, block)
            k, j = np.nonzero(grid[1:] == grid[:-1, :1])
            at, shift = k * block, j + block
        if len(w) > rows * block and rows:  # the last, shorter row
            j = np.flatnonzero(w[rows * block :] == w[(rows - 1) * block])
            at, shift = np.append(at, np.full(len(j), (rows - 1) * block)), np.append(shift, j + block)
        keep = (shift >= low) & (shift < high)
        return at[keep], shift[keep]
    found = []
    for q in range(low, high):
        later = w[q::block]
        k = np.flatnonzero(w[::block][: len(later)] == later)
        found.append((k * block, np.full(len(k), q)))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _primes_of(high: int) -> np.ndarray:
    """The smallest prime factor of each number below ``high``."""
    least = np.zeros(max(high, 2), np.int64)
    for p in range(2, len(least)):
        if p * p > len(least):
            break
        if least[p] == 0:
            part = least[p * p :: p]
            part[part == 0] = p
    return np.where(least == 0, np.arange(len(least)), least)


def pieces(ids: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """``(q, s, e)``: the stretches of matches at periods ``low`` up to ``high`` (not
    included) that may belong to a run."""
    n, out, windows = len(ids), [], _Windows(ids)
    high = min(high, n - SMALLEST + 1)
    least = None
    start = low
    while start < high:
        block = SMALLEST if start < 2 * SMALLEST else 1 << (start.bit_length() - 1)
        stop = min(high, 2 * block)
        if block + start > n:
            break
        at, shift = _recurring(windows, n, block, start, stop)
        if len(at):
            least = _primes_of(high) if least is None else least
            rest, whole = shift.copy(), np.ones(len(at), bool)
            while (rest > 1).any():
                prime = np.where(rest > 1, least[rest], 1)
                some = np.flatnonzero((rest > 1) & whole)
                smaller = shift[some] // prime[some]
                whole[some] = ~windows.same(at[some], at[some] + smaller, shift[some] + block - smaller)
                rest = rest // prime
            at, shift = at[whole], shift[whole]
            for q in np.unique(shift):
                # The Z-values at a boundary reach to the mismatches beside it.
                miss = np.flatnonzero(ids[:-q] != ids[q:])
                k = np.unique(np.searchsorted(miss, at[shift == q]))
                s = np.where(k > 0, miss[k - 1] + 1, 0) if len(miss) else np.zeros(1, np.int64)
                e = np.append(miss, n - q)[k]
                out += [(int(q), int(a), int(b)) for a, b in zip(s, e) if b > a]
        start = stop
    return out


@trimmed
def _solve(batches):
    for batch in batches:
        made = []
        for doc, h, low, high, at, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "low", "high", "at", "words"))):
            words, numbers = text.split(" "), {}
            ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
            # Where hardly any word comes back, nothing can.
            if len(words) - len(numbers) >= MIN_WORDS * (MIN_REPEATS - 1) // MIN_REPEATS:
                made += [(doc, h, q, at + s, at + e) for q, s, e in pieces(ids, low, high)]
        columns = list(zip(*made)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "h", "period", "lo", "hi"])


# -- whole texts ----------------------------------------------------------------
def tiles(texts: DataFrame) -> DataFrame:
    """``texts(doc_id, h, words)`` as tiles ``doc_id, h, low, high, at, words``: words
    from ``at`` on, joined, and the periods to look for in them."""
    sizes = ", ".join(f"{TILE * LOW_OCTAVE << b}L" for b in range(40))
    rows = texts.withColumn("n", F.size("words")).withColumn("last", F.expr(f"size(filter(array({sizes}), x -> x < n))"))
    octave = f"(shiftleft({LOW_OCTAVE}L, b))"
    count = f"if(b = last, 0L, (n - {TILE - STRIDE} * {octave} - 1) div ({STRIDE} * {octave}))"
    tile = f"""struct(if(b = 0, 1L, {octave}) as low, if(b = last, n div {MIN_REPEATS} + 1L, 2 * {octave}) as high, k * {STRIDE} * {octave} as at,
        array_join(slice(words, int(k * {STRIDE} * {octave} + 1), int(least({TILE} * {octave}, n))), ' ') as words)"""
    every = F.expr(f"if(n < {MIN_WORDS}, null, flatten(transform(sequence(0, last), b -> transform(sequence(0L, {count}), k -> {tile}))))")
    # An outer explode, as Spark would filter the others on the tiles, and make
    # them twice; the rows without a tile go by their null.
    each = rows.select("doc_id", "h", every.alias("tiles")).select("doc_id", "h", F.explode_outer("tiles").alias("t"))
    return each.where("t is not null").select("doc_id", "h", "t.*")


def stitched(found: DataFrame) -> DataFrame:
    """``doc_id, h, start, length, period`` of the runs that ``pieces`` make up."""
    order = Window.partitionBy("doc_id", "h", "period").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = found.withColumn("fresh", F.coalesce((F.col("lo") > reach).cast("int"), F.lit(0)))
    joined = apart.withColumn("island", F.sum("fresh").over(order)).groupBy("doc_id", "h", "period", "island").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    runs = joined.select("doc_id", "h", "start", (F.col("hi") - F.col("start") + F.col("period")).alias("length"), "period")
    runs = runs.where((F.col("length") >= MIN_WORDS) & (F.col("length") >= MIN_REPEATS * F.col("period")))
    return runs.groupBy("doc_id", "h", "start", "length").agg(F.min("period").alias("period"))


def runs_of(texts: DataFrame) -> DataFrame:
    """All runs of ``texts(doc_id, h, words)``: ``doc_id, h, start, length, period``."""
    return stitched(tiles(texts).mapInArrow(_solve, PIECES))


def summarised(runs: DataFrame) -> DataFrame:
    """One row per text with a run: ``n_runs``, ``runs`` by start and period, the
    greatest (``best``), and ``kept``, the stretches ``at, length`` of words before
    ``tail`` that no run drops."""
    order = Window.partitionBy("doc_id", "h").orderBy(F.col("start") + F.col("period"), "start", "period")
    done = F.coalesce(F.max(F.col("start") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rows = runs.withColumn("done", done).withColumn("free", F.col("start") + F.col("period") - F.col("done"))
    kept = F.when(F.col("free") > 0, F.struct(F.col("done").alias("at"), F.col("free").alias("length")))
    made = rows.groupBy("doc_id", "h").agg(
        F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"),
        F.array_sort(F.collect_list(kept)).alias("kept"),
        F.max(F.col("start") + F.col("length")).alias("tail"),
    )
    best = F.expr("aggregate(runs, runs[0], (b, x) -> if(x.length * b.period > b.length * x.period, x, b))")
    return made.withColumn("n_runs", F.size("runs").cast("long")).withColumn("best", best)


def _keyed(docs: DataFrame, words: Column) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    return texts.withColumn("h", F.xxhash64("words"))


def collapsed(docs: DataFrame, words: Column) -> DataFrame:
    """Each row's ``doc_id``, the hash ``h`` of its words, its summary (null without a
    run), and its ``words`` without those that a run drops: all after the run's first
    period.

    Rows are known by doc_id and a hash of their words, so that texts need not
    travel with their tiles; the summaries are broadcast if counted to be small,
    else texts meet them in a shuffled join."""
    spark = docs.sparkSession
    texts = _keyed(docs, words)
    with scratch(spark) as result, small_batches(spark, 200):
        found = written(summarised(runs_of(texts)), result)
    size = found.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n_runs"), F.lit(0)).alias("runs")).first()
    keys = found.withColumnRenamed("doc_id", "of").withColumnRenamed("h", "key")
    rows = texts.join(bounded(keys, size["rows"] + size["runs"], 256), (F.col("h") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("of")), "left")
    left = F.expr("if(runs is null, words, concat(flatten(transform(kept, s -> slice(words, int(s.at + 1), int(s.length)))), slice(words, int(tail + 1), size(words))))")
    return rows.select("doc_id", "h", F.coalesce("n_runs", F.lit(0).cast("long")).alias("n_runs"), "runs", "best", left.alias("words"))


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with the words that runs drop taken out of ``text``; a text without a
    run stays as it is, white space too.  Other columns are kept."""
    of, h, key, cut = unused(docs, "of", "h", "key", "cut")
    made = collapsed(docs, words_of("text")).where("n_runs > 0")
    named = made.select(F.col("doc_id").alias(of), F.col("h").alias(key), F.array_join("words", " ").alias(cut)).distinct()
    rows = docs.withColumn(h, F.xxhash64(words_of("text"))).join(named, (F.col(h) == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(of)), "left")
    return rows.withColumn("text", F.coalesce(cut, "text")).select(*[F.col(f"`{c}`") for c in docs.columns])


def planted(words: str, doc_id: str) -> Column:
    """Words that repeat from a place on, in a tenth of the documents (by the
    crc32 of the id); the others as they are."""
    h = f"crc32(cast(cast({doc_id} as string) as binary))"
    n = f"size({words})"
    g = f"({h} div 10)"
    a = f"({g} % {n})"
    p = f"(1 + ({n} - {a}) div (3 + {g} % 8))"
    return F.expr(f"""if({h} % 10 = 0 and {n} > 0,
        transform(array(struct(int({a}) as a, int({p}) as p, {words} as ws)), k -> transform(k.ws, (word, i) -> if(i < k.a, word, get(k.ws, k.a + (i - k.a) % k.p))))[0], {words})""")


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of which repeat a stretch."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", words_of("text").alias("w"))
    rows = collapsed(docs, planted("w", "doc_id"))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    listed = F.expr("array_join(transform(coalesce(runs, array()), r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return rows.select(
        "doc_id",
        "n_runs",
        *best,
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.array_join("words", " ").cast("binary"), 256).alias("collapsed_sha256"),
    )
