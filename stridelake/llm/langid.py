"""Language identification with character Kneser-Ney models.

One interpolated Kneser-Ney model of character n-grams per language, over
words padded at both ends.  Every training text is counted and every n-gram is
kept: words per language, then n-grams, are combined in each task before they
are shuffled, and joins of the counted tables give probabilities and back-off
weights.  Up to ``MODEL_ROWS`` entries each task holds the models as sorted hash
arrays per order; beyond, the different words of the texts meet the tables in
joins, with the same result.  What a model assigns to a text is the
cross-entropy per character, and the language with the lowest wins.  The cross-entropies of
all training texts calibrate the score and, per language, the cross-entropy above which a
prediction counts as rejected; they are sums and counts that Spark makes.

Edge cases: null text, or text without a letter, is ``und`` with score 0; so is
everything when nothing was learned.  Rows with null language or null doc_id do
not train.  Ties go to the alphabetically first language; repeated rows count
as often as they occur; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import grouped, materialize, small_side, trimmed

ORDER = 4
#: Entries (16 bytes each) of all models together up to which every task holds
#: them; the tables themselves have no bound.
MODEL_ROWS = 4_000_000
#: Texts from which on a word's scores meet them in parts, where joins are used.
HOT_ROWS = 200_000
REJECT_QUANTILE = 0.995
#: Widths of the bins in which cross-entropies are counted, powers of two, so that a
#: finer bin lies in one coarser bin.
BINS = (2.0**-10, 2.0**-24)
CACHE_CHUNKS = 600_000
#: Characters looked up together.
GROUP_CHARS = 2_000_000
START, END = "\x02", "\x03"
_WORDS = regex.compile(r"\p{L}+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(chunk: str) -> list[str]:
    return _WORDS.findall(chunk.lower())


def padded(word: str, order: int = ORDER) -> str:
    return START * (order - 1) + word + END


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, n`` over all rows of ``docs(lang, text)``."""

    @trimmed
    def run(batches):
        held: dict[str, Counter] = {}

        def flush():
            for lang, counts in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])
            held.clear()

        for batch in batches:
            chunks: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                chunks.setdefault(lang, Counter()).update((text.as_py() or "").split(" "))
            for lang, counts in chunks.items():
                own = held.setdefault(lang, Counter())
                for chunk, n in counts.items():
                    for word in words_of(chunk):
                        own[word] += n
            if sum(map(len, held.values())) > 300_000:
                yield from flush()
        yield from flush()

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, gram, n``: n-grams of the highest order, from word counts."""

    @trimmed
    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                text = padded(word, order)
                for at in range(len(text) - order + 1):
                    counts[lang, text[at : at + order]] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "gram", "n"])

    return words.select("lang", "word", "n").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def hashed(codes: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of code points."""
    out = np.full(len(codes), codes.shape[1], np.uint64)
    for column in codes.T:
        out = (out ^ column.astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out


@dataclass
class KneserNey:
    """One language's model: per order a sorted array of gram hashes with
    probabilities, and of context hashes with back-off weights."""

    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    floor: float = 1e-7

    @classmethod
    def fit(cls, grams: list[str], counts: list[int], order: int = ORDER) -> KneserNey:
        model = cls()
        codes = np.array([[ord(c) for c in g] for g in grams], np.int64).reshape(len(grams), order)
        n = np.array(counts, float)
        levels = [(codes, n)]
        for _ in range(order - 1):
            # Continuation counts: how many different characters come before.
            shorter, times = np.unique(levels[-1][0][:, 1:], axis=0, return_counts=True)
            levels.append((shorter, times.astype(float)))
        letters = len(levels[-1][0]) + 1
        below: np.ndarray | None = None
        for codes, n in reversed(levels):
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2.0 * twos) if ones and twos else 0.5
            context = hashed(codes[:, :-1])
            keys, member, types = np.unique(context, return_inverse=True, return_counts=True)
            total = np.bincount(member, n)
            weight = discount * types / total
            lower = np.full(len(codes), 1.0 / letters) if below is None else model._look(model.grams[-1], hashed(codes[:, 1:]), 0.0)
            p = np.maximum(n - discount, 0) / total[member] + weight[member] * lower
            at = np.argsort(hashed(codes))
            model.grams.append((hashed(codes)[at], p[at]))
            model.contexts.append((keys, weight))
            below = p
        model.floor = 1.0 / letters
        return model

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default: float) -> np.ndarray:
        known, value = table
        if not len(known):
            return np.full(len(keys), default)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, value[at], default)

    def surprise(self, codes: np.ndarray) -> np.ndarray:
        """-log2 p of the last character of each row."""
        order = codes.shape[1]
        p = np.full(len(codes), self.floor)
        for k in range(order):
            own = codes[:, order - 1 - k :]
            weight = self._look(self.contexts[k], hashed(own[:, :-1]), 1.0)
            p = self._look_or(self.grams[k], hashed(own), weight * p)
        return -np.log2(p)

    @classmethod
    def _look_or(cls, table, keys, otherwise):
        found = cls._look(table, keys, -1.0)
        return np.where(found >= 0, found, otherwise)


class Identifier:
    """All languages' models, and what calibrates them."""

    def __init__(self, models: dict[str, KneserNey], order: int = ORDER):
        self.langs = sorted(models)
        self.models = [models[k] for k in self.langs]
        self.order = order
        self.tables: Tables | None = None
        self.sharpness = 1.0
        self.limits = np.full(len(self.langs), np.inf)
        self._reset()

    def _reset(self) -> None:
        width = len(self.langs) + 1
        self.known: dict[str, int] = {}
        self.values = np.zeros((1024, width))
        self.words: dict[str, int] = {}
        self.word_values = np.zeros((1024, width))
        self.seen, self.seen_values = np.empty(0, np.uint64), np.empty((0, width - 1))

    def __getstate__(self):
        fresh = Identifier.__new__(Identifier)
        fresh.langs = self.langs
        fresh._reset()
        return self.__dict__ | fresh.__dict__

    def _surprises(self, grams: np.ndarray) -> np.ndarray:
        """-log2 p of each gram's last character, a column per language; each
        different gram goes through the models once."""
        keys, first, member = np.unique(hashed(grams), return_index=True, return_inverse=True)
        new = ~np.isin(keys, self.seen, assume_unique=True)
        if new.any():
            found = np.stack([m.surprise(grams[first[new]]) for m in self.models], axis=1)
            merged = np.concatenate([self.seen, keys[new]])
            order = np.argsort(merged)
            self.seen, self.seen_values = merged[order], np.concatenate([self.seen_values, found])[order]
        return self.seen_values[np.searchsorted(self.seen, keys)][member]

    @staticmethod
    def _grown(table: np.ndarray, size: int) -> np.ndarray:
        while len(table) < size:
            table = np.concatenate([table, np.zeros_like(table)])
        return table

    def _learn_words(self, words: list[str]) -> None:
        base, texts = len(self.words), [padded(w, self.order) for w in words]
        self.words.update(zip(words, range(base, base + len(words))))
        self.word_values = self._grown(self.word_values, base + len(words))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        per = sizes - self.order + 1
        opens = np.cumsum(per) - per
        at = np.repeat(np.cumsum(sizes) - sizes - opens, per) + np.arange(per.sum())
        own = slice(base, base + len(words))
        self.word_values[own, :-1] = np.add.reduceat(self._surprises(codes[at[:, None] + np.arange(self.order)]), opens)
        self.word_values[own, -1] = per

    def _learn(self, chunks: list[str]) -> None:
        found = [words_of(c) for c in chunks]
        if len(self.words) > CACHE_CHUNKS:
            self.words, self.word_values = {}, np.zeros_like(self.word_values[:1024])
        new = list(set().union(*found).difference(self.words))
        if new:
            self._learn_words(new)
        base = len(self.known)
        self.known.update(zip(chunks, range(base, base + len(chunks))))
        self.values = self._grown(self.values, base + len(chunks))
        for k, words in enumerate(found):
            self.values[base + k] = self.word_values[self.words[words[0]]] if len(words) == 1 else sum((self.word_values[self.words[w]] for w in words), np.zeros(len(self.langs) + 1))

    def cross_entropies(self, texts: list[str]) -> list[np.ndarray | None]:
        """Bits per character under each language; None without a letter."""
        out = []
        for group in grouped(texts, GROUP_CHARS):
            cut = [t.split(" ") for t in group]
            chunks = set().union(*cut)
            new = chunks.difference(self.known)
            if new and len(self.known) + len(new) > CACHE_CHUNKS:
                self._reset()
                new = chunks
            if new:
                self._learn(list(new))
            for own in cut:
                total = self.values[np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))].sum(axis=0)
                out.append(total[:-1] / total[-1] if total[-1] else None)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool, float | None]]:
        """Language, score, whether calibration rejects it, cross-entropy."""
        if not self.langs:
            return [("und", 0.0, True, None)] * len(texts)
        out = []
        for h in self.cross_entropies([t or "" for t in texts]):
            if h is None:
                out.append(("und", 0.0, True, None))
                continue
            best = int(np.argmin(h))
            score = 1.0 / np.exp2(self.sharpness * (h[best] - h)).sum()
            out.append((self.langs[best], float(score), bool(h[best] > self.limits[best]), float(h[best])))
        return out

    def calibrate(self, measured: DataFrame) -> None:
        """Set the sharpness with the best log-likelihood, and each language's
        rejection limit, from ``measured(lang, h)``: cross-entropies of every text."""
        if not self.langs:
            return
        at = F.array_position(F.array(*map(F.lit, self.langs)), F.col("lang"))
        rows = measured.where(F.col("h").isNotNull() & F.col("lang").isin(self.langs)).select("lang", "h", F.element_at("h", at.cast("int")).alias("v"))

        def loss(sharpness: float):
            likely = F.transform("h", lambda x: F.pow(F.lit(2.0), F.least(F.lit(-sharpness) * (x - F.col("v")), F.lit(500.0))))
            return F.avg(F.log2(F.aggregate(likely, F.lit(0.0), lambda s, x: s + x)))

        tried = [2.0**k for k in range(-3, 7)]
        losses = rows.agg(*[loss(s).alias(f"l{k}") for k, s in enumerate(tried)]).first()
        if losses[0] is None:
            return
        self.sharpness = tried[min(range(len(tried)), key=lambda k: losses[k])]
        places = {r["lang"]: REJECT_QUANTILE * (r["count"] - 1) for r in rows.groupBy("lang").count().collect()}
        values = ranked(rows.select("lang", "v"), [(lang, int(f(p))) for lang, p in places.items() for f in (np.floor, np.ceil)])
        for lang, p in places.items():
            low, high = values[lang, int(np.floor(p))], values[lang, int(np.ceil(p))]
            self.limits[self.langs.index(lang)] = low + (high - low) * (p - np.floor(p))


def ranked(rows: DataFrame, wanted: list[tuple[str, int]]) -> dict[tuple[str, int], float]:
    """The values at the wanted (language, rank from 0) of ``rows(lang, v)`` in ascending
    order.  Values are counted in bins, then in finer ones inside those that hold a
    wanted rank, then one by one: the driver gets counts, no rows."""
    spark, left, held = rows.sparkSession, {t: t[1] for t in set(wanted)}, {t: 0 for t in set(wanted)}
    outer = F.lit(0)
    for width in (*BINS, None):
        inner = F.col("v") if width is None else F.floor(F.col("v") / width)
        bins = F.broadcast(spark.createDataFrame(sorted({(t[0], b) for t, b in held.items()}), "lang string, bin long"))
        counted = rows.withColumn("bin", outer.cast("long")).join(bins, ["lang", "bin"]).groupBy("lang", "bin", inner.alias("x")).count().collect()
        found: dict[tuple[str, int], list[tuple[float, int]]] = {}
        for r in counted:
            found.setdefault((r["lang"], r["bin"]), []).append((r["x"], r["count"]))
        for bin_ in found.values():
            bin_.sort()
        for t in left:
            for x, n in found[t[0], held[t]]:
                if left[t] < n:
                    break
                left[t] -= n
            held[t] = x
        outer = inner
    return held


# -- tables ------------------------------------------------------------------
@dataclass
class Tables:
    """Written tables ``lang, k, key, value`` of the probabilities of n-grams
    and of the back-off weights of contexts of each order ``k``, and ``lang,
    letters``, one more than each language's characters."""

    grams: DataFrame
    contexts: DataFrame
    letters: DataFrame
    order: int


def fit_tables(counted: DataFrame, order: int = ORDER) -> Tables:
    """All languages' models from ``counted(lang, gram, n)``, by joins."""
    levels = {order: counted}
    for k in reversed(range(1, order)):
        # Continuation counts: how many different characters come before.
        levels[k] = materialize(levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), "level")
    letters = materialize(levels[1].groupBy("lang").agg((F.count("*") + 1).alias("letters")), "letters")
    grams, contexts, below = [], [], None
    for k in range(1, order + 1):
        own = levels[k].withColumn("context", F.substring("gram", 1, k - 1) if k > 1 else F.lit(""))
        ones, twos = F.sum((F.col("n") == 1).cast("long")), F.sum((F.col("n") == 2).cast("long"))
        discount = own.groupBy("lang").agg(F.when((ones > 0) & (twos > 0), ones / (ones + 2 * twos)).otherwise(0.5).alias("d"))
        context = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("types")).join(discount, "lang")
        context = materialize(context.withColumn("weight", F.col("d") * F.col("types") / F.col("total")), "contexts")
        rows = own.join(context, ["lang", "context"])
        if below is None:
            rows = rows.join(letters, "lang").withColumn("lower", 1.0 / F.col("letters"))
        else:
            rows = rows.withColumn("rest", F.substring("gram", 2, k - 1)).join(below.select("lang", F.col("key").alias("rest"), F.col("value").alias("lower")), ["lang", "rest"])
        p = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("lower")
        below = materialize(rows.select("lang", F.lit(k).alias("k"), F.col("gram").alias("key"), p.alias("value")), "grams")
        grams.append(below)
        contexts.append(context.select("lang", F.lit(k).alias("k"), F.col("context").alias("key"), F.col("weight").alias("value")))
    return Tables(reduce(DataFrame.unionByName, grams), reduce(DataFrame.unionByName, contexts), letters, order)


def held_models(tables: Tables) -> dict[str, KneserNey] | None:
    """The tables as sorted hash arrays, or None beyond ``MODEL_ROWS``."""
    both = tables.grams.withColumn("context", F.lit(False)).unionByName(tables.contexts.withColumn("context", F.lit(True)))
    if both.count() > MODEL_ROWS:
        return None

    @trimmed
    def run(batches):
        for batch in batches:
            keys, orders = batch.column(2).to_pylist(), batch.column(1).to_numpy()
            lengths = np.fromiter(map(len, keys), np.int64, len(keys))
            out = np.zeros(len(keys), np.uint64)
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                codes = np.array([[ord(c) for c in keys[i]] for i in at], np.int64).reshape(len(at), size)
                out[at] = hashed(codes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(orders), pa.array(out.view(np.int64)), batch.column(3), batch.column(4)], names=["lang", "k", "h", "value", "context"])

    table = both.select("lang", "k", "key", "value", "context").mapInArrow(run, "lang string, k int, h long, value double, context boolean").toArrow().to_pandas()
    letters = {r["lang"]: r["letters"] for r in tables.letters.collect()}
    models = {}
    for lang, own in table.groupby("lang"):
        model = KneserNey(floor=1.0 / letters[lang])
        for k in range(1, tables.order + 1):
            for context, into in ((False, model.grams), (True, model.contexts)):
                part = own[(own["k"] == k) & (own["context"] == context)]
                h = part["h"].to_numpy(np.int64).view(np.uint64)
                at = np.argsort(h)
                into.append((h[at], part["value"].to_numpy(float)[at]))
        models[lang] = model
    return models


def joined_entropies(docs: DataFrame, tables: Tables) -> DataFrame:
    """The columns of ``docs`` but for ``text``, and ``h``, an array of the
    cross-entropies in alphabetical order of the languages (null without a
    letter), from joins of the texts' different words with the tables."""

    @trimmed
    def run(batches):
        for batch in batches:
            found = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                counts = Counter(w for chunk in (text or "").split(" ") for w in words_of(chunk))
                found.append([{"w": w, "n": n} for w, n in counts.items()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.struct([("w", pa.string()), ("n", pa.int64())])))], names=[*batch.schema.names[:-1], "words"])

    names = [c for c in docs.columns if c != "text"]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    made = docs.select(*names, "text").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names) + ", words array<struct<w:string,n:long>>")
    rows = materialize(made.withColumn("_row", F.monotonically_increasing_id()), "words")
    own = rows.select("_row", F.explode("words").alias("x")).select("_row", "x.w", "x.n")
    order = tables.order
    text = F.concat(F.lit(START * (order - 1)), F.col("w"), F.lit(END))
    grams = own.select("w").distinct().select("w", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("w") + 1), lambda i: F.substr(text, i, F.lit(order)))).alias("g"))
    grams = materialize(grams.groupBy("w", "g").agg(F.count("*").alias("times")), "word-grams")
    scored = grams.select("g").distinct().join(small_side(tables.letters, 64)).withColumn("p", 1.0 / F.col("letters"))
    for k in range(1, order + 1):
        last = F.substring("g", order - k + 1, k)
        weight = tables.contexts.where(F.col("k") == k).select("lang", F.col("key").alias("context"), F.col("value").alias("weight"))
        known = tables.grams.where(F.col("k") == k).select("lang", F.col("key").alias("last"), F.col("value").alias("found"))
        scored = scored.withColumn("context", F.substring(last, 1, k - 1) if k > 1 else F.lit("")).withColumn("last", last)
        scored = scored.join(weight, ["lang", "context"], "left").join(known, ["lang", "last"], "left")
        scored = scored.select("g", "lang", F.coalesce("found", F.coalesce("weight", F.lit(1.0)) * F.col("p")).alias("p"))
    scored = materialize(scored.select("g", "lang", (-F.log2("p")).alias("s")), "surprises")
    words = materialize(grams.join(scored, "g").groupBy("w", "lang").agg(F.sum(F.col("times") * F.col("s")).alias("s")), "word-scores")
    # A word that very many texts have is there in parts, and texts are dealt to them.
    often = materialize(own.groupBy("w").agg(F.ceil(F.count("*") / HOT_ROWS).cast("int").alias("parts")).where("parts > 1"), "frequent-words")
    often = small_side(often, 64)
    dealt = own.join(often, "w", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("_row"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    words = words.join(often, "w", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    total = dealt.join(words, ["w", "part"]).groupBy("_row", "lang").agg((F.sum(F.col("n") * F.col("s")) / F.sum(F.col("n") * (F.char_length("w") + 1))).alias("h"))
    h = total.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("lang", "h"))).alias("h")).select("_row", F.col("h.h").alias("h"))
    return rows.join(h, "_row", "left").select(*names, "h")


def learn(docs: DataFrame, order: int = ORDER) -> Identifier:
    """Models of ``docs(doc_id, lang, text)`` whose language is known, not calibrated."""
    docs = docs.select(F.col("doc_id").cast("long"), "lang", "text").where("lang is not null and doc_id is not null")
    tables = fit_tables(materialize(gram_counts(word_counts(docs), order), "grams"), order)
    models = held_models(tables)
    found = Identifier(models if models is not None else {r["lang"]: None for r in tables.letters.collect()}, order)
    found.tables = tables if models is None else None
    return found


def train(docs: DataFrame, order: int = ORDER) -> Identifier:
    """Fit and calibrate on ``docs(doc_id, lang, text)`` whose language is known."""
    found = learn(docs, order)
    found.calibrate(entropies(docs.where("lang is not null and doc_id is not null").select("lang", "text"), found))
    return found


def entropies(docs: DataFrame, model: Identifier) -> DataFrame:
    """The columns of ``docs`` but for ``text``, and ``h``, the cross-entropies under each
    language, null without a letter; computed once."""
    names = [c for c in docs.columns if c != "text"]
    if not model.langs:
        return docs.select(*names, F.lit(None).cast("array<double>").alias("h"))
    if model.tables is not None:
        return materialize(joined_entropies(docs, model.tables), "entropies")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @trimmed
    def run(batches):
        for batch in batches:
            rows = shared.value.cross_entropies([x or "" for x in batch.column(batch.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([None if h is None else h.tolist() for h in rows], pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "h"])

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    return materialize(docs.select(*names, "text").mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in names) + ", h array<double>"), "entropies")


def identify(docs: DataFrame, model: Identifier) -> DataFrame:
    """``doc_id, lang_pred, score, rejected, bits_per_char`` for each row."""
    if model.tables is not None:
        return _judged(joined_entropies(docs.select(F.col("doc_id").cast("long"), "text"), model.tables), model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @trimmed
    def run(batches):
        own = shared.value
        for batch in batches:
            rows = own.predict(batch.column(1).to_pylist())
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "lang_pred", "score", "rejected", "bits_per_char"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean, bits_per_char double")


def _judged(rows: DataFrame, model: Identifier, *more: str) -> DataFrame:
    """What ``Identifier.predict`` says, from ``doc_id, h``; ``more`` columns stay."""
    if not model.langs:
        return rows.select("doc_id", *more, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(None).cast("double").alias("bits_per_char"))
    none = F.col("h").isNull()
    least = F.array_min("h")
    at = F.array_position("h", least)
    limit = F.element_at(F.array(*[F.lit(float(x)) for x in model.limits]), at.cast("int"))
    score = 1.0 / F.aggregate(F.transform("h", lambda v: F.pow(F.lit(2.0), F.lit(model.sharpness) * (least - v))), F.lit(0.0), lambda t, v: t + v)
    lang = F.element_at(F.array(*map(F.lit, model.langs)), at.cast("int"))
    return rows.select("doc_id", *more, F.when(none, "und").otherwise(lang).alias("lang_pred"), F.when(none, 0.0).otherwise(score).alias("score"), F.coalesce(least > limit, F.lit(True)).alias("rejected"), least.alias("bits_per_char"))


def op6_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bucket = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = learn(docs.where(bucket != 2))
    # Every text is measured once; those that train also calibrate.
    rows = entropies(docs.select(F.col("doc_id").cast("long"), "lang", F.coalesce(bucket == 2, F.lit(False)).alias("held_out"), "text"), model)
    model.calibrate(rows.where("lang is not null and doc_id is not null and not held_out").select("lang", "h"))
    return _judged(rows, model, "held_out").select("doc_id", "held_out", "lang_pred", "score", "rejected", "bits_per_char")
