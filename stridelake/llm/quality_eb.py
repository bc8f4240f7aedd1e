"""Quality classifier with hierarchical empirical Bayes.

A logistic classifier on the shape of a document gives its evidence.  Grouped
aggregates of that evidence give each host and each path within it a posterior
quality rate: the global rate shrinks hosts, a host's rate shrinks its paths,
with strengths estimated from the spread between groups (method of moments), so
sparse sites stay near the prior.  The table at hand has no addresses: its host
is ``source`` and its path ``lang``; both are parameters.  A document's score joins its own evidence
with the posterior of its path, from which its own share is left out.

Edge cases: null text counts as empty; null host or path is a group of its own;
without labels of both kinds the classifier falls back to the labelled rate;
repeated rows count as often as they occur; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stridelake.llm.common import materialize, small_batches, small_side, trim, unused

#: Labelled documents the classifier is fitted on at most, in order of a hash.
MAX_LABELLED = 20_000
KEEP_AT = 0.5
CACHE_CHUNKS = 120_000
FEATURES = ("words", "symbol_words", "upper_words", "exclaimed", "word_length", "digits", "distinct_words", "echoes", "distinct_triples")
_SYMBOL = regex.compile(r"[#*$%&|<>{}\[\]^~=\\]")


class Featurizer:
    """Shape features of whole texts; what depends on a word is remembered."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.facts = np.zeros((4096, 5))

    def forget(self) -> None:
        """Back to a small memory between batches of a shared worker."""
        if len(self.known) > CACHE_CHUNKS // 2:
            self.known.clear()
            self.facts = np.zeros((4096, 5))

    def _learn(self, words: list[str]) -> None:
        base = len(self.known)
        while base + len(words) > len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        self.facts[base : base + len(words)] = [(bool(_SYMBOL.search(w)), len(w) > 1 and w.isupper(), "!" in w, len(w), sum(map(str.isdigit, w))) for w in words]
        self.known.update(zip(words, range(base, base + len(words))))

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        n = len(words)
        if not n:
            return np.zeros(len(FEATURES))
        new = list(set(words).difference(self.known))
        if new and len(self.known) + len(new) > CACHE_CHUNKS:
            self.known.clear()
            new = list(set(words))
        if new:
            self._learn(new)
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, n)
        symbols, upper, loud, chars, digits = self.facts[ids].sum(axis=0)
        triples = (ids[:-2] << 42) ^ (ids[1:-1] << 21) ^ ids[2:] if n > 2 else ids[:1]
        return np.array([np.log(n), symbols / n, upper / n, loud / n, chars / n, digits / chars, len(np.unique(ids)) / n, (ids[1:] == ids[:-1]).mean() if n > 1 else 0.0, len(np.unique(triples)) / len(triples)])


@lru_cache(maxsize=1)
def featurizer() -> Featurizer:
    return Featurizer()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features(text: pd.Series) -> pd.Series:
    own = featurizer()
    return text.map(lambda t: own(t if isinstance(t, str) else None))


@dataclass
class Logistic:
    """Standardised logistic regression with a ridge penalty."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base_logit: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> Logistic:
        base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        width = x.shape[1] if x.ndim == 2 else len(FEATURES)
        if not len(y) or y.min() == y.max():
            return cls(np.zeros(width), np.ones(width), np.append(np.zeros(width), base), base)
        centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
        penalty = np.diag(np.append(np.full(width, ridge), 1e-6))
        w = np.append(np.zeros(width), base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            move = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
            w = w + np.clip(move, -2, 2)
            if np.abs(move).max() < 1e-6:
                break
        return cls(centre, scale, w, base)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale @ self.weights[:-1] + self.weights[-1], -12, 12)


def fit_classifier(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Logistic:
    """Fit on at most ``MAX_LABELLED`` labels, one document each."""
    chosen = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null").distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(MAX_LABELLED)
    # Where rows share a doc_id, one of them stands for the label.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", features("text").alias("x")).groupBy("doc_id", "y").agg(F.min("x").alias("x")).orderBy("doc_id", "y").collect()
    return Logistic.fit(np.array([r["x"] for r in rows], float), np.array([r["y"] for r in rows], float))


def evidence(model: Logistic):
    """Column function: a document's logit under the classifier."""

    @F.pandas_udf(T.DoubleType())
    def logit(text: pd.Series) -> pd.Series:
        own = featurizer()
        x = np.array([own(t if isinstance(t, str) else None) for t in text]).reshape(len(text), len(FEATURES))
        own.forget()
        trim()
        return pd.Series(model.logit(x))

    return logit


def _sigmoid(z):
    return 1 / (1 + F.exp(-z))


def _strength(groups: DataFrame) -> tuple[float, float]:
    """Mean of ``groups(n, s, q)`` (rows, sum and squares of rates) and the
    strength of the Beta prior its spread between groups implies."""
    mean = F.sum("s") / F.sum("n")
    row = groups.agg(mean.alias("m"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum(F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))).alias("w")).first()
    if not row["n"]:
        return 0.5, 1.0
    m = min(max(row["m"], 1e-4), 1 - 1e-4)
    between = max(row["b"] / row["n"] - row["m"] ** 2 - row["w"] / row["n"], 1e-6)
    return m, min(max(m * (1 - m) / between - 1, 1.0), 1e5)


def scored(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", label: str = "quality", with_text: bool = True) -> tuple[DataFrame, str]:
    """``docs`` (without ``text`` if so asked) with one more struct column, and
    its name: ``p_document, host_posterior, path_posterior, score, kept``.
    Each text is read once for the classifier; rows and evidence are written."""
    model = fit_classifier(docs, labels, label)
    key = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00"))
    logit, h, q, site_, eb = unused(docs, "_logit", "_host", "_path", "_site", "_eb")
    rows = docs.withColumns({logit: evidence(model)("text"), h: key(host), q: key(path)})
    names = [F.col(f"`{c}`") for c in docs.columns if with_text or c != "text"]
    with small_batches(docs.sparkSession):
        marked = materialize(rows.select(*names, logit, h, q), "evidence")
    p = _sigmoid(F.col(logit))
    paths = materialize(marked.select(F.col(h).alias("host"), F.col(q).alias("path"), p.alias("p")).groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "sites")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in "nsq"])
    overall, host_strength = _strength(hosts)
    _, path_strength = _strength(paths)
    sites = paths.join(hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs")), "host")
    site = materialize(sites.select(F.col("host").alias(h), F.col("path").alias(q), F.struct("n", "s", "hn", "hs").alias(site_)), "sites")
    joined = marked.join(small_side(site, 256), [h, q])
    of = lambda c: F.col(f"{site_}.{c}")
    at_host = (host_strength * overall + of("hs") - p) / (host_strength + of("hn") - 1)
    at_path = (path_strength * at_host + of("s") - p) / (path_strength + of("n") - 1)
    inside = F.least(F.greatest(at_path, F.lit(1e-4)), F.lit(1 - 1e-4))
    score = _sigmoid(F.log(inside / (1 - inside)) + F.col(logit) - F.lit(model.base_logit))
    return joined.select(*names, F.struct(p.alias("p_document"), at_host.alias("host_posterior"), at_path.alias("path_posterior"), score.alias("score"), (score >= KEEP_AT - 1e-9).alias("kept")).alias(eb)), eb


def classify(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """``doc_id, p_document, host_posterior, path_posterior, score, kept``."""
    rows, eb = scored(docs.select("doc_id", "text", *{names.get("host", "source"), names.get("path", "lang")}), labels, with_text=False, **names)
    return rows.select("doc_id", f"{eb}.*")


def keep_good(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """The rows of ``docs`` the classifier keeps, with their columns."""
    rows, eb = scored(docs, labels, **names)
    return rows.where(F.col(f"{eb}.kept")).drop(eb)


def op9_quality_eb(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
