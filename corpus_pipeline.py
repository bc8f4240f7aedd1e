"""Corpus pipeline: five stages, each written as Parquet and read again.

Every stage takes all rows its predecessor kept, and its decisions take effect
in what it returns.  All but the last return the columns of ``documents``; the
last returns pieces with their token ids, sequence and offset.

Null and blank texts are judged like other documents; those that are kept are
near copies of each other, so that one stays, and it is packed as its end mark.
Rows with null doc_id are kept by the near-copy stage; null source or lang is a
site of its own.  Repeated rows of one doc_id leave one.  Of equal texts the
smallest doc_id stays.  Very long texts are treated whole and cut into pieces of
4096 ids.  An empty table gives an empty result; without labels of both kinds the
quality stage goes by the labelled rate alone (none: everything stays).

A stage deletes the intermediate tables of the one before it: a result must be
written before the next stage is called for the same folder.  The last stage's
tables stay, so results of several runs can be read in any order.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.llm import packing, quality_eb, simhash, suffix_dedup, surrogates
from stridelake.llm.common import discard, fresh_path, scratch_paths

#: No stage's decisions can be written in SQL (fitted classifier, keyed digests,
#: byte-exact cuts, tokenizer): the tests hold the rows against brute force.
ORACLE_SQL = None


def _resized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a changed text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


#: Intermediate tables that each stage but the last left, by stage and folder.
_left: dict[tuple[int, str], list[str]] = {}


def _stage(number: int):
    """A stage that deletes its predecessor's intermediate tables for the same
    folder: that result is written by then.  Those of the last stage stay, as its
    result reads them for as long as somebody holds it."""

    def wrap(work):
        @wraps(work)
        def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            for path in _left.pop((number - 1, sf_dir), ()):
                discard(spark, path)
            before = scratch_paths()
            out = work(spark, docs, sf_dir)
            if number < LAST:
                _left[number, sf_dir] = [path for path in scratch_paths() if path not in before]
            return out

        return stage

    return wrap


LAST = 5


@_stage(1)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality_eb.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage(2)
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    return simhash.keep_first(docs)


@_stage(3)
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeated passages cover."""
    return _resized(suffix_dedup.dedup(docs))


@_stage(4)
def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates in place of personal data."""
    return _resized(surrogates.replace(docs))


@_stage(5)
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces, with their ids and places in the training sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("pii surrogates", private_data),
    ("best-fit packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path, before = fresh_path(spark, "stage"), last
            docs.write.parquet(path)
            docs, last = spark.read.schema(docs.schema).parquet(path), path
            if before:
                discard(spark, before)
    return docs
