"""Helpers the training-data operators share: the shared folder, written
intermediate tables, and connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only where the setting is absent, as in tests on one machine, a fresh
    temporary folder takes its place and is kept for the session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = "file://" + tempfile.mkdtemp(prefix="stridelake-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    A lost executor costs nothing that was written, and later steps see true
    sizes.
    """
    return written(df, fresh_path(df.sparkSession, label))


def written(df: DataFrame, path: str) -> DataFrame:
    # Short row groups: a task holds one in memory while it writes.
    df.write.option("parquet.block.size", 16 << 20).parquet(path)
    _scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Intermediate tables this driver has written and not deleted.
_scratch: list[str] = []


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    if path in _scratch:
        _scratch.remove(path)


def scratch_paths() -> list[str]:
    """Intermediate tables written and not deleted: a caller who has written
    their operators' results may ``discard`` them."""
    return list(_scratch)


@contextmanager
def scratch(spark: SparkSession):
    """Intermediate tables written inside are deleted at the end, but for the
    path that the result is written to: ``with scratch(spark) as result``."""
    result = fresh_path(spark, "result")
    before = list(_scratch)
    try:
        yield result
    finally:
        for path in [x for x in _scratch if x not in before and x != result]:
            discard(spark, path)


#: Bytes of a table up to which it may be broadcast.
BROADCAST_BYTES = 64 << 20


def small_side(written_table: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, marked for broadcast if its counted rows, at
    ``row_bytes`` each, stay below ``BROADCAST_BYTES``; as it is beyond, where
    the join shuffles."""
    return bounded(written_table, written_table.count(), row_bytes)


def bounded(table: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``table``, known to have ``rows`` rows at most, marked for broadcast if
    these stay below ``BROADCAST_BYTES``."""
    return F.broadcast(table) if rows * row_bytes <= BROADCAST_BYTES else table


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    there, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in there:
            name += "_"
        there.add(name.lower())
        out.append(name)
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Short Arrow batches for what runs inside, then the setting as it was:
    whole texts are long, and a batch is held several times over between Spark
    and its Python workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


def trimmed(run):
    """A task's function over batches that leaves its worker process small: it
    serves other operators next."""

    @wraps(run)
    def lean(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return lean


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges(src long, dst long)`` with its component's
    smallest node: columns ``node, component``.

    Contraction (Boegeholz, Brand and Todor, 2020): each node is merged into the
    least node of its closed neighbourhood, and only edges between different
    merged nodes go into the next round.  Rounds alternate between the order of
    the ids, in which the stars that blocks give collapse at once, and a fresh
    hashed order, which takes away a fixed share of the nodes of any graph on
    average.  So all rounds together handle a small multiple of the edges, and
    their number grows with the logarithm of the nodes.  Names are then followed
    back from the last round to the first.

    A neighbourhood is only ever a partially aggregated minimum; a hub's edges
    meet its name in a join whose other side has one row a node.  Links never
    reach the driver.  Self-loops and repeated edges are ignored.  Empty in,
    empty out.
    """
    spark = edges.sparkSession

    def once(e: DataFrame, path: str) -> DataFrame:
        e = e.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        return written(e.distinct(), path)

    def least(e: DataFrame, k: int) -> DataFrame:
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        if k % 2 == 0:
            return both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("name"))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("node"))
        best = both.groupBy("src").agg(F.min(rank("dst")).alias("m"))
        return best.select(F.col("src").alias("node"), F.least(rank("src"), "m")["node"].alias("name"))

    paths = [fresh_path(spark, "cc")]
    current = once(edges.select("src", "dst"), paths[0])
    rounds: list[tuple[DataFrame, int]] = []
    while not current.isEmpty():
        paths += [fresh_path(spark, "cc-names"), fresh_path(spark, "cc")]
        names = written(least(current, len(rounds)), paths[-2])
        rounds.append((names, names.count()))
        of = bounded(names, rounds[-1][1], 24)
        merged = current.join(of.toDF("src", "a"), "src").join(of.toDF("dst", "b"), "dst")
        current = once(merged.select(F.col("a").alias("src"), F.col("b").alias("dst")), paths[-1])
    if not rounds:
        return current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    last, n = rounds.pop()
    for names, more in reversed(rounds):
        later = bounded(last.toDF("name", "final"), n, 24)
        last, n = names.join(later, "name", "left").select("node", F.coalesce("final", "name").alias("name")), more
    last = materialize(last, "components")
    for path in paths:
        discard(spark, path)
    # A component has two nodes at least.
    smallest = bounded(last.groupBy("name").agg(F.min("node").alias("component")), n // 2, 24)
    return last.join(smallest, "name").select("node", "component")


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable label after joining rows ``a`` and ``b``."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        high, low = np.maximum(la, lb)[differ], np.minimum(la, lb)[differ]
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def grouped(texts: Iterable[str], limit: int) -> Iterator[list[str]]:
    """Consecutive texts in groups of about ``limit`` characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held
