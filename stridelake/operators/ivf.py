"""Approximate nearest rows from a written inverted-file index.

The index is a published table of blocks, in files by cell: k-means centroids are
fitted in Spark on a bounded sample, and every row of the index is in the cell of its
nearest centroid; a cell with many rows has several blocks.  A query probes the cells
of its nearest centroids and meets their blocks alone: the probed cells are a partition
filter of the scan, and queries, not the index, are what moves.  Blocks of probed cells
that cannot hold a nearer row (by their pivot and radius) are not scored.

What grows: the index once when it is written; a search reads the probed cells and
shuffles a query's vector once for each of its probes.  The number of cells is bounded
by what centroids may take, so their list is small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.operators.neighbours import QUERY_ROWS, _found, _queries, blocks, flat_rows, gaps, matrix, unit, visit
from stridelake.sources.published import latest, publish, versions

#: Cells of an index of ``n`` rows: the root of n, times this.
CELLS_BY_ROOT = 1.0
#: The fewest cells that a query probes; besides, all whose centroid is at most
#: ``WIDEN`` times as far from it as the nearest.  On clustered rows these are few;
#: where all centroids are about equally far, no cell can be left out.
LEAST_PROBES, WIDEN = 4, 1.25


def write_index(index: DataFrame, path: str, kind: str = "cosine", cells: int | None = None) -> int:
    """Write (or replace, as a whole) the index of ``index(id, weighted, norm)`` at
    ``path``; rows of no length are left out.  Returns the version."""
    rows = index.where("norm > 0").count()
    made, centroids = blocks(index, kind, cells or max(1, round(CELLS_BY_ROOT * rows**0.5)))
    spark = index.sparkSession
    number = max(versions(spark, f"{path}/centroids"), default=0) + 1
    head = spark.createDataFrame([(kind, i, c.tolist()) for i, c in enumerate(centroids)], "kind string, cell int, centre array<double>")
    # Files by cell; the centroids are published last and name the version.
    made.repartition("cell").write.partitionBy("cell").parquet(f"{path}/blocks/{number:012d}")
    return publish(head, f"{path}/centroids", number, keep=2)


def probe(queries: DataFrame, path: str, k: int = 1, query_id: str = "clip_id", widen: float = WIDEN, leave_out_self: bool = False) -> DataFrame:
    """``query_id, rank, id, distance, compared`` by the index at ``path``: the nearest
    rows among the probed cells of each of ``queries(query_id, weighted, norm)``.  Probes
    are widened for a query as long as its cells have fewer rows than it asks for.
    ``leave_out_self`` drops the row whose id is the query's own."""
    spark = queries.sparkSession
    number = max(versions(spark, f"{path}/centroids"))
    head = latest(spark, f"{path}/centroids", number).orderBy("cell").collect()
    kind = head[0]["kind"]
    stored = spark.read.parquet(f"{path}/blocks/{number:012d}")
    sizes = {r["cell"]: r["n"] for r in stored.groupBy("cell").agg(F.sum(F.size("ids")).alias("n")).collect()}
    wanted = k + int(leave_out_self)
    centres = spark.sparkContext.broadcast((np.array([r["centre"] for r in head], float), np.array([sizes.get(r["cell"], 0) for r in head])))

    def pick(batches):
        at, rows = centres.value
        for batch in batches:
            vectors = matrix(batch.column("v"))
            if not len(vectors):
                continue
            away = gaps(unit(vectors) if kind == "cosine" else vectors, at)
            order = np.argsort(away, 1, kind="stable")
            near = (away <= widen * away.min(1, keepdims=True)).sum(1)
            held = np.cumsum(rows[order], 1)
            cells = [o[: max(LEAST_PROBES, n, int(np.searchsorted(h, wanted)) + 1)].tolist() for o, n, h in zip(order, near, held)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    asked = _queries(queries, query_id)
    q_type, id_type = dict(asked.dtypes)["q"], stored.schema["ids"].dataType.elementType.simpleString()
    schema = f"q {q_type}, best array<struct<distance:double,id:{id_type}>>, compared long"
    pairs = asked.mapInArrow(pick, f"q {q_type}, v array<double>, cells array<int>").select("q", "v", F.explode("cells").alias("cell"))
    # Queries of a cell in groups of bounded rows; a popular cell has several.
    counts = pairs.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("parts"))
    dealt = pairs.join(F.broadcast(counts), "cell").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")))
    groups = dealt.groupBy("cell", "part").agg(F.collect_list("q").alias("q"), F.collect_list("v").alias("v"))
    of_id = pa.string() if id_type == "string" else pa.int64()

    def score(batches):
        for batch in batches:
            # Row by row from Arrow's buffers: a batch of blocks as Python lists takes many times its bytes.
            for q, v, ids, vectors in zip(*(batch.column(c) for c in ("q", "v", "ids", "vectors"))):
                best = [[] for _ in range(len(q))]
                visit(kind, wanted, matrix(v.values), best, flat_rows(vectors, len(ids)), ids.as_py())
                yield _found(q.values, best, [len(ids)] * len(best), of_id)

    met = stored.join(groups, "cell").select("ids", "vectors", "q", "v").mapInArrow(score, schema)
    each = met.select("q", "compared", F.explode_outer("best").alias("b"))
    if leave_out_self:
        each = each.withColumn("b", F.when(F.col("b.id").cast("string") != F.col("q").cast("string"), F.col("b")))
    best = F.slice(F.array_sort(F.collect_list("b")), 1, k)
    merged = met.groupBy("q").agg(F.sum("compared").alias("compared")).join(each.groupBy("q").agg(best.alias("best")), "q")
    rows = merged.select(F.col("q").alias(query_id), "compared", F.posexplode("best").alias("at", "b"))
    return rows.select(query_id, (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias("id"), F.col("b.distance").alias("distance"), "compared")
