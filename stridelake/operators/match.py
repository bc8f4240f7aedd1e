"""Nearest reference athletes, tiers, gaps and confidence."""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridelake.functions import round_off, zero_is_missing
from stridelake.operators.neighbours import met, search
from stridelake.operators.reference import player_key
from stridelake.sources import settled

NO_MATCH, NO_DISTANCE, NO_CONFIDENCE = "—", 999.0, 88.5
# Upper bounds of the tiers and their labels.
TIERS = [(40, "$1.2M - Elite Tier"), (100, "$450k - D1 Prospect"), (200, "$180k - High School Elite"), (350, "$45k - Developmental")]
LOWEST_TIER = "$8k - Amateur"
# By metric of the match, its name, vector place, default, digits.
STATS = [("release_velocity", 0, 7.0, 2), ("shot_arc", 1, 45.0, 1), ("knee_angle", 2, 150.0, 1), ("elbow_angle", 3, 165.0, 1), ("kinetic_sync_ms", 4, 300.0, 1), ("fluidity_score", 5, 75.0, 0), ("hip_rotation_deg", 6, 5.0, 2), ("balance_index", 7, 75.0, 0)]
# Gap, stat, metric of the clip, what stands for a missing one, digits.
GAPS = [("arc_gap", "shot_arc", "shot_arc_deg", 45.0, 1), ("vel_gap", "release_velocity", "release_velocity_mps", 7.0, 2), ("knee_gap", "knee_angle", "knee_angle", 150.0, 1), ("elbow_gap", "elbow_angle", "elbow_angle", 165.0, 1), ("fluid_gap", "fluidity_score", "fluidity_score", 80.0, 1), ("hip_gap", "hip_rotation_deg", "hip_rotation_deg", 5.0, 1), ("ksync_gap", "kinetic_sync_ms", "kinetic_sync_ms", 15.0, 1), ("bal_gap", "balance_index", "balance_index", 80.0, 1)]


def nearest(queries: DataFrame, index: DataFrame, kind: str = "cosine", k: int = 1, query_id: str = "clip_id") -> DataFrame:
    """``query_id, rank, id, distance``: the ``k`` nearest rows of ``index(id,
    weighted, norm)`` for each of ``queries(query_id, weighted, norm)``; equal
    distances go by id.  Exact for an index of any size; query ids are distinct."""
    return search(queries, index, kind, k, query_id).drop("compared")


def nearest_by_each(queries: DataFrame, index: DataFrame, query_id: str = "clip_id") -> DataFrame:
    """``query_id, id, cosine, l2``: the nearest row by cosine with its
    distance, and the least L2 distance."""
    by = lambda kind: nearest(queries, index, kind, 1, query_id)
    far = by("l2").select(query_id, F.col("distance").alias("l2"))
    return by("cosine").select(query_id, "id", F.col("distance").alias("cosine")).join(far, query_id)


def without_self(found: DataFrame, k: int, query_id: str) -> DataFrame:
    """The first ``k`` of ``k + 1`` nearest rows that are not the query itself."""
    order = Window.partitionBy(query_id).orderBy("rank")
    return found.where(F.col(query_id) != F.col("id")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_lsh(queries: DataFrame, index: DataFrame, query_id: str = "clip_id", threshold: float = 1.2, tables: int = 8, width: float = 0.9, leave_out_self: bool = False) -> DataFrame:
    """Nearest by cosine for large reference sets: unit vectors meet in buckets
    of random projections.  A query that meets nothing within ``threshold`` (L2
    of unit vectors) is answered by the exact search.  ``leave_out_self`` drops
    the row whose id is the query's own."""
    as_unit = lambda df, key: df.where("norm > 0").select(F.col(key).alias("key"), array_to_vector(F.transform("weighted", lambda v: v / F.col("norm"))).alias("unit"))
    left, right = as_unit(queries, query_id), as_unit(index, "id")
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hash", bucketLength=width, numHashTables=tables, seed=7).fit(right)

    def bucketed(rows: DataFrame, key: str, vector: str) -> DataFrame:
        hashes = F.array(*[vector_to_array(F.col("hash")[t])[0] for t in range(tables)])
        return model.transform(rows).select(F.col("key").alias(key), vector_to_array("unit").alias(vector), F.posexplode(hashes).alias("table", "bucket"))

    # A bucket's rows and queries meet as blocks; no pair is shuffled.
    near = met(bucketed(left, "q", "v"), bucketed(right, "id", "vector"), "l2", 2 if leave_out_self else 1, ["table", "bucket"])
    pairs = near.select(F.col("q").alias(query_id), F.explode("best").alias("b")).select(query_id, "b.id", F.col("b.distance").alias("l2")).where(F.col("l2") < threshold)
    if leave_out_self:
        pairs = pairs.where(F.col(query_id) != F.col("id"))
    best = pairs.groupBy(query_id).agg(F.min(F.struct("l2", "id")).alias("b")).select(query_id, F.col("b.id").alias("id"), (F.col("b.l2") * F.col("b.l2") / 2).alias("distance"))
    best = settled(best)
    rest = queries.where("norm > 0").join(best.select(query_id), query_id, "left_anti")
    exact = nearest(rest, index, "cosine", 2 if leave_out_self else 1, query_id)
    if leave_out_self:
        exact = exact.where(F.col(query_id) != F.col("id"))
    exact = exact.groupBy(query_id).agg(F.min(F.struct("distance", "id")).alias("b")).select(query_id, F.col("b.id").alias("id"), F.col("b.distance").alias("distance"))
    return best.unionByName(exact)


def tier(distance_: Column) -> Column:
    out = F
    for bound, label in TIERS:
        out = out.when(distance_ < bound, label)
    return out.otherwise(LOWEST_TIER)


def base_confidence(distance_: Column) -> Column:
    return round_off(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - distance_ * 150)), 1)


def penalised(confidence: Column, people: Column, n_warnings: Column) -> Column:
    """First for several people, rounded; then for each warning, rounded."""
    first = F.when(people > 1, round_off(confidence * 0.85, 1)).otherwise(confidence)
    return F.when(n_warnings > 0, round_off(first * F.greatest(F.lit(0.7), 1.0 - n_warnings * 0.03), 1)).otherwise(first)


def match_reference(clips: DataFrame, index: DataFrame) -> DataFrame:
    """Each clip with its nearest athlete by cosine (as built) and by L2 (as the
    tiers mean it), its tiers, and its confidence.  ``clips`` has the metrics,
    vectors, ``people`` and ``warnings``."""
    facts = index.select("id", F.col("name").alias("match_name"), player_key(index.columns).alias("player_id"), F.col("raw").alias("match_raw"))
    rows = clips.join(nearest_by_each(clips, index), "clip_id", "left").join(facts, "id", "left")
    base = F.coalesce(base_confidence(F.col("cosine")), F.lit(NO_CONFIDENCE))
    return rows.select(
        *[F.col(f"`{c}`") for c in clips.columns],
        F.col("id").alias("match_id"),
        F.coalesce("match_name", F.lit(NO_MATCH)).alias("match_name"),
        F.when(F.col("player_id") != 0, F.col("player_id")).alias("player_id"),
        "match_raw",
        F.coalesce("cosine", F.lit(NO_DISTANCE)).alias("match_cosine"),
        F.coalesce("l2", F.lit(NO_DISTANCE)).alias("match_l2"),
    ).select(
        "*",
        tier(F.col("match_cosine")).alias("tier_cosine"),
        tier(F.col("match_l2")).alias("tier_l2"),
        F.when(F.col("match_id").isNull(), NO_CONFIDENCE).otherwise(base_confidence(F.col("match_cosine"))).alias("base_confidence"),
    ).withColumn("confidence", penalised(F.col("base_confidence"), F.col("people"), F.size("warnings")))


def match_stats(matched: DataFrame) -> DataFrame:
    """``pro``: the match's eight statistics under short names, null without a
    match."""
    fields = []
    for name, at, default, digits in STATS:
        value = F.bround(F.coalesce(F.get("match_raw", F.lit(at)), F.lit(default)), digits)
        fields.append((value.cast("int") if digits == 0 else value).alias(name))
    return matched.withColumn("pro", F.when(F.col("match_id").isNotNull(), F.struct(*fields)))


def image_url(player_id: Column, pattern: str, placeholder: str) -> Column:
    return F.coalesce(F.format_string(pattern, player_id), F.lit(placeholder))


def gaps(with_pro: DataFrame) -> DataFrame:
    """One column per gap, match minus clip; a clip's zero counts as missing."""
    # First to six places: a tie of decimals is a tie whatever its last bits are.
    made = [round_off(round_off(F.col(f"pro.{stat}") - zero_is_missing(F.col(metric).cast("double"), default), 6), digits).alias(name) for name, stat, metric, default, digits in GAPS]
    return with_pro.select("*", *made)


def top_k(pairs: DataFrame, by: str, k: int, query_id: str) -> DataFrame:
    order = Window.partitionBy(query_id).orderBy(by, "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
