"""Season statistics to comparable eight-number vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.functions import clip, round_off
from stridelake.sources import METRICS, WEIGHTS, positions

MIN_GAMES = 5
#: What a missing statistic counts as, and the least it may be.
DEFAULTS = {"REB": 5.0, "AST": 2.0, "TOV": 1.0, "FG3_PCT": 0.35, "GP": 10.0}
FLOORS = {"TOV": 0.1, "GP": 1.0}
#: A metric that is absent from a clip, in vector order.
QUERY_DEFAULTS = (7.0, 45.0, 145.0, 165.0, 150.0, 65.0, 5.0, 85.0)


def number(name: str) -> Column:
    """A statistic as a number: blank, null or unreadable gives its default."""
    value = F.coalesce(F.col(name).cast("string").try_cast("double"), F.lit(DEFAULTS[name]))
    return F.greatest(value, F.lit(FLOORS[name])) if name in FLOORS else value


def cleaned(box: DataFrame, min_games: float = MIN_GAMES) -> DataFrame:
    """Rows with enough games and a name."""
    name = F.trim("PLAYER_NAME")
    return box.where(F.col("GP").cast("string").try_cast("double") >= min_games).withColumn("PLAYER_NAME", name).where(F.col("PLAYER_NAME").isNotNull() & ~F.col("PLAYER_NAME").isin("", "nan"))


def completed(box: DataFrame, *order: str) -> DataFrame:
    """A season table that lacks names, player ids or team ids gets them from the
    rows' places in ``order``: ``Player_<place>``, and the place as id."""
    wanted = {"PLAYER_NAME": F.concat(F.lit("Player_"), F.col("idx").cast("string")), "PLAYER_ID": F.col("idx"), "TEAM_ID": F.col("idx")}
    missing = {c: v for c, v in wanted.items() if c not in box.columns}
    return positions(box, *order).withColumns(missing).drop("idx") if missing else box


def fallback_index(seeds: DataFrame, *order: str) -> DataFrame:
    """The reference index of stand-in rows, under ids of their own:
    ``fallback_<player id>_<place>``."""
    return reference_index(positions(seeds, *order), F.concat_ws("_", F.lit("fallback"), "PLAYER_ID", "idx"))


def player_key(columns: list[str]) -> Column:
    """The player of an index row: its ``meta_id``, if it has one that is not zero,
    or else its ``player_id``."""
    return F.coalesce(F.nullif(F.col("meta_id"), F.lit(0)), F.col("player_id")) if "meta_id" in columns else F.col("player_id")


def vectors(box: DataFrame) -> DataFrame:
    """``box`` with ``raw``, the vector in metric order."""
    rows = box.select("*", *[number(c).alias(f"_{c}") for c in DEFAULTS])
    reb, ast = F.col("_REB") / F.col("_GP"), F.col("_AST") / F.col("_GP")
    rows = rows.withColumn("_reb_pg", reb).withColumn("_guard", ast / (reb + 1)).withColumn("_care", F.col("_AST") / F.col("_TOV"))
    reb, guard, care, fg3 = F.col("_reb_pg"), F.col("_guard"), F.col("_care"), F.col("_FG3_PCT")
    raw = F.array(
        round_off(clip(5.5 + 1.2 * guard + 2.5 * fg3, 4.0, 9.0), 2),
        round_off(clip(38 + 22 * fg3, 38.0, 55.0), 1),
        round_off(clip(170 - F.least(2.5 * reb, F.lit(30.0)), 135.0, 175.0), 1),
        round_off(clip(158 + 18 * fg3, 150.0, 178.0), 1),
        round_off(clip(20 - F.least(6 * guard, F.lit(12.0)), 8.0, 20.0) * 1000.0 / 30.0, 1),
        round_off(clip(70 + 5 * care + 35 * fg3, 60.0, 98.0), 1),
        round_off(clip(40 * (fg3 - 0.33) - 0.5 * (reb - 5), -20.0, 20.0), 2),
        round_off(clip(50 + 10 * care, 50.0, 98.0), 1),
    )
    return rows.withColumn("raw", raw).select(*[F.col(f"`{c}`") for c in box.columns], "raw")


def weighted(raw: Column) -> Column:
    """Element-wise weights that give all dimensions a like span."""
    return F.zip_with(raw, F.array(*[F.lit(w) for w in WEIGHTS]), lambda a, b: a * b)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda t, v: t + v * v))


def reference_index(box: DataFrame, key: Column | None = None) -> DataFrame:
    """``id, name, player_id, raw, weighted, norm`` of a season table."""
    id_ = F.concat_ws("_", "PLAYER_ID", "TEAM_ID") if key is None else key
    rows = vectors(box).select(id_.alias("id"), F.col("PLAYER_NAME").alias("name"), F.col("PLAYER_ID").alias("player_id"), "raw", weighted(F.col("raw")).alias("weighted"))
    return rows.withColumn("norm", norm(F.col("weighted")))


def query_vector(metrics: DataFrame) -> DataFrame:
    """Metric rows with their ``raw`` and ``weighted`` vectors and ``norm``."""
    raw = F.array(*[F.coalesce(F.col(m).cast("double"), F.lit(d)) for m, d in zip(METRICS, QUERY_DEFAULTS)])
    rows = metrics.withColumn("raw", raw).withColumn("weighted", weighted(F.col("raw")))
    return rows.withColumn("norm", norm(F.col("weighted")))
