"""Report parsing, normalising and assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.operators.match import GAPS
from stridelake.sources import METRICS

FEEDBACK = "array<struct<timestamp:string,category:string,observation:string>>"


def parse(reports: DataFrame) -> DataFrame:
    """``clip_id, body`` with the JSON body's fields, and its feedback as a variant: any
    shape is kept as it came.  A body that is no object has no fields."""
    body = F.try_parse_json("body")
    text = lambda name: F.try_variant_get(body, f"$.{name}", "string").alias(name)
    fields = [text(f) for f in ("athlete_action", "scout_report", "witty_catchphrase")]
    return reports.select("clip_id", *fields, F.try_variant_get(body, "$.athlete_feedback", "variant").alias("feedback"))


def normalise(parsed: DataFrame) -> DataFrame:
    """Blank texts get their stand-ins.  Feedback that is a list stays, entry by entry;
    any other (a text, a number, true, an object) becomes one general remark with its
    text; what counts as nothing (null, an empty text, list or object, zero, false)
    an empty list.  Of a list's entries, those that are no objects become remarks too."""
    text = lambda c, d: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit(d)).alias(c)
    kind = F.schema_of_variant("feedback")
    said = F.when(kind == "STRING", F.try_variant_get("feedback", "$", "string")).otherwise(F.to_json("feedback"))
    nothing = F.col("feedback").isNull() | kind.isin("VOID") | said.isin("", "{}", "[]", "false") | (said.try_cast("double") == 0) & (kind != "STRING")
    remark = lambda v: F.struct(F.lit("").alias("timestamp"), F.lit("general").alias("category"), v.alias("observation"))

    def entry(v):
        field = lambda name: F.try_variant_get(v, f"$.{name}", "string").alias(name)
        own = F.schema_of_variant(v)
        return F.when(own.startswith("OBJECT"), F.struct(field("timestamp"), field("category"), field("observation"))).otherwise(remark(F.when(own == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))))

    entries = F.transform(F.try_variant_get("feedback", "$", "array<variant>"), entry)
    feedback = F.when(nothing, F.array().cast(FEEDBACK)).when(kind.startswith("ARRAY"), entries).otherwise(F.array(remark(said)))
    return parsed.select("clip_id", text("athlete_action", "—"), text("scout_report", "—"), text("witty_catchphrase", ""), feedback.alias("athlete_feedback"))


def measured(normalised: DataFrame, matched: DataFrame) -> DataFrame:
    """Normalised reports with ``stats`` from the measurement, whatever the report said
    of them: the metrics, their uncertainties and the market index.  A clip without a
    report is there with its stats."""
    stats = F.struct(*METRICS, F.col("knee_unc").alias("knee_angle_uncertainty"), F.col("elbow_unc").alias("elbow_angle_uncertainty"), F.col("tier_cosine").alias("market_index"))
    return matched.select("clip_id", stats.alias("stats")).join(normalised, "clip_id", "left")


def payload(matched: DataFrame) -> DataFrame:
    """``user_stats, pro_stats, deltas`` as JSON texts."""
    deltas = F.when(F.col("pro").isNotNull(), F.to_json(F.struct(*[g[0] for g in GAPS]))).otherwise("{}")
    return matched.select("clip_id", F.to_json(F.struct(*METRICS)).alias("user_stats"), F.coalesce(F.to_json("pro"), F.lit("{}")).alias("pro_stats"), deltas.alias("deltas"))


def envelope(matched: DataFrame, reports: DataFrame, telemetry: DataFrame) -> DataFrame:
    """Everything about a clip in one nested row."""
    stats = F.struct(*METRICS, "knee_unc", "elbow_unc", F.col("tier_cosine").alias("market_index"))
    pro = F.when(F.col("match_id").isNotNull(), F.struct(F.col("match_name").alias("name"), F.col("player_id"), F.col("pro").alias("vector_stats")))
    rows = matched.select("clip_id", stats.alias("stats"), pro.alias("matched_pro"), F.struct(*[g[0] for g in GAPS]).alias("kinematic_deltas"), "confidence", "people", F.col("warnings").alias("validation_warnings"), "quality_score", "quality_label", F.col("factors").alias("confidence_factors"))
    return rows.join(telemetry, "clip_id").join(normalise(parse(reports)), "clip_id", "left")
