"""The jobs: every query of the engine, composed from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridelake.functions import angle, round_off
from stridelake.operators import drift, ivf, match, metrics, norms, reference, report, rules, series, shots, studies
from stridelake.operators import runs as repeats
from stridelake.plans import fixtures
from stridelake.sources.published import latest, publish
from stridelake.sources import METRICS, melt_pose, or_else, overwrite, read_baselines, read_box_scores, read_pose_frames, seed_table, settled, shared_folder, sport_metrics, sports, table, write_baselines

#: Smoothed doubles hardly repeat, so they are not gathered in dictionaries first.
PLAIN = {"parquet.enable.dictionary": "false"}

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    Q[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 7) -> DataFrame:
    """Doubles rounded, so that engines agree beyond the last bits."""
    return df.select(*[(round_off(c, digits) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


# -- shared steps ------------------------------------------------------------
def bounds(spark, d):
    return series.clip_bounds(fixtures.clips(spark, d))


def ranged(spark, d):
    return fixtures.ranged_pose(spark, d, bounds(spark, d))


def arrays(spark, d, short=False):
    return series.smoothed(fixtures.short_pose(spark, d) if short else ranged(spark, d))


def sided(spark, d, made=lambda rows: rows):
    """Clips with their channels, computed once: all that follows is scalar
    work on them, and its expressions do not nest.  Channels are written once, as
    ``made`` of them, and those of the shooting side are read out of them."""
    return metrics.with_joints(settled(made(metrics.sides(series.clip_records(arrays(spark, d), bounds(spark, d)))), **PLAIN))


def measured(spark, d):
    return metrics.measures(metrics.events(sided(spark, d)))


def people(spark, d):
    return series.people(series.in_range(fixtures.frames(spark, d), bounds(spark, d)))


def judged(spark, d):
    return metrics.quality(metrics.uncertainty(metrics.metric_record(measured(spark, d))), people(spark, d))


def index(spark, d):
    return reference.reference_index(reference.cleaned(fixtures.box(spark, d)))


#: What reports need of a judged clip, besides its nested telemetry.
FACTS = ["clip_id", "status", *METRICS, "knee_unc", "elbow_unc", "people", "warnings", "quality_score", "quality_label", "factors"]


def records(spark, d, *more):
    """Judged clips, computed once: several branches read them."""
    return settled(judged(spark, d).select(*FACTS, *more))


def matched(spark, d):
    return match.match_reference(reference.query_vector(records(spark, d)), settled(index(spark, d)))


def runs(spark, d):
    rows = metrics.metric_record(measured(spark, d)).select("clip_id", "status", *METRICS)
    return settled(rows).withColumn("cohort", F.col("clip_id") % 10).withColumn("day", F.floor(F.col("clip_id") / 10))


# -- scans and sinks -------------------------------------------------------------
@query
def pose_scan(spark, d):
    """Pose frames written in the scan's schema, read back and melted."""
    path = shared_folder(spark)
    overwrite(fixtures.wide_pose(spark, d), path)
    return rounded(melt_pose(read_pose_frames(spark, path)))


@query
def box_scan(spark, d):
    """A league table as CSV, read as text and coerced."""
    path = shared_folder(spark)
    fixtures.box(spark, d).select("PLAYER_ID", "PLAYER_NAME", "TEAM_ID", "GP", "REB", "AST", "TOV", "FG3_PCT", "PTS").write.csv(path, header=True)
    rows = reference.reference_index(reference.cleaned(read_box_scores(spark, path)))
    return rows.select("id", "name", "player_id", *[F.col("raw")[k].alias(f"v{k}") for k in range(8)])


@query
def index_write(spark, d):
    """The index published twice, the second in place of the first, and its row
    count."""
    path = shared_folder(spark)
    for _ in range(2):
        publish(index(spark, d), path, keep=1)
    return latest(spark, path).agg(F.count("*").alias("entries"), F.countDistinct("id").alias("ids"))


@query
def baseline_roundtrip(spark, d):
    """Baselines written as JSON objects and read back."""
    path = shared_folder(spark)
    write_baselines(drift.capture(records(spark, d)), path)
    return rounded(read_baselines(spark, path), 2)


# -- series --------------------------------------------------------------------
@query
def clip_range_filter(spark, d):
    frames = series.in_range(fixtures.frames(spark, d), bounds(spark, d))
    return frames.select("clip_id", "f", "ms", "e")


@query
def landmark_select(spark, d):
    return series.select_landmarks(fixtures.landmarks(spark, d))


@query
def frame_sampling_people(spark, d):
    rows = people(spark, d)
    return rows.select("clip_id", "people_max", "sampled", (F.col("people_max") > 1).alias("multi_person"))


@query
def gap_fill(spark, d):
    return rounded(series.long_channels(series.fill_gaps(fixtures.pose(spark, d)), "n"))


@query
def smooth_series(spark, d):
    return rounded(series.long_channels(series.smoothed(fixtures.pose(spark, d))))


@query
def smooth_short(spark, d):
    return rounded(series.long_channels(arrays(spark, d, short=True)))


@query
def shooting_side(spark, d):
    return rounded(sided(spark, d).where("n > 0").select("clip_id", "n", "l_vis", "r_vis", "side"))


@query
def pose_visibility(spark, d):
    return rounded(series.clip_records(arrays(spark, d), bounds(spark, d)).select("clip_id", "n", "visibility"))


# -- events and metrics ----------------------------------------------------------
@query
def dip_release_events(spark, d):
    return metrics.events(sided(spark, d)).where("n >= 5").select("clip_id", "n", "side", "dip", "release")


def _usable(spark, d):
    return measured(spark, d).where("n >= 5")


@query
def joint_angles(spark, d):
    return rounded(_usable(spark, d).select("clip_id", "raw_knee", "raw_elbow"), 5)


@query
def release_velocity(spark, d):
    return rounded(_usable(spark, d).select("clip_id", "torso", "power", "velocity"), 5)


@query
def shot_arc(spark, d):
    return rounded(_usable(spark, d).select("clip_id", "lever_arc", "flight_arc", "arc"), 4)


@query
def hip_rotation(spark, d):
    return rounded(_usable(spark, d).select("clip_id", "twist", "hip_rotation"), 5)


@query
def kinetic_sync(spark, d):
    return rounded(_usable(spark, d).select("clip_id", "sync"), 5)


@query
def balance_index(spark, d):
    return _usable(spark, d).select("clip_id", "balance")


@query
def fluidity(spark, d):
    return rounded(_usable(spark, d).select("clip_id", "jerk", "fluidity"), 6)


@query
def clip_metrics(spark, d):
    return rounded(metrics.metric_record(measured(spark, d)).select("clip_id", "status", *METRICS, F.col("knee_angle").alias("knee_flexion_at_dip"), F.col("elbow_angle").alias("elbow_flexion_at_release"), "raw_angle_out_of_range"), 2)


@query
def angle_uncertainty(spark, d):
    return metrics.uncertainty(measured(spark, d)).select("clip_id", "knee_unc", "elbow_unc")


@query
def video_quality(spark, d):
    return judged(spark, d).select("clip_id", F.array_join("notes", "; ").alias("notes"), "resolution", "quality_score", "quality_label", "people")


@query
def validation_warnings(spark, d):
    return judged(spark, d).select("clip_id", F.size("warnings").alias("n_warnings"), F.array_join("warnings", "; ").alias("warnings"))


@query
def confidence_factors(spark, d):
    return records(spark, d).select("clip_id", F.explode("factors").alias("f")).select("clip_id", "f.factor", "f.impact", "f.message")


@query
def telemetry_overlay(spark, d):
    rows = metrics.overlay(metrics.events(sided(spark, d)))
    return rows.select("clip_id", "f", "time_sec", *[rows["joints"][j][k].alias(f"{j}_{a}") for j in ("wrist", "ankle") for k, a in enumerate("xy")])


@query
def telemetry_struct(spark, d):
    return metrics.telemetry(judged(spark, d))


# -- reference and matching --------------------------------------------------------
@query
def box_to_vector(spark, d):
    rows = reference.reference_index(reference.cleaned(fixtures.box(spark, d)))
    return rows.select("id", "name", "player_id", *[F.col("raw")[k].alias(f"v{k}") for k in range(8)])


@query
def seed_fallback(spark, d):
    """Season rows of teams, with the seeds standing in where a division has no
    row that passes."""
    box = reference.cleaned(fixtures.box(spark, d))
    cols = ["PLAYER_NAME", "PLAYER_ID", "REB", "AST", "TOV", "FG3_PCT", "PTS", "GP"]
    seeds = seed_table(spark).select(*cols)
    full = or_else(box.select(*cols), seeds).withColumn("division", F.lit("all"))
    none = or_else(box.where("TEAM_ID < 0").select(*cols), seeds).withColumn("division", F.lit("none"))
    return rounded(reference.vectors(full.unionByName(none)).select("division", "PLAYER_NAME", "PLAYER_ID", *[F.col("raw")[k].alias(f"v{k}") for k in range(8)]), 2)


@query
def weighted_vectors(spark, d):
    rows = reference.query_vector(metrics.metric_record(measured(spark, d)))
    return rounded(rows.select("clip_id", *[F.col("weighted")[k].alias(f"w{k}") for k in range(8)]), 4)


@query
def nn_cosine(spark, d):
    q, i = fixtures.all_vectors(spark, d)
    return rounded(match.without_self(match.nearest(q, i, "cosine", 2, "vec_id"), 1, "vec_id").select("vec_id", "id", "distance"))


@query
def nn_l2(spark, d):
    q, i = fixtures.all_vectors(spark, d)
    return rounded(match.without_self(match.nearest(q, i, "l2", 2, "vec_id"), 1, "vec_id").select("vec_id", "id", "distance"))


@query
def nn_topk(spark, d):
    q, i = fixtures.all_vectors(spark, d)
    return rounded(match.without_self(match.nearest(q, i, "cosine", 4, "vec_id"), 3, "vec_id"))


@query
def nn_lsh(spark, d):
    q, i = fixtures.all_vectors(spark, d)
    return match.nearest_lsh(q, i, "vec_id", leave_out_self=True)


@query
def nn_ivf(spark, d):
    """The same searches by a written inverted-file index of all rows."""
    q, i = fixtures.all_vectors(spark, d)
    path = shared_folder(spark)
    ivf.write_index(i, path)
    return rounded(ivf.probe(q, path, 1, "vec_id", leave_out_self=True).select("vec_id", "id", "distance"))


@query
def match_confidence_tier(spark, d):
    return rounded(matched(spark, d).select("clip_id", "match_id", "match_name", "match_cosine", "match_l2", "tier_cosine", "tier_l2", "base_confidence", "confidence"), 5)


@query
def match_empty_index(spark, d):
    """Clips against an index without a row: the defaults of no match."""
    none = settled(index(spark, d).where("player_id < 0"))
    rows = match.match_reference(reference.query_vector(records(spark, d)), none)
    return rows.select("clip_id", "match_name", "match_cosine", "match_l2", "tier_cosine", "tier_l2", "base_confidence", "confidence")


@query
def matched_pro(spark, d):
    rows = match.match_stats(matched(spark, d))
    return rows.select("clip_id", "match_name", match.image_url(F.col("player_id"), "https://img.invalid/%d.png", "https://img.invalid/none.png").alias("image_url"), *[F.col(f"pro.{s[0]}").alias(s[0]) for s in match.STATS])


@query
def metric_deltas(spark, d):
    return match.gaps(match.match_stats(matched(spark, d))).select("clip_id", *[g[0] for g in match.GAPS])


@query
def completed_keys(spark, d):
    """A season table without names and teams: both from the rows' places."""
    box = reference.completed(fixtures.box(spark, d).drop("PLAYER_NAME", "TEAM_ID"), "PLAYER_ID")
    rows = reference.reference_index(reference.cleaned(box))
    return rows.select("id", "name", "player_id", *[F.col("raw")[k].alias(f"v{k}") for k in range(8)])


@query
def fallback_keys(spark, d):
    """The index of a division with players, and of one without: the stand-ins under
    their own ids."""
    cols = ["id", "name", "player_id"]
    there = reference.cleaned(fixtures.box(spark, d))
    seeds = reference.fallback_index(seed_table(spark), "PLAYER_ID").select(*cols)
    of = lambda rows, name: or_else(reference.reference_index(rows).select(*cols), seeds).withColumn("division", F.lit(name))
    return of(there, "all").unionByName(of(there.where("TEAM_ID < 0"), "none"))


@query
def player_keys(spark, d):
    """Players of an index whose rows have a second id, some of them null or zero."""
    rows = index(spark, d).withColumn("meta_id", F.when(F.col("player_id") % 3 == 1, F.lit(0).cast("long")).when(F.col("player_id") % 3 == 2, F.col("player_id") + 1000))
    return rows.select("id", reference.player_key(rows.columns).alias("player"))


# -- reports and drift ---------------------------------------------------------------
@query
def report_normalise(spark, d):
    rows = report.normalise(report.parse(fixtures.reports(spark, d)))
    return rows.select("clip_id", "athlete_action", "scout_report", "witty_catchphrase", F.size("athlete_feedback").alias("n_feedback"), F.get("athlete_feedback", F.lit(0))["category"].alias("first_category"), F.get("athlete_feedback", F.lit(0))["observation"].alias("first_observation"))


@query
def report_shapes(spark, d):
    """Feedback of any shape, and statistics overwritten by the measurement."""
    clips = matched(spark, d)
    rows = report.measured(report.normalise(report.parse(fixtures.shaped_reports(spark, d))), clips)
    said = F.array_join(F.transform("athlete_feedback", lambda f: F.concat_ws("|", F.coalesce(f["timestamp"], F.lit("-")), F.coalesce(f["category"], F.lit("-")), F.coalesce(f["observation"], F.lit("-")))), ";")
    return rounded(rows.select("clip_id", F.size("athlete_feedback").alias("n_feedback"), said.alias("feedback"), "athlete_action", *[F.col(f"stats.{m}").alias(m) for m in (*METRICS, "market_index")]), 2)


@query
def report_payload(spark, d):
    return report.payload(match.gaps(match.match_stats(matched(spark, d))))


@query
def report_envelope(spark, d):
    clips = settled(metrics.telemetry(judged(spark, d), *FACTS[1:]))
    found = match.match_reference(reference.query_vector(clips.select(*FACTS)), settled(index(spark, d)))
    return report.envelope(match.gaps(match.match_stats(found)), fixtures.reports(spark, d), clips.select("clip_id", "telemetry"))


@query
def baseline_capture(spark, d):
    return rounded(drift.capture(records(spark, d)), 2)


def _shifted(rows):
    """A run whose values are off by a known amount, and some missing."""
    rows = drift.unpivot(rows, ["clip_id"])
    return rows.where("(clip_id + length(metric)) % 11 <> 0").withColumn("value", F.col("value") + F.col("clip_id") % 9)


@query
def drift_check(spark, d):
    rows = records(spark, d)
    found = drift.check(_shifted(rows), drift.capture(rows))
    return drift.report(found).select("clip_id", F.size("messages").alias("n"), F.array_join("messages", "; ").alias("messages"))


# -- sports and studies ----------------------------------------------------------------
def _with_sport(rows):
    return rows.withColumn("sport", F.when(F.col("clip_id") % 7 == 0, "cricket").when(F.col("clip_id") % 5 == 0, "tennis").otherwise("basketball"))


@query
def sport_lookup(spark, d):
    """Each clip's sport; an unknown one gets the first sport's settings."""
    known = F.broadcast(sports(spark).withColumnRenamed("id", "sport"))
    default = sports(spark).where("id = 'basketball'").first()
    rows = _with_sport(fixtures.clips(spark, d)).join(known, "sport", "left")
    return rows.select("clip_id", "sport", F.coalesce("name", F.lit(default["name"])).alias("name"), F.coalesce("min_clip_sec", F.lit(default["min_clip_sec"])).alias("min_clip_sec"), F.coalesce(F.size("event_phases"), F.lit(len(default["event_phases"]))).alias("phases"))


@query
def sport_metrics_listing(spark, d):
    """How many clips each sport has, and whether its metrics are available."""
    counts = _with_sport(fixtures.clips(spark, d)).groupBy("sport").agg(F.count("*").alias("clips"))
    made = sport_metrics(spark).groupBy("sport").agg(F.count("*").alias("metrics"))
    rows = sports(spark).select(F.col("id").alias("sport"), "name").join(made, "sport", "left").join(counts, "sport", "left")
    return rows.select("sport", "name", F.coalesce("metrics", F.lit(0)).alias("metrics"), (F.coalesce("metrics", F.lit(0)) > 0).alias("available"), F.coalesce("clips", F.lit(0)).alias("clips"))


def _wrist(spark, d):
    return sided(spark, d).where("n >= 5").select("clip_id", F.posexplode(F.col("wrist")["y2"]).alias("f", "y"))


@query
def shot_segments(spark, d):
    return studies.shot_segments(_wrist(spark, d).withColumn("y", round_off("y", 6)))


@query
def shot_releases(spark, d):
    """Shots of every clip by prominent releases."""
    rows = sided(spark, d).where("n >= 5").select("clip_id", "fps", F.transform(F.col("wrist")["y2"], lambda v: round_off(v, 6)).alias("y"))
    found = shots.segments(settled(shots.releases(rows)))
    return rounded(found.select("clip_id", "shot", "first_f", "last_f", "release_f", "prominence"), 6)


@query
def shot_metrics(spark, d):
    """The metrics of every shot of every clip."""
    found = shots.per_shot(sided(spark, d, _even_wrist))
    # Without the shots' channels: they would be written once more.
    return rounded(settled(found.select("clip_id", "shot", "first_f", "last_f", "side", "dip", "release", "raw_knee", "raw_elbow", "velocity", "arc", "hip_rotation", "sync", "balance", "fluidity")), 4)


def _even_wrist(rows):
    """Wrist heights to six places, so that engines agree on equal ones."""
    even = lambda s: s.withField("y2", F.transform(s["y2"], lambda v: round_off(v, 6)))
    return rows.withColumn("ch", F.transform_values("ch", lambda k, v: F.when(k.endswith("_wrist"), even(v)).otherwise(v)))


@query
def subject_rank(spark, d):
    rows = fixtures.frames(spark, d).select("clip_id", F.col("e").alias("subject"), (F.col("k") / 100.0).alias("size"), ((F.col("e") % 101) / 100.0).alias("centre_x"))
    return rounded(studies.primary_subject(rows))


def _knee(spark, d):
    point = lambda j, a: F.col(j)[a][F.col("f")]
    rows = sided(spark, d).where("n >= 5").select("clip_id", "hip", "knee", "ankle", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("f"))
    return rows.select("clip_id", "f", angle(*[tuple(point(j, a) for a in ("x3", "y3", "z3")) for j in ("hip", "knee", "ankle")]).alias("angle"))


@query
def angle_jumps(spark, d):
    return rounded(studies.angle_jumps(_knee(spark, d), 15.0), 5)


@query
def run_stddev(spark, d):
    return studies.run_spread(runs(spark, d), ["cohort"])


@query
def run_repeat(spark, d):
    """Two runs with the same parameters and one without smoothing, recorded one by
    one: the spread of each clip's metrics over the first two, and over all."""
    path = shared_folder(spark)
    filled = settled(series.fill_gaps(ranged(spark, d)))
    for number, smoothing in enumerate((True, True, False)):
        channels = series.channel_arrays(filled) if smoothing else filled
        clips = settled(metrics.shooting_side(series.clip_records(channels, bounds(spark, d))))
        made = metrics.metric_record(metrics.measures(metrics.events(clips)))
        repeats.record(made, path, {"smoothing": smoothing}, number)
    rows = settled(repeats.recorded(spark, path))
    same = repeats.spread(rows, "parameters").where("runs = 2").select("clip_id", "metric", F.col("spread").alias("same"))
    return rounded(repeats.spread(rows).join(same, ["clip_id", "metric"]), 6)


@query
def truth_mae(spark, d):
    joint = F.concat_ws("_", "side", "joint").alias("joint")
    raw = fixtures.pose(spark, d).where("x2 is not null").select("clip_id", joint, "f", F.col("x2").alias("x"), F.col("y2").alias("y"))
    found = series.long_channels(series.smoothed(fixtures.pose(spark, d))).select("clip_id", joint, "f", F.col("x2").alias("x"), F.col("y2").alias("y"))
    return rounded(studies.joint_error(found, raw), 6)


@query
def expert_corr(spark, d):
    return rounded(runs(spark, d).where("status = 'ok'").agg(F.corr("knee_angle", "elbow_angle").alias("knee_elbow"), F.corr("balance_index", "hip_rotation_deg").alias("balance_hip")), 6)


@query
def benchmark_prf(spark, d):
    rows = runs(spark, d).select((F.col("knee_angle") > 140).cast("int").alias("predicted"), (F.col("clip_id") % 3 == 0).cast("int").alias("actual"))
    return rounded(studies.precision_recall(rows))


@query
def metric_trend(spark, d):
    return rounded(studies.trend(runs(spark, d), "cohort", "day", "knee_angle"), 5)


@query
def cohort_percentile(spark, d):
    return rounded(studies.cohort_percentiles(runs(spark, d).select("clip_id", "cohort", "knee_angle"), "cohort", "knee_angle"), 6)


@query
def norm_merge(spark, d):
    """Norms of knee angles by cohort from states of three spans of days, published one
    by one and merged."""
    rows = runs(spark, d).select("cohort", F.col("day").cast("long").alias("day"), F.col("knee_angle").alias("value"))
    path = shared_folder(spark)
    for span in range(3):
        norms.add_day(rows.where(F.col("day") % 3 == span), path, span)
    made = norms.norms(spark, path)
    return rounded(made.select("cohort", F.col("n").cast("long").alias("clips"), *[norms.quantile(q).alias(f"p{round(100 * q)}") for q in (0.25, 0.5, 0.9)], norms.rank(F.lit(145.0)).alias("rank_145"), norms.slope().alias("slope")), 5)


@query
def ideal_range(spark, d):
    values = drift.unpivot(runs(spark, d), ["clip_id"])
    rows = studies.in_ideal_range(values, sport_metrics(spark))
    return rows.groupBy("metric").agg(F.count("*").alias("clips"), F.sum(F.col("in_range").cast("int")).alias("inside"))


@query
def confidence_tiers(spark, d):
    return matched(spark, d).select(studies.confidence_tier(F.col("confidence")).alias("tier")).groupBy("tier").agg(F.count("*").alias("clips"))


@query
def phase_labels(spark, d):
    rows = metrics.events(sided(spark, d)).where("n >= 5").select("clip_id", "dip", "release", "fps", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("f"))
    return rows.select("clip_id", "f", studies.phase(F.col("f"), F.col("dip"), F.col("release"), F.col("fps")).alias("phase"))


@query
def key_frames(spark, d):
    rules = spark.createDataFrame([("dip", "wrist", "max"), ("release", "wrist", "min"), ("bend", "knee", "max")], "key string, channel string, pick string")
    rows = sided(spark, d).where("n >= 5")
    long = rows.select("clip_id", F.explode(F.create_map(*[x for j in ("wrist", "knee") for x in (F.lit(j), F.col(j)["y2"])])).alias("channel", "ys")).select("clip_id", "channel", F.posexplode("ys").alias("f", "v"))
    return studies.key_frames(long.withColumn("v", round_off("v", 6)), rules)


@query
def sport_rules(spark, d):
    """Events and metrics of every clip by its sport's configuration."""
    return rules.judge(_with_sport(sided(spark, d).where("n >= 5")))


@query
def stream_clips(spark, d):
    from stridelake.streaming.clips import replay

    return replay(spark, table(spark, d, "events"))


#: Parts in which a replayed stream comes, at least; frames of a part, about.
CHUNKS, CHUNK_FRAMES = 4, 200_000


@query
def stream_metrics(spark, d):
    """All clips through a stream of frames in several parts, each taken before the
    next one comes: their metrics and matches, as the batches publish them when clips
    close.  A part has bounded frames, so state does too."""
    from stridelake.streaming import live

    base = shared_folder(spark)
    chunks = max(CHUNKS, -(-table(spark, d, "events").count() // CHUNK_FRAMES))
    made = fixtures.live_pose(spark, d, chunks)
    made.write.partitionBy("chunk").parquet(f"{base}/frames")
    frames = spark.read.schema(made.schema).parquet(f"{base}/frames")
    fields = live.LIVE_FRAMES.fieldNames()
    facts = settled(fixtures.clips(spark, d).drop("total_frames"))
    refs = settled(index(spark, d))
    take = lambda: live.start(spark, f"{base}/in", facts, refs, f"{base}/out", f"{base}/state", files_per_batch=1_000_000).awaitTermination()
    for k in range(chunks):
        frames.where(F.col("chunk") == k).select(*fields).write.mode("append").parquet(f"{base}/in")
        take()
    # A frame of another clip, much later, lets the watermark close all of them.
    end = frames.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts")).select(F.lit(-1).cast("long").alias("clip_id"), F.lit(0).alias("frame_idx"), F.lit(0).alias("n_people"), F.lit(None).cast(live.LIVE_FRAMES["p3"].dataType).alias("p3"), F.lit(None).cast(live.LIVE_FRAMES["p2"].dataType).alias("p2"), "ts")
    end.write.mode("append").parquet(f"{base}/in")
    take()
    rows = live.results(spark, f"{base}/out").where("clip_id >= 0")
    return rounded(rows.drop("started", "ended", "knee_unc", "elbow_unc"), 5)
