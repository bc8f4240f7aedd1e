"""Events, metrics, quality and confidence of a clip, from its channel arrays.

All of it is scalar work on one row per clip; nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.functions import angle, clip, half_turn, initial_slope, round_off, second_difference, spread
from stridelake.sources import JOINTS

MIN_FRAMES = 5
#: The record of a clip without a usable shot.
FALLBACK = {"release_velocity_mps": 7.0, "shot_arc_deg": 45.0, "knee_angle": 145.0, "elbow_angle": 165.0, "kinetic_sync_ms": 150.0, "hip_rotation_deg": 5.0, "balance_index": 75, "fluidity_score": 65}
FALLBACK_WARNING = "Analysis used fallback values. Video may lack a detectable jump shot or pose."


def _at(series: Column, axis: str, i: Column) -> Column:
    return F.get(series[axis], i)


def _point(series: Column, i: Column) -> tuple[Column, ...]:
    return tuple(_at(series, a, i) for a in ("x3", "y3", "z3"))


def sides(records: DataFrame, backwards: bool = False) -> DataFrame:
    """``side``: where the shoulder is seen better on average (a tie is right).  Frames
    are added from the first to the last, or ``backwards``: sides that are seen alike but
    for the last bits go by it."""
    seen = lambda s: F.col("ch")[f"{s}_shoulder"]["v2"]
    mean = lambda s: F.aggregate(F.reverse(seen(s)) if backwards else seen(s), F.lit(0.0), lambda t, v: t + v) / F.col("n")
    return records.withColumn("l_vis", mean("left")).withColumn("r_vis", mean("right")).withColumn("side", F.when(F.col("l_vis") > F.col("r_vis"), "left").otherwise("right"))


def with_joints(sided: DataFrame) -> DataFrame:
    """The channels of ``side`` as columns of their own."""
    return sided.select("*", *[F.try_element_at("ch", F.concat_ws("_", "side", F.lit(j))).alias(j) for j in JOINTS])


def shooting_side(records: DataFrame) -> DataFrame:
    """``side`` (``sides``) and its channels (``with_joints``)."""
    return with_joints(sides(records))


def events(sided: DataFrame) -> DataFrame:
    """``dip`` and ``release`` frames from the wrist's height on screen."""
    y = F.col("wrist")["y2"]
    dip = F.greatest(F.lit(0), F.least((F.array_position(y, F.array_max(y)) - 1).cast("int"), F.col("n") - 5))
    rows = sided.withColumn("dip", dip)
    stop = F.least(F.col("n"), F.col("dip") + (F.col("fps") * 1.5).cast("int"))
    window = F.slice(y, F.col("dip") + 1, F.greatest(stop - F.col("dip"), F.lit(0)))
    lowest = F.col("dip") + (F.array_position(window, F.array_min(window)) - 1).cast("int")
    return rows.withColumn("release", F.when(stop > F.col("dip") + 2, lowest).otherwise(F.col("dip") + 1))


def measures(found: DataFrame) -> DataFrame:
    """The eight metrics before rounding, and what leads to them."""
    d, r, n, ar = F.col("dip"), F.col("release"), F.col("n"), F.col("ar")
    w, e, s, h, k, a = (F.col(j) for j in ("wrist", "elbow", "shoulder", "hip", "knee", "ankle"))
    gap = lambda p, i, q, j: F.sqrt(F.pow(_at(p, "x2", i) - _at(q, "x2", j), 2) + F.pow(_at(p, "y2", i) - _at(q, "y2", j), 2))
    rows = found.select("*", angle(_point(h, d), _point(k, d), _point(a, d)).alias("_knee"), angle(_point(s, r), _point(e, r), _point(w, r)).alias("_elbow"), gap(s, d, h, d).alias("torso"), gap(w, r, w, d).alias("_travel"))
    rows = rows.withColumn("raw_knee", F.when(F.col("_knee") < 10, 135.0).otherwise(F.col("_knee"))).withColumn("raw_elbow", F.when(F.col("_elbow") < 10, 165.0).otherwise(F.col("_elbow")))
    rows = rows.withColumn("power", F.when((F.col("torso") > 1e-5) & (r > d), F.col("_travel") / F.col("torso")).otherwise(0.0))
    rows = rows.withColumn("velocity", F.when(F.col("power") > 0, clip(F.col("power") * 3.5, 4.0, 10.0)).otherwise(6.5))
    dx, dy = (_at(w, "x2", r) - _at(s, "x2", r)) * ar, -(_at(w, "y2", r) - _at(s, "y2", r))
    rows = rows.withColumn("lever_arc", F.when(F.abs(dx) > 1e-5, clip(F.degrees(F.atan2(dy, F.abs(dx))) - 15.0, 30.0, 75.0)).otherwise(48.5))
    rest = n - r - 1
    span = F.least(F.lit(7), rest)
    xs = F.transform(F.slice(w["x2"], r + 1, F.greatest(span, F.lit(0))), lambda v: v * ar)
    ys = F.transform(F.slice(w["y2"], r + 1, F.greatest(span, F.lit(0))), lambda v: -v)
    rows = rows.withColumn("_xs", F.when(rest >= 3, xs)).withColumn("_ys", ys)
    flight = F.when(spread(F.col("_xs")) > 1e-5, F.degrees(F.atan(F.abs(initial_slope(F.col("_xs"), F.col("_ys"))))))
    rows = rows.withColumn("flight_arc", flight).withColumn("arc", F.when(F.col("flight_arc").between(30.0, 75.0), F.col("flight_arc")).otherwise(F.col("lever_arc")))
    line = lambda j: F.atan2(_at(F.col("ch")[f"right_{j}"], "z3", d) - _at(F.col("ch")[f"left_{j}"], "z3", d), _at(F.col("ch")[f"right_{j}"], "x3", d) - _at(F.col("ch")[f"left_{j}"], "x3", d))
    rows = rows.withColumn("twist", half_turn(F.degrees(line("shoulder") - line("hip")))).withColumn("hip_rotation", clip(F.col("twist"), -45.0, 45.0))
    taken = F.abs(r - d)
    fps = F.when(taken > 15, F.col("fps") * (taken / 8.0)).otherwise(F.col("fps"))
    rows = rows.withColumn("sync", clip(F.when(fps > 0, taken / fps * 1000.0).otherwise(taken * 33.3), 120.0, 395.0))
    middle = lambda j: (_at(F.col("ch")[f"left_{j}"], "x2", d) + _at(F.col("ch")[f"right_{j}"], "x2", d)) / 2.0
    lean = F.abs(middle("hip") - middle("ankle")) / F.col("torso")
    rows = rows.withColumn("balance", F.when(F.col("torso") > 1e-4, clip(100 - lean * 120, 40.0, 99.0).cast("int")).otherwise(85))
    path = F.slice(w["y2"], d + 1, F.greatest(r - d, F.lit(0)))
    rows = rows.withColumn("jerk", F.when(r - d > 3, spread(second_difference(path))).otherwise(0.0))
    rows = rows.withColumn("fluidity", F.when(r > d + 2, clip(100 - F.col("jerk") * 5000, 40.0, 99.0).cast("int")).otherwise(65))
    return rows.drop("_knee", "_elbow", "_travel", "_xs", "_ys")


def is_fallback() -> Column:
    """Too few frames, or never a pose."""
    return (F.col("n") < MIN_FRAMES) | F.col("visibility").isNull()


def metric_record(measured: DataFrame) -> DataFrame:
    """Rounded metrics with the fallback record where it applies."""
    made = {
        "release_velocity_mps": round_off("velocity", 2),
        "shot_arc_deg": round_off("arc", 1),
        "knee_angle": round_off(clip(F.col("raw_knee"), 90.0, 180.0), 1),
        "elbow_angle": round_off(clip(F.col("raw_elbow"), 100.0, 180.0), 1),
        "kinetic_sync_ms": round_off("sync", 1),
        "hip_rotation_deg": round_off("hip_rotation", 1),
        "balance_index": F.col("balance"),
        "fluidity_score": F.col("fluidity"),
    }
    status = F.when(is_fallback(), "fallback").otherwise("ok")
    return measured.select("*", status.alias("status"), *[F.when(is_fallback(), F.lit(FALLBACK[m])).otherwise(c).alias(m) for m, c in made.items()], (~is_fallback() & (~F.col("raw_knee").between(90, 180) | ~F.col("raw_elbow").between(100, 180))).alias("raw_angle_out_of_range"))


def uncertainty(records: DataFrame) -> DataFrame:
    """``knee_unc, elbow_unc``: spread of the angle in three frames to either
    side of its event, widened where visibility is low; null in a fallback."""

    def of(joints: tuple[str, str, str], event: str) -> Column:
        p, q, s = (F.col(j) for j in joints)
        around = F.sequence(F.greatest(F.lit(0), F.col(event) - 3), F.greatest(F.least(F.col("n"), F.col(event) + 4) - 1, F.lit(0)))
        angles = F.filter(F.transform(around, lambda i: angle(_point(p, i), _point(q, i), _point(s, i))), lambda x: x > 10)
        spread_ = F.element_at(F.transform(F.array(angles), lambda v: F.when(F.size(v) >= 3, spread(v)).otherwise(5.0)), 1)
        return F.when(~is_fallback(), round_off(clip(spread_ * 1.2 * F.when(F.col("visibility") < 0.6, 1.5).otherwise(1.0), 3.0, 12.0), 1))

    return records.select("*", of(("hip", "knee", "ankle"), "dip").alias("knee_unc"), of(("shoulder", "elbow", "wrist"), "release").alias("elbow_unc"))


# The texts of notes and flags.
NOTES = [
    ("Low resolution may reduce pose accuracy. Use 720p or higher for best results.", "width < 320 or height < 240"),
    ("Low framerate (<20 fps) can blur fast motions. 30 fps or higher recommended.", "fps < 20"),
    ("Slow-motion detected. Kinetic sync timing adjusted for high-speed capture.", "fps > 90"),
    ("Vertical/portrait video can compress shot arc. For best accuracy, use landscape with a 45° angle.", "ar < 0.6"),
    ("Ultra-wide format may distort joint positions at frame edges.", "ar > 2.2"),
    ("Short clip: ensure it contains a single, complete jump shot for reliable analysis.", "n < 30"),
]
LOW_VISIBILITY = "Low pose visibility. Ensure full-body visibility and good lighting."


def quality(records: DataFrame, people: DataFrame) -> DataFrame:
    """Quality notes, score and label; warnings; confidence factors.  ``people``
    has ``clip_id, people_max``."""
    rows = records.join(people.select("clip_id", "people_max"), "clip_id", "left")
    rows = rows.withColumn("people", F.when(is_fallback(), 0).otherwise(F.coalesce(F.when(F.col("people_max") != 0, F.col("people_max")), F.lit(1))))
    notes = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(t)) for t, c in NOTES]))
    size = F.greatest("width", "height", F.lit(320))
    q_res = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 20 * F.log10(size / 320 + 1e-6) + 40))
    q_fps = F.least(F.lit(15.0), 15 * F.least(F.col("fps") / 30.0, F.lit(1.5)))
    q_ar = F.when(F.col("ar").between(0.6, 2.2), 10).otherwise(5)
    q_people = F.when(F.col("people") <= 1, 10).otherwise(F.greatest(F.lit(0), 10 - 5 * (F.col("people") - 1)))
    score = F.when(~is_fallback(), clip(q_res + q_fps + q_ar + 30 * F.col("visibility") + q_people, 0.0, 100.0).cast("int"))
    rows = rows.withColumn("notes", F.when(is_fallback(), F.array().cast("array<string>")).otherwise(notes)).withColumn("quality_score", score)
    label = F.when(F.col("quality_score") >= 80, "Excellent").when(F.col("quality_score") >= 60, "Good").when(F.col("quality_score") >= 40, "Fair").when(F.col("quality_score").isNotNull(), "Low")
    rows = rows.withColumn("quality_label", label).withColumn("resolution", F.concat_ws("×", F.col("width").cast("string"), F.col("height").cast("string")))
    # Angles are held in range before they are flagged, so only visibility fires.
    flags = F.array_compact(
        F.array(
            F.when(F.col("visibility") < 0.5, F.lit(LOW_VISIBILITY)),
            F.when(~F.col("knee_angle").between(90, 180), F.concat(F.lit("Knee angle ("), "knee_angle", F.lit("°) outside biological range. Check for occlusion or camera angle."))),
            F.when(~F.col("elbow_angle").between(100, 180), F.concat(F.lit("Elbow angle ("), "elbow_angle", F.lit("°) outside typical range. Ensure arm is visible at release."))),
        )
    )
    warnings = F.when(is_fallback(), F.array(F.lit(FALLBACK_WARNING))).otherwise(F.concat(flags, "notes"))
    rows = rows.withColumn("warnings", warnings)
    k = F.size("warnings")
    factor = lambda name, impact, text: F.struct(F.lit(name).alias("factor"), impact.cast("int").alias("impact"), text.alias("message"))
    factors = F.array_compact(
        F.array(
            F.when(F.col("quality_score") < 60, factor("video_quality", -F.least(F.lit(20), 60 - F.col("quality_score")), F.concat(F.lit("Video quality "), "quality_score", F.lit("/100 — re-record at 720p+, 30 fps")))),
            F.when(F.col("people") > 1, factor("multi_person", F.lit(-15), F.concat("people", F.lit(" people detected — record only the shooter")))),
            F.when(F.col("visibility") < 0.5, factor("pose_visibility", F.lit(-10), F.lit("Low joint visibility — ensure full body and good lighting"))),
            F.when(k > 0, factor("validation", -F.least(F.lit(15), 4 * k), F.concat(k.cast("string"), F.lit(" quality note(s) — see recommendations above")))),
        )
    )
    return rows.withColumn("factors", F.when(is_fallback(), F.slice(factors, 1, 0)).otherwise(factors)).withColumn("multi_person_note", F.when(F.col("people") > 1, F.lit("Multiple people detected; results may mix subjects.")))


def joints_at(i: Column) -> Column:
    """Map from joint to [x, y] of the shooting side at a frame."""
    pairs = [x for j in ("wrist", "elbow", "shoulder", "hip", "knee", "ankle") for x in (F.lit(j), F.array(round_off(_at(F.col(j), "x2", i), 4), round_off(_at(F.col(j), "y2", i), 4)))]
    return F.when((i >= 0) & (i < F.col("n")), F.create_map(*pairs))


def overlay(records: DataFrame) -> DataFrame:
    """One row per overlay frame from dip to 1.5 s after release."""
    stop = F.least(F.col("n") - 1, F.col("release") + (F.col("fps") * 1.5).cast("int"))
    rows = records.where(~is_fallback()).withColumn("f", F.explode(F.sequence("dip", stop)))
    return rows.select("clip_id", "f", round_off(F.col("f") / F.col("fps"), 3).alias("time_sec"), joints_at(F.col("f")).alias("joints"))


def telemetry(records: DataFrame, *more: str) -> DataFrame:
    """``clip_id``, the columns ``more``, and one struct with all of a clip's nested
    output."""
    stop = F.least(F.col("n") - 1, F.col("release") + (F.col("fps") * 1.5).cast("int"))
    frame = lambda i: F.struct(round_off(i / F.col("fps"), 3).alias("time_sec"), joints_at(i).alias("joints"))
    ok = ~is_fallback()
    frames = F.when(ok, F.transform(F.sequence("dip", stop), frame))
    detection = F.struct(F.array(F.lit("pose landmarks")).alias("algorithms"), F.col("people").alias("people_detected_max"), F.col("multi_person_note").alias("video_quality_note"))
    quality_ = F.struct("notes", "resolution", round_off("fps", 1).alias("fps"), F.col("quality_score").alias("score"), F.col("quality_label").alias("label"))
    return records.select("clip_id", *more, F.struct(round_off("fps", 2).alias("fps"), F.when(ok, F.col("side")).alias("shooting_side"), F.when(ok, frame(F.col("dip"))).alias("dip"), F.when(ok, frame(F.col("release"))).alias("release"), F.coalesce(frames, F.array().cast(frames_type())).alias("frames"), detection.alias("detection_metadata"), quality_.alias("video_quality"), F.col("warnings").alias("validation_warnings"), F.col("factors").alias("confidence_factors")).alias("telemetry"))


def frames_type() -> str:
    return "array<struct<time_sec:double,joints:map<string,array<double>>>>"
