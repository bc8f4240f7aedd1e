"""DuckDB SQL of the jobs, written apart from the operators.

Each text is a chain of common table expressions over the given tables: the
derived views, filled and smoothed channels in long form, events, metrics.
"""

from __future__ import annotations

import re

from stridelake.plans import fixtures as X
from stridelake.sources import SEED_ROWS

TABLES = {"events": "events", "lineitem": "lineitem", "supplier": "supplier"}
AXES = ("x2", "y2", "v2", "x3", "y3", "z3")
NAMES = ("release_velocity_mps", "shot_arc_deg", "knee_angle", "elbow_angle", "kinetic_sync_ms", "fluidity_score", "hip_rotation_deg", "balance_index")
WEIGHTS = (16.6, 3.3, 1.25, 1.66, 0.33, 1.66, 2.22, 2.0)

# The smoothing projection times 858, rows 0 to 4; row 5 times 429; the rest is
# the rotation of the first five.
_EDGE = [
    [678, 288, 48, -72, -102, -72, -12, 48, 78, 48, -72],
    [288, 246, 192, 132, 72, 18, -24, -48, -48, -18, 48],
    [48, 192, 246, 232, 172, 88, 2, -64, -88, -48, 78],
    [-72, 132, 232, 251, 212, 138, 52, -23, -64, -48, 48],
    [-102, 72, 172, 212, 206, 168, 112, 52, 2, -24, -12],
]
_MIDDLE = [2 * v for v in (-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36)]
_ROWS = _EDGE + [_MIDDLE] + [r[::-1] for r in _EDGE[::-1]]
_MATRIX = "[" + ", ".join("[" + ", ".join(f"{v}e0/858e0" for v in r) + "]" for r in _ROWS) + "]"


def sql(ctes: str, select: str) -> str:
    """One text; the closing order keeps a row limit above it from reaching the
    joins, where DuckDB may not return."""
    return f"with {ctes} select * from ({select}) order by all".format(**TABLES)


BOUNDS = """
b0 as (select *, case when fps > 0 then fps else 30e0 end as rate, try_cast(nullif(trim(start_sec), '') as double) as st, try_cast(nullif(trim(end_sec), '') as double) as en from clips),
bounds as (select clip_id, rate as fps, width, height, case when height > 0 then width / cast(height as double) else 1e0 end as ar,
  cast(case when st >= 0 then least(trunc(st * rate), total_frames - 1) else 0 end as int) as lo,
  cast(case when en > coalesce(st, 0) then least(trunc(en * rate), total_frames) else total_frames end as int) as hi from b0)"""
RANGED = "pose as (select p.* replace (p.f - b.lo as f) from pose_all p join bounds b using (clip_id) where p.f >= lo and p.f < hi)"
WHOLE = "pose as (select * from pose_all)"
SHORT = "pose as (select * replace (clip_id * 100000 + f // size as clip_id, f % size as f) from (select *, case clip_id % 5 when 0 then 4 when 1 then 5 when 2 then 10 when 3 then 11 else 12 end as size from pose_all))"


def _fill(a: str) -> str:
    known = f"case when {a} is not null then f end"
    back, ahead = "rows between unbounded preceding and current row", "rows between current row and unbounded following"
    return f"""last_value({a} ignore nulls) over (w {back}) as p_{a}, last_value({known} ignore nulls) over (w {back}) as pf_{a},
      first_value({a} ignore nulls) over (w {ahead}) as q_{a}, first_value({known} ignore nulls) over (w {ahead}) as qf_{a}"""


SERIES = f"""
around as (select *, count(*) over (partition by clip_id, side, joint) as n, {', '.join(map(_fill, AXES))}
  from pose window w as (partition by clip_id, side, joint order by f)),
gap as (select clip_id, side, joint, f, cast(n as int) as n, v2 as raw_v2, {', '.join(f'''case when n < 11 then coalesce({a}, 0e0) when {a} is not null then {a}
    when p_{a} is not null and q_{a} is not null then p_{a} + (q_{a} - p_{a}) * (f - pf_{a}) / cast(qf_{a} - pf_{a} as double) else coalesce(p_{a}, q_{a}, 0e0) end as {a}''' for a in AXES)} from around),
lists as (select clip_id, side, joint, any_value(n) as n, {', '.join(f'list({a} order by f) as {a}' for a in AXES)} from gap group by all),
m as (select {_MATRIX} as h),
sm as (select clip_id, side, joint, n, unnest(range(n)) as f, {', '.join(f'''unnest(case when n < 11 then {a} else list_transform(range(n), lambda i:
    list_dot_product(h[i - greatest(least(i - 5, n - 11), 0) + 1], {a}[greatest(least(i - 5, n - 11), 0) + 1 : greatest(least(i - 5, n - 11), 0) + 11])) end) as {a}''' for a in AXES)} from lists, m)"""

#: Sides, events, and the joints of the shooting side at each frame.
EVENTS = """
vis as (select clip_id, any_value(n) as n, avg(case when side = 'left' then v2 end) as l_vis, avg(case when side = 'right' then v2 end) as r_vis from sm where joint = 'shoulder' group by clip_id),
sides as (select *, case when l_vis > r_vis then 'left' else 'right' end as side from vis),
act as (select s.clip_id, s.f, s.joint, s.x2, s.y2, s.x3, s.y3, s.z3 from sm s join sides using (clip_id, side)),
wr as (select a.clip_id, a.f, a.x2, a.y2, n, fps, ar from act a join sides using (clip_id) join bounds using (clip_id) where joint = 'wrist'),
dips as (select clip_id, any_value(n) as n, any_value(fps) as fps, any_value(ar) as ar, greatest(0, least(arg_max(f, struct_pack(y := y2, g := -f)), any_value(n) - 5)) as d from wr group by clip_id),
win as (select clip_id, least(n, d + cast(trunc(fps * 1.5) as bigint)) as stop from dips),
ev as (select dips.*, case when stop > d + 2 then (select arg_min(w.f, struct_pack(y := w.y2, g := w.f)) from wr w where w.clip_id = dips.clip_id and w.f >= d and w.f < stop) else d + 1 end as r from dips join win using (clip_id))"""


def _ang(a: str, b: str, c: str) -> str:
    diff = lambda p: [f"({p}.{x} - {b}.{x})" for x in ("x3", "y3", "z3")]
    u, v = diff(a), diff(c)
    dot = lambda p, q: "(" + " + ".join(f"{i} * {j}" for i, j in zip(p, q)) + ")"
    nu, nv = f"sqrt({dot(u, u)})", f"sqrt({dot(v, v)})"
    return f"case when {nu} >= 1e-9 and {nv} >= 1e-9 then degrees(acos(greatest(least({dot(u, v)} / ({nu} * {nv}), 1e0), -1e0))) else 0e0 end"


def _join(joints: str, at: str) -> str:
    return " ".join(f"join act {j} on {j}.clip_id = ev.clip_id and {j}.joint = '{j}' and {j}.f = {at}" for j in joints.split())


METRICS = f"""
knees as (select ev.clip_id, {_ang('hip', 'knee', 'ankle')} as a from ev {_join('hip knee ankle', 'd')}),
elbows as (select ev.clip_id, {_ang('shoulder', 'elbow', 'wrist')} as a from ev {_join('shoulder elbow wrist', 'r')}),
mv as (select ev.clip_id, sqrt(power(w2.x2 - w1.x2, 2) + power(w2.y2 - w1.y2, 2)) as travel, sqrt(power(s.x2 - h.x2, 2) + power(s.y2 - h.y2, 2)) as torso
  from ev join act w1 on w1.clip_id = ev.clip_id and w1.joint = 'wrist' and w1.f = d join act w2 on w2.clip_id = ev.clip_id and w2.joint = 'wrist' and w2.f = r
  join act s on s.clip_id = ev.clip_id and s.joint = 'shoulder' and s.f = d join act h on h.clip_id = ev.clip_id and h.joint = 'hip' and h.f = d),
pw as (select mv.*, case when torso > 1e-5 and r > d then travel / torso else 0e0 end as power from mv join ev using (clip_id)),
lev as (select ev.clip_id, (wrist.x2 - shoulder.x2) * ar as dx, shoulder.y2 - wrist.y2 as dy from ev {_join('wrist shoulder', 'r')}),
lever as (select clip_id, case when abs(dx) > 1e-5 then greatest(least(degrees(atan2(dy, abs(dx))) - 15, 75e0), 30e0) else 48.5e0 end as lever_arc from lev),
fl0 as (select ev.clip_id, w.x2 * ev.ar as x, -w.y2 as y, first_value(w.x2 * ev.ar) over (partition by ev.clip_id order by w.f) as x0 from ev join wr w on w.clip_id = ev.clip_id and w.f >= r and w.f < r + least(7, ev.n - r - 1) where ev.n - r - 1 >= 3),
fl as (select clip_id, stddev_pop(x) as sx, count(*)::double as s0, sum(x - x0) as s1, sum(power(x - x0, 2)) as s2, sum(power(x - x0, 3)) as s3, sum(power(x - x0, 4)) as s4, sum(y) as t0, sum((x - x0) * y) as t1, sum(power(x - x0, 2) * y) as t2 from fl0 group by clip_id),
flight as (select clip_id, case when sx > 1e-5 and abs(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)) > 1e-30 then degrees(atan(abs((s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))))) end as flight_arc from fl),
both_sides as (select ev.clip_id, s.joint, max(case when s.side = 'right' then s.z3 end) - max(case when s.side = 'left' then s.z3 end) as dz, max(case when s.side = 'right' then s.x3 end) - max(case when s.side = 'left' then s.x3 end) as dx, avg(s.x2) as mid from ev join sm s on s.clip_id = ev.clip_id and s.f = d where s.joint in ('shoulder', 'hip', 'ankle') group by all),
tw as (select clip_id, degrees(max(case when joint = 'shoulder' then atan2(dz, dx) end) - max(case when joint = 'hip' then atan2(dz, dx) end)) + 180 as t, abs(max(case when joint = 'hip' then mid end) - max(case when joint = 'ankle' then mid end)) as lean from both_sides group by clip_id),
jk0 as (select w.clip_id, w.y2 - 2 * lag(w.y2, 1) over k + lag(w.y2, 2) over k as dd from wr w join ev on w.clip_id = ev.clip_id and w.f >= d and w.f < r window k as (partition by w.clip_id order by w.f)),
jk as (select clip_id, stddev_pop(dd) as jerk from jk0 group by clip_id),
raw as materialized (select ev.clip_id, n, d, r, fps, case when knees.a < 10 then 135e0 else knees.a end as raw_knee, case when elbows.a < 10 then 165e0 else elbows.a end as raw_elbow, torso, power,
  case when power > 0 then greatest(least(power * 3.5, 10e0), 4e0) else 6.5e0 end as velocity, lever_arc, flight_arc, case when flight_arc between 30 and 75 then flight_arc else lever_arc end as arc,
  ((t % 360) + 360) % 360 - 180 as twist, greatest(least(((t % 360) + 360) % 360 - 180, 45e0), -45e0) as hip_rotation,
  greatest(least(abs(r - d) / (case when abs(r - d) > 15 then fps * abs(r - d) / 8e0 else fps end) * 1000, 395e0), 120e0) as sync,
  cast(case when torso > 1e-4 then trunc(greatest(least(100 - lean / torso * 120, 99e0), 40e0)) else 85 end as int) as balance,
  case when r - d > 3 then jerk else 0e0 end as jerk, cast(case when r > d + 2 then trunc(greatest(least(100 - (case when r - d > 3 then jerk else 0e0 end) * 5000, 99e0), 40e0)) else 65 end as int) as fluidity
  from ev join knees using (clip_id) join elbows using (clip_id) join pw using (clip_id) join lever using (clip_id) left join flight using (clip_id) join tw using (clip_id) left join jk using (clip_id))"""

RECORD = """
seen as (select clip_id, avg(v) as visibility, count(v) as k, max(n) as n from (select clip_id, side, joint, avg(raw_v2) as v, any_value(n) as n from gap where joint in ('wrist', 'elbow', 'shoulder') group by all) group by clip_id),
facts as (select b.*, coalesce(n, 0) as n, case when k = 6 then visibility end as visibility, (coalesce(n, 0) < 5 or k is distinct from 6) as fell from bounds b left join seen using (clip_id)),
rec as (select f.clip_id, f.fell, f.n, f.fps, f.ar, f.width, f.height, f.visibility, case when f.fell then 'fallback' else 'ok' end as status,
  case when f.fell then 7e0 else round(velocity, 2) end as release_velocity_mps, case when f.fell then 45e0 else round(arc, 1) end as shot_arc_deg,
  case when f.fell then 145e0 else round(greatest(least(raw_knee, 180e0), 90e0), 1) end as knee_angle, case when f.fell then 165e0 else round(greatest(least(raw_elbow, 180e0), 100e0), 1) end as elbow_angle,
  case when f.fell then 150e0 else round(sync, 1) end as kinetic_sync_ms, case when f.fell then 5e0 else round(hip_rotation, 1) end as hip_rotation_deg,
  case when f.fell then 75 else balance end as balance_index, case when f.fell then 65 else fluidity end as fluidity_score,
  not f.fell and (raw_knee not between 90 and 180 or raw_elbow not between 100 and 180) as raw_angle_out_of_range from facts f left join raw using (clip_id))"""

PEOPLE = """
one as (select w.clip_id, w.f - lo as f, n_people, count(*) over (partition by w.clip_id) as n from wave w join bounds using (clip_id) where w.f >= lo and w.f < hi),
ppl as (select clip_id, max(n_people) as people_max, count(*) as sampled from one where f % greatest(1, n // 8) = 0 group by clip_id)"""

_NOTES = [
    ("Low resolution may reduce pose accuracy. Use 720p or higher for best results.", "width < 320 or height < 240"),
    ("Low framerate (<20 fps) can blur fast motions. 30 fps or higher recommended.", "fps < 20"),
    ("Slow-motion detected. Kinetic sync timing adjusted for high-speed capture.", "fps > 90"),
    ("Vertical/portrait video can compress shot arc. For best accuracy, use landscape with a 45° angle.", "ar < 0.6e0"),
    ("Ultra-wide format may distort joint positions at frame edges.", "ar > 2.2e0"),
    ("Short clip: ensure it contains a single, complete jump shot for reliable analysis.", "n < 30"),
]
_NOTE_LIST = "list_filter([" + ", ".join(f"case when {c} then '{t}' end" for t, c in _NOTES) + "], lambda x: x is not null)"
QUALITY = f"""
qp as (select rec.*, case when fell then 0 else coalesce(nullif(people_max, 0), 1) end as people from rec left join ppl using (clip_id)),
qs as (select *, case when fell then []::varchar[] else {_NOTE_LIST} end as notes,
  case when not fell then cast(trunc(greatest(least(greatest(0, least(100, 20 * log10(greatest(width, height, 320) / 320e0 + 1e-6) + 40)) + least(15, 15 * least(fps / 30, 1.5e0)) + case when ar between 0.6e0 and 2.2e0 then 10 else 5 end + 30 * visibility + case when people <= 1 then 10 else greatest(0, 10 - 5 * (people - 1)) end, 100e0), 0e0)) as int) end as quality_score from qp),
judged as (select *, case when quality_score >= 80 then 'Excellent' when quality_score >= 60 then 'Good' when quality_score >= 40 then 'Fair' when quality_score is not null then 'Low' end as quality_label,
  case when fell then ['Analysis used fallback values. Video may lack a detectable jump shot or pose.'] else list_concat(case when visibility < 0.5e0 then ['Low pose visibility. Ensure full-body visibility and good lighting.'] else []::varchar[] end, notes) end as warnings from qs)"""

UNCERTAIN = f"""
ka as (select ev.clip_id, {_ang('hip', 'knee', 'ankle')} as a from ev join act hip on hip.clip_id = ev.clip_id and hip.joint = 'hip' and hip.f between d - 3 and d + 3 join act knee on knee.clip_id = ev.clip_id and knee.joint = 'knee' and knee.f = hip.f join act ankle on ankle.clip_id = ev.clip_id and ankle.joint = 'ankle' and ankle.f = hip.f),
ea as (select ev.clip_id, {_ang('shoulder', 'elbow', 'wrist')} as a from ev join act shoulder on shoulder.clip_id = ev.clip_id and shoulder.joint = 'shoulder' and shoulder.f between r - 3 and r + 3 join act elbow on elbow.clip_id = ev.clip_id and elbow.joint = 'elbow' and elbow.f = shoulder.f join act wrist on wrist.clip_id = ev.clip_id and wrist.joint = 'wrist' and wrist.f = shoulder.f),
ks as (select clip_id, case when count(*) >= 3 then stddev_pop(a) else 5e0 end as s from ka where a > 10 group by clip_id),
es as (select clip_id, case when count(*) >= 3 then stddev_pop(a) else 5e0 end as s from ea where a > 10 group by clip_id),
unc as (select facts.clip_id, case when not fell then round(greatest(least(coalesce(ks.s, 5e0) * 1.2e0 * case when visibility < 0.6e0 then 1.5e0 else 1e0 end, 12e0), 3e0), 1) end as knee_unc, case when not fell then round(greatest(least(coalesce(es.s, 5e0) * 1.2e0 * case when visibility < 0.6e0 then 1.5e0 else 1e0 end, 12e0), 3e0), 1) end as elbow_unc from facts left join ks using (clip_id) left join es using (clip_id))"""

CLEAN_BOX = "cleaned as (select * replace (trim(PLAYER_NAME) as PLAYER_NAME) from box where GP >= 5 and trim(PLAYER_NAME) not in ('', 'nan'))"


def vector_of(source: str, keys: str) -> str:
    """v0 to v7 of rows with REB, AST, TOV, FG3_PCT, GP."""
    return f"""(select {keys}, round(greatest(least(5.5e0 + 1.2e0 * g + 2.5e0 * p, 9e0), 4e0), 2) as v0, round(greatest(least(38 + 22 * p, 55e0), 38e0), 1) as v1,
      round(greatest(least(170 - least(2.5e0 * rp, 30e0), 175e0), 135e0), 1) as v2, round(greatest(least(158 + 18 * p, 178e0), 150e0), 1) as v3,
      round(greatest(least(20 - least(6 * g, 12e0), 20e0), 8e0) * 1000 / 30e0, 1) as v4, round(greatest(least(70 + 5 * c + 35 * p, 98e0), 60e0), 1) as v5,
      round(greatest(least(40 * (p - 0.33e0) - 0.5e0 * (rp - 5), 20e0), -20e0), 2) as v6, round(greatest(least(50 + 10 * c, 98e0), 50e0), 1) as v7
      from (select *, REB / greatest(GP, 1) as rp, AST / greatest(GP, 1) / (REB / greatest(GP, 1) + 1) as g, AST / greatest(TOV, 0.1e0) as c, FG3_PCT as p from {source}))"""


PROS = f"pros as {vector_of('cleaned', 'PLAYER_ID, TEAM_ID, PLAYER_NAME')}, refs as (select concat(PLAYER_ID, '_', TEAM_ID) as id, PLAYER_NAME as name, PLAYER_ID as player_id, [{', '.join(f'v{k} * {w}e0' for k, w in enumerate(WEIGHTS))}] as wv, v0, v1, v2, v3, v4, v5, v6, v7 from pros)"
MATCH = f"""
qv as (select *, [{', '.join(f'cast({m} as double) * {w}e0' for m, w in zip(NAMES, WEIGHTS))}] as qw from judged),
pairs as (select clip_id, id, 1 - list_cosine_similarity(qw, wv) as cosine, list_distance(qw, wv) as l2 from qv, refs),
best as (select clip_id, arg_min(id, struct_pack(a := cosine, b := id)) as id, min(cosine) as match_cosine, min(l2) as match_l2 from pairs group by clip_id),
mt as (select q.*, best.id as match_id, refs.name as match_name, refs.player_id, match_cosine, match_l2, v0, v1, v2, v3, v4, v5, v6, v7, round(greatest(0, least(100, 100 - match_cosine * 150)), 1) as base_confidence from qv q join best using (clip_id) join refs on refs.id = best.id),
pen as (select *, case when people > 1 then round(base_confidence * 0.85e0, 1) else base_confidence end as c1 from mt),
matched as (select *, case when len(warnings) > 0 then round(c1 * greatest(0.7e0, 1 - len(warnings) * 0.03e0), 1) else c1 end as confidence from pen)"""


def _tier(c: str) -> str:
    return f"case when {c} < 40 then '$1.2M - Elite Tier' when {c} < 100 then '$450k - D1 Prospect' when {c} < 200 then '$180k - High School Elite' when {c} < 350 then '$45k - Developmental' else '$8k - Amateur' end"


def _r(columns: str, digits: int = 7) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in columns.split())


_POSE = ",".join((X.BASE, X.POSE, X.CLIPS, BOUNDS))
_MAIN = ",".join((_POSE, RANGED, SERIES))
_EV = ",".join((_MAIN, EVENTS))
_RAW = ",".join((_EV, METRICS))
_REC = ",".join((_RAW, RECORD))
_JUDGED = ",".join((_REC, PEOPLE, QUALITY))
_MATCHED = ",".join((_JUDGED, X.BOX, CLEAN_BOX, PROS, MATCH))
_LONG = f"select clip_id, side, joint, f, {_r(' '.join(AXES))} from sm"
_OK = "where n >= 5"
_SPORT = "case when clip_id % 7 = 0 then 'cricket' when clip_id % 5 = 0 then 'tennis' else 'basketball' end"
_UNPIVOT = "(" + " union all ".join(f"select clip_id, fell, '{m}' as metric, cast({m} as double) as value from rec" for m in NAMES) + ")"
_TOL = "case metric when 'release_velocity_mps' then 0.6e0 when 'shot_arc_deg' then 6e0 when 'knee_angle' then 10e0 when 'elbow_angle' then 10e0 when 'kinetic_sync_ms' then 50e0 when 'hip_rotation_deg' then 8e0 else 15e0 end"
_VECTORS = "v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings where embedding is not null), p as (select q.vec_id, i.vec_id as id, 1 - list_cosine_similarity(q.e, i.e) as c, list_distance(q.e, i.e) as l from v q, v i where q.vec_id % 20 = 0 and i.vec_id <> q.vec_id)"
_KNEE = f"ang as (select hip.clip_id, hip.f, {_ang('hip', 'knee', 'ankle')} as angle from act hip join act knee on knee.clip_id = hip.clip_id and knee.f = hip.f and knee.joint = 'knee' join act ankle on ankle.clip_id = hip.clip_id and ankle.f = hip.f and ankle.joint = 'ankle' join sides on sides.clip_id = hip.clip_id where hip.joint = 'hip' and n >= 5)"
_LANDMARK_ROWS = ", ".join(f"('{s}', '{j}', {i})" for j, pair in {"shoulder": (11, 12), "elbow": (13, 14), "wrist": (15, 16), "hip": (23, 24), "knee": (25, 26), "ankle": (27, 28)}.items() for s, i in zip(("left", "right"), pair))
_SEEDS = ", ".join("(" + ", ".join(repr(v) if not isinstance(v, str) else f"'{v}'" for v in row) + ")" for row in SEED_ROWS)
_GAPS = [("arc_gap", "round(v1, 1)", "shot_arc_deg", 45, 1), ("vel_gap", "round(v0, 2)", "release_velocity_mps", 7, 2), ("knee_gap", "round(v2, 1)", "knee_angle", 150, 1), ("elbow_gap", "round(v3, 1)", "elbow_angle", 165, 1), ("fluid_gap", "round_even(v5, 0)", "fluidity_score", 80, 1), ("hip_gap", "round(v6, 2)", "hip_rotation_deg", 5, 1), ("ksync_gap", "round(v4, 1)", "kinetic_sync_ms", 15, 1), ("bal_gap", "round_even(v7, 0)", "balance_index", 80, 1)]
_RUNS = "runs as (select *, clip_id % 10 as cohort, clip_id // 10 as day from rec)"
_FEEDBACK = "case when clip_id % 3 = 0 then 'list' when clip_id % 3 = 1 then 'text' end"

# By shape of the feedback (as in the derived reports): its entries, and what they say.
_SHAPE_COUNT = "[1, 0, 1, 0, 1, 0, 0, 0, 0, 1, 1, 3, 2]"
_SHAPE_TEXT = """['|general|keep going', '', '|general|7.5', '', '|general|true', '', '', '', '', '|general|{{"tempo":"slow"}}', '0:01|form|steady', '|general|a word;-|power|-;|general|3', '|general|[1,2];|general|null']"""

# Sports by rules: events first, then what is read at them.
_ELBOW = f"elb as (select elbow.clip_id, elbow.f, {_ang('shoulder', 'elbow', 'wrist')} as angle from act elbow join act shoulder on shoulder.clip_id = elbow.clip_id and shoulder.f = elbow.f and shoulder.joint = 'shoulder' join act wrist on wrist.clip_id = elbow.clip_id and wrist.f = elbow.f and wrist.joint = 'wrist' join sides on sides.clip_id = elbow.clip_id where elbow.joint = 'elbow' and n >= 5)"
_RULES = f"""
ch0 as (select wr.clip_id, wr.f, wr.n, wr.fps, {_SPORT.replace('clip_id', 'wr.clip_id')} as sport, round(wr.y2, 6) as wrist, round(ang.angle, 6) as knee, round(elb.angle, 6) as elbow from wr join ang using (clip_id, f) join elb using (clip_id, f)),
ch as materialized (select *, round(abs(elbow - coalesce(lag(elbow) over (partition by clip_id order by f), elbow)) * fps, 6) as speed from ch0),
one as (select clip_id, any_value(sport) as sport, any_value(fps) as fps, arg_max(f, struct_pack(a := wrist, b := -f)) as dip, arg_min(f, struct_pack(a := knee, b := f)) as trophy from ch group by clip_id),
two as (select one.clip_id, any_value(one.sport) as sport, any_value(one.fps) as fps, any_value(dip) as dip, any_value(trophy) as trophy,
  arg_min(f, struct_pack(a := wrist, b := f)) filter (f > dip and f <= dip + trunc(one.fps * 1.5e0)) as release, arg_max(f, struct_pack(a := speed, b := -f)) filter (f > trophy) as contact from one join ch using (clip_id) group by one.clip_id),
held as (select two.*, k.knee as knee_dip, e.elbow as elbow_release, t.knee as knee_trophy, c.speed as speed_contact, (select max(wrist) - min(wrist) from ch where ch.clip_id = two.clip_id and ch.f between trophy and contact) as reach
  from two left join ch k on k.clip_id = two.clip_id and k.f = dip left join ch e on e.clip_id = two.clip_id and e.f = release left join ch t on t.clip_id = two.clip_id and t.f = trophy left join ch c on c.clip_id = two.clip_id and c.f = contact)"""
_RULE_ROWS = " union all ".join(
    f"select clip_id, sport, '{kind}' as kind, '{name}' as name, ({value})::double as value from held where (sport = 'tennis') = {tennis}"
    for tennis, kind, name, value in [
        ("false", "event", "dip", "dip"), ("false", "event", "release", "release"), ("false", "metric", "knee_at_dip", "round(knee_dip, 1)"), ("false", "metric", "elbow_at_release", "round(elbow_release, 1)"), ("false", "metric", "lift_ms", "round(round((release - dip) / fps * 1000, 6), 1)"),
        ("true", "event", "trophy", "trophy"), ("true", "event", "contact", "contact"), ("true", "metric", "knee_at_trophy", "round(knee_trophy, 1)"), ("true", "metric", "elbow_speed_at_contact", "round(speed_contact, 1)"), ("true", "metric", "swing_ms", "round(round((contact - trophy) / fps * 1000, 6), 1)"), ("true", "metric", "reach", "round(round(reach, 6), 4)"),
    ]
)

# Releases: the rise to the lower of both sides' highest points, each up to a lower one.
_SHOTS = """
wy as (select clip_id, f, n, fps, round(y2, 6) as y from wr where n >= 5),
lowest as (select clip_id, f, n, fps, y from (select *, lag(y) over k as p, lead(y) over k as q from wy window k as (partition by clip_id order by f)) where y < p and y <= q),
stop_l as (select m.clip_id, m.f, max(o.f) as k from lowest m join wy o on o.clip_id = m.clip_id and o.f < m.f and o.y <= m.y group by all),
stop_r as (select m.clip_id, m.f, min(o.f) as k from lowest m join wy o on o.clip_id = m.clip_id and o.f > m.f and o.y < m.y group by all),
tops as (select m.clip_id, m.f, m.y, any_value(m.fps) as fps, max(case when o.f < m.f then o.y end) as l, max(case when o.f > m.f then o.y end) as r
  from lowest m left join stop_l using (clip_id, f) left join stop_r using (clip_id, f) join wy o on o.clip_id = m.clip_id and o.f > coalesce(stop_l.k, -1) and o.f < coalesce(stop_r.k, 1000000) group by m.clip_id, m.f, m.y),
prom as (select clip_id, f, y, fps, least(l, r) - y as prominence from tops where least(l, r) - y >= 0.08e0),
rel as (select * from prom p where not exists (select 1 from prom o where o.clip_id = p.clip_id and o.f <> p.f and abs(o.f - p.f) < 0.25e0 * p.fps and (o.y < p.y or (o.y = p.y and o.f < p.f)))),
relk as (select *, row_number() over (partition by clip_id order by f) - 1 as shot, lag(f) over (partition by clip_id order by f) as before from rel),
begins as (select r.clip_id, r.shot, r.f, r.prominence, case when before is null then 0 else (select arg_min(w.f, struct_pack(a := -w.y, b := w.f)) from wy w where w.clip_id = r.clip_id and w.f >= r.before and w.f < r.f) end as first_f from relk r),
whole as (select c.clip_id, c.n, coalesce(b.shot, 0) as shot, coalesce(b.first_f, 0) as first_f, b.f as release_f, b.prominence from (select distinct clip_id, n from wy) c left join begins b using (clip_id)),
seg as (select clip_id, shot, first_f::int as first_f, (coalesce(lead(first_f) over (partition by clip_id order by shot), n) - 1)::int as last_f, release_f::int as release_f, prominence from whole)"""
# Each segment as a clip of its own.
_CUT = """
seg_bounds as (select clip_id * 100000 + shot as clip_id, b.fps, b.width, b.height, b.ar from seg join bounds b using (clip_id) where last_f - first_f >= 4),
seg_sm as (select clip_id * 100000 + shot as clip_id, side, joint, (last_f - first_f + 1)::bigint as n, f - first_f as f, x2, case when joint = 'wrist' then round(y2, 6) else y2 end as y2, v2, x3, y3, z3 from sm join seg using (clip_id) where f between first_f and last_f and last_f - first_f >= 4)"""


def _again(*ctes: str) -> str:
    """These steps once more on segments, under names with ``seg_`` before them."""
    text = ",".join(ctes)
    names = {*re.findall(r"^([a-z_0-9]+) as (?:materialized )?\(", text, re.M), "sm", "bounds"}
    return re.sub(r"\b(" + "|".join(sorted(names, key=len, reverse=True)) + r")\b", r"seg_\1", text)


ORACLE: dict[str, str] = {
    "pose_scan": sql(",".join((X.BASE, X.POSE)), f"select clip_id, f, n_people, side, joint, {_r(' '.join(AXES))} from pose_all"),
    "box_scan": sql(",".join((X.BOX, CLEAN_BOX, PROS)), "select id, name, player_id, v0, v1, v2, v3, v4, v5, v6, v7 from refs"),
    "index_write": sql(",".join((X.BOX, CLEAN_BOX, PROS)), "select count(*) as entries, count(distinct id) as ids from refs"),
    "baseline_roundtrip": sql(_REC, f"select clip_id, metric, value as baseline, {_TOL} as tolerance from {_UNPIVOT} where not fell"),
    "match_empty_index": sql(_JUDGED, "select clip_id, '—' as match_name, 999e0 as match_cosine, 999e0 as match_l2, '$8k - Amateur' as tier_cosine, '$8k - Amateur' as tier_l2, 88.5e0 as base_confidence, case when len(warnings) > 0 then round(c * greatest(0.7e0, 1 - len(warnings) * 0.03e0), 1) else c end as confidence from (select *, case when people > 1 then round(88.5e0 * 0.85e0, 1) else 88.5e0 end as c from judged)"),
    "clip_range_filter": sql(_POSE, "select w.clip_id, w.f - lo as f, cast(floor(1000 * w.f / fps) as int) as ms, e from wave w join bounds using (clip_id) where w.f >= lo and w.f < hi"),
    "landmark_select": sql(X.BASE, f"select clip_id, f, side, joint, case when i < size then ((e + i) % 101) / 100e0 end as x, case when i < size then ((e * 3 + i) % 97) / 100e0 end as y, case when i < size then (k % 7) / 10e0 end as z from (select *, case when e % 13 = 0 then 0 when e % 7 = 0 then 20 else 33 end as size from wave) cross join (values {_LANDMARK_ROWS}) as t(side, joint, i)"),
    "frame_sampling_people": sql(",".join((_POSE, PEOPLE)), "select clip_id, people_max, sampled, people_max > 1 as multi_person from ppl"),
    "gap_fill": sql(",".join((_POSE, WHOLE, SERIES)), f"select clip_id, side, joint, f, n, {_r(' '.join(AXES))} from gap"),
    "smooth_series": sql(",".join((_POSE, WHOLE, SERIES)), _LONG),
    "smooth_short": sql(",".join((_POSE, SHORT, SERIES)), _LONG),
    "shooting_side": sql(_EV, f"select clip_id, n, {_r('l_vis r_vis')}, side from sides"),
    "pose_visibility": sql(_REC, f"select clip_id, n, {_r('visibility')} from facts"),
    "dip_release_events": sql(_EV, f"select ev.clip_id, ev.n, side, d as dip, r as release from ev join sides using (clip_id) where ev.n >= 5"),
    "joint_angles": sql(_RAW, f"select clip_id, {_r('raw_knee raw_elbow', 5)} from raw {_OK}"),
    "release_velocity": sql(_RAW, f"select clip_id, {_r('torso power velocity', 5)} from raw {_OK}"),
    "shot_arc": sql(_RAW, f"select clip_id, {_r('lever_arc flight_arc arc', 4)} from raw {_OK}"),
    "hip_rotation": sql(_RAW, f"select clip_id, {_r('twist hip_rotation', 5)} from raw {_OK}"),
    "kinetic_sync": sql(_RAW, f"select clip_id, {_r('sync', 5)} from raw {_OK}"),
    "balance_index": sql(_RAW, f"select clip_id, balance from raw {_OK}"),
    "fluidity": sql(_RAW, f"select clip_id, {_r('jerk', 6)}, fluidity from raw {_OK}"),
    "clip_metrics": sql(_REC, f"select clip_id, status, {', '.join(NAMES)}, knee_angle as knee_flexion_at_dip, elbow_angle as elbow_flexion_at_release, raw_angle_out_of_range from rec"),
    "angle_uncertainty": sql(",".join((_REC, UNCERTAIN)), "select * from unc"),
    "video_quality": sql(_JUDGED, "select clip_id, array_to_string(notes, '; ') as notes, concat(width, '×', height) as resolution, quality_score, quality_label, people from judged"),
    "validation_warnings": sql(_JUDGED, "select clip_id, len(warnings)::int as n_warnings, array_to_string(warnings, '; ') as warnings from judged"),
    "confidence_factors": sql(_JUDGED, """select clip_id, 'video_quality' as factor, -least(20, 60 - quality_score) as impact, concat('Video quality ', quality_score, '/100 — re-record at 720p+, 30 fps') as message from judged where not fell and quality_score < 60
      union all select clip_id, 'multi_person', -15, concat(people, ' people detected — record only the shooter') from judged where not fell and people > 1
      union all select clip_id, 'pose_visibility', -10, 'Low joint visibility — ensure full body and good lighting' from judged where not fell and visibility < 0.5e0
      union all select clip_id, 'validation', -least(15, 4 * len(warnings))::int, concat(len(warnings), ' quality note(s) — see recommendations above') from judged where not fell and len(warnings) > 0"""),
    "telemetry_overlay": sql(_REC, "select ev.clip_id, w.f, round(w.f / ev.fps, 3) as time_sec, round(w.x2, 4) as wrist_x, round(w.y2, 4) as wrist_y, round(a.x2, 4) as ankle_x, round(a.y2, 4) as ankle_y from ev join facts on facts.clip_id = ev.clip_id and not fell join act w on w.clip_id = ev.clip_id and w.joint = 'wrist' and w.f between d and least(ev.n - 1, r + cast(trunc(ev.fps * 1.5) as bigint)) join act a on a.clip_id = w.clip_id and a.joint = 'ankle' and a.f = w.f"),
    "box_to_vector": sql(",".join((X.BOX, CLEAN_BOX, PROS)), "select id, name, player_id, v0, v1, v2, v3, v4, v5, v6, v7 from refs"),
    "seed_fallback": sql(",".join((X.BOX, CLEAN_BOX)), f"select division, PLAYER_NAME, PLAYER_ID, v0, v1, v2, v3, v4, v5, v6, v7 from {vector_of(f'''(select 'all' as division, PLAYER_NAME, PLAYER_ID, REB, AST, TOV, FG3_PCT, GP from cleaned union all select 'none', n, i::bigint, r::double, a::double, t::double, f::double, g::double from (values {_SEEDS}) as s(n, i, r, a, t, f, p, g))''', 'division, PLAYER_NAME, PLAYER_ID')}"),
    "weighted_vectors": sql(_REC, f"select clip_id, {', '.join(f'round(cast({m} as double) * {w}e0, 4) as w{k}' for k, (m, w) in enumerate(zip(NAMES, WEIGHTS)))} from rec"),
    "nn_cosine": sql(_VECTORS, "select vec_id, arg_min(id, struct_pack(a := c, b := id)) as id, round(min(c), 7) as distance from p group by vec_id"),
    "nn_l2": sql(_VECTORS, "select vec_id, arg_min(id, struct_pack(a := l, b := id)) as id, round(min(l), 7) as distance from p group by vec_id"),
    "nn_topk": sql(_VECTORS, "select vec_id, id, round(c, 7) as distance, rank::int as rank from (select *, row_number() over (partition by vec_id order by c, id) as rank from p) where rank <= 3"),
    "match_confidence_tier": sql(_MATCHED, f"select clip_id, match_id, match_name, round(match_cosine, 5) as match_cosine, round(match_l2, 5) as match_l2, {_tier('match_cosine')} as tier_cosine, {_tier('match_l2')} as tier_l2, base_confidence, confidence from matched"),
    "matched_pro": sql(_MATCHED, "select clip_id, match_name, concat('https://img.invalid/', player_id, '.png') as image_url, round(v0, 2) as release_velocity, round(v1, 1) as shot_arc, round(v2, 1) as knee_angle, round(v3, 1) as elbow_angle, round(v4, 1) as kinetic_sync_ms, round_even(v5, 0)::int as fluidity_score, round(v6, 2) as hip_rotation_deg, round_even(v7, 0)::int as balance_index from matched"),
    "metric_deltas": sql(_MATCHED, f"select clip_id, {', '.join(f'round(round({v} - coalesce(nullif(cast({m} as double), 0), {z}), 6), {p}) as {g}' for g, v, m, z, p in _GAPS)} from matched"),
    "report_normalise": sql(",".join((X.BASE, X.CLIPS)), f"select clip_id, case when clip_id % 4 = 0 then '—' else concat('Jump shot ', clip_id) end as athlete_action, case when clip_id % 5 = 0 then '—' else 'solid' end as scout_report, case when clip_id % 5 = 0 then '' else 'swish' end as witty_catchphrase, (case {_FEEDBACK} when 'list' then 2 when 'text' then 1 else 0 end)::int as n_feedback, case {_FEEDBACK} when 'list' then 'form' when 'text' then 'general' end as first_category, case {_FEEDBACK} when 'list' then 'steady' when 'text' then concat('keep going ', clip_id) end as first_observation from clips"),
    "completed_keys": sql(",".join((X.BOX, "numbered as (select * replace (concat('Player_', row_number() over (order by PLAYER_ID) - 1) as PLAYER_NAME, row_number() over (order by PLAYER_ID) - 1 as TEAM_ID) from box)", CLEAN_BOX.replace("from box", "from numbered"), PROS)), "select id, name, player_id, v0, v1, v2, v3, v4, v5, v6, v7 from refs"),
    "fallback_keys": sql(",".join((X.BOX, CLEAN_BOX)), f"select concat(PLAYER_ID, '_', TEAM_ID) as id, PLAYER_NAME as name, PLAYER_ID as player_id, 'all' as division from cleaned union all select concat('fallback_', i, '_', row_number() over (order by i) - 1), n, i, 'none' from (values {_SEEDS}) as s(n, i, r, a, t, f, p, g)"),
    "player_keys": sql(",".join((X.BOX, CLEAN_BOX)), "select concat(PLAYER_ID, '_', TEAM_ID) as id, case when PLAYER_ID % 3 = 2 then PLAYER_ID + 1000 else PLAYER_ID end as player from cleaned"),
    "report_shapes": sql(_MATCHED, f"select clip_id, (case when clip_id % 17 < 2 then 0 else list_extract({_SHAPE_COUNT}, clip_id % 13 + 1) end)::int as n_feedback, case when clip_id % 17 < 2 then '' else list_extract({_SHAPE_TEXT}, clip_id % 13 + 1) end as feedback, '—' as athlete_action, {', '.join(NAMES)}, {_tier('match_cosine')} as market_index from matched"),
    "report_payload": sql(_MATCHED, f"select clip_id, to_json(struct_pack({', '.join(f'{m} := {m}' for m in NAMES)}))::varchar as user_stats, to_json(struct_pack(release_velocity := round(v0, 2), shot_arc := round(v1, 1), knee_angle := round(v2, 1), elbow_angle := round(v3, 1), kinetic_sync_ms := round(v4, 1), fluidity_score := round_even(v5, 0)::int, hip_rotation_deg := round(v6, 2), balance_index := round_even(v7, 0)::int))::varchar as pro_stats, to_json(struct_pack({', '.join(f'{g} := round(round({v} - coalesce(nullif(cast({m} as double), 0), {z}), 6), {p})' for g, v, m, z, p in _GAPS)}))::varchar as deltas from matched"),
    "stream_clips": sql("e as (select user_id, ts, value, case when ts - lag(ts) over k < interval 3 hour then 0 else 1 end as fresh from {events} window k as (partition by user_id order by ts)), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from e)", "select user_id as clip_id, min(ts)::timestamp as started, max(ts)::timestamp + interval 3 hour as ended, count(*) as frames, round(avg(value), 6) as mean_value from s group by user_id, session"),
    "baseline_capture": sql(_REC, f"select clip_id, metric, value as baseline, {_TOL} as tolerance from {_UNPIVOT} where not fell"),
    "drift_check": sql(_REC, f"select clip_id, count(*)::int as n, string_agg(message, '; ' order by metric) as messages from (select clip_id, metric, case when (clip_id + length(metric)) % 11 = 0 then concat(metric, ': missing') when clip_id % 9 > {_TOL} then printf('%s: expected %.2f, got %.2f, tolerance %.2f', metric, value, value + clip_id % 9, {_TOL}) end as message from {_UNPIVOT} where not fell) where message is not null group by clip_id"),
    "sport_lookup": sql(",".join((X.BASE, X.CLIPS)), f"select clip_id, {_SPORT} as sport, case {_SPORT} when 'tennis' then 'Tennis' else 'Basketball' end as name, case {_SPORT} when 'tennis' then 3e0 else 2e0 end as min_clip_sec, (case {_SPORT} when 'tennis' then 4 else 5 end)::int as phases from clips"),
    "sport_metrics_listing": sql(",".join((X.BASE, X.CLIPS)), f"select t.sport, t.name, t.m::bigint as metrics, t.m > 0 as available, coalesce(c.n, 0)::bigint as clips from (values ('basketball', 'Basketball', 8), ('tennis', 'Tennis', 0), ('golf', 'Golf', 0)) as t(sport, name, m) left join (select {_SPORT} as sport, count(*) as n from clips group by 1) c on c.sport = t.sport"),
    "shot_segments": sql(_EV, "select clip_id, shot, min(f)::int as first_f, max(f)::int as last_f, max(case when hit = 1 then f end)::int as release_f from (select clip_id, f, hit, coalesce(sum(hit) over (partition by clip_id order by f rows between unbounded preceding and 1 preceding), 0)::bigint as shot from (select clip_id, f, case when round(y2, 6) < lag(round(y2, 6)) over k and round(y2, 6) <= lead(round(y2, 6)) over k then 1 when lag(y2) over k is null or lead(y2) over k is null then 0 else 0 end as hit from wr where n >= 5 window k as (partition by clip_id order by f))) group by clip_id, shot"),
    "sport_rules": sql(",".join((_EV, _KNEE, _ELBOW, _RULES)), f"select * from ({_RULE_ROWS})"),
    "shot_releases": sql(",".join((_EV, _SHOTS)), "select clip_id, shot::int as shot, first_f, last_f, release_f, round(prominence, 6) as prominence from seg"),
    "shot_metrics": sql(",".join((_EV, _SHOTS, _CUT, _again(EVENTS, METRICS))), "select s.clip_id, s.shot::int as shot, first_f, last_f, d.side, r.d::int as dip, r.r::int as release, round(raw_knee, 4) as raw_knee, round(raw_elbow, 4) as raw_elbow, round(velocity, 4) as velocity, round(arc, 4) as arc, round(hip_rotation, 4) as hip_rotation, round(sync, 4) as sync, balance, fluidity from seg_raw r join seg s on r.clip_id = s.clip_id * 100000 + s.shot join seg_sides d on d.clip_id = r.clip_id"),
    "subject_rank": sql(X.BASE, "select clip_id, subject, size, centre_x, round(score, 7) as score from (select *, row_number() over (partition by clip_id order by score desc, subject) as place from (select clip_id, e as subject, k / 100e0 as size, (e % 101) / 100e0 as centre_x, k / 100e0 * (1 - 2 * abs((e % 101) / 100e0 - 0.5e0)) as score from wave)) where place = 1"),
    "angle_jumps": sql(",".join((_EV, _KNEE)), "select clip_id, f::int as f, round(angle, 5) as angle, round(jump, 5) as jump from (select *, abs(angle - lag(angle) over (partition by clip_id order by f)) as jump from ang) where jump > 15"),
    "run_repeat": sql(",".join((_REC, "seg_bounds as (select * from bounds), seg_sm as (select clip_id, side, joint, n, f, x2, y2, v2, x3, y3, z3 from gap)", _again(EVENTS, METRICS, RECORD))), " union all ".join(f"select a.clip_id, '{m}' as metric, 3::bigint as runs, 2::bigint as settings, round(sqrt(2e0) / 3 * abs(a.{m} - b.{m}::double), 6) as spread, 0e0 as same from rec a join seg_rec b using (clip_id)" for m in NAMES)),
    "run_stddev": sql(",".join((_REC, _RUNS)), f"select cohort, count(*) as runs, {', '.join(f'round(stddev_pop(cast({m} as double)), 6) as {m}' for m in NAMES)} from runs group by cohort"),
    "truth_mae": sql(",".join((_POSE, WHOLE, SERIES)), "select concat(s.side, '_', s.joint) as joint, round(avg((abs(s.x2 - p.x2) + abs(s.y2 - p.y2)) / 2), 6) as mae, count(*) as frames from sm s join pose p on p.clip_id = s.clip_id and p.side = s.side and p.joint = s.joint and p.f = s.f where p.x2 is not null group by 1"),
    "expert_corr": sql(",".join((_REC, _RUNS)), "select round(corr(knee_angle, elbow_angle), 6) as knee_elbow, round(corr(balance_index, hip_rotation_deg), 6) as balance_hip from runs where status = 'ok'"),
    "benchmark_prf": sql(",".join((_REC, _RUNS)), "select tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::double, 7) as accuracy, round(tp / nullif(tp + fp, 0)::double, 7) as precision, round(tp / nullif(tp + fn, 0)::double, 7) as recall from (select count(*) filter (knee_angle > 140 and clip_id % 3 = 0) as tp, count(*) filter (knee_angle > 140 and clip_id % 3 <> 0) as fp, count(*) filter (not knee_angle > 140 and clip_id % 3 = 0) as fn, count(*) filter (not knee_angle > 140 and clip_id % 3 <> 0) as tn from runs)"),
    "metric_trend": sql(",".join((_REC, _RUNS)), "select cohort, round(regr_slope(knee_angle, day), 5) as slope, round(arg_max(moving, day), 5) as last_moving, count(*) as points from (select *, avg(knee_angle) over (partition by cohort order by day rows between 2 preceding and current row) as moving from runs) group by cohort"),
    "cohort_percentile": sql(",".join((_REC, _RUNS)), "select clip_id, cohort, knee_angle, round(percent_rank() over (partition by cohort order by knee_angle), 6) as percent_rank from runs"),
    "norm_merge": sql(",".join((_REC, _RUNS)), f"select cohort, count(*) as clips, {', '.join(f'quantile_disc(knee_angle, {q}) as p{round(100 * q)}' for q in (0.25, 0.5, 0.9))}, round(count(*) filter (knee_angle <= 145) / count(*)::double, 5) as rank_145, round(case when min(day) < max(day) then regr_slope(knee_angle, day) end, 5) as slope from runs group by cohort"),
    "ideal_range": sql(_REC, f"select metric, count(*) as clips, sum(case when value between low and high then 1 else 0 end)::bigint as inside from {_UNPIVOT} join (values ('release_velocity_mps', 7, 9), ('shot_arc_deg', 45, 55), ('knee_angle', 140, 165), ('elbow_angle', 165, 178), ('hip_rotation_deg', 5, 15), ('kinetic_sync_ms', 120, 250), ('balance_index', 85, 99), ('fluidity_score', 75, 99)) as t(metric, low, high) using (metric) group by metric"),
    "confidence_tiers": sql(_MATCHED, "select case when confidence >= 80 then 'High' when confidence >= 50 then 'Medium' else 'Low' end as tier, count(*) as clips from matched group by 1"),
    "phase_labels": sql(_EV, "select wr.clip_id, wr.f::int as f, case when wr.f < d then 'Setup' when wr.f = d then 'Dip' when wr.f < r then 'Drive' when wr.f = r then 'Release' else 'Follow-through' end as phase from wr join ev on ev.clip_id = wr.clip_id where wr.n >= 5"),
    "key_frames": sql(_EV, "select act.clip_id, key, case when key = 'release' then arg_min(f, struct_pack(a := round(y2, 6), b := f)) else arg_min(f, struct_pack(a := -round(y2, 6), b := f)) end::int as f from act join sides using (clip_id) join (values ('dip', 'wrist'), ('release', 'wrist'), ('bend', 'knee')) as t(key, joint) using (joint) where n >= 5 group by act.clip_id, key"),
    "stream_metrics": sql(_MATCHED, f"select m.clip_id, c.total_frames as frames, status, {', '.join(NAMES)}, people::int as people, len(warnings)::int as n_warnings, quality_score, quality_label, match_id, match_name, round(match_cosine, 5) as match_cosine, round(match_l2, 5) as match_l2, {_tier('match_cosine')} as tier_cosine, {_tier('match_l2')} as tier_l2, confidence from matched m join clips c using (clip_id)"),
}
