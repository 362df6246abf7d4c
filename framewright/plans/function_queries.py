"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import rotations as R, text as X, vectors as V
from framewright.operators import sampling as T, windows as W
from framewright.plans.registry import query
from framewright.plans.views import episodes_ev, ev, frames_ev, frames_li, li, table, vec, vectors


def r6(c):
    return F.transform(c, lambda v: F.round(v, 6) + 0.0)


def r12(c):
    return F.transform(c, lambda v: F.round(v, 12))


_ST = {"mean": [25.0, 36000.0, 0.05, 0.04], "std": [14.0, 24000.0, 0.03, 0.025], "min": [1.0, 900.0, 0.0, 0.0], "max": [50.0, 105000.0, 0.1, 0.08], "q01": [1.0, 1000.0, 0.0, 0.0], "q99": [50.0, 100000.0, 0.1, 0.08], "q10": [5.0, 5000.0, 0.0, 0.02], "q90": [45.0, 80000.0, 0.1, 0.02]}
_I = "for i in [1, 2, 3, 4]"


def _norm(expr: str) -> str:
    return li(f"select episode_index, frame_index, [round({expr}, 6) + 0.0 {_I}] as v from frames_li")


def _li(spark, sf, v):
    return frames_li(spark, sf).select("episode_index", "frame_index", r6(v).alias("v"))


@query(_norm(f"(state[i] - {_ST['mean']}[i]) / ({_ST['std']}[i] + 1e-8)"))
def f01_normalized_mean_std(spark, sf):
    return _li(spark, sf, V.normalized(F.col("state"), "MEAN_STD", _ST))


@query(_norm(f"2 * (state[i] - {_ST['q10']}[i]) / case when {_ST['q90']}[i] = {_ST['q10']}[i] then 1e-8 else {_ST['q90']}[i] - {_ST['q10']}[i] end - 1"))
def f01_normalized_quantile10(spark, sf):
    """By 6 digits, as the other modes: prices by cents over a range of 75,000 end in ties of 3 digits, which doubles decide by chance, but in none of 4 or more."""
    return _li(spark, sf, V.normalized(F.col("state"), "QUANTILE10", _ST))


@query(_norm("state[i]"))
def f01_normalize_round_trip(spark, sf):
    out = F.col("state")
    for mode in ("MIN_MAX", "QUANTILES", "MEAN_STD"):
        out = V.normalized(V.normalized(out, mode, _ST), mode, _ST, inverse=True)
    return frames_li(spark, sf).withColumn("state", out).select("episode_index", "frame_index", F.transform("state", lambda v: F.round(v, 4)).alias("v"))


@query(li("select episode_index, frame_index, [round((state[1] - 25.0) / (14.0 + 1e-8), 6)] as a, [state[2]] as b from frames_li"))
def f02_normalized_selected(spark, sf):
    f = frames_li(spark, sf).select("episode_index", "frame_index", F.slice("state", 1, 1).alias("a"), F.slice("state", 2, 1).alias("b"))
    out = f.withColumns(V.normalized_columns({"a": ("MEAN_STD", {"mean": [25.0], "std": [14.0]}), "b": ("IDENTITY", {})}))
    return out.withColumn("a", r6(F.col("a")))


@query(_norm(f"2 * (greatest({_ST['q10']}[i], least({_ST['q90']}[i], state[i])) - {_ST['q10']}[i]) / greatest({_ST['q90']}[i] - {_ST['q10']}[i], 1e-8) - 1"))
def f03_clip_normalized(spark, sf):
    return _li(spark, sf, V.clip_normalized(F.col("state"), "QUANTILE10", _ST))


@query(_norm(f"case when {_ST['q90']}[i] = {_ST['q10']}[i] then 0.0 else 2 * (state[i] - {_ST['q10']}[i]) / ({_ST['q90']}[i] - {_ST['q10']}[i]) - 1 end"))
def f04_masked_min_max(spark, sf):
    return _li(spark, sf, V.masked_min_max(F.col("state"), _ST["q10"], _ST["q90"]))


@query(_norm("case when i in (1, 3) then state[i] - state[5 - i] else state[i] end"))
def f05_delta_transform(spark, sf):
    return _li(spark, sf, V.delta(F.col("state"), F.reverse("state"), (0, 2)))


@query(vec("select vec_id, [round(x, 6) + 0.0 for x in state[1:6] || state[8:23]] as v from vectors"))
def f06_selected_dims(spark, sf):
    return vectors(spark, sf).select("vec_id", r6(V.selected_dims(F.col("state"), "0:6,7:23")).alias("v"))


@query(ev("select index, [round(greatest(0.0, 1 - abs((greatest(-1.0, least(0.0, pred_value)) + 1) * 10 - i)), 6) for i in range(11)] as v from frames_ev"))
def f07_two_hot(spark, sf):
    return frames_ev(spark, sf).select("index", r6(V.two_hot(F.col("pred_value"), [-1 + i / 10 for i in range(11)])).alias("v"))


@query(vec(", e as (select vec_id, [exp(x - list_max(state)) for x in state] as e from vectors) select vec_id, round(list_sum([e[i] * (-1 + (i - 1) / 63) for i in range(1, 65)]) / list_sum(e), 6) as v from e"))
def f08_expected_value(spark, sf):
    return vectors(spark, sf).select("vec_id", F.round(V.expected_value(F.col("state"), [-1 + i / 63 for i in range(64)]), 6).alias("v"))


@query(vec("select vec_id, [case when x < -1 then -1 else least(255, floor((x + 1) / 2 * 256)) end::bigint for x in state] as bins from vectors"))
def f09_discretized(spark, sf):
    return vectors(spark, sf).select("vec_id", V.discretized(F.col("state")).alias("bins"))


@query("select conv_id, turn, 'Task: ' || translate(trim(text), '_' || chr(10), '  ') || ', State: 0 ' || turn || ';' || chr(10) || 'Action: ' as prompt from conversations")
def f10_state_prompt(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", X.state_prompt(F.col("text"), F.array(F.lit(0).cast("long"), F.col("turn"))).alias("prompt"))


@query("select conv_id, turn, case when role = 'user' then '' else text || chr(10) end || 'Advantage: ' || case when turn % 2 = 1 then 'positive' else 'negative' end as tagged from conversations")
def f11_advantage_tag(spark, sf):
    task = F.when(F.col("role") == "user", F.lit(None).cast("string")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", X.advantage_tag(task, F.col("turn") % 2 == 1).alias("tagged"))


@query("select d.doc_id, text || case when d.doc_id % 10 < 3 then '' else chr(10) || 'Advantage: ' || case when quality = 1 then 'positive' else 'negative' end end as tagged from documents d join labels l on d.doc_id = l.doc_id where quality in (0, 1)")
def f12_tag_with_dropout(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").where("quality in (0, 1)"), "doc_id")
    return d.select("doc_id", X.tag_with_dropout(F.col("text"), F.col("quality"), (F.col("doc_id") % 10) / 10, 0.3).alias("tagged"))


@query("select conv_id, turn, case when text like '%' || chr(10) then text else text || chr(10) end as a, case when text like '%.' then text else text || '.' end as b, regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g') as c from conversations")
def f13_task_text(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", X.ends_with_newline(t).alias("a"), X.ends_with_period(t).alias("b"), X.plain_words(t).alias("c"))


@query(ev(""", d as (select *, coalesce(lead(x, 7) over w, last_value(x) over (w rows between unbounded preceding and unbounded following)) - x as d from frames_ev window w as (partition by episode_index order by frame_index)),
w as (select index, episode_index, case when d > 100 then 1.0 when d < 0 then 0.0 else greatest(0.0, least(1.0, (d - (10.0 - 2 * 50.0)) / (4 * 50.0 + 1e-6))) end as w from d)
select index, round(w * count(*) over (partition by episode_index) / (sum(w) over (partition by episode_index) + 1e-6), 6) as weight from w"""))
def f17_sample_weights(spark, sf):
    from pyspark.sql import Window

    f = frames_ev(spark, sf).withColumn("d", W.look_ahead_delta("x", 7))
    f = f.withColumn("w", V.sample_weight(F.col("d"), 100.0, F.lit(10.0), F.lit(50.0)))
    batch = Window.partitionBy("episode_index")
    return f.select("index", F.round(F.col("w") * F.count("*").over(batch) / (F.sum("w").over(batch) + 1e-6), 6).alias("weight"))


@query(ev("select index, round(greatest(0.0, least(1.0, (frame_index - 10) / 20)), 6) as tau from frames_ev"))
def f18_relative_position(spark, sf):
    return frames_ev(spark, sf).select("index", F.round(V.relative_position(F.col("frame_index"), F.lit(10), F.lit(30)), 6).alias("tau"))


@query(ev("select index, round([0.0, 0.2, 0.7][1 + frame_index % 3] + (frame_index % 10) / 10 * [0.2, 0.5, 0.3][1 + frame_index % 3], 6) as progress from frames_ev"))
def f19_stage_progress(spark, sf):
    p = V.stage_progress((F.col("frame_index") % 3).cast("int"), (F.col("frame_index") % 10) / 10, [2.0, 5.0, 3.0])
    return frames_ev(spark, sf).select("index", F.round(p, 6).alias("progress"))


@query(ev("select episode_index, lpad((length // 60)::varchar, 2, '0') || ':' || lpad((length % 60)::varchar, 2, '0') as clock, length * 10 as frame from episodes_ev"))
def f20_clock_times(spark, sf):
    e = episodes_ev(spark, sf).select("episode_index", X.clock(F.col("length")).alias("clock"))
    return e.select("episode_index", "clock", X.frame_of(F.col("clock"), 10).alias("frame"))


@query(ev("select episode_index, 'task' as name, '00:' || lpad((length // 10)::varchar, 2, '0') as \"end\", length - 1 as end_frame from episodes_ev"))
def f21_default_annotation(spark, sf):
    e = episodes_ev(spark, sf).select("episode_index", F.explode(X.default_annotation(F.col("length"), 10)).alias("a"))
    return e.select("episode_index", "a.name", "a.end", "a.end_frame")


@query(li("select episode_index, frame_index, sqrt(state[3]^2 + state[4]^2) > 0.08 as enabled, round(state[3] * 0.5, 6) as dx from frames_li"))
def f22_delta_action(spark, sf):
    f = frames_li(spark, sf).withColumn("d", V.delta_action(F.slice("state", 3, 2), 0.5, 0.08))
    return f.select("episode_index", "frame_index", "d.enabled", F.round(F.col("d.scaled")[0], 6).alias("dx"))


@query(li("select episode_index, frame_index, case when (state[1] / 50 < 0.5 and state[3] * 10 > 0.5) or (state[1] / 50 > 0.75 and state[3] * 10 < 0.5) then -0.02 else 0.0 end::double as penalty from frames_li"))
def f23_gripper_penalty(spark, sf):
    return frames_li(spark, sf).select("episode_index", "frame_index", V.gripper_penalty(F.col("state")[0], F.col("state")[2] * 10, 50.0, -0.02).alias("penalty"))


@query(ev("select index, case when is_intervention > 0 then pred_value else x end as action, label = 'view' or label = 'purchase' as done, case when label = 'purchase' then 1.0 else 0.0 end::double as reward from frames_ev"))
def f24_intervention_override(spark, sf):
    s = V.intervened(F.col("is_intervention") > 0, F.col("pred_value"), F.col("x"), F.col("label") == "view", F.col("label") == "purchase")
    return frames_ev(spark, sf).select("index", s.alias("s")).select("index", "s.*")


@query(ev("select index, case when abs(-pred_value - 1) <= 0.01 then 1.0 else x end as reward, abs(-pred_value - 1) <= 0.01 or label = 'view' as done from frames_ev"))
def f25_classifier_reward(spark, sf):
    s = V.classifier_reward(-F.col("pred_value"), F.col("x"), F.col("label") == "view")
    return frames_ev(spark, sf).select("index", s.alias("s")).select("index", "s.*")


@query(ev("select index, case when frame_index > 5 and is_intervention > 0 then 'human' when frame_index % 2 = 0 then 'policy' else 'human' end as collector from frames_ev"))
def f26_collector(spark, sf):
    return frames_ev(spark, sf).select("index", X.collector(F.col("frame_index") > 5, F.col("is_intervention") > 0, F.col("frame_index") % 2 == 0, "policy", "human").alias("collector"))


_Q = "[state[i] / sqrt(list_sum([y * y for y in state[4:7]])) for i in [4, 5, 6, 7]]"
#: v rotated by q = (u, w): v + 2 u x (u x v + w v)
_ROTATED = """, q as (select vec_id, state[1:3] as v, {q} as q from vectors),
t as (select *, [q[2] * v[3] - q[3] * v[2] + q[4] * v[1], q[3] * v[1] - q[1] * v[3] + q[4] * v[2], q[1] * v[2] - q[2] * v[1] + q[4] * v[3]] as t from q),
r as (select vec_id, q, [v[1] + 2 * (q[2] * t[3] - q[3] * t[2]), v[2] + 2 * (q[3] * t[1] - q[1] * t[3]), v[3] + 2 * (q[1] * t[2] - q[2] * t[1])] as r, v from t)""".replace("{q}", _Q)


@query(vec(f"{_ROTATED} select vec_id, [round(round(x, 12), 6) + 0.0 for x in r] as rotated, [round(round(x, 12), 6) + 0.0 for x in v] as back from r"))
def f27_rotation_round_trip(spark, sf):
    """Rotated by a quaternion made of other numbers, through a matrix and a rotation vector, and back by its inverse.

    Both by 12 digits before 6, or the way's rounding errors would decide numbers that end in a tie, such as 1/128.
    """
    q = R.unit(F.slice("state", 4, 4))
    again = R.quat_of_rotvec(R.rotvec_of_quat(R.quat_of_matrix(R.matrix_of_quat(q))))
    v = vectors(spark, sf).select("vec_id", F.slice("state", 1, 3).alias("v"), again.alias("q"))
    v = v.withColumn("r", R.applied(F.col("q"), F.col("v")))
    return v.select("vec_id", r6(r12(F.col("r"))).alias("rotated"), r6(r12(R.applied(R.inverse(F.col("q")), F.col("r")))).alias("back"))


@query(vec(""", q as (select vec_id, {q} as q, [state[i] / sqrt(list_sum([y * y for y in state[8:11]])) for i in [8, 9, 10, 11]] as p from vectors)
select vec_id, [round(x, 6) + 0.0 for x in [p[4] * q[1] + p[1] * q[4] + p[2] * q[3] - p[3] * q[2], p[4] * q[2] + p[2] * q[4] + p[3] * q[1] - p[1] * q[3], p[4] * q[3] + p[3] * q[4] + p[1] * q[2] - p[2] * q[1],
  p[4] * q[4] - p[1] * q[1] - p[2] * q[2] - p[3] * q[3]]] as composed from q""".replace("{q}", _Q)))
def f27_rotation_composed(spark, sf):
    q = vectors(spark, sf).select("vec_id", R.unit(F.slice("state", 4, 4)).alias("q"), R.unit(F.slice("state", 8, 4)).alias("p"))
    return q.select("vec_id", r6(R.composed(F.col("p"), F.col("q"))).alias("composed"))


@query(vec("""select vec_id, [round(q[i] * 2 * acos(greatest(-1.0, least(1.0, q[4]))) / sqrt(1 - q[4] * q[4]), 6) + 0.0 for i in [1, 2, 3]] as axis_angle
from (select vec_id, [state[i] / sqrt(list_sum([y * y for y in state[1:4]])) for i in [1, 2, 3, 4]] as q from vectors)"""))
def f28_quat_to_axis_angle(spark, sf):
    q = vectors(spark, sf).select("vec_id", R.unit(F.slice("state", 1, 4)).alias("q"))
    return q.select("vec_id", r6(R.axis_angle_of_quat(F.col("q"))).alias("axis_angle"))


@query(vec(""", a as (select vec_id, [x / sqrt(list_sum([y * y for y in state[1:3]])) for x in state[1:3]] as a, state[4:6] as s from vectors),
b as (select vec_id, a, [s[i] - a[i] * (a[1] * s[1] + a[2] * s[2] + a[3] * s[3]) for i in [1, 2, 3]] as b from a),
u as (select vec_id, a, [x / sqrt(b[1] * b[1] + b[2] * b[2] + b[3] * b[3]) for x in b] as b from b)
select vec_id, [round(x, 6) + 0.0 for x in list_concat(a, b)] as six, [round(x, 6) + 0.0 for x in [a[2] * b[3] - a[3] * b[2], a[3] * b[1] - a[1] * b[3], a[1] * b[2] - a[2] * b[1]]] as third, case when a[1] > 0.5 then 1.0 else -1.0 end::double as grip from u"""))
def f28_six_to_matrix(spark, sf):
    m = vectors(spark, sf).select("vec_id", R.matrix_of_six(F.slice("state", 1, 6)).alias("m"))
    return m.select("vec_id", r6(R.six_of_matrix(F.col("m"))).alias("six"), r6(F.transform("m", lambda r: r[2])).alias("third"), R.binary_gripper(F.col("m")[0][0]).alias("grip"))


@query(vec(f", q as (select vec_id, state, {_Q} as q from vectors) select vec_id, [round(x, 6) + 0.0 for x in list_concat(state[1:3], [q[i] * 2 * acos(greatest(-1.0, least(1.0, q[4]))) / sqrt(1 - q[4] * q[4]) for i in [1, 2, 3]], state[8:8])] as pose from q"))
def f29_pose_state(spark, sf):
    s = R.pose_state(F.slice("state", 1, 3), R.unit(F.slice("state", 4, 4)), F.slice("state", 8, 1))
    return vectors(spark, sf).select("vec_id", r6(s).alias("pose"))


@query(ev("select index, x as \"a/x\", label as \"a/b/label\" from frames_ev"))
def f30_flattened(spark, sf):
    nested = frames_ev(spark, sf).select("index", F.struct("x", F.struct("label").alias("b")).alias("a"))
    flat = nested.select(V.flattened(nested.schema))
    again = flat.select(V.unflattened(flat.columns))
    return again.select(V.flattened(again.schema))


@query(li("select episode_index, frame_index, [round(0.7 * s + 0.3 * t, 6) for s, t in list_zip(state, list_reverse(state))] as v from frames_li".replace("[round(0.7 * s + 0.3 * t, 6) for s, t in list_zip(state, list_reverse(state))]", f"[round(0.7 * state[i] + 0.3 * state[5 - i], 6) {_I}]")))
def f31_overlap_combine(spark, sf):
    from framewright.operators.matching import combined

    return _li(spark, sf, combined("conservative", F.col("state"), F.reverse("state")))


@query(vec("select a.vec_id, sqrt(list_sum([(a.state[i] - b.state[i]) ^ 2 for i in range(1, 65)])) < 11 as similar from vectors a join vectors b on a.episode_index = b.episode_index and b.frame_index = a.frame_index + 1"))
def f32_similar_observations(spark, sf):
    v = vectors(spark, sf)
    b = v.select("episode_index", (F.col("frame_index") - 1).alias("frame_index"), F.col("state").alias("next"))
    return v.join(b, ["episode_index", "frame_index"]).select("vec_id", V.similar(F.col("state"), F.col("next"), 11.0).alias("similar"))


@query(li("select episode_index, frame_index, frame_index + i - 1 as timestep, round(frame_index / 10 + (i - 1) * 0.02, 6) as timestamp, state[i] as action from frames_li, (values (1), (2), (3), (4)) t(i)"))
def f33_timed_chunk(spark, sf):
    f = frames_li(spark, sf).select("episode_index", "frame_index", F.explode(V.timed_chunk(F.col("frame_index") / 10, F.col("frame_index"), F.col("state"), 0.02)).alias("c"))
    return f.select("episode_index", "frame_index", "c.timestep", F.round("c.timestamp", 6).alias("timestamp"), "c.action")


@query(ev(", m as (select min(length) as lo, max(length) as hi from episodes_ev) select index, round(pred_value * greatest(1.0, least(hi / length, hi / lo)) * 2 + 1, 6) as v from frames_ev join episodes_ev using (episode_index), m"))
def f34_curve_rescaled(spark, sf):
    e = episodes_ev(spark, sf).select("episode_index", "length")
    m = e.agg(F.min("length").alias("lo"), F.max("length").alias("hi"))
    f = frames_ev(spark, sf).join(e, "episode_index").crossJoin(F.broadcast(m))  # one row
    return f.select("index", F.round(V.curve_rescaled(F.col("pred_value"), F.col("length"), F.col("lo"), F.col("hi")), 6).alias("v"))


@query(li("select episode_index, frame_index, case when frame_index = 2 then 0.0 else state[1] end as v from frames_li"))
def f35_first_scalar(spark, sf):
    v = F.when(F.col("frame_index") == 2, F.array().cast("array<double>")).otherwise(F.col("state"))
    return frames_li(spark, sf).select("episode_index", "frame_index", V.first_scalar(v).alias("v"))


@query(ev("select index, x as \"observation.value\", 3 as domain_id from frames_ev"))
def f36_domain_id(spark, sf):
    return frames_ev(spark, sf).select("index", "x").withColumnsRenamed({"x": "observation.value"}).withColumn("domain_id", F.lit(3))


@query(vec("select vec_id, [[[round(state[1 + c + 2 * (w + 4 * h)] / 255, 6) + 0.0 for w in range(4)] for h in range(8)] for c in range(2)] as image from vectors"))
def f37_scaled_pixels(spark, sf):
    hwc = F.array(*[F.array(*[F.slice("state", 1 + 2 * (w + 4 * h), 2) for w in range(4)]) for h in range(8)])
    v = vectors(spark, sf).select("vec_id", V.pixels_scaled(hwc).alias("image"))
    return v.select("vec_id", F.transform("image", lambda c: F.transform(c, lambda r: F.transform(r, lambda x: F.round(x, 6) + 0.0))).alias("image"))


@query("select conv_id, turn, case when role = 'assistant' then text when turn > 2 then role else 'go' end as instruction from conversations")
def f38_chosen_instruction(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", X.chosen_instruction(F.when(F.col("role") == "assistant", F.col("text")).otherwise(""), F.when(F.col("turn") > 2, F.col("role")), default=F.lit("go")).alias("instruction"))


@query(ev("select index, 'at <point>[' || least(99, round_even(frame_index * 0.5, 0))::bigint || ', ' || least(49, round_even(frame_index * 7 * 0.25, 0))::bigint || ']</point> then <point>[x]</point>' as text from frames_ev"))
def f39_rescaled_points(spark, sf):
    t = F.concat(F.lit("at <point>["), F.col("frame_index").cast("string"), F.lit(", "), (F.col("frame_index") * 7).cast("string"), F.lit("]</point> then <point>[x]</point>"))
    return frames_ev(spark, sf).select("index", X.rescaled_points(t, (200, 200), (50, 100)).alias("text"))


@query("select conv_id, turn, 'top view: <image>' || chr(10) || 'wrist: <image>' || chr(10) || 'Instruction: ' || text || chr(10) || 'Actions: <action><action><action>' as prompt from conversations")
def f40_camera_prompt(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.camera_prompt(F.col("text"), ["observation.top_view", "observation.wrist"], 3).alias("prompt"))


@query(_norm("case when i = 1 then 0.0 when i = 3 then 1 / (1 + exp(-state[i])) else state[i] end"))
def f41_squashed_dims(spark, sf):
    return _li(spark, sf, V.squashed(F.col("state"), (0,), (2,)))


@query(li("select episode_index, frame_index, state || [0.0, 0.0] as v, [true, true, true, true, false, false] as real from frames_li"))
def p20_padded_vector(spark, sf):
    return frames_li(spark, sf).select("episode_index", "frame_index", V.padded(F.col("state"), 6).alias("v"), V.real_dims(F.col("state"), 6).alias("real"))
