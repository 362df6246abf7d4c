"""Queries of per-episode windows, joins and sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window, functions as F

from framewright.operators import matching as M, sampling as T, windows as W
from framewright.plans.registry import query
from framewright.plans.views import episodes_ev, ev, frames_ev, frames_gap, frames_li, gap, li, table, vec, vectors

_W = "window w as (partition by episode_index order by frame_index)"


@query(ev(f"""select index, [coalesce(lag(x, 2) over w, first_value(x) over w), x, coalesce(lead(x, 3) over w, last_value(x) over (w rows between unbounded preceding and unbounded following))] as win,
  [lag(index, 2) over w is null, false, lead(index, 3) over w is null] as win_is_pad from frames_ev {_W}"""))
def w01_offset_window(spark, sf):
    return W.offset_window(frames_ev(spark, sf), "x", W.offsets_of([-0.2, 0.0, 0.3], 10), "win").select("index", "win", "win_is_pad")


@query(ev(f"select index, [coalesce(lag(x, 2) over w, lag(x, 1) over w, x), coalesce(lag(x, 1) over w, x), x, coalesce(lead(x, 1) over w, x), coalesce(lead(x, 3) over w, lead(x, 1) over w, x)] as win from frames_ev {_W}"))
def w02_nearest_offset_window(spark, sf):
    return W.nearest_offset_window(frames_ev(spark, sf), "x", [-2, -1, 0, 1, 3], "win").select("index", "win")


@query(ev("select index, [greatest(dataset_from_index, least(dataset_to_index - 1, index + d)) for d in [-6, -3, 0, 3, 6]] as at, [index + d < dataset_from_index or index + d >= dataset_to_index for d in [-6, -3, 0, 3, 6]] as pad from frames_ev join episodes_ev using (episode_index)"))
def w10_strided_windows(spark, sf):
    f = frames_ev(spark, sf).join(episodes_ev(spark, sf).select("episode_index", "dataset_from_index", "dataset_to_index"), "episode_index")
    i = f.select("index", W.clamped_indices(F.col("index"), F.col("dataset_from_index"), F.col("dataset_to_index"), W.strided_offsets(4, 3)).alias("i"))
    return i.select("index", F.col("i.index").alias("at"), F.col("i.is_pad").alias("pad"))


@query(ev("select f.index, g.index as at, round(g.x, 6) as x from frames_ev f join episodes_ev e using (episode_index) join frames_ev g on g.index = greatest(dataset_from_index, least(dataset_to_index - 1, f.index + 40))"))
def j05_clamped_offset_lookup(spark, sf):
    f = frames_ev(spark, sf)
    e = episodes_ev(spark, sf).select("episode_index", "dataset_from_index", "dataset_to_index")
    at = f.select("index", "episode_index").join(e, "episode_index").select("index", F.greatest("dataset_from_index", F.least(F.col("dataset_to_index") - 1, F.col("index") + 40)).alias("at"))
    return at.join(f.select(F.col("index").alias("at"), F.round("x", 6).alias("x")), "at")


@query(ev(f"select index, round(coalesce(lead(x, 7) over w, last_value(x) over (w rows between unbounded preceding and unbounded following)) - x, 6) as delta from frames_ev {_W}"))
def w11_look_ahead_delta(spark, sf):
    return frames_ev(spark, sf).select("index", F.round(W.look_ahead_delta("x", 7), 6).alias("delta"))


@query(ev(f", d as (select coalesce(lead(x, 7) over w, last_value(x) over (w rows between unbounded preceding and unbounded following)) - x as d from frames_ev {_W}) select round(greatest(0.0, avg(d)), 6) as mean, round(greatest(1e-6, stddev_pop(d)), 6) as std from d"))
def a17_delta_statistics(spark, sf):
    d = frames_ev(spark, sf).select(W.look_ahead_delta("x", 7).alias("d"))
    return d.agg(F.round(F.greatest(F.lit(0.0), F.avg("d")), 6).alias("mean"), F.round(F.greatest(F.lit(1e-6), F.stddev_pop("d")), 6).alias("std"))


@query(ev("select index, [greatest(dataset_from_index, index - 4 - j * 2) for j in range(1, 4)] as at from frames_ev join episodes_ev using (episode_index)"))
def w12_rewind_indices(spark, sf):
    f = frames_ev(spark, sf).join(episodes_ev(spark, sf).select("episode_index", "dataset_from_index"), "episode_index")
    return f.select("index", W.rewind_indices(F.col("index"), F.col("dataset_from_index"), 4, F.lit(3), 2).alias("at"))


@query(ev(""", k as (select *, case when frame_index % 5 = 2 then x end as y from frames_ev),
b as (select *, last_value(case when y is not null then frame_index end ignore nulls) over (w rows unbounded preceding) as fa, last_value(y ignore nulls) over (w rows unbounded preceding) as ya,
  first_value(case when y is not null then frame_index end ignore nulls) over (w rows between current row and unbounded following) as fb, first_value(y ignore nulls) over (w rows between current row and unbounded following) as yb from k window w as (partition by episode_index order by frame_index))
select index, round(case when fa is null then yb when fb is null or fb = fa then ya else ya + (yb - ya) * (frame_index - fa) / (fb - fa) end, 6) as y from b"""))
def w13_interpolated_progress(spark, sf):
    f = frames_ev(spark, sf).withColumn("y", F.when(F.col("frame_index") % 5 == 2, F.col("x")).otherwise(F.lit(float("nan"))))
    return f.select("index", F.round(W.interpolated("y"), 6).alias("y"))


@query(li("select episode_index, frame_index, [case when state[i + 1] - state[i] > 0.03 then 2 when state[i + 1] - state[i] < -0.03 then 0 else 1 end for i in [1, 2, 3]] as classes, [s >= 0.05 for s in state] as complete from frames_li"))
def w14_progress_classes(spark, sf):
    return frames_li(spark, sf).select("episode_index", "frame_index", *W.progress_classes("state", 0.03, 0.05))


@query(li(f"select episode_index, frame_index, [round((state[i] - coalesce(lag(state) over w, state)[i]) / 0.1, 4) for i in [1, 2, 3, 4]] as velocity from frames_li {_W}"))
def w15_velocity(spark, sf):
    return frames_li(spark, sf).select("episode_index", "frame_index", F.transform(W.velocity("state", 0.1), lambda v: F.round(v, 4)).alias("velocity"))


@query(li(f""", c as (select *, [greatest(5.0, least(40.0, state[1])), greatest(1000.0, least(50000.0, state[2]))] as clipped from frames_li)
select episode_index, frame_index, clipped, coalesce(sqrt((clipped[1] - (lag(clipped) over w)[1])^2 + (clipped[2] - (lag(clipped) over w)[2])^2) > 20000, false) as jump from c {_W}"""))
def w16_clip_and_jump(spark, sf):
    f = frames_li(spark, sf).withColumn("xy", F.slice("state", 1, 2))
    return f.select("episode_index", "frame_index", *W.clipped_with_jump("xy", [5.0, 1000.0], [40.0, 50000.0], 20000.0))


@query(ev(f""", e as (select *, label in ('click', 'view') as enabled from frames_ev), r as (select *, enabled and not coalesce(lag(enabled) over w, false) as rising from e {_W})
select index, last_value(case when rising then x end ignore nulls) over (w rows unbounded preceding) as reference, last_value(case when enabled then x end ignore nulls) over (w rows unbounded preceding) as held from r {_W}"""))
def w17_latch_and_hold(spark, sf):
    f = frames_ev(spark, sf).withColumn("enabled", F.col("label").isin("click", "view"))
    return f.select("index", *W.latched("enabled", "x"))


@query(ev(f"select index, list(x) over (w rows between current row and 3 following) as chunk from frames_ev {_W} qualify len(list(x) over (w rows between current row and 3 following)) = 4"))
def w18_action_chunks(spark, sf):
    f = frames_ev(spark, sf)
    chunks = W.action_chunks(f, "x", 4)
    return chunks.join(f.select("episode_index", "frame_index", "index"), ["episode_index", "frame_index"]).select("index", "chunk")


def _cubics() -> str:
    """The weights of cubics fitted to 11 values, a row for each place in the window."""
    x = np.vander(np.arange(11), 4)
    return str((x @ np.linalg.pinv(x)).tolist())


@query(ev(f""", y as (select episode_index, list(x order by frame_index) as y, count(*) as n from frames_ev group by 1)
select episode_index, frame_index, round(case when n < 11 then x when frame_index < 5 then list_dot_product(h[frame_index + 1], y[1:11]) when frame_index >= n - 5 then list_dot_product(h[12 - n + frame_index], y[n - 10:n])
  else list_dot_product(h[6], y[frame_index - 4:frame_index + 6]) end, 6) as smooth from frames_ev join y using (episode_index), (select {_cubics()} as h)"""))
def w19_smoothed(spark, sf):
    return W.smoothed(frames_ev(spark, sf), "x").withColumn("smooth", F.round("smooth", 6))


@query(gap(f""", k as (select * from frames_gap qualify coalesce(lag(q) over (partition by episode_index order by frame_index) <> q, true))
select episode_index, frame_index, round(coalesce(0.5 * q + 0.3 * lag(q, 1) over w + 0.2 * lag(q, 2) over w, q), 6) as filtered from k {_W}"""))
def w20_weighted_filter(spark, sf):
    return W.weighted_filter(frames_gap(spark, sf), "q", [0.5, 0.3, 0.2]).select("episode_index", "frame_index", F.round("filtered", 6).alias("filtered"))


@query(ev(f"select episode_index, frame_index, x as state, pred_value as action, is_intervention as reward, case when d then x else nx end as next_state, d as done from (select *, label = 'purchase' or lead(index) over w is null as d, lead(x) over w as nx from frames_ev {_W})"))
def w21_transitions(spark, sf):
    return W.transitions(frames_ev(spark, sf).withColumn("done", F.col("label") == "purchase"), "x", "pred_value", "is_intervention", "done")


@query(ev("select index, row_number() over (partition by episode_index order by frame_index) >= 50 as truncated from frames_ev"))
def w22_time_limit(spark, sf):
    return frames_ev(spark, sf).select("index", W.truncated(50).alias("truncated"))


@query(ev(f", t as (select *, label = 'error' as toggle from frames_ev), s as (select *, sum(toggle::int) over (w rows unbounded preceding) % 2 = 1 as active from t {_W}) select index, case when active then 'active' when toggle then 'release' else 'policy' end as mode from s"))
def w26_intervention_states(spark, sf):
    return frames_ev(spark, sf).withColumn("toggle", F.col("label") == "error").select("index", W.intervention_states("toggle").alias("mode"))


@query(ev(f", t as (select *, case when label = 'click' then x end as teleop, case when frame_index > 3 then pred_value end as policy from frames_ev) select index, case when frame_index % 3 > 0 then coalesce(teleop, last_value(teleop ignore nulls) over (w rows unbounded preceding), policy, 0.0) else coalesce(policy, 0.0) end as action from t {_W}"))
def w27_fallback_action(spark, sf):
    f = frames_ev(spark, sf).withColumns({"teleop": F.when(F.col("label") == "click", F.col("x")), "policy": F.when(F.col("frame_index") > 3, F.col("pred_value"))})
    return f.select("index", W.fallback_action(F.col("frame_index") % 3 > 0, "teleop", "policy").alias("action"))


@query(ev(f", s as (select *, min(frame_index) filter (label = 'purchase') over (partition by episode_index) as f, case when frame_index % 4 <> 3 then x end as a from frames_ev) select episode_index, row_number() over w - 1 as frame_index, coalesce(a, last_value(a ignore nulls) over (w rows unbounded preceding)) as action from s where f is null or frame_index <= f + 1 {_W}"))
def w28_compiled_rollouts(spark, sf):
    f = frames_ev(spark, sf).select("episode_index", "frame_index", (F.col("label") == "purchase").alias("done"), F.when(F.col("frame_index") % 4 != 3, F.col("x")).alias("action"))
    return W.compiled_rollouts(f, "done", "action").select("episode_index", "frame_index", "action")


@query(ev("select i as index, coalesce((select min(episode_index) from episodes_ev where i >= dataset_from_index and i < dataset_to_index), 0) as episode_index from (select event_id * 2 as i from events)"))
def j03_episode_of_index(spark, sf):
    points = table(spark, sf, "events").select((F.col("event_id") * 2).alias("index"))
    return M.episode_of_index(points, episodes_ev(spark, sf))


@query(ev("""select index, case when frame_index between 5 and 9 then 0 when frame_index between 12 and 30 then 1 when frame_index between 31 and 31 then 2 when frame_index < 5 then 0 when frame_index < 12 then 0 else 2 end as stage,
  round(case when frame_index between 5 and 9 then (frame_index - 5) / 4 when frame_index between 12 and 30 then (frame_index - 12) / 18 when frame_index = 31 then 1.0 when frame_index < 5 then 0.0 when frame_index < 12 then 1.0 else 0.999 end, 6) as tau from frames_ev"""))
def j04_stage_interval_join(spark, sf):
    lists = [F.array(*map(F.lit, x)) for x in (("reach", "lift", "place"), (5, 12, 31), (9, 30, 31))]
    f = frames_ev(spark, sf).withColumn("st", M.stage_and_tau(F.col("frame_index"), *lists))
    return f.select("index", F.col("st.stage").alias("stage"), F.round("st.tau", 6).alias("tau"))


_NEAR = """, q as (select episode_index, index, timestamp + 0.03 as t from frames_ev where frame_index % 3 = 0), d as (select episode_index, timestamp as t, x from frames_ev where frame_index % 2 = 0),
m as (select q.*, d.x, abs(q.t - d.t) as dist, row_number() over (partition by q.index order by abs(q.t - d.t), d.t) as r from q join d using (episode_index))"""


@query(ev(_NEAR + " select index, x, dist > 0.05 as is_pad from m where r = 1"))
def j06_nearest_timestamp(spark, sf):
    f = frames_ev(spark, sf)
    q = f.where("frame_index % 3 = 0").select("episode_index", "index", (F.col("timestamp") + 0.03).alias("timestamp"))
    d = f.where("frame_index % 2 = 0").select("episode_index", "timestamp", "x")
    return M.nearest_in_time(q, d, "timestamp", "x", 0.05).select("index", "x", "is_pad")


@query(ev("select index, x from frames_ev where frame_index % 3 = 0"))
def j07_exact_timestamp(spark, sf):
    f = frames_ev(spark, sf)
    q = f.where("frame_index % 3 = 0").select("episode_index", "index", (F.col("timestamp") + 0.00001).alias("timestamp"))
    return M.nearest_in_time(q, f.select("episode_index", "timestamp", "x"), "timestamp", "x", 0.0001, strict=True).select("index", "x")


@query("select o_orderkey, t.new as task_index from orders join (select o_orderpriority as task, row_number() over (order by o_orderpriority desc) - 1 as new from (select distinct o_orderpriority from orders)) t on task = o_orderpriority")
def j08_task_id_remap(spark, sf):
    o = table(spark, sf, "orders")
    names = o.select(F.col("o_orderpriority").alias("task")).distinct()
    source = names.select("task", (F.row_number().over(Window.orderBy("task")) - 1).cast("long").alias("task_index"))
    target = names.select("task", (F.row_number().over(Window.orderBy(F.desc("task"))) - 1).cast("long").alias("task_index"))
    rows = o.join(source, F.col("o_orderpriority") == F.col("task")).select("o_orderkey", "task_index")
    return M.remapped_ids(rows, source, target, "task_index", "task")


@query("select o_orderkey, case when o_custkey % 4 < 3 then o_custkey % 4 + 10 else 9 end as chunk, case when o_custkey % 4 < 3 then (o_custkey % 4) * 2 else 99 end as file from orders")
def j09_file_remap(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("chunk"), F.lit(0).cast("long").alias("file"))
    moves = table(spark, sf, "orders").select((F.col("o_custkey") % 4).alias("chunk")).distinct().where("chunk < 3").select("chunk", F.lit(0).cast("long").alias("file"), (F.col("chunk") + 10).alias("to_chunk"), (F.col("chunk") * 2).alias("to_file"))
    return M.relocated(o, moves, "chunk", "file", (9, 99))


@query(ev("select index from frames_ev where episode_index % 4 = 1"))
def j10_semi_join(spark, sf):
    keep = episodes_ev(spark, sf).where("episode_index % 4 = 1").select("episode_index")
    return frames_ev(spark, sf).join(keep, "episode_index", "left_semi").select("index")


@query("select event_id as index from events where event_id % 11 = 3")
def j11_missing_predictions(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("index"))
    return M.missing_rows(e, e.where("index % 11 <> 3"), "index")


@query("select r as rank from range(200) t(r) where r not in (select user_id from events)")
def j12_missing_shards(spark, sf):
    return M.missing_shards(table(spark, sf, "events").select(F.col("user_id").alias("rank")), 200)


@query(li("""select coalesce(a.e, b.e) as episode_index, coalesce(a.t, b.t) as timestep, [round(case when a.s is null then b.s[i] when b.s is null then a.s[i] else 0.3 * a.s[i] + 0.7 * b.s[i] end, 4) for i in [1, 2, 3, 4]] as action
from (select episode_index as e, frame_index as t, state as s from frames_li) a full join (select episode_index as e, frame_index + 2 as t, state as s from frames_li) b on a.e = b.e and a.t = b.t where coalesce(a.t, b.t) > 1"""))
def j13_action_chunk_merge(spark, sf):
    f = frames_li(spark, sf)
    old = f.select("episode_index", F.col("frame_index").alias("timestep"), F.col("state").alias("action"))
    new = f.select("episode_index", (F.col("frame_index") + 2).alias("timestep"), F.col("state").alias("action"))
    m = M.merged_chunks(old, new, 1, keys=("episode_index",))
    return m.withColumn("action", F.transform("action", lambda v: F.round(v, 4)))


@query(ev("select index, round(x - pred_value, 6) as gap from frames_ev"))
def j14_attached_predictions(spark, sf):
    f = frames_ev(spark, sf)
    M.require_all(f, f, "index")
    return f.select("index", "x").join(f.select("index", "pred_value"), "index").select("index", F.round(F.col("x") - F.col("pred_value"), 6).alias("gap"))


@query(ev("select index, case when frame_index >= 0 and frame_index < 10 then 'approach' when frame_index >= 10 and frame_index < 20 then 'grasp' when frame_index = 25 then 'pause' end as instruction from frames_ev"))
def j16_instruction_lookup(spark, sf):
    ranges = F.create_map(*[F.lit(x) for p in (("10 20", "grasp"), ("0 10", "approach"), ("25 25", "pause")) for x in p])
    return frames_ev(spark, sf).select("index", M.instruction_at(ranges, F.col("frame_index")).alias("instruction"))


@query(ev("select index, x from frames_ev order by index"))
def t01_ordered_by_index(spark, sf):
    return frames_ev(spark, sf).select("index", "x").orderBy("index")


def _digest(seed: int, *keys: str) -> str:
    """T.digest in SQL."""
    text = " || ':' || ".join([*(f"{k}::varchar" for k in keys), f"'{seed}'"])
    return f"('0x' || left(md5({text}), {T.DIGITS}))::bigint"


@query(ev(f"select index, x, row_number() over (order by {_digest(7, 'index')}) - 1 as position from frames_ev"))
def t02_seeded_shuffle(spark, sf):
    """The order itself, as positions."""
    return T.shuffled(frames_ev(spark, sf).select("index", "x"), "index", 7)


#: Three epochs over shards of 16 episodes, three shards open at a time.
EPOCHS = ev(f""", s as (select distinct episode_index // 16 as shard, unnest([0, 1, 2]) as epoch from episodes_ev),
r as (select epoch, shard, (row_number() over (partition by epoch order by {_digest(7, "epoch", "shard")}) - 1) // 3 as turn from s),
o as (select epoch, turn, index, task_index, row_number() over (partition by epoch order by turn, {_digest(7, "epoch", "index")}) - 1 as position from frames_ev join r on shard = episode_index // 16) select """)


def epochs_ev(spark, sf):
    f = frames_ev(spark, sf).select("index", "task_index", F.floor(F.col("episode_index") / 16).alias("shard"))
    return T.epoch_order(f, "index", "shard", 7, range(3), 3)


@query(EPOCHS + "epoch, turn, position, index from o")
def t02_epoch_order(spark, sf):
    """Shuffled shards, some open at a time, in another order in each epoch."""
    return epochs_ev(spark, sf).select("epoch", "turn", "position", "index")


@query(ev(f", n as (select count(*) as n from frames_ev), d as (select i as draw, greatest(0, n - 5000) + {_digest(7, 'i')} % least(n, 5000) as index from n, range(256) as t(i)) select draw, index, x from d join frames_ev using (index)"))
def t03_sample_with_replacement(spark, sf):
    return T.sample_with_replacement(frames_ev(spark, sf).select("index", "x"), 256, 5000, 7)


@query(ev(""", a as (select 'offline' as source, index, row_number() over (partition by episode_index order by frame_index desc) > 2 as ok from frames_ev where episode_index % 2 = 0
  union all select 'online', index, row_number() over (partition by episode_index order by frame_index desc) > 5 from frames_ev where episode_index % 2 = 1),
n as (select source, count(*) filter (ok) as n from a group by 1) select source, index, round(case when ok then case when source = 'online' then 0.25 else 0.75 end / n else 0 end, 9) as weight from a join n using (source)"""))
def t04_sampling_weights(spark, sf):
    f = frames_ev(spark, sf)
    return T.sampling_weights(f.where("episode_index % 2 = 0"), f.where("episode_index % 2 = 1"), 0.25, 2, 5).withColumn("weight", F.round("weight", 9))


@query(ev(", n as (select episode_index, length, greatest(least(20, length), least(floor(length ** 0.75)::bigint, 10000)) as n from episodes_ev) select episode_index, round_even(i * (length - 1) / (n - 1), 0)::bigint as frame_index from n, range(10000) r(i) where i < n"))
def t05_evenly_spaced_sample(spark, sf):
    e = episodes_ev(spark, sf).withColumn("n", T.sample_count(F.col("length"), 20))
    return e.select("episode_index", F.explode(T.evenly_spaced(F.col("length"), F.col("n"))).alias("frame_index"))


@query(ev(f", r as (select episode_index, frame_index, x, row_number() over (partition by episode_index order by {_digest(3, 'episode_index', 'frame_index')}) as r from frames_ev) select episode_index, frame_index, x from r join episodes_ev using (episode_index) where r <= greatest(1, floor(length * 0.1))"))
def t06_sample_per_episode(spark, sf):
    return T.sample_per_episode(frames_ev(spark, sf), 0.1, 3).select("episode_index", "frame_index", "x")


@query(ev("select index, x from frames_ev where index > (select max(index) from frames_ev) - 1234"))
def t07_newest_rows(spark, sf):
    return T.newest(frames_ev(spark, sf).select("index", "x"), 1234)


@query(ev("select index, row_number() over (partition by episode_index order by frame_index % 8, frame_index) as place from frames_ev"))
def t08_coarse_to_fine(spark, sf):
    w = Window.partitionBy("episode_index").orderBy(*T.coarse_to_fine(8))
    return frames_ev(spark, sf).select("index", F.row_number().over(w).alias("place"))


@query(ev(f"select index, {_digest(11, 'index')} % 1000000 / 1000000 < 0.3 as dropped from frames_ev"))
def t09_reproducible_draws(spark, sf):
    return frames_ev(spark, sf).select("index", (T.chance(F.col("index"), 11) < 0.3).alias("dropped"))


@query(ev("select index, x * 0.5 + pred_value as score from frames_ev"))
def x04_batch_scorer(spark, sf):
    return W.scored(frames_ev(spark, sf), ["x", "pred_value"], lambda batch: batch["x"].to_numpy() * 0.5 + batch["pred_value"].to_numpy())
