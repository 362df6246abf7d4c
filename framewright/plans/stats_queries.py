"""Queries of the statistics and the report."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import labels as L, stats as S
from framewright.plans.registry import query
from framewright.plans.views import episodes_ev, ev, frames_ev, frames_li, li, table, vec, vectors


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


_AGG = "count(*) as count, min(v) as min, max(v) as max, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std"
_AGG4 = _AGG.replace(", 6)", ", 4)")
_Q = ", ".join(f"round(case when count(*) < 2 then avg(v) else quantile_cont(v, {q}) end, 6) as {S.quantile_name(q)}" for q in S.QUANTILES)
_LONG = ", long as (select episode_index, i - 1 as dim, state[i] as v from frames_li, (values (1), (2), (3), (4)) as t(i))"
_QN = [S.quantile_name(q) for q in S.QUANTILES]


@query(li(f"{_LONG} select 'state' as feature, dim, {_AGG}, {_Q} from long group by dim"))
def a01_feature_stats(spark, sf):
    return rounded(S.feature_stats(frames_li(spark, sf), ["state"]), "mean", "std", *_QN)


@query(li(f"{_LONG} select episode_index, 'state' as feature, dim, {_AGG}, {_Q} from long group by episode_index, dim"))
def a02_episode_stats(spark, sf):
    return rounded(S.feature_stats(frames_li(spark, sf), ["state"], ("episode_index",)), "mean", "std", *_QN)


@query(li(f"""{_LONG}, parts as (select episode_index, dim, count(*) as n, min(v) as lo, max(v) as hi, avg(v) as m, case when count(*) < 2 then avg(v) else quantile_cont(v, 0.5) end as q from long group by all)
select 'state' as feature, p.dim, a.count, a.min, a.max, a.mean, a.std, round(sum(n * q) / sum(n), 4) as q50 from parts p join (select dim, {_AGG4} from long group by dim) a on a.dim = p.dim group by all"""))
def a03_merged_stats(spark, sf):
    parts = S.feature_stats(frames_li(spark, sf), ["state"], ("episode_index",))
    return rounded(S.merged_stats(parts, (0.5,)), "mean", "std", "q50", digits=4)


@query(ev(""", b as (select episode_index, min(x) - 1e-10 as lo, max(x) + 1e-10 as hi, count(*) as n from frames_ev group by 1),
h as (select episode_index, least(floor((x - lo) / ((hi - lo) / 50)), 49)::bigint as b, count(*) as c, any_value(lo) as lo, any_value(hi) as hi, any_value(n) as n from frames_ev join b using (episode_index) group by 1, 2),
u as (select *, sum(c) over (partition by episode_index order by b) as up, (hi - lo) / 50 as w from h)
select episode_index, round(min_by(case when b = 0 then lo else lo + b * w + (n * 0.5 - (up - c)) / c * w end, b) filter (up >= n * 0.5), 6) as q50,
  round(min_by(case when b = 0 then lo else lo + b * w + (n * 0.9 - (up - c)) / c * w end, b) filter (up >= n * 0.9), 6) as q90 from u group by 1"""))
def a04_histogram_quantiles(spark, sf):
    return rounded(S.histogram_quantiles(frames_ev(spark, sf), "x", (0.5, 0.9), 50, ("episode_index",)), "q50", "q90")


@query(vec("select vec_id, round(list_min(state), 6) as min, round(list_max(state), 6) as max, round(list_sum(state) / len(state), 6) as mean from vectors"))
def a05_row_stats(spark, sf):
    return rounded(vectors(spark, sf).select("vec_id", *S.row_stats("state")), "min", "max", "mean")


@query(li("select 'state' as feature, s as stat, [round(v, 4) for v in list(v order by dim)] as value from (" + " union all ".join(f"select {i} as dim, '{s}' as s, {e} as v from frames_li" for i in range(4) for s, e in (("count", "count(*)::double"), ("max", f"max(state[{i + 1}])"), ("min", f"min(state[{i + 1}])"))) + ") group by s"))
def s07_stats_document(spark, sf):
    doc = S.as_document(S.feature_stats(frames_li(spark, sf), ["state"], quantiles=(0.5,)), ("min", "max", "count"))
    return doc.withColumn("value", F.transform("value", lambda v: F.round(v, 4)))


@query(li(f"{_LONG} select dim, min(v) as min, max(v) as max, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std from long group by dim"))
def a01_positional_stats(spark, sf):
    return rounded(S.positional_stats(frames_li(spark, sf), "state", 4), "mean", "std")


@query(ev("""select count(*) as episodes, count(*) filter (episode_success = 'success') as success, count(*) filter (episode_success = 'failure') as failure, count(*) filter (episode_success is null) as unlabelled,
  round(count(*) filter (episode_success = 'success') / count(*), 6) as success_ratio, round(count(*) filter (episode_success = 'success') / count(episode_success), 6) as labelled_success_ratio from episodes_ev"""))
def a08_success_report(spark, sf):
    return rounded(S.success_report(episodes_ev(spark, sf), L.report_label(F.col("episode_success"))), "success_ratio", "labelled_success_ratio")


@query(ev("""select count(*) filter (is_intervention > 0) as frames, count(distinct episode_index) filter (is_intervention > 0) as episodes,
  round(count(*) filter (is_intervention > 0) / count(*), 6) as frame_ratio, round(count(distinct episode_index) filter (is_intervention > 0) / count(distinct episode_index), 6) as episode_ratio from frames_ev"""))
def a09_intervention_report(spark, sf):
    return rounded(S.intervention_report(frames_ev(spark, sf)), "frame_ratio", "episode_ratio")


@query(ev("select round(avg(length / 10), 6) as mean_s, min(length / 10) as min_s, max(length / 10) as max_s from episodes_ev"))
def a10_episode_seconds(spark, sf):
    s = F.col("length") / 10
    return episodes_ev(spark, sf).agg(F.round(F.avg(s), 6).alias("mean_s"), F.min(s).alias("min_s"), F.max(s).alias("max_s"))


@query("""with e as (select user_id, count(*)::double as v from events group by 1), m as (select min(v) as lo, max(v) as hi, (max(v) - min(v)) / 20 as w from e)
select b as bin, round(lo + b * w, 6) as low, round(lo + (b + 1) * w, 6) as high, coalesce(n, 0) as n from range(20) r(b), m left join (select least(floor((v - lo) / w), 19)::bigint as k, count(*) as n from e, m group by 1) on k = b""")
def a11_length_histogram(spark, sf):
    e = episodes_ev(spark, sf).select(F.col("length").cast("double").alias("v"))
    return rounded(S.histogram(e, "v"), "low", "high")


@query("""with t as (select o_custkey, o_orderpriority as task, min(o_orderkey) as k from orders group by 1, 2), f as (select task, min(o_custkey) as c from t group by 1)
select task, row_number() over (order by c, task) - 1 as first from f""")
def a12_tasks_in_first_seen_order(spark, sf):
    lists = table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("tasks"))
    return S.distinct_in_order(lists, "tasks", ["o_custkey"])


@query("select count(quality) as total, count(*) filter (quality = 1) as positives, count(*) filter (quality not in (0, 1)) as invalid, round(count(*) filter (quality = 1) / count(quality), 6) as positive_ratio from labels")
def a13_indicator_stats(spark, sf):
    return rounded(S.indicator_stats(table(spark, sf, "labels"), "quality"), "positive_ratio")


_ANN = "(select l_orderkey as episode_index, l_linenumber as pos, l_returnflag as name, l_quantity as d, row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber desc, l_quantity desc) as r from lineitem)"


@query(f"""with s as (select name, d / sum(d) over (partition by episode_index) as p from {_ANN} where r = 1), m as (select name, avg(p) as p from s group by 1)
select name, round(p / sum(p) over (), 6) as proportion from m""")
def a18_temporal_proportions(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("episode_index"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("name"), F.lit(0.0).alias("start"), F.col("l_quantity").alias("end"))
    return rounded(S.temporal_proportions(a), "proportion")


_STEPS = """, steps as (select episode_index, frame_index as step, x as reward, label = 'purchase' as done, is_intervention > 0.5 as success from frames_ev),
kept as (select * from (select *, min(step) filter (done) over (partition by episode_index) as f from steps) where f is null or step <= f),
summary as (select episode_index, sum(reward) as sum_reward, max(reward) as max_reward, bool_or(success) as success from kept group by 1)"""


def _steps(spark, sf):
    return frames_ev(spark, sf).select("episode_index", F.col("frame_index").alias("step"), F.col("x").alias("reward"), (F.col("label") == "purchase").alias("done"), (F.col("is_intervention") > 0.5).alias("success"))


@query(ev(_STEPS + " select episode_index, round(sum_reward, 6) as sum_reward, max_reward, success from summary"))
def a19_rollout_summary(spark, sf):
    return rounded(S.rollout_summary(_steps(spark, sf)), "sum_reward")


@query(ev(_STEPS + """ select episode_index % 3 as task_group, episode_index % 15 as task_id, round(avg(sum_reward), 6) as avg_sum_reward, round(avg(max_reward), 6) as avg_max_reward, round(100 * avg(success::int), 6) as pc_success, count(*) as n_episodes
from summary group by rollup (1, 2)"""))
def a20_evaluation_rollup(spark, sf):
    e = S.rollout_summary(_steps(spark, sf)).withColumns({"task_group": F.col("episode_index") % 3, "task_id": F.col("episode_index") % 15})
    return rounded(S.evaluation_rollup(e, "task_group", "task_id"), "avg_sum_reward", "avg_max_reward", "pc_success")


@query(ev("select e.episode_index, coalesce(episode_success, case when max(f.is_intervention) > 0 then 'success' else 'failure' end) as label from episodes_ev e join frames_ev f using (episode_index) group by e.episode_index, episode_success"))
def a21_inferred_success(spark, sf):
    flags = frames_ev(spark, sf).groupBy("episode_index").agg(F.max("is_intervention").alias("flag"))
    return episodes_ev(spark, sf).join(flags, "episode_index").select("episode_index", S.inferred_success(F.col("episode_success"), F.col("flag")).alias("label"))


@query(ev(", l as (select x from frames_ev where timestamp >= 1.0) select 0 as dim, round_even(min(x), 1) as low, round_even(max(x), 1) as high from l"))
def a22_joint_limits(spark, sf):
    return S.joint_limits(frames_ev(spark, sf).withColumn("state", F.array("x")), "state", 1.0, 1)


@query(ev(""", l as (select *, row_number() over (partition by episode_index order by timestamp desc) as r from frames_ev)
select episode_index, max(x) as max, round(quantile_cont(x, 0.5), 6) as p50, round(quantile_cont(x, 0.95), 6) as p95, round((count(*) - 1) / (max(timestamp) - min(timestamp)), 6) as rate from l where r <= 20 group by 1"""))
def a23_latency_summary(spark, sf):
    return rounded(S.latency_summary(frames_ev(spark, sf), "x", "timestamp", ["episode_index"], 20), "p50", "p95", "rate")


@query("with d as (select len(string_split(text, ' ')) as n, length(text) as c from documents where text is not null) select round(avg(n), 6) as mean, round(quantile_cont(n, 0.99), 6) as p99, min(n)::bigint as min, max(n)::bigint as max, round(sum(c) / sum(n), 6) as ratio from d")
def a24_length_summary(spark, sf):
    d = table(spark, sf, "documents").where("text is not null").select("text", F.split("text", " ").alias("w"))
    return rounded(S.length_summary(d, "w", F.length("text")), "mean", "p99", "ratio")


@query(ev("select least(min(x), min(pred_value)) as low, greatest(max(x), max(pred_value)) as high from frames_ev"))
def a25_finite_bounds(spark, sf):
    return S.finite_bounds(frames_ev(spark, sf).withColumn("x", F.when(F.col("index") % 97 == 5, F.lit(float("nan"))).otherwise(F.col("x"))).unionByName(frames_ev(spark, sf)), ["x", "pred_value"])


@query(ev("select round(min(pred_value), 6) as min, round(max(pred_value), 6) as max, round(avg(pred_value), 6) as mean, round(stddev_pop(pred_value), 6) as std from frames_ev"))
def a25_value_summary(spark, sf):
    v = "pred_value"
    return frames_ev(spark, sf).agg(F.round(F.min(v), 6).alias("min"), F.round(F.max(v), 6).alias("max"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"))


@query(ev("select count(distinct episode_index) as total_episodes, count(*) as total_frames, count(distinct task_index) as total_tasks, '0:' || count(distinct episode_index) as train_split from frames_ev"))
def a26_totals(spark, sf):
    return S.totals(frames_ev(spark, sf))


@query(ev("select episode_index, dataset_from_index as \"from\", dataset_to_index as \"to\" from episodes_ev"))
def a27_episode_bounds(spark, sf):
    return S.episode_bounds(frames_ev(spark, sf))


@query(ev(""", s as (select *, case when label = lag(label) over w then 0 else 1 end as s from frames_ev window w as (partition by episode_index order by frame_index)),
r as (select *, sum(s) over (partition by episode_index order by frame_index) as run from s) select episode_index, label, min(frame_index) as "from", max(frame_index) + 1 as "to" from r group by episode_index, label, run"""))
def a27_run_bounds(spark, sf):
    return S.run_bounds(frames_ev(spark, sf), "label", "frame_index", ["episode_index"])


@query(li(f"{_LONG} select 'state' as feature, dim, {_AGG4} from long group by dim"))
def a07_stats_of_episode_stats(spark, sf):
    """Statistics of a dataset without stored ones: per episode, then merged."""
    return rounded(S.merged_stats(S.feature_stats(frames_li(spark, sf), ["state"], ("episode_index",))), "mean", "std", digits=4)
