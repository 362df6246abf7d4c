"""Queries of the label chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import labels as L
from framewright.plans.registry import query
from framewright.plans.views import episodes_ev, ev, frames_ev, frames_gap, gap

_FACTS = """, facts as (select f.*, e.length, coalesce(e.episode_success, 'failure') = 'success' as success, t.m as task_max_length
  from frames_ev f join episodes_ev e using (episode_index) join (select task_index, max(length) as m from episodes_ev group by task_index) t on t.task_index = e.task_index)"""
_TARGET = "greatest(-1.0, least(0.0, (-(length - frame_index - 1) - case when success then 0.0 else task_max_length * 1.0 end)::double / (task_max_length * 2.0)))"
_CHAIN = f"""{_FACTS}, targets as (select *, {_TARGET} as target from facts),
rewards as (select *, case when lead(frame_index) over w = frame_index + 1 then target - lead(target) over w else target end as reward from targets window w as (partition by episode_index order by frame_index)),
advantages as (select *, sum(reward) over (partition by episode_index order by frame_index rows between current row and {{n}} - 1 following) + coalesce(lead(pred_value, {{n}}) over (partition by episode_index order by frame_index), 0.0) - pred_value as advantage from rewards)"""


@query(ev("select task_index, count(*) as n_frames, round(avg(x), 6) as mean_x from frames_ev group by task_index"))
def j01_frames_with_task(spark, sf):
    tasks = episodes_ev(spark, sf).select("task_index").distinct().withColumn("task", F.concat(F.lit("task_"), F.col("task_index").cast("string")))
    return frames_ev(spark, sf).join(tasks, "task_index").groupBy("task_index").agg(F.count("*").alias("n_frames"), F.round(F.avg("x"), 6).alias("mean_x"))


@query(ev(f"{_FACTS} select index, length, success, task_max_length from facts"))
def j02_frames_with_episode_facts(spark, sf):
    return L.with_episode_facts(frames_ev(spark, sf), episodes_ev(spark, sf)).select("index", "length", "success", "task_max_length")


@query(ev("select task_index, max(length) as task_max_length from episodes_ev group by task_index"))
def a14_task_max_length(spark, sf):
    return L.task_lengths(episodes_ev(spark, sf))


@query(ev(f"{_FACTS} select index, round({_TARGET}, 6) as target from facts"))
def w03_value_target(spark, sf):
    return L.with_episode_facts(frames_ev(spark, sf), episodes_ev(spark, sf)).select("index", F.round(L.value_target(), 6).alias("target"))


@query(ev(f"{_FACTS} select index, case when length > 1 then round(greatest(-1.0, least(0.0, (-0.5 * (length - frame_index - 1) - case when success then 0.0 else frame_index * 0.5 end)::double / (length - 1))), 6) end as target from facts"))
def w04_episode_value_target(spark, sf):
    return L.with_episode_facts(frames_ev(spark, sf), episodes_ev(spark, sf)).select("index", F.round(L.episode_value_target(0.5), 6).alias("target"))


@query(gap("select episode_index, frame_index, round(case when lead(frame_index) over w = frame_index + 1 then v - lead(v) over w else v end, 6) as reward from frames_gap window w as (partition by episode_index order by frame_index)"))
def w05_dense_reward(spark, sf):
    return frames_gap(spark, sf).select("episode_index", "frame_index", F.round(L.dense_reward("v"), 6).alias("reward"))


@query(gap("select episode_index, frame_index, round(case when lead(frame_index) over w = frame_index + 1 then v - lead(v) over w when episode_index % 2 = 0 then v else v + 1 end, 6) as reward from frames_gap window w as (partition by episode_index order by frame_index)"))
def w06_dense_reward_by_outcome(spark, sf):
    f = frames_gap(spark, sf).withColumn("success", F.col("episode_index") % 2 == 0)
    return f.select("episode_index", "frame_index", F.round(L.dense_reward("v", "success"), 6).alias("reward"))


_RUNS = ", runs as (select *, frame_index - row_number() over (partition by episode_index order by frame_index) as run from frames_gap)"


@query(gap(_RUNS + " select episode_index, frame_index, round(sum(q) over (w rows between current row and 2 following) + coalesce(lead(v, 3) over w, 0.0) - v, 6) as advantage from runs window w as (partition by episode_index, run order by frame_index)"))
def w07_n_step_advantage(spark, sf):
    f = L.n_step_advantage(frames_gap(spark, sf), 3, "q", "v")
    return f.select("episode_index", "frame_index", F.round("advantage", 6).alias("advantage"))


@query(gap(_RUNS + " select episode_index, frame_index, round(sum(q) over (w rows between current row and 2 following) + coalesce(lead(v, 3) over w, case when episode_index % 2 = 0 then 0.0 else -1.0 end) - v, 6) as advantage from runs window w as (partition by episode_index, run order by frame_index)"))
def w08_n_step_advantage_by_outcome(spark, sf):
    f = L.n_step_advantage(frames_gap(spark, sf).withColumn("success", F.col("episode_index") % 2 == 0), 3, "q", "v", "success")
    return f.select("episode_index", "frame_index", F.round("advantage", 6).alias("advantage"))


@query(ev(f"{_FACTS} select index, round(case when length - frame_index <= 2 then case when success then 1.0 else -1.0 end else 0.99 * coalesce(lead(pred_value) over (partition by episode_index order by frame_index), pred_value) end, 6) as td_target from facts"))
def w09_td_target(spark, sf):
    f = L.with_episode_facts(frames_ev(spark, sf), episodes_ev(spark, sf))
    return f.select("index", F.round(L.td_target(0.99, 2, value="pred_value"), 6).alias("td_target"))


@query(ev(_CHAIN.format(n=5) + " select task_index, round(quantile_cont(advantage, 0.7), 6) as threshold from advantages group by task_index"))
def a15_task_thresholds(spark, sf):
    f = L.with_episode_facts(frames_ev(spark, sf), episodes_ev(spark, sf)).withColumn("target", L.value_target())
    f = L.n_step_advantage(f.withColumn("reward", L.dense_reward()), 5, value="pred_value")
    return L.task_thresholds(f).select("task_index", F.round("threshold", 6).alias("threshold"))


@query(ev("select index, max(is_intervention) over (partition by episode_index) > 0.5 as positive from frames_ev"))
def a16_episode_any(spark, sf):
    return frames_ev(spark, sf).select("index", L.episode_any("is_intervention").alias("positive"))


@query(ev("select episode_index, coalesce(episode_success, 'failure') as label from episodes_ev"))
def f14_strict_success_label(spark, sf):
    return episodes_ev(spark, sf).select("episode_index", L.success_label(F.col("episode_success"), "failure").alias("label"))


@query("select o_orderkey, case when s in ('success', 'true', '1') then 'success' when s in ('failure', 'false', '0') then 'failure' when s = '' then null else s end as label from (select o_orderkey, lower(trim(case o_orderstatus when 'F' then ' Success ' when 'O' then 'false' else case when o_orderkey % 2 = 0 then '  ' else o_orderstatus end end)) as s from orders)")
def f15_report_label(spark, sf):
    s = F.col("o_orderstatus")
    raw = F.when(s == "F", " Success ").when(s == "O", "false").otherwise(F.when(F.col("o_orderkey") % 2 == 0, "  ").otherwise(s))
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", L.report_label(raw).alias("label"))


@query(ev(_CHAIN.format(n=5) + """, thresholds as (select task_index, quantile_cont(advantage, 0.7) as threshold from advantages group by task_index)
select a.task_index, count(*) as frames, sum(case when advantage >= threshold or is_intervention > 0.5 or is_expert then 1 else 0 end)::bigint as positives
from advantages a join thresholds using (task_index) join (select episode_index, is_expert from episodes_ev) using (episode_index) group by a.task_index"""))
def f16_label_chain(spark, sf):
    """For each task, how many frames the whole chain labels positive; the flagship query."""
    f = L.labelled(frames_ev(spark, sf), episodes_ev(spark, sf), n=5)
    return f.groupBy("task_index").agg(F.count("*").alias("frames"), F.sum("indicator").alias("positives"))


@query(ev(f"{_FACTS} select f.index, f.length, f.frame_index, not f.success as failed, round({_TARGET}, 6) as target from facts f"))
def j15_training_columns(spark, sf):
    f = L.with_episode_facts(frames_ev(spark, sf), episodes_ev(spark, sf))
    return f.select("index", "length", "frame_index", (~F.col("success")).alias("failed"), F.round(L.value_target(), 6).alias("target"))
