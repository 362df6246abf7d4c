"""The offline-RL label chain: value targets, dense rewards, n-step advantages, per-task thresholds and binary labels.

All rules run in frame order inside an episode, whatever the order of the input, and in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from framewright.operators.quantiles import exact_quantiles
from framewright.sources.scratch import cut

STRICT_SUCCESS = ("success", "true", "1", "yes")
STRICT_FAILURE = ("failure", "fail", "false", "0", "no")


def clipped(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def success_label(label: Column, default: str | None = None) -> Column:
    """`success` or `failure`; anything else raises, null takes the default, and raises where there is none."""
    text = F.lower(F.trim(label.cast("string")))
    missing = F.lit(default) if default else F.raise_error(F.lit("episode_success is required")).cast("string")
    return F.when(text.isin(*STRICT_SUCCESS), "success").when(text.isin(*STRICT_FAILURE), "failure").when(label.isNull(), missing).otherwise(F.raise_error(F.concat(F.lit("not a success label: "), text)).cast("string"))


def report_label(label: Column) -> Column:
    """`success`, `failure`, null for blank and missing labels, and any other text as it is."""
    text = F.lower(F.trim(label.cast("string")))
    return F.when(text.isin("success", "true", "1"), "success").when(text.isin("failure", "false", "0"), "failure").when((text == "") | (text == "nan"), F.lit(None)).otherwise(text)


def task_lengths(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy("task_index").agg(F.max("length").alias("task_max_length"))


def with_episode_facts(frames: DataFrame, episodes: DataFrame, default_success: str = "failure", *more: str) -> DataFrame:
    """frames with length, success and the longest length of the task, and more columns of episodes."""
    facts = episodes.select("episode_index", "length", F.col("task_index").alias("_task"), (F.coalesce(report_label(F.col("episode_success")), F.lit(default_success)) == "success").alias("success"), *more)
    facts = facts.join(task_lengths(episodes).withColumnRenamed("task_index", "_task"), "_task").drop("_task")
    return frames.join(facts, "episode_index")


def value_target(c_fail: float = 1.0, low: float = -1.0, high: float = 0.0) -> Column:
    """Return to go of a step cost of 1, failures charged the task's longest length times c_fail, divided by both."""
    longest = F.col("task_max_length").cast("double")
    charge = longest * c_fail
    togo = -(F.col("length") - F.col("frame_index") - 1) - F.when(F.col("success"), 0.0).otherwise(charge)
    return clipped(togo / F.greatest(longest + charge, F.lit(1e-12)), low, high)


def episode_value_target(c_fail: float = 1.0, low: float = -1.0, high: float = 0.0) -> Column:
    """The variant that divides by the episode's own length; an episode of one frame has no target."""
    f = F.col("frame_index").cast("double")
    togo = -0.5 * (F.col("length") - F.col("frame_index") - 1) - F.when(F.col("success"), 0.0).otherwise(f * c_fail)
    return F.when(F.col("length") > 1, clipped(F.try_divide(togo, F.col("length") - 1), low, high))


def _order() -> Window:
    return Window.partitionBy("episode_index").orderBy("frame_index")


def dense_reward(target: str = "target", success: str | None = None) -> Column:
    """target - next target where the next frame follows at once, else the target; with success, plus 1 at the end of failures."""
    w = _order()
    follows = F.lead("frame_index").over(w) == F.col("frame_index") + 1
    last = F.col(target) if success is None else F.when(F.col(success), F.col(target)).otherwise(F.col(target) + 1)
    return F.when(F.coalesce(follows, F.lit(False)), F.col(target) - F.lead(target).over(w)).otherwise(last)


def n_step_advantage(frames: DataFrame, n: int, reward: str = "reward", value: str = "value", success: str | None = None, out: str = "advantage") -> DataFrame:
    """Rewards of up to n frames without a gap, plus the value n frames on (0, or by success 0 and -1, where there is none), minus the value here."""
    run = F.col("frame_index") - F.row_number().over(_order())
    w = Window.partitionBy("episode_index", "_run").orderBy("frame_index")
    beyond = F.lit(0.0) if success is None else F.when(F.col(success), 0.0).otherwise(-1.0)
    boot = F.coalesce(F.lead(value, n).over(w), beyond)
    total = F.sum(reward).over(w.rowsBetween(0, n - 1))
    return frames.withColumn("_run", run).withColumn(out, total + boot - F.col(value)).drop("_run")


def td_target(gamma: float = 0.99, window: int = 1, success_reward: float = 1.0, failure_reward: float = -1.0, value: str = "value") -> Column:
    """One-step target: frames within window of the end earn the terminal reward, others gamma times the next value (their own at the end of the data)."""
    done = F.col("length") - F.col("frame_index") <= window
    nxt = F.coalesce(F.lead(value).over(_order()), F.col(value))
    return F.when(done, F.when(F.col("success"), success_reward).otherwise(failure_reward)).otherwise(gamma * nxt)


def task_thresholds(frames: DataFrame, positive_ratio: float = 0.3, value: str = "advantage") -> DataFrame:
    """(task_index, threshold): the linearly interpolated quantile above which positive_ratio of a task's frames lie; NaN is left out.

    A task may hold any share of all frames: its values are never in one buffer. frames is read twice.
    """
    return exact_quantiles(frames.where(~F.isnan(value)), value, {"threshold": 1 - positive_ratio}, ("task_index",))


def binarized(frames: DataFrame, thresholds: DataFrame, intervention: str | None = None, expert: str | None = None, value: str = "advantage", out: str = "indicator") -> DataFrame:
    """1 where value reaches its task's threshold, or by force on interventions over 0.5 and in expert episodes. NaN never reaches."""
    hit = ~F.isnan(value) & (F.col(value) >= F.col("threshold"))
    if intervention:
        hit = hit | (F.coalesce(F.col(intervention), F.lit(0.0)) > 0.5)
    if expert:
        hit = hit | F.coalesce(F.col(expert), F.lit(False))
    return frames.join(thresholds, "task_index", "left").withColumn(out, F.coalesce(hit, F.lit(False)).cast("long")).drop("threshold")


def episode_any(label: str) -> Column:
    """Whether any frame of the episode has a label over 0.5."""
    return F.max(F.col(label) > 0.5).over(Window.partitionBy("episode_index"))


def labelled(frames: DataFrame, episodes: DataFrame, value: str = "pred_value", n: int = 50, positive_ratio: float = 0.3, c_fail: float = 1.0) -> DataFrame:
    """The whole chain: target, reward, advantage and indicator of every frame.

    Up to the advantage there is one shuffle of the frames, by episode. That table is written once and read for the thresholds
    (its task and advantage only) and for the labels, whose join with a row for each task needs no shuffle.
    """
    f = with_episode_facts(frames, episodes, "failure", "is_expert").withColumn("target", value_target(c_fail))
    f = cut(n_step_advantage(f.withColumn("reward", dense_reward()), n, "reward", value), "advantage")
    return binarized(f, task_thresholds(f, positive_ratio), "is_intervention", "is_expert")
