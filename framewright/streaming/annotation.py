"""Annotation of a stored dataset episode by episode, that goes on where it was broken off.

Three tables lie in one folder: `scores`, what each batch of the stream gave; `status`, the episodes of each batch and how many of
their frames it scored, written after the batch's scores; and the final labels, which a commit makes visible. A batch that runs
again replaces its own scores and status, so no row is there twice; scores of a batch without a status don't count.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framewright.operators.labels import binarized, task_thresholds
from framewright.sources import commits
from framewright.sources.dataset import stream_frames

SCORES = "episode_index long, index long, task_index long, advantage double, run long, batch long"
STATUS = "episode_index long, frames long, run long, batch long"


def _table(spark: SparkSession, out: str, name: str, schema: str) -> DataFrame:
    there = commits.listed(spark, f"{out}/{name}")
    return spark.read.schema(schema).option("basePath", f"{out}/{name}").parquet(f"{out}/{name}") if there else spark.createDataFrame([], schema)


def episodes_done(spark: SparkSession, out: str, episodes: DataFrame, but: tuple[int, int] = (-1, -1)) -> DataFrame:
    """(episode_index) of the episodes all of whose frames are scored, leaving out what the batch `but` (run, batch) has done."""
    status = _table(spark, out, "status", STATUS).where(~((F.col("run") == but[0]) & (F.col("batch") == but[1])))
    scored = status.groupBy("episode_index").agg(F.sum("frames").alias("_scored"))
    return scored.join(episodes, "episode_index").where("_scored >= length").select("episode_index")


def progress(spark: SparkSession, out: str, episodes: DataFrame) -> DataFrame:
    """(status, done, total): inference until all episodes are scored, then merging, then completed."""
    total, done = episodes.count(), episodes_done(spark, out, episodes).count()
    phase = "completed" if commits.newest(spark, out) else "merging" if done == total else "inference"
    return spark.createDataFrame([(phase, done, total)], "status string, done long, total long")


def annotated(
    spark: SparkSession, root: str, schema, episodes: DataFrame, out: str, score: Column, positive_ratio: float = 0.3, config: str = "", files_per_trigger: int = 16, told: Callable[[str], None] = lambda step: None
) -> DataFrame:
    """(episode_index, index, task_index, advantage, indicator) of all frames under root/data, from the folder out if it has them.

    score is a column over the frames (schema), episodes has the length of each. Frames are scored by a stream whose checkpoint is
    in out, so that a call after a failure scores the batches that are left; episodes that earlier calls have scored are passed over
    also when the checkpoint is lost. Then the thresholds of all tasks are taken and the labels are written. A finished folder is
    read; another config than it was begun with only warns. told is called with each step's name before it.
    """
    record = commits.newest(spark, out)
    begun = commits.newest(spark, f"{out}/config")
    if begun is None:
        commits.commit(spark, f"{out}/config", {"version": 0, "config": config})
    elif begun["config"] != config:
        warnings.warn(f"{out} was begun with another configuration", stacklevel=2)
    if record:
        return spark.read.parquet(record["final"])
    runs = [int(n) for n in commits.listed(spark, f"{out}/checkpoints")]
    used = [int(n.removeprefix("run=")) for kind in ("scores", "status") for n in commits.listed(spark, f"{out}/{kind}") if n.startswith("run=")]
    run = max(runs) if runs else max(used, default=-1) + 1

    def write(batch: DataFrame, number: int) -> None:
        place = f"run={run}/batch={number}"
        rest = batch.join(episodes_done(spark, out, episodes, (run, number)), "episode_index", "left_anti")
        told(f"scores {number}")
        rest.select("episode_index", "index", "task_index", score.cast("double").alias("advantage")).write.mode("overwrite").parquet(f"{out}/scores/{place}")
        told(f"status {number}")
        scored = spark.read.schema(SCORES).parquet(f"{out}/scores/{place}")
        scored.groupBy("episode_index").agg(F.count("*").alias("frames")).write.mode("overwrite").parquet(f"{out}/status/{place}")
        told(f"end {number}")

    frames = stream_frames(spark, root, schema, files_per_trigger=files_per_trigger)
    frames.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoints/{run}").trigger(availableNow=True).start().awaitTermination()
    if (lost := episodes.join(episodes_done(spark, out, episodes), "episode_index", "left_anti").count()):
        raise RuntimeError(f"{lost} episodes have fewer frames than their length")
    told("merge")
    scores = _table(spark, out, "scores", SCORES).join(_table(spark, out, "status", STATUS).select("run", "batch", "episode_index").distinct(), ["run", "batch", "episode_index"], "left_semi")
    final = f"{out}/final/{uuid.uuid4().hex}"
    labels = binarized(scores, task_thresholds(scores, positive_ratio)).select("episode_index", "index", "task_index", "advantage", "indicator")
    labels.repartitionByRange("index").sortWithinPartitions("index").write.parquet(final)
    told("commit")
    commits.commit(spark, out, {"version": 0, "final": final})
    return spark.read.parquet(final)
