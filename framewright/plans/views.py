"""The driver's tables as trajectory data: frames, episodes, transitions, vectors. Each view has its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from framewright.operators.indexing import with_offsets

FPS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def episodes_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One episode for each user of events."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("episode_index")).agg(F.count("*").alias("length"))
    e = with_offsets(e, "episode_index", "length")
    k = F.col("episode_index")
    return e.select("*", (k % 5).alias("task_index"), F.when(k % 7 == 0, F.lit(None)).when(k % 3 == 0, "failure").otherwise("success").alias("episode_success"), (k % 10 == 0).alias("is_expert"))


def frames_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame for each event, in the order of time."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = table(spark, sf_dir, "events").withColumn("frame_index", (F.row_number().over(w) - 1).cast("long"))
    e = episodes_ev(spark, sf_dir).select("episode_index", "dataset_from_index", "task_index")
    f = f.join(e, F.col("user_id") == F.col("episode_index"))
    return f.select(
        (F.col("dataset_from_index") + F.col("frame_index")).alias("index"), "episode_index", "frame_index", (F.col("frame_index") / FPS).alias("timestamp"), "task_index",
        F.col("value").alias("x"), F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("is_intervention"), (-F.least(F.lit(1.0), F.col("value") / 100)).alias("pred_value"), F.col("event_type").alias("label"),
    )


def frames_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of orders, with the gaps that their line numbers have."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")).alias("m"))
    return li.select(F.col("l_orderkey").alias("episode_index"), (F.col("l_linenumber") - 1).cast("long").alias("frame_index"), F.col("m.l_quantity").alias("q"), (F.col("m.l_extendedprice") / 1000).alias("v"))


def frames_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short episodes: an order's lines, with a state of four numbers, its success and its task."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    li = table(spark, sf_dir, "lineitem").withColumn("frame_index", (F.row_number().over(w) - 1).cast("long"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode_index"), (F.col("o_orderstatus") == "F").alias("success"), F.col("o_orderpriority").alias("task"))
    return li.join(o, F.col("l_orderkey") == F.col("episode_index")).select("episode_index", "frame_index", F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("state"), "success", "task")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("vec_id")
    v = table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.col("label").cast("long").alias("episode_index"), (F.row_number().over(w) - 1).cast("long").alias("frame_index"), F.col("embedding").cast("array<double>").alias("state"))


EV = """episodes_ev as (select user_id as episode_index, count(*) as length, (sum(count(*)) over (order by user_id) - count(*))::bigint as dataset_from_index,
  (sum(count(*)) over (order by user_id))::bigint as dataset_to_index, user_id % 5 as task_index,
  case when user_id % 7 = 0 then null when user_id % 3 = 0 then 'failure' else 'success' end as episode_success, user_id % 10 = 0 as is_expert from events group by user_id),
frames_ev as (select dataset_from_index + frame_index as index, episode_index, frame_index, frame_index / 10 as timestamp, task_index, value as x,
  case when event_type = 'error' then 1.0::double else 0.0::double end as is_intervention, -least(1.0::double, value / 100) as pred_value, event_type as label
  from (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_index from events) join episodes_ev on user_id = episode_index)"""
GAP = """frames_gap as (select l_orderkey as episode_index, (l_linenumber - 1)::bigint as frame_index, l_quantity as q, l_extendedprice / 1000 as v
  from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) as r from lineitem) where r = 1)"""
LI = """frames_li as (select l_orderkey as episode_index, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 as frame_index,
  [l_quantity, l_extendedprice, l_discount, l_tax] as state, o_orderstatus = 'F' as success, o_orderpriority as task from lineitem join orders on l_orderkey = o_orderkey)"""
VEC = """vectors as (select vec_id, label::bigint as episode_index, row_number() over (partition by label order by vec_id) - 1 as frame_index, embedding::double[] as state from embeddings)"""


def ev(body: str) -> str:
    return f"with {EV}{' ' if not body.startswith(',') else ''}{body}"


def gap(body: str) -> str:
    return f"with {GAP}{' ' if not body.startswith(',') else ''}{body}"


def li(body: str) -> str:
    return f"with {LI}{' ' if not body.startswith(',') else ''}{body}"


def vec(body: str) -> str:
    return f"with {VEC}{' ' if not body.startswith(',') else ''}{body}"
