"""Queries of the streams: each reads one file a batch, so that state is carried on, and gives what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from framewright.operators import labels as L, sampling as T
from framewright.plans.registry import query
from framewright.plans.views import episodes_ev, ev, frames_ev, gap, table
from framewright.plans.window_queries import EPOCHS, epochs_ev
from framewright.sources import dataset as D
from framewright.sources.scratch import cut, new_folder
from framewright.streaming import annotation as A, elements as E, stateful as R


#: Rows of a file, about.
SLICE_ROWS = 1_000_000
#: Batches of a stream, whatever its rows: each has as many files as they need. More batches of as many rows would bring each key
#: in each batch, so that the calls for keys would grow as the square of the rows.
BATCHES = 4


def _source(rows: DataFrame) -> DataFrame:
    """rows as a stream of batches, each a range of _seq, or the rows of one _slice where they have that. They are
    written at once; as a stream takes files by the time they were changed, the files are then given the times at which they would have come."""
    spark, root = rows.sparkSession, new_folder(rows.sparkSession, "stream")
    rows = cut(rows, "rows")
    if "_slice" in rows.columns:
        slices = rows.agg(F.max("_slice")).first()[0] + 1
        rows.repartitionByRange(slices, "_slice").sortWithinPartitions("_slice").write.partitionBy("_slice").parquet(f"{root}/data")
        _timed(spark, f"{root}/data", "_slice=", lambda name: int(name.split("=")[1]))
        return D.stream_frames(spark, root, rows.drop("_slice").schema, files_per_trigger=1)
    files = max(1, -(-rows.count() // (BATCHES * SLICE_ROWS)))
    rows.repartitionByRange(BATCHES * files, "_seq").sortWithinPartitions("_seq").write.parquet(f"{root}/data")
    _timed(spark, f"{root}/data", "part-", str)  # parts are numbered by range
    return D.stream_frames(spark, root, rows.schema, files_per_trigger=files)


def _timed(spark, folder: str, prefix: str, order) -> None:
    """Give what lies in folder under names with the prefix, and the files in it, times a second apart, by the order of the names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((f for f in fs.listStatus(path) if f.getPath().getName().startswith(prefix)), key=lambda f: order(f.getPath().getName()))
    for k, f in enumerate(found):
        for file in fs.listStatus(f.getPath()) if f.isDirectory() else [f]:
            fs.setTimes(file.getPath(), 1_600_000_000_000 + 1_000 * k, -1)


def _run(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    out, check = new_folder(spark, "out"), new_folder(spark, "check")
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _tasks(spark, sf: str) -> DataFrame:
    """The texts of the tasks, written once: every batch joins them."""
    tasks = episodes_ev(spark, sf).select("task_index").distinct().withColumn("task", F.concat(F.lit("task_"), F.col("task_index").cast("string")))
    return cut(tasks, "tasks")


@query(ev("select index, 'task_' || task_index as task from frames_ev"))
def r01_stream_scan_with_tasks(spark, sf):
    f = frames_ev(spark, sf).select("index", "task_index", F.col("index").alias("_seq"))
    return _run(_source(f).join(_tasks(spark, sf), "task_index").select("index", "task"))


@query(EPOCHS + "epoch, position, index, 'task_' || task_index as task from o")
def r01_stream_epochs(spark, sf):
    """A stream over three epochs, each shuffled by shards in its own way, with the task's text."""
    f = epochs_ev(spark, sf).select("epoch", "position", "index", "task_index", F.struct("epoch", "position").alias("_seq"))
    return _run(_source(f).join(_tasks(spark, sf), "task_index").select("epoch", "position", "index", "task"))


@query(ev("select episode_index, frame_index, [coalesce(lag(x, 2) over w, first_value(x) over w), coalesce(lag(x, 1) over w, x), x, coalesce(lead(x, 1) over w, x)] as \"window\", [lag(x, 2) over w is null, lag(x, 1) over w is null, false, lead(x, 1) over w is null] as is_pad from frames_ev window w as (partition by episode_index order by frame_index)"))
def r02_stream_look_around(spark, sf):
    e = episodes_ev(spark, sf).select("episode_index", "dataset_to_index")
    f = frames_ev(spark, sf).join(e, "episode_index").select("episode_index", "frame_index", "x", (F.col("index") + 1 == F.col("dataset_to_index")).alias("last"), F.col("frame_index").alias("_seq"))
    return _run(R.look_around(_source(f), "x", 2, 1))


@query(ev("select case when is_intervention > 0.5 then 'both' else 'online' end as place, count(*) as n from frames_ev where index % 13 <> 4 group by 1"))
def r03_transition_routing(spark, sf):
    x = F.when(F.col("index") % 13 == 4, F.lit(float("nan"))).otherwise(F.col("x"))
    f = frames_ev(spark, sf).select("index", x.alias("x"), "is_intervention", F.col("index").alias("_seq"))
    out = new_folder(spark, "routed")
    R.routed(_source(f), out, new_folder(spark, "check")).awaitTermination()
    online, offline = spark.read.parquet(f"{out}/online"), spark.read.parquet(f"{out}/offline")
    both = offline.select("index", F.lit("both").alias("place"))
    return online.select("index").join(both, "index", "left").groupBy(F.coalesce("place", F.lit("online")).alias("place")).agg(F.count("*").alias("n"))


@query(ev(""", m as (select episode_index, max(frame_index) as last from frames_ev group by 1), n as (select f.*, lag(x) over (partition by episode_index order by frame_index) as before, m.last from frames_ev f join m using (episode_index))
select episode_index as robot, frame_index + 2 as timestep, round(case when before is null then x else 0.3 * (before + 1) + 0.7 * x end, 6) as action from n where frame_index + 2 <= last - 1"""))
def r04_stream_action_merge(spark, sf):
    """A frame sends the actions of two timesteps ahead and one that is already taken: the first overlaps with what the frame before sent."""
    e = episodes_ev(spark, sf).select("episode_index", (F.col("length") - 1).alias("_last"))
    f = frames_ev(spark, sf).join(e, "episode_index").select(F.col("episode_index").alias("robot"), F.col("frame_index").alias("seq"), "x", (F.col("frame_index") == F.col("_last")).alias("over"))
    sent = F.explode(F.array(*[F.struct((F.col("seq") + d).alias("timestep"), (F.col("x") + more).alias("action")) for d, more in ((2, 0.0), (3, 1.0), (-2, 9.0))]))
    chunks = f.select("robot", "seq", "over", sent.alias("c")).select("robot", "seq", "c.timestep", "c.action", (F.col("seq") - 1).alias("taken"), "over", F.col("seq").alias("_seq"))
    return _run(R.merge_actions(_source(chunks), lambda old, new: 0.3 * old + 0.7 * new, "over")).withColumn("action", F.round("action", 6))


@query(ev(""", o as (select episode_index as robot, frame_index as timestep, x, label = 'error' as must_go from frames_ev),
k as (select robot, timestep, x, true as kept, x as last from o where timestep = 0
  union all select o.robot, o.timestep, o.x, o.must_go or abs(o.x - k.last) >= 20, case when o.must_go or abs(o.x - k.last) >= 20 then o.x else k.last end from k join o on o.robot = k.robot and o.timestep = k.timestep + 1)
select robot, timestep, x from k where kept""").replace("with episodes_ev", "with recursive episodes_ev", 1))
def r05_observation_deduplication(spark, sf):
    f = frames_ev(spark, sf).select(F.col("episode_index").alias("robot"), F.col("frame_index").alias("timestep"), "x", (F.col("label") == "error").alias("must_go"), F.col("frame_index").alias("_seq"))
    return _run(R.distinct_observations(_source(f), 20.0))


@query(ev(", d as (select episode_index as source, frame_index as seq, label = 'purchase' as done, coalesce(sum((label = 'purchase')::int) over (partition by episode_index order by frame_index rows between unbounded preceding and 1 preceding), 0)::bigint as episode from frames_ev), k as (select *, bool_or(done) over (partition by source, episode) as ended from d) select source, episode, row_number() over (partition by source, episode order by seq) - 1 as frame_index, seq from k where ended"))
def r06_episode_sessions(spark, sf):
    f = frames_ev(spark, sf).select(F.col("episode_index").alias("source"), F.col("frame_index").alias("seq"), (F.col("label") == "purchase").alias("done"), F.col("frame_index").alias("_seq"))
    return _run(R.episodes_of(_source(f)))


@query(ev(", d as (select episode_index as source, frame_index as seq, label = 'purchase' as done, coalesce(sum((label = 'purchase')::int) over (partition by episode_index order by frame_index rows between unbounded preceding and 1 preceding), 0)::bigint as episode from frames_ev), k as (select *, bool_or(done) over (partition by source, episode) as ended from d) select source, episode, row_number() over (partition by source, episode order by seq) - 1 as frame_index, seq from k where ended"))
def r06_long_sessions(spark, sf):
    """The same by lists that only grow until an episode ends."""
    f = frames_ev(spark, sf).select(F.col("episode_index").alias("source"), F.col("frame_index").alias("seq"), (F.col("label") == "purchase").alias("done"), F.col("frame_index").alias("_seq"))
    return _run(E.long_episodes_of(_source(f)))


@query(ev(""", l as (select max(frame_index) as most from frames_ev), k as (select episode_index as robot, frame_index as f, x from frames_ev, l where frame_index % 20 <> 3 or most < 20 * (frame_index // 20 + 2)),
e as (select robot, max(f) as last from k group by 1), s as (select distinct robot, f + d as s from k, (values (2), (3)) as t(d)),
a as (select s.robot, s.s, e.last, old.x as old, new.x as new from s join e using (robot) left join k old on old.robot = s.robot and old.f = s.s - 3 left join k new on new.robot = s.robot and new.f = s.s - 2)
select robot, s as timestep, round(case when old is null then new when new is null then old + 1 else 0.3 * (old + 1) + 0.7 * new end, 6) as action, s > last - 1 as closed from a, l where s <= last - 1 or last + 30.5 < most - 10"""))
def r04_queued_actions(spark, sf):
    """A frame a minute; every twentieth comes two batches late, under the watermark, and is dropped whole with what it took. Queues of
    robots that have been silent for half an hour are closed."""
    most = table(spark, sf, "events").groupBy("user_id").count().agg(F.max("count")).first()[0] - 1
    i = F.col("frame_index")
    late = F.when((i % 20 == 3) & (F.lit(most) >= 20 * (F.floor(i / 20) + 2)), 2).otherwise(0)
    f = frames_ev(spark, sf).select(F.col("episode_index").alias("robot"), i.alias("seq"), "x", (F.floor(i / 20) + late).cast("int").alias("_slice"))
    sent = F.explode(F.array(*[F.struct((F.col("seq") + d).alias("timestep"), (F.col("x") + more).alias("action")) for d, more in ((2, 0.0), (3, 1.0), (-2, 9.0))]))
    chunks = f.select("robot", "seq", sent.alias("c"), "_slice").select("robot", "seq", "c.timestep", "c.action", (F.col("seq") - 1).alias("taken"), F.timestamp_seconds(1_700_000_000 + 60 * F.col("seq")).alias("ts"), "_slice")
    return _run(E.queued_actions(_source(chunks), lambda old, new: 0.3 * old + 0.7 * new, idle_ms=1_830_000)).withColumn("action", F.round("action", 6))


@query(ev(""", p as (select *, coalesce(lag(x) over w, x) as before, is_intervention > 0.5 as e, coalesce(lag(is_intervention > 0.5) over w, false) as was from frames_ev window w as (partition by episode_index order by frame_index))
select episode_index, frame_index, round((x - before) / 0.1, 6) as velocity, abs(x - before) > 100 as jumped, frame_index + 1 as step,
  coalesce(last_value(case when e and not was then x end ignore nulls) over (partition by episode_index order by frame_index rows unbounded preceding), 0) as held from p"""))
def r09_stream_velocity(spark, sf):
    e = episodes_ev(spark, sf).select("episode_index", (F.col("length") - 1).alias("_last"))
    f = frames_ev(spark, sf).join(e, "episode_index").select("episode_index", "frame_index", "x", (F.col("is_intervention") > 0.5).alias("enabled"), (F.col("frame_index") == F.col("_last")).alias("over"), F.col("frame_index").alias("_seq"))
    return _run(R.stepwise(_source(f), 0.1, 100.0, "over")).withColumn("velocity", F.round("velocity", 6))


@query(ev(", l as (select episode_index as robot, x, row_number() over (partition by episode_index order by frame_index desc) as r from frames_ev) select robot, least(30, count(*)) as n, max(x) filter (r <= 30) as max from l group by 1"))
def r10_latency_ring(spark, sf):
    """What was given out last for each robot, after several batches."""
    f = frames_ev(spark, sf).select(F.col("episode_index").alias("robot"), F.col("frame_index").alias("seq"), F.col("x").alias("value"), F.col("frame_index").alias("_seq"))
    return _run(R.latency(_source(f), 30)).groupBy("robot").agg(F.max_by("n", "seq").alias("n"), F.max_by("max", "seq").alias("max"))


@query("""with w as (select time_bucket(interval '1 hour', ts) as start, count(*) as n, round(avg(value), 6) as mean from events group by 1)
select start, n, mean from w where start + interval '1 hour' <= (select max(ts) from events) - interval '10 minutes'""")
def r10_latency_windows(spark, sf):
    """The windows that the watermark has closed; no row is late."""
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_id").alias("_seq"))
    w = _run(R.windowed_latency(_source(e)))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"))


@query("""with b as (select min(epoch(ts)) as lo, max(epoch(ts)) as hi from events), e as (select ts, value, event_id, least(3, floor(4 * (epoch(ts) - lo) / (hi - lo))) as slice from events, b),
w as (select time_bucket(interval '1 hour', ts) as start, count(*) as n, round(avg(value), 6) as mean from e where slice > 0 or event_id % 3 > 0 group by 1)
select start, n, mean from w where start + interval '1 hour' <= (select max(ts) from events) - interval '10 minutes'""")
def r10_late_windows(spark, sf):
    """A third of the rows of the first quarter of the time come with the last: their windows are closed, and they are dropped."""
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value", "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"))
    ends = e.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first()
    quarter = F.least(F.lit(3), F.floor(4 * (F.col("t") - ends.lo) / (ends.hi - ends.lo))).cast("int")
    slices = e.withColumn("_slice", F.when((quarter == 0) & (F.col("event_id") % 3 == 0), 3).otherwise(quarter)).select("ts", "value", "_slice")
    return _run(R.windowed_latency(_source(slices))).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"))


@query(ev("select index, x from frames_ev where index > (select max(index) from frames_ev) - 777"))
def r11_stream_ring_log(spark, sf):
    f = frames_ev(spark, sf).select("index", "x", F.col("index").alias("_seq"))
    return T.newest(_run(_source(f).select("index", "x")), 777)


@query(ev(", t as (select task_index, quantile_cont(x, 0.7) as q from frames_ev group by 1) select index, (x >= q)::int::bigint as indicator from frames_ev join t using (task_index)"))
def r08_two_pass_labels(spark, sf):
    f = frames_ev(spark, sf).select("index", "task_index", F.col("x").alias("advantage"), F.col("index").alias("_seq"))
    table_ = _run(_source(f).select("index", "task_index", "advantage"))
    return L.binarized(table_, L.task_thresholds(table_)).select("index", "indicator")


class Planted(RuntimeError):
    """A failure that a query plants on purpose."""


def failing_at(step: str):
    """To be told of steps; fails at the one named."""

    def told(name: str) -> None:
        if name == step:
            raise Planted(step)

    return told


@query(ev(", t as (select task_index, quantile_cont(x * 2, 0.7) as q from frames_ev group by 1) select index, x * 2 as score, (x * 2 >= q)::int::bigint as indicator from frames_ev join t using (task_index)"))
def r07_resumed_annotation(spark, sf):
    """Scoring that fails three times: with a batch scored but not recorded, with all scored and nothing merged, with all merged
    and nothing committed. Each call goes on where the one before was broken off."""
    f = frames_ev(spark, sf).select("episode_index", "index", "task_index", "x")
    e, root, out = cut(episodes_ev(spark, sf).select("episode_index", "length"), "episodes"), new_folder(spark, "frames"), new_folder(spark, "annotated")
    cut(f, "rows").repartitionByRange(4, "episode_index").write.parquet(f"{root}/data")
    run = lambda told=lambda step: None: A.annotated(spark, root, f.schema, e, out, F.col("x") * 2, files_per_trigger=1, told=told)
    for step in ("status 2", "merge", "commit"):
        try:
            run(failing_at(step))
        except Exception as failure:
            if "Planted" not in str(failure) and not isinstance(failure, Planted):
                raise
        else:
            raise RuntimeError(f"{step} was never reached")
    return run().select("index", F.col("advantage").alias("score"), "indicator")


@query(ev(", n as (select count(*) as n from episodes_ev) select status, case when status = 'inference' then 0 else n end as done, n as total from n, (values ('inference'), ('merging'), ('completed')) as t(status)"))
def r07_annotation_status(spark, sf):
    """What the status says before, after a failure between scoring and merging, and at the end."""
    f = frames_ev(spark, sf).select("episode_index", "index", "task_index", "x")
    e, root, out = cut(episodes_ev(spark, sf).select("episode_index", "length"), "episodes"), new_folder(spark, "frames"), new_folder(spark, "annotated")
    f.repartitionByRange(4, "episode_index").write.parquet(f"{root}/data")
    seen = [A.progress(spark, out, e)]
    try:
        A.annotated(spark, root, f.schema, e, out, F.col("x"), told=failing_at("merge"))
    except Planted:
        seen.append(A.progress(spark, out, e))
    A.annotated(spark, root, f.schema, e, out, F.col("x"))
    return seen[0].union(seen[1]).union(A.progress(spark, out, e))
