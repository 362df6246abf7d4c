"""Queries that write datasets and read them back."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from framewright.functions.vectors import real_dims
from framewright.operators.indexing import with_offsets
from framewright.operators import labels as L, stats as S, windows as W
from framewright.plans.registry import query
from framewright.plans.stream_queries import Planted, failing_at
from framewright.plans.views import episodes_ev, ev, frames_ev, frames_li, li, table
from framewright.sources import dataset as D, schema as C
from framewright.sources.scratch import new_folder

_FEATURES = {"index": {"dtype": "int64", "shape": (1,)}, "episode_index": {"dtype": "int64", "shape": (1,)}, "x": {"dtype": "float64", "shape": (1,)}}


def _written(spark, sf):
    root = new_folder(spark, "dataset")
    D.write_frames(frames_ev(spark, sf), root, 3000)
    return root


@query(ev("select index, episode_index, x from frames_ev"))
def s01_frame_scan(spark, sf):
    return D.scan_frames(spark, _written(spark, sf), _FEATURES)


@query(ev("select index, episode_index, x from frames_ev where episode_index in (3, 5, 8)"))
def s02_episode_filtered_scan(spark, sf):
    return D.scan_frames(spark, _written(spark, sf), _FEATURES, [3, 5, 8])


@query("select 10 as fps, count(*) as total_frames, 3 as features from events")
def s03_manifest_round_trip(spark, sf):
    root = new_folder(spark, "manifest")
    n = table(spark, sf, "events").count()
    D.write_manifest(spark, root, {"fps": 10, "total_frames": n, "features": {k: {**v, "shape": list(v["shape"])} for k, v in _FEATURES.items()}})
    info = D.scan_manifest(spark, root)
    return table(spark, sf, "events").limit(1).select(F.lit(info["fps"]).alias("fps"), F.lit(info["total_frames"]).cast("long").alias("total_frames"), F.lit(len(C.schema_of(info["features"]))).alias("features"))


@query("select o_orderpriority as task, row_number() over (order by o_orderpriority) - 1 as task_index from (select distinct o_orderpriority from orders)")
def s04_task_scan(spark, sf):
    root = new_folder(spark, "tasks")
    t = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("__index_level_0__")).distinct()
    t.withColumn("task_index", (F.row_number().over(Window.orderBy("__index_level_0__")) - 1).cast("long")).write.parquet(f"{root}/meta/tasks.parquet")
    return D.scan_tasks(spark, root)


@query(ev("select episode_index, length, dataset_from_index, dataset_to_index from episodes_ev"))
def s05_episode_scan(spark, sf):
    root = new_folder(spark, "episodes")
    e = episodes_ev(spark, sf).select("episode_index", "length", "dataset_from_index", "dataset_to_index").withColumn("stats/x/max", F.lit(1.0))
    e.write.parquet(f"{root}/meta/episodes/chunk-000")
    return D.scan_episodes(spark, root)


@query(ev("select episode_index, ['task_' || task_index, 'task_' || (task_index + 1) % 5] as tasks from episodes_ev"))
def s06_named_tasks(spark, sf):
    e = episodes_ev(spark, sf).select("episode_index", F.array("task_index", (F.col("task_index") + 1) % 5).alias("tasks"))
    t = episodes_ev(spark, sf).select("task_index").distinct().withColumn("task", F.concat(F.lit("task_"), F.col("task_index").cast("string")))
    return D.named_tasks(e, t)


_ROTATED = """, r as (select episode_index, length, length * 24 as bytes, row_number() over (order by episode_index) as r from episodes_ev),
p as (select r, episode_index, bytes, 0::bigint as b, bytes as s from r where r = 1 union all
  select r.r, r.episode_index, r.bytes, case when p.s + r.bytes > 5242 then p.b + 1 else p.b end, case when p.s + r.bytes > 5242 then r.bytes else p.s + r.bytes end from p join r on r.r = p.r + 1)
select b // 4 as chunk_index, b % 4 as file_index, min(p.episode_index) as first_episode, count(distinct p.episode_index) as episodes, count(*) as rows, sum(index)::bigint as total from p join frames_ev using (episode_index) group by b"""


@query(ev(_ROTATED).replace("with episodes_ev", "with recursive episodes_ev", 1))
def s08_rotated_files(spark, sf):
    """Three columns of 8 bytes in files of 0.005 MB at most, four files a chunk; the map says what the files hold."""
    root = new_folder(spark, "rotated")
    place = D.write_rotated(frames_ev(spark, sf).select("index", "episode_index", "x"), root, 0.005, 4)
    held = spark.read.parquet(f"{root}/data").groupBy("chunk_index", "file_index", "episode_index").agg(F.count("*").alias("n"), F.sum("index").alias("t"))
    held = held.join(place, ["chunk_index", "file_index", "episode_index"]).groupBy(F.col("chunk_index").cast("long").alias("chunk_index"), F.col("file_index").cast("long").alias("file_index"))
    return held.agg(F.min("episode_index").alias("first_episode"), F.count("*").alias("episodes"), F.sum("n").alias("rows"), F.sum("t").alias("total"))


_TWICE = """, f as (select *, dense_rank() over (partition by episode_index % 2 order by episode_index) - 1 as e, row_number() over (partition by episode_index % 2 order by episode_index, frame_index) - 1 as i from frames_ev),
n as (select count(distinct episode_index) as e, count(*) as i from frames_ev where episode_index % 2 = 0),
g as (select f.e + case when episode_index % 2 = 1 then n.e else 0 end as e, f.i + case when episode_index % 2 = 1 then n.i else 0 end as i, x, label from f, n)"""


@query(ev(_TWICE + " select e as episode_index, count(*) as length, min(i) as dataset_from_index, max(i) + 1 as dataset_to_index, list_sort(list(distinct label)) as tasks from g group by e"))
def s10_appended_episodes(spark, sf):
    """A dataset begun with half of the episodes; the others appended to what is stored."""
    return D.stored(spark, _appended(spark, sf))["episodes"].select("episode_index", "length", "dataset_from_index", "dataset_to_index", "tasks")


@query(ev(_TWICE + " select 'x' as feature, 0 as dim, count(*) as count, min(x) as min, max(x) as max, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std from g"))
def s10_appended_stats(spark, sf):
    """The statistics merged on appending are those of all frames."""
    s = D.stored(spark, _appended(spark, sf))["stats"]
    return s.select("feature", "dim", "count", "min", "max", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def _buffer(spark, sf):
    return frames_ev(spark, sf).select(F.col("episode_index").alias("source"), F.col("frame_index").alias("step"), F.col("label").alias("task"), "x")


def _appended(spark, sf, steps=()):
    """A dataset of two halves; before the second is appended, a writer fails at each of the steps named."""
    root, buffer = new_folder(spark, "growing"), _buffer(spark, sf)
    D.appended(spark, root, buffer.where(F.col("source") % 2 == 0), 30, ["x"])
    for step in steps:
        try:
            D.appended(spark, root, buffer.where(F.col("source") % 2 == 1), 30, ["x"], told=failing_at(step))
        except Planted:
            continue
        raise RuntimeError(f"{step} was never reached")
    D.appended(spark, root, buffer.where(F.col("source") % 2 == 1), 30, ["x"])
    return root


@query(ev(_TWICE + ", t as (select label, row_number() over (order by min(i)) - 1 as task_index from g group by 1) select e as episode_index, i as index, x, task_index from g join t using (label)"))
def s10_recovered_append(spark, sf):
    """Writers that fail before each of their writes leave nothing behind that is read, and the one that gets through appends once."""
    return D.stored(spark, _appended(spark, sf, ("frames", "episodes", "tasks", "stats", "commit")))["frames"].select("episode_index", "index", "x", "task_index")


_BUCKETS = """, b as (select case when x = 0 then 0 else sign(x) * (floor(ln(abs(x)) * 256) + 1048576) end::bigint as b, count(*) as n from frames_ev group by 1),
u as (select b, sum(n) over (order by b) as up, sum(n) over () as total from b),
m as (select *, case when b = 0 then 0 else sign(b) * exp((abs(b) - 1048576 + 0.5) / 256) end as v from u),
q as (select p.name, p.q * (any_value(total) - 1) as spot, p.q, min(v) filter (up > floor(p.q * (total - 1))) as low, min(v) filter (up > ceil(p.q * (total - 1))) as high from m, (values ('q01', 0.01::double), ('q10', 0.1), ('q50', 0.5), ('q90', 0.9), ('q99', 0.99)) as p(name, q) group by 1, 3)"""


@query(ev(_BUCKETS + " select 'x' as feature, name, round(low + (high - low) * (spot - floor(spot)), 6) as value from q"))
def s10_appended_quantiles(spark, sf):
    """Quantiles from the sketches that were stored with each half and merged on appending."""
    s = S.sketched(D.stored(spark, _appended(spark, sf))["stats"])
    names = [S.quantile_name(q) for q in S.QUANTILES]
    melted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.round(n, 6).alias("value")) for n in names])).alias("m")
    return s.select("feature", melted).select("feature", "m.name", "m.value")


@query(ev(", q as (select quantile_cont(x, [0.01, 0.1, 0.5, 0.9, 0.99]) as q from frames_ev) select 'x' as feature, true as within from q"))
def a03_merged_sketches(spark, sf):
    """Whether the quantiles of merged sketches, one for each episode, are as near to the exact ones as they say."""
    f = frames_ev(spark, sf)
    parts = S.with_sketches(S.feature_stats(f, ["x"], ("episode_index",), ()), f, ["x"], ("episode_index",)).drop("episode_index")
    merged, exact = S.sketched(S.merged_stats(parts)), S.feature_stats(f, ["x"])
    names = [S.quantile_name(q) for q in S.QUANTILES]
    near = [F.abs(merged[n] - exact[n]) <= F.abs(exact[n]) * S.SKETCH_ERROR * 1.001 for n in names]
    both = merged.join(exact, ["feature", "dim"])
    within = near[0]
    for n in near[1:]:
        within = within & n
    return both.select("feature", within.alias("within"))


@query(ev(_TWICE + ", t as (select label, row_number() over (order by min(i)) - 1 as task_index from g group by 1), d as (select e, i, x, label, 0 as k from g union all select e, i, x, label || '_b', 1 from g where e % 3 = 0), r as (select *, dense_rank() over (order by k, e) - 1 as ne, row_number() over (order by k, i) - 1 as ni from d), w as (select label, row_number() over (order by min(ni)) - 1 as task_index from r group by 1) select ne as episode_index, ni as index, x, label as task from r"))
def u01_merged_by_reference(spark, sf):
    """Two stored datasets, one of them appended to, as one without a copy of their frames; their tasks are others."""
    first, second, both = _appended(spark, sf), new_folder(spark, "second"), new_folder(spark, "both")
    held = D.stored(spark, first)
    some = held["frames"].where("episode_index % 3 = 0").join(held["tasks"], "task_index")
    D.appended(spark, second, some.select(F.col("episode_index").alias("source"), F.col("frame_index").alias("step"), F.concat("task", F.lit("_b")).alias("task"), "x"), 30, ["x"])
    D.merged_by_reference(spark, both, [first, second])
    found = D.stored(spark, both)
    return found["frames"].join(found["tasks"], "task_index").select("episode_index", "index", "x", "task")


@query(ev(_TWICE + ", k as (select *, case when e % 4 = 1 then 'val' else 'train' end as split from g where e % 4 > 0) select split, dense_rank() over (partition by split order by e) - 1 as episode_index, row_number() over (partition by split order by i) - 1 as index, x, label as task from k"))
def p14_split_by_reference(spark, sf):
    """A stored dataset that was appended to, split by lists of episodes without a copy of its frames."""
    root, roots = _appended(spark, sf), {s: new_folder(spark, s) for s in ("train", "val")}
    e = D.stored(spark, root)["episodes"].where("episode_index % 4 > 0")
    D.split_by_reference(spark, root, e.select("episode_index", F.when(F.col("episode_index") % 4 == 1, "val").otherwise("train").alias("split")), roots)
    parts = [(s, D.stored(spark, r)) for s, r in roots.items()]
    return D.concatenated([p["frames"].join(p["tasks"], "task_index").select(F.lit(s).alias("split"), "episode_index", "index", "x", "task") for s, p in parts])


@query(ev("select index, episode_index, x from frames_ev where episode_index % 37 = 5"))
def s02_episodes_by_file(spark, sf):
    """Frames of some episodes, from the files that hold them."""
    root = new_folder(spark, "rotated")
    place = D.write_rotated(frames_ev(spark, sf).select("index", "episode_index", "x"), root, 0.005, 4)
    return D.scan_placed(spark, root, place, place.where("episode_index % 37 = 5")).select("index", "episode_index", "x")


@query(ev("select index, x::float as x from frames_ev where index % 3 = 0"))
def s11_sidecar_round_trip(spark, sf):
    root = new_folder(spark, "sidecar")
    D.write_sidecar(root, "a", frames_ev(spark, sf).where("index % 3 = 0").select("index", "x"))
    return D.all_sidecars(spark, root, ["a"])[0]


@query(ev(", t as (select label as task, row_number() over (order by min(index)) - 1 as task_index from frames_ev group by 1), r as (select episode_index, dense_rank() over (order by episode_index) - 1 as e, index, frame_index, x, label from frames_ev) select index, e as episode_index, frame_index, frame_index / 30 as timestamp, task_index, x from r join t on label = task"))
def s09_ingested_frames(spark, sf):
    buffer = frames_ev(spark, sf).select(F.col("episode_index").alias("source"), F.col("frame_index").alias("step"), F.col("label").alias("task"), "x")
    return D.ingest(buffer, 30)[0].select("index", "episode_index", "frame_index", "timestamp", "task_index", "x")


@query(ev(", r as (select *, dense_rank() over (order by episode_index) - 1 as e from frames_ev) select e as episode_index, count(*) as length, min(index) as dataset_from_index, max(index) + 1 as dataset_to_index, list_sort(list(distinct label)) as tasks from r group by e"))
def s10_ingested_episodes(spark, sf):
    buffer = frames_ev(spark, sf).select(F.col("episode_index").alias("source"), F.col("frame_index").alias("step"), F.col("label").alias("task"), "x")
    return D.ingest(buffer, 30)[1].drop("source")


@query(ev("select index, case when index % 3 = 0 then round(x::float::double, 4) else 'nan'::double end as advantage, case when index % 2 = 0 then 1 else 0 end::bigint as flag from frames_ev"))
def s13_sidecar_overlay(spark, sf):
    root = new_folder(spark, "sidecar")
    f = frames_ev(spark, sf)
    D.write_sidecar(root, "a", f.where("index % 3 = 0").select("index", F.col("x").alias("advantage")))
    D.write_sidecar(root, "b", f.where("index % 2 = 0").select("index", F.lit(1).cast("bigint").alias("flag")))
    o = D.overlaid(f.select("index"), *D.all_sidecars(spark, root, ["a", "b"]))
    return o.select("index", F.round(F.col("advantage").cast("double"), 4).alias("advantage"), "flag")


@query(ev("select index, case when index % 4 = 1 then -1.0 else pred_value end as pred_value, case when index % 4 = 1 then 7 else 0 end::bigint as mark from frames_ev"))
def s12_column_upsert(spark, sf):
    f = frames_ev(spark, sf).select("index", "pred_value")
    some = f.where("index % 4 = 1")
    f = D.upserted(f, "pred_value", some.select("index", F.lit(-1.0).alias("pred_value")))
    return D.upserted(f, "mark", some.select("index", F.lit(7).cast("bigint").alias("mark")))


@query(ev("select episode_index, length, dataset_from_index, episode_success, round((select max(x) from frames_ev f where f.episode_index = e.episode_index), 6) as max_x from episodes_ev e"))
def s16_layout_upgrade(spark, sf):
    f, e = frames_ev(spark, sf), episodes_ev(spark, sf).select("episode_index", "episode_success")
    s = f.groupBy("episode_index").agg(F.max("x").alias("value")).select("episode_index", F.lit("x").alias("feature"), F.lit("max").alias("stat"), F.lit(0).alias("dim"), "value")
    u = D.upgraded(f, e, s)
    return u.select("episode_index", "length", "dataset_from_index", "episode_success", F.round(F.col("stats")["stats/x/max/0"], 6).alias("max_x"))


@query(li("select episode_index as episode, frame_index, [state[1]::float, state[3]::float] as state, episode_index % 2 = 0 as success from frames_li"))
def s17_imported_episodes(spark, sf):
    r = frames_li(spark, sf).groupBy(F.col("episode_index").alias("episode")).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_index", "state", "task"))), lambda x: F.struct(F.slice(x.state, 1, 1).alias("joint"), F.slice(x.state, 3, 1).alias("gripper"), x.task.alias("instruction"))).alias("steps"))
    r = r.withColumn("path", F.when(F.col("episode") % 2 == 0, "/data/success/x").otherwise("/data/failure/x"))
    return D.imported_episodes(r, "path").select("episode", "frame_index", "state", "success")


@query("""with l as (select user_id as ring, row_number() over (partition by user_id order by event_id) - 1 as n, event_type = 'purchase' as done from events),
m as (select *, max(n) over (partition by ring) as last from l), k as (select ring, n % 40 as slot, done, (n % 40 - (13 - 40) + 40) % 40 as age from m where n > last - 40),
e as (select ring, slot, age, coalesce(sum(done::int) over (partition by ring order by age rows between unbounded preceding and 1 preceding), 0)::bigint as episode_index from k)
select ring, slot, episode_index, row_number() over (partition by ring, episode_index order by age) - 1 as frame_index from e""")
def s18_exported_log(spark, sf):
    """A ring of 40 slots for each user, holding the newest of all their events, read from slot 13 on."""
    by = Window.partitionBy("user_id")
    log = table(spark, sf, "events").select(F.col("user_id").alias("ring"), (F.row_number().over(by.orderBy("event_id")) - 1).alias("n"), F.count("*").over(by).alias("c"), (F.col("event_type") == "purchase").alias("done"))
    log = log.where("n >= c - 40").select("ring", (F.col("n") % 40).cast("long").alias("slot"), "done", F.lit(False).alias("truncated"))
    return D.exported_log(log, 40, 13, 40).select("ring", "slot", "episode_index", "frame_index")


@query("""with k as (select event_id, row_number() over (order by event_id) - 1 as slot, event_type = 'purchase' as done from events), a as (select *, (slot - 777 + n) % n as age from k, (select count(*) as n from events)),
e as (select slot, age, coalesce(sum(done::int) over (order by age rows between unbounded preceding and 1 preceding), 0)::bigint as episode_index from a)
select slot, episode_index, row_number() over (partition by episode_index order by age) - 1 as frame_index from e""")
def s18_one_large_ring(spark, sf):
    """All events in one ring, read from slot 777 on; no task has more than a block of 500 slots."""
    events = table(spark, sf, "events")
    n = events.count()
    log = with_offsets(events.select("event_id", (F.col("event_type") == "purchase").alias("done")).withColumn("one", F.lit(1).cast("long")), "event_id", "one", "slot", "end")
    log = log.select(F.lit(0).alias("ring"), "slot", "done", F.lit(False).alias("truncated"))
    return D.exported_log(log, n, 777, n, block=500).select("slot", "episode_index", "frame_index")


@query(ev(", k as (select *, case when frame_index % 5 = 2 then x / 500 end as y from frames_ev) select index, episode_index, frame_index, round(y, 6) as progress_sparse from k where y is not null"))
def s19_progress_table(spark, sf):
    f = frames_ev(spark, sf).withColumn("y", F.when(F.col("frame_index") % 5 == 2, F.col("x") / 500)).withColumn("progress_dense", W.interpolated("y"))
    root = new_folder(spark, "progress")
    f.select("index", "episode_index", "frame_index", F.col("y").alias("progress_sparse"), "progress_dense").orderBy("index").write.parquet(root)
    return spark.read.parquet(root).where("progress_sparse is not null").select("index", "episode_index", "frame_index", F.round("progress_dense", 6).alias("progress_sparse"))


@query("select count(*) as rows from lineitem")
def s20_footer_counts(spark, sf):
    n = D.footer_counts(spark, f"{sf}/lineitem.parquet")
    return table(spark, sf, "lineitem").limit(1).select(F.lit(n).cast("long").alias("rows"))


@query(ev("select episode_index, frame_index, x::float as x, coalesce(episode_success, 'failure') as episode_success from frames_ev join episodes_ev using (episode_index)"))
def s21_rollout_dataset(spark, sf):
    r = frames_ev(spark, sf).select("episode_index", "frame_index", "x", F.col("pred_value").alias("next.reward"), F.col("is_intervention").alias("complementary_info.is_intervention"), F.lit(1).alias("slot"))
    return D.rollout_dataset(r, episodes_ev(spark, sf), ("slot",))


@query(li("select episode_index, frame_index, [true, true, true, true, false] as real from frames_li"))
def p21_validity_mask(spark, sf):
    return frames_li(spark, sf).select("episode_index", "frame_index", real_dims(F.col("state"), 5).alias("real"))


@query(ev("select 'x' as feature, count(*) as count, round(max(x), 6) as max, coalesce((select count(*) from episodes_ev where episode_success = 'success'), 0) as success from frames_ev"))
def x02_processor_pipeline(spark, sf):
    """Named steps of DataFrame functions, run one after the other by transform()."""
    steps = {"stats": lambda f: S.feature_stats(f, ["x"], quantiles=(0.5,)), "short": lambda s: s.select("feature", "count", F.round("max", 6).alias("max"))}
    out = frames_ev(spark, sf)
    for step in steps.values():
        out = out.transform(step)
    ok = S.success_report(episodes_ev(spark, sf), L.report_label(F.col("episode_success"))).select("success")  # one row
    return out.crossJoin(F.broadcast(ok))
