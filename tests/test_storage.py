"""Stored datasets that grow, merge and are annotated, with failures in between; packing and logs in blocks."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from framewright.operators import indexing as I, quantiles as Q, sampling as T, stats as S
from framewright.plans.stream_queries import Planted, failing_at
from framewright.sources import commits, dataset as D
from framewright.streaming import annotation as A


def buffer(spark, episodes, task="t", size=4):
    rows = [(e, i, f"{task}{e % 2}", float(e * 10 + i)) for e in episodes for i in range(size)]
    return spark.createDataFrame(rows, "source long, step long, task string, x double")


def files(root):
    return sorted(str(p) for p in root.rglob("*.parquet"))


@pytest.mark.parametrize("step", ["frames", "episodes", "tasks", "stats", "commit"])
def test_a_failed_append_is_not_seen(spark, tmp_path, step):
    root = str(tmp_path / "d")
    with pytest.raises(Planted):
        D.appended(spark, root, buffer(spark, [0]), 10, ["x"], told=failing_at(step))
    assert D.stored(spark, root) is None
    D.appended(spark, root, buffer(spark, [0, 1]), 10, ["x"])
    with pytest.raises(Planted):
        D.appended(spark, root, buffer(spark, [2, 3]), 10, ["x"], told=failing_at(step))
    old = D.stored(spark, root)
    assert old["frames"].count() == 8 and old["episodes"].count() == 2 and old["stats"].first()["count"] == 8
    D.appended(spark, root, buffer(spark, [2, 3]), 10, ["x"])
    new = D.stored(spark, root)
    assert sorted(r["index"] for r in new["frames"].collect()) == list(range(16)) and new["record"]["version"] == 1
    named = {f"part={p['part']}" for p in new["record"]["parts"]}
    assert len(commits.swept(spark, root, "data", named)) == (step != "frames") * 2 and D.stored(spark, root)["frames"].count() == 16


def test_of_two_writers_one_commits(spark, tmp_path):
    root = str(tmp_path / "d")
    commits.commit(spark, root, {"version": 0, "who": "first"})
    with pytest.raises(commits.Conflict):
        commits.commit(spark, root, {"version": 0, "who": "second"})
    assert commits.newest(spark, root) == {"version": 0, "who": "first"}
    commits.commit(spark, root, {"version": 1, "who": "third"})
    assert commits.newest(spark, root)["who"] == "third" and len(commits.listed(spark, f"{root}/commits")) == 2


def test_merging_by_reference_writes_no_frames(spark, tmp_path):
    a, b, both, more = (str(tmp_path / n) for n in ("a", "b", "both", "more"))
    D.appended(spark, a, buffer(spark, [0, 1, 2]), 10, ["x"])
    D.appended(spark, b, buffer(spark, [5], "u"), 10, ["x"])
    D.appended(spark, b, buffer(spark, [6], "t"), 10, ["x"])
    before = files(tmp_path / "a") + files(tmp_path / "b")
    D.merged_by_reference(spark, both, [a, b])
    D.merged_by_reference(spark, more, [both, a])
    assert files(tmp_path / "a") + files(tmp_path / "b") == before and not (tmp_path / "both" / "data").exists()
    for root, sources in ((both, "ab"), (more, "aba")):
        held = D.stored(spark, root)
        rows = held["frames"].join(held["tasks"], "task_index").orderBy("index").collect()
        xs = {"a": [(e * 10.0 + i, f"t{e % 2}") for e in (0, 1, 2) for i in range(4)], "b": [(e * 10.0 + i, t) for e, t in ((5, "u1"), (6, "t0")) for i in range(4)]}
        assert [(r.x, r.task) for r in rows] == sum((xs[s] for s in sources), [])
        assert [r["index"] for r in rows] == list(range(len(rows))) and [r.episode_index for r in rows] == [i // 4 for i in range(len(rows))]
        assert held["stats"].first()["count"] == len(rows)
        spans = held["episodes"].orderBy("episode_index").select("episode_index", "dataset_from_index", "dataset_to_index").collect()
        assert [tuple(s) for s in spans] == [(i, 4 * i, 4 * i + 4) for i in range(len(rows) // 4)]
    D.appended(spark, both, buffer(spark, [9], "v"), 10, ["x"])
    assert D.stored(spark, both)["frames"].agg(F.max("index"), F.max("episode_index")).first() == (23, 5)


def test_splitting_by_reference_writes_no_frames(spark, tmp_path):
    a, both, train, val, again = (str(tmp_path / n) for n in ("a", "both", "train", "val", "again"))
    D.appended(spark, a, buffer(spark, [0, 1, 2]), 10, ["x"], max_mb=0.0001)  # a file for each episode
    D.appended(spark, a, buffer(spark, [3, 4]), 10, ["x"], max_mb=0.0001)
    before = files(tmp_path / "a")
    lists = spark.createDataFrame([(0, "train"), (3, "train"), (1, "val")], "episode_index long, split string")
    D.split_by_reference(spark, a, lists, {"train": train, "val": val})

    def told(root):
        held = D.stored(spark, root)
        return [tuple(r) for r in held["frames"].join(held["tasks"], "task_index").orderBy("index").select("index", "episode_index", "frame_index", "x", "task").collect()]

    want = lambda episodes: [(4 * k + i, k, i, e * 10.0 + i, f"t{e % 2}") for k, e in enumerate(episodes) for i in range(4)]
    assert told(train) == want([0, 3]) and told(val) == want([1])
    assert files(tmp_path / "a") == before and not (tmp_path / "train" / "data").exists()
    assert len(D.stored(spark, val)["record"]["parts"]) == 1 and D.stored(spark, val)["tasks"].collect() == [("t1", 0)]
    assert sorted(tuple(r) for r in D.stored(spark, train)["tasks"].select("task", "task_index").collect()) == [("t0", 0), ("t1", 1)]
    assert read_files(D.stored(spark, train)["frames"]) == 2  # of five
    spans = D.stored(spark, train)["episodes"].orderBy("episode_index").select("episode_index", "dataset_from_index", "dataset_to_index").collect()
    stats = D.stored(spark, train)["stats"].first()
    assert [tuple(r) for r in spans] == [(0, 0, 4), (1, 4, 8)] and (stats["count"], stats["min"], stats["max"]) == (8, 0.0, 33.0)
    D.merged_by_reference(spark, both, [val, train, val, a])  # parts that stand in it several times, with other shifts and tasks
    assert told(both) == want([1, 0, 3, 1, 0, 1, 2, 3, 4])
    D.split_by_reference(spark, both, spark.createDataFrame([(i, "again") for i in (0, 2, 3, 5, 8)], "episode_index long, split string"), {"again": again})
    assert told(again) == want([1, 3, 1, 1, 4])
    D.appended(spark, val, buffer(spark, [5]), 10, ["x"])
    assert told(val) == want([1, 5]) and files(tmp_path / "a") == before
    for wrong, roots in ((lists, {"train": train}), (lists, {"train": train, "val": val}), (lists.limit(0), {}), (spark.createDataFrame([(77, "x")], lists.schema), {"x": again})):
        with pytest.raises(ValueError):
            D.split_by_reference(spark, a, wrong, roots)


@pytest.mark.parametrize("block", [7, 65_536])
def test_epochs_are_shuffled_by_shards(spark, block):
    rows = spark.range(600).select(F.col("id").alias("index"), F.when(F.col("id") < 300, 0).otherwise(1 + F.col("id") % 9).alias("shard"))  # half of all in one shard
    got = [T.epoch_order(rows, "index", "shard", seed, range(3), 4, block).orderBy("epoch", "position").collect() for seed in (1, 1, 2)]
    assert got[0] == got[1] and got[0] != got[2]
    orders = []
    for epoch in range(3):
        mine = [r for r in got[0] if r.epoch == epoch]
        assert [r.position for r in mine] == list(range(600)) and sorted(r["index"] for r in mine) == list(range(600))
        assert [r.turn for r in mine] == sorted(r.turn for r in mine)
        shards = [{r.shard for r in mine if r.turn == t} for t in range(3)]
        assert [len(s) for s in shards] == [4, 4, 2] and len(set().union(*shards)) == 10
        orders.append([r["index"] for r in mine])
    assert len({tuple(o) for o in orders}) == 3
    assert [(r.epoch, r.turn, r.position, r["index"]) for r in T.epoch_order(rows, "index", "shard", 1, range(3), 4, 65_536).orderBy("epoch", "position").collect()] == [(r.epoch, r.turn, r.position, r["index"]) for r in got[0]]
    assert T.epoch_order(rows.limit(0), "index", "shard", 1, range(3)).count() == 0


@pytest.mark.parametrize(("listed", "read"), [(1_000, 2), (0, 4)])
def test_only_files_of_the_episodes_are_read(spark, tmp_path, monkeypatch, listed, read):
    monkeypatch.setattr(D, "LISTED_FILES", listed)
    frames = spark.range(4_000).select(F.col("id").alias("index"), F.expr("id div 20").alias("episode_index"), F.rand(1).alias("x"))
    place = D.write_rotated(frames, str(tmp_path), 0.004, 5)
    got = D.scan_placed(spark, str(tmp_path), place, spark.createDataFrame([(3,), (150,)], "episode_index long"))
    assert got.groupBy("episode_index").count().orderBy("episode_index").collect() == [(3, 20), (150, 20)]
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()  # files of the chunks, by the join
    assert len(files(tmp_path / "data")) > 20 and read_files(got) == read


def read_files(df):
    """Files that the scan of the frames opened, by Spark's own metric."""
    df.collect()
    plans, found = [df._jdf.queryExecution().executedPlan()], []
    while plans:
        p = plans.pop()
        name = p.nodeName()
        plans += [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in name else []
        plans += [p.children().apply(i) for i in range(p.children().size())]
        if name.startswith("Scan parquet") and "/data" in p.relation().location().rootPaths().mkString(" "):
            found.append(p.metrics().apply("numFiles").value())
    return sum(found)


def test_packing_is_exact_and_bears_huge_episodes(spark):
    sizes = [Decimal("0.1")] * 12 + [Decimal(1_000_000)] + [Decimal("0.1")] * 5
    e = spark.createDataFrame([(i, s, 1) for i, s in enumerate(sizes)], "episode_index long, size decimal(20, 3), length long")
    got = [r.batch for r in I.placed(e, "episode_index", "size", 0.3).orderBy("episode_index").collect()]
    assert got == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 5, 5, 5, 6, 6]


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_logs_in_blocks(spark, block):
    ends = {4, 5, 11, 40}
    rows = [(r, s, s in ends, False) for r in (0, 1) for s in range(60)]
    log = spark.createDataFrame(rows, "ring long, slot long, done boolean, truncated boolean")
    got = {(r.ring, r.slot): (r.episode_index, r.frame_index) for r in D.exported_log(log, 60, 10, 55, block=block).collect()}
    want, episode, frame = {}, 0, 0
    for s in [(i + 10 - 55) % 60 for i in range(55)]:
        want[s] = (episode, frame)
        episode, frame = (episode + 1, 0) if s in ends else (episode, frame + 1)
    assert got == {(r, s): v for r in (0, 1) for s, v in want.items()}


def test_sketches_of_odd_values(spark):
    values = [0.0, -3.5, 7.25, 1e300, -1e-300, float("inf"), float("-inf"), float("nan"), None]
    v = spark.createDataFrame([("k", x) for x in values * 3], "k string, v double")
    one = Q.sketches(v, "v", ("k",))
    both = Q.merged_sketches(one.unionByName(one), ("k",))
    got = both.select(*[Q.sketch_quantile(F.col("sketch"), q).alias(str(q)) for q in (0.0, 1 / 6, 2 / 6, 3 / 6, 4 / 6, 5 / 6, 1.0)]).first()
    want = [float("-inf"), -3.5, -1e-300, 0.0, 7.25, 1e300, float("inf")]
    assert all(g == w or abs(g - w) <= abs(w) * Q.SKETCH_ERROR * 1.001 for g, w in zip(got, want, strict=True))
    none = spark.createDataFrame([("k", None), ("k", [(5, 1)])], f"k string, sketch {Q.SKETCH}")
    assert Q.merged_sketches(none, ("k",)).count() == 0


def test_stats_of_nothing_and_of_one_row(spark):
    f = spark.createDataFrame([(2.0,)], "x double")
    s = S.sketched(S.with_sketches(S.feature_stats(f, ["x"], quantiles=()), f, ["x"])).first()
    assert s.q50 == s.mean == 2.0
    assert S.with_sketches(S.feature_stats(f.limit(0), ["x"], quantiles=()), f.limit(0), ["x"]).count() == 0


def test_annotation_without_its_checkpoint(spark, tmp_path):
    frames = spark.range(60).select(F.expr("id div 10").alias("episode_index"), F.col("id").alias("index"), (F.col("id") % 2).alias("task_index"), F.col("id").cast("double").alias("x"))
    frames.repartitionByRange(3, "episode_index").write.parquet(str(tmp_path / "d" / "data"))
    episodes = frames.groupBy("episode_index").agg(F.count("*").alias("length"))
    out, seen = tmp_path / "out", []
    run = lambda told, config="": A.annotated(spark, str(tmp_path / "d"), frames.schema, episodes, str(out), F.col("x") * 2, 0.5, config, 1, told)

    def stop_late(step):
        seen.append(step)
        if step == "status 1":
            raise Planted(step)

    with pytest.raises(Exception, match="Planted"):
        run(stop_late)
    assert A.progress(spark, str(out), episodes).first() == ("inference", 2, 6)
    (out / "checkpoints").rename(tmp_path / "lost")
    with pytest.warns(UserWarning, match="another configuration"):
        got = run(lambda step: None, "changed").orderBy("index").collect()
    assert [(r["index"], r.advantage, r.indicator) for r in got] == [(i, 2.0 * i, int(i >= 30)) for i in range(60)]
    assert A.progress(spark, str(out), episodes).first() == ("completed", 6, 6)
    run(seen.append)
    assert seen[-1] == "status 1"  # a finished folder is read


def test_weights_of_both_sides(spark):
    f = spark.createDataFrame([(e, i, 10 * e + i) for e in range(3) for i in range(4)], "episode_index long, frame_index long, index long")
    w = T.sampling_weights(f, f, 0.25, 1, 0).groupBy("source").agg(F.sum("weight").alias("w"))
    assert {r.source: round(r.w, 9) for r in w.collect()} == {"offline": 0.75, "online": 0.25}


def test_rotated_files_are_written_once_and_whole(spark, tmp_path, monkeypatch):
    """A file for each place and nothing beside it, with the values of all types; writing again replaces or, elsewhere, adds."""
    rows = spark.range(40).selectExpr(
        "id as index", "id div 4 as episode_index", "if(id % 3 = 0, null, id / 7) as x", "if(id % 5 = 0, null, concat('a', id)) as s", "array(id, null) as a", "timestamp_seconds(id) as t",
        "cast(id as decimal(20, 3)) as d", "id % 2 = 0 as b", "cast(cast(id as string) as binary) as raw", "named_struct('p', id, 'q', array(cast(id as float))) as st", "date_add(date'2024-01-01', cast(id as int)) as day",
    )
    root = str(tmp_path / "it")
    for _ in range(2):
        place = D.write_rotated(rows, root, 0.0005, 3)
    held = spark.read.parquet(f"{root}/data")
    assert dict(held.drop("chunk_index", "file_index").dtypes) == dict(rows.dtypes)
    assert sorted(map(str, held.select(rows.columns).collect())) == sorted(map(str, rows.collect()))
    places = {(r.chunk_index, r.file_index) for r in place.collect()}
    found = [p for p in (tmp_path / "it").rglob("*") if p.is_file()]
    assert len(found) == len(places) > 3 and {p.name for p in found} == {"part-00000.snappy.parquet"}
    more = D.write_rotated(rows.withColumn("episode_index", rows.episode_index + 10), root, 0.0005, 3, first_file=3 * len(places))
    assert spark.read.parquet(f"{root}/data").count() == 80 and more.count() == 10


def test_a_file_of_several_row_groups(tmp_path, monkeypatch):
    import pyarrow as pa
    from pyarrow import parquet

    monkeypatch.setattr(D, "ROW_GROUP_BYTES", 100)
    batch = lambda low, n, f: pa.RecordBatch.from_pydict({"chunk_index": [0] * n, "file_index": f, "x": list(range(low, low + n))})
    (told,) = D._files_of_task(iter([batch(0, 20, [0] * 20), batch(20, 20, [0] * 10 + [1] * 10), batch(40, 1, [2])]), str(tmp_path))
    assert told.to_pydict() == {"files": [3]}
    read = [parquet.ParquetFile(tmp_path / "chunk_index=0" / f"file_index={f}" / "part-00000.snappy.parquet") for f in range(3)]
    assert [f.read()["x"].to_pylist() for f in read] == [list(range(30)), list(range(30, 40)), [40]]
    assert [f.num_row_groups for f in read] == [2, 1, 1]
