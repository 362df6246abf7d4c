"""Hand-computed examples and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import text as X, vectors as V
from framewright.operators import indexing as I, labels as L, matching as M, sampling as T, stats as S, surgery as G, windows as W
from framewright.sources import schema as C


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_value_targets_of_two_episodes(spark):
    e = spark.createDataFrame([(0, 3, 0, "success"), (1, 2, 0, "failure")], "episode_index long, length long, task_index long, episode_success string")
    f = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)], "episode_index long, frame_index long")
    got = [r.t for r in L.with_episode_facts(f, e).withColumn("t", L.value_target()).orderBy("episode_index", "frame_index").collect()]
    assert np.allclose(got, [-2 / 6, -1 / 6, 0, -4 / 6, -3 / 6])


def test_rewards_telescope_to_the_target(spark):
    f = spark.createDataFrame([(0, i, -float(10 - i)) for i in range(10)], "episode_index long, frame_index long, target double")
    r = f.withColumn("r", L.dense_reward()).orderBy("frame_index").collect()
    assert math.isclose(sum(x.r for x in r), -10.0)


def test_two_hot_and_expected_value(spark):
    centers = [-1.0, -0.5, 0.0]
    rows = [one(spark, V.two_hot(F.lit(v), centers)) for v in (-1.0, -0.5, -0.25, 0.0)]
    assert rows == [[1, 0, 0], [0, 1, 0], [0, 0.5, 0.5], [0, 0, 1]]
    ends = [one(spark, V.expected_value(F.array(*map(F.lit, x)), centers)) for x in ((100.0, -100.0, -100.0), (-100.0, -100.0, 100.0))]
    assert np.allclose(ends, [-1, 0])


def test_sample_counts(spark):
    df = spark.createDataFrame([(n,) for n in (1, 1000, 2000, 5000, 10000, 20000)], "n long")
    assert [r.c for r in df.select("n", T.sample_count(F.col("n")).alias("c")).orderBy("n").collect()] == [1, 177, 299, 594, 1000, 1681]


def test_histograms(spark):
    h = S.histogram(spark.range(1, 101).select(F.col("id").cast("double").alias("v")), "v").collect()
    assert sum(r.n for r in h) == 100 and min(r.low for r in h) == 1
    flat = S.histogram(spark.createDataFrame([(42.0,)] * 4, "v double"), "v").collect()
    assert [r.n for r in flat if r.n] == [4]


def test_nan_never_reaches_a_threshold(spark):
    f = spark.createDataFrame([(0, float("nan")), (0, 1.0), (0, None)], "task_index long, advantage double")
    out = L.binarized(f, spark.createDataFrame([(0, 0.5)], "task_index long, threshold double")).collect()
    assert sorted(r.indicator for r in out) == [0, 0, 1]


def test_one_frame_episode_has_no_episode_target(spark):
    e = spark.createDataFrame([(0, 1, 0, "success")], "episode_index long, length long, task_index long, episode_success string")
    f = spark.createDataFrame([(0, 0)], "episode_index long, frame_index long")
    assert L.with_episode_facts(f, e).select(L.episode_value_target().alias("t")).first().t is None


def test_strict_label_raises(spark):
    with pytest.raises(Exception, match="not a success label"):
        one(spark, L.success_label(F.lit("maybe")))


def test_offsets():
    assert W.offsets_of([-0.2, 0.0, 0.1], 10) == [-2, 0, 1]
    with pytest.raises(ValueError):
        W.offsets_of([0.05], 10)


def test_null_value_is_no_padding(spark):
    f = spark.createDataFrame([(0, 0, 1.0), (0, 1, None)], "episode_index long, frame_index long, x double")
    r = W.offset_window(f, "x", [1], "w").orderBy("frame_index").collect()
    assert [x.w_is_pad for x in r] == [[False], [True]] and r[0].w == [None]


def test_merged_stats_equal_the_whole(spark):
    f = spark.createDataFrame([(i % 3, [float(i), float(i * i)]) for i in range(50)], "episode_index long, s array<double>")
    merged = S.merged_stats(S.feature_stats(f, ["s"], ("episode_index",))).orderBy("dim").collect()
    whole = S.feature_stats(f, ["s"]).orderBy("dim").collect()
    assert np.allclose([(m["mean"], m["std"], m["count"]) for m in merged], [(w["mean"], w["std"], w["count"]) for w in whole])


def test_smoothing_keeps_cubics(spark):
    f = spark.createDataFrame([(0, i, 0.01 * i**3 - i) for i in range(30)], "episode_index long, frame_index long, x double")
    got = [r.smooth for r in W.smoothed(f, "x").orderBy("frame_index").collect()]
    assert np.allclose(got, [0.01 * i**3 - i for i in range(30)])


def test_smoothing_of_short_episodes_copies(spark):
    f = spark.createDataFrame([(0, i, float(i % 2)) for i in range(4)], "episode_index long, frame_index long, x double")
    assert [r.smooth for r in W.smoothed(f, "x").orderBy("frame_index").collect()] == [0, 1, 0, 1]


def test_reindexing(spark):
    f = spark.createDataFrame([(5, 2, "a"), (5, 7, "b"), (900_000, 0, "c")], "episode_index long, frame_index long, x string")
    frames, episodes = I.reindexed(f)
    assert [tuple(r) for r in frames.orderBy("index").collect()] == [(0, 0, 0, "a"), (1, 0, 1, "b"), (2, 1, 0, "c")]
    assert [r.source_episode_index for r in episodes.orderBy("episode_index").collect()] == [5, 900_000]


def test_surgery_raises(spark):
    e = spark.createDataFrame([(0, 1), (1, 1)], "episode_index long, length long")
    f = spark.createDataFrame([(0, 0), (1, 0)], "episode_index long, frame_index long")
    for gone in ([], [0, 1], [7]):
        with pytest.raises(ValueError):
            G.delete_episodes(f, e, gone)
    with pytest.raises(ValueError):
        G.parsed_episodes(spark, "5-2", 9)
    with pytest.raises(ValueError):
        G.remove_features(f, None, "frame_index")


def test_combined_features():
    a = {"v": {"dtype": "float32", "shape": (2,), "names": ["x", "y"]}}
    b = {"v": {"dtype": "float32", "shape": (2,), "names": ["y", "z"]}}
    assert G.combine_features(a, b)["v"]["names"] == ["x", "y", "z"]
    with pytest.raises(ValueError):
        G.combine_features(a, {"v": {"dtype": "int64", "shape": (1,), "names": ["q"]}})


def test_schema_of_features():
    s = C.schema_of({"a": {"dtype": "float32", "shape": (1,)}, "b": {"dtype": "float32", "shape": (3,)}, "c": {"dtype": "int64", "shape": (2, 2)}, "i": {"dtype": "image", "shape": (3, 4, 4)}, "v": {"dtype": "video", "shape": (3, 4, 4)}})
    assert [f.dataType.simpleString() for f in s] == ["float", "array<float>", "array<array<bigint>>", "binary"]
    assert s["b"].metadata == {"length": 3}
    with pytest.raises(ValueError):
        C.schema_of({"a": {"dtype": "date", "shape": (1,)}})


def test_unknown_combination_raises(spark):
    with pytest.raises(ValueError):
        M.combined("other", F.col("a"), F.col("b"))


def test_missing_predictions_raise(spark):
    with pytest.raises(RuntimeError, match="2 rows"):
        M.require_all(spark.range(3).withColumnRenamed("id", "index"), spark.range(1).withColumnRenamed("id", "index"), "index")


def test_discretised_ends(spark):
    assert one(spark, V.discretized(F.array(*map(F.lit, (-2.0, -1.0, 0.0, 1.0, 5.0))))) == [-1, 0, 128, 255, 255]


def test_masked_min_max_without_width(spark):
    assert one(spark, V.masked_min_max(F.array(F.lit(3.0)), [2.0], [2.0])) == [0.0]
    assert one(spark, V.masked_min_max(F.array(F.lit(0.4)), [2.0], [2.0], inverse=True)) == [2.0]


def test_points_malformed_stay(spark):
    t = "a <point>[10, 20]</point> b <point>[1,]</point>"
    assert one(spark, X.rescaled_points(F.lit(t), (100, 100), (50, 200))) == "a <point>[20, 10]</point> b <point>[1,]</point>"


def test_sampling_without_replacement_is_stable(spark):
    f = spark.createDataFrame([(0, i) for i in range(40)], "episode_index long, frame_index long")
    a, b = (sorted(r.frame_index for r in T.sample_per_episode(f.repartition(n), 0.2, 5).collect()) for n in (1, 7))
    assert a == b and len(a) == 8
