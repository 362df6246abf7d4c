"""Feature statistics in the long form (feature, stat, dim, value), per episode and merged, and the dataset report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from framewright.operators.quantiles import SKETCH_ERROR, exact_quantiles, merged_sketches, sketch_quantile, sketches  # noqa: F401

QUANTILES = (0.01, 0.10, 0.50, 0.90, 0.99)


def quantile_name(q: float) -> str:
    return f"q{round(q * 100):02d}"


def long_vectors(frames: DataFrame, features: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, feature, dim, v): a row for each element of each vector or number."""
    kinds = dict(frames.dtypes)
    parts = [F.transform(F.col(f).cast("array<double>"), lambda x: x) if kinds[f].startswith("array") else F.array(F.col(f).cast("double")) for f in features]
    packed = F.array(*[F.struct(F.lit(f).alias("feature"), p.alias("vs")) for f, p in zip(features, parts, strict=True)])
    one = frames.select(*keys, F.explode(packed).alias("p"))
    return one.select(*keys, F.col("p.feature").alias("feature"), F.posexplode("p.vs").alias("dim", "v"))


def _interpolated(values: Column, q: float) -> Column:
    """The linearly interpolated quantile of sorted values; null where there are none."""
    at = (F.size(values) - 1) * F.lit(q)
    low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    return F.when(low == high, low).otherwise((F.floor(at) + 1 - at) * low + (at - F.floor(at)) * high)


def _episode_stats(frames: DataFrame, features: list[str], keys: tuple[str, ...], quantiles: tuple[float, ...]) -> DataFrame:
    """feature_stats() of episodes: an episode's vectors are gathered as they are, and only then taken apart by dim, so that
    what is grouped are frames and not elements."""
    kinds = dict(frames.dtypes)
    vectors = {f: F.col(f).cast("array<double>") if kinds[f].startswith("array") else F.array(F.col(f).cast("double")) for f in features}
    held = frames.groupBy(*keys).agg(*[F.collect_list(v).alias(f"_{i}") for i, v in enumerate(vectors.values())])
    packed = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_{i}").alias("m")) for i, f in enumerate(vectors)])
    held = held.select(*keys, F.explode(packed).alias("p")).select(*keys, "p.feature", "p.m").where(F.size("m") > 0)
    widest = F.array_max(F.transform("m", F.size))
    dims = held.where(widest > 0).select(*keys, "feature", "m", F.explode(F.sequence(F.lit(0), widest - 1)).alias("dim"))
    ordered = dims.select(*keys, "feature", "dim", F.sort_array(F.filter(F.transform("m", lambda v: F.get(v, F.col("dim"))), lambda x: x.isNotNull())).alias("_v"))
    n = F.size("_v")
    out = ordered.withColumn("mean", F.try_divide(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x), n))
    out = out.withColumn("std", F.sqrt(F.try_divide(F.aggregate("_v", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))), n)))
    basic = [n.cast("long").alias("count"), F.get("_v", F.lit(0)).alias("min"), F.get("_v", n - 1).alias("max"), "mean", "std"]
    return out.select(*keys, "feature", "dim", *basic, *[F.when(n < 2, F.col("mean")).otherwise(_interpolated(F.col("_v"), q)).alias(quantile_name(q)) for q in quantiles])


def feature_stats(frames: DataFrame, features: list[str], keys: tuple[str, ...] = (), quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """One row for each key, feature and dim: count, min, max, mean, population std and exact quantiles.

    With fewer than two rows the quantiles are the mean. Nulls are left out; NaN counts as the largest number. The values of an
    episode are sorted together; with other keys, such as a task, and without any, a group may be large and is never in one buffer.
    """
    if quantiles and "episode_index" in keys:
        return _episode_stats(frames, features, keys, quantiles)
    rows = long_vectors(frames, features, keys)
    basic = [F.count("v").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")]
    names = [quantile_name(q) for q in quantiles]
    if not quantiles:
        out = rows.groupBy(*keys, "feature", "dim").agg(*basic)
    else:
        by = [*keys, "feature", "dim"]
        out = rows.groupBy(*by).agg(*basic).join(exact_quantiles(rows, "v", dict(zip(names, quantiles, strict=True)), tuple(by)), by, "left")
    return out.select(*keys, "feature", "dim", "count", "min", "max", "mean", "std", *[F.when(F.col("count") < 2, F.col("mean")).otherwise(F.col(n)).alias(n) for n in names])


def with_sketches(stats: DataFrame, frames: DataFrame, features: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """stats of frames with a mergeable sketch of each feature and dim, from which sketched() takes quantiles; null where there are no numbers."""
    by = (*keys, "feature", "dim")
    return stats.join(sketches(long_vectors(frames, features, keys), "v", by), list(by), "left")


def sketched(stats: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """stats with quantiles from its sketches, right within SKETCH_ERROR of their size; with fewer than two rows they are the mean."""
    return stats.select("*", *[F.when(F.col("count") < 2, F.col("mean")).otherwise(sketch_quantile(F.col("sketch"), q)).alias(quantile_name(q)) for q in quantiles])


def positional_stats(frames: DataFrame, feature: str, dims: int) -> DataFrame:
    """min, max, mean and std of a short vector's dimensions, without a row for each element."""
    v = [F.col(feature)[i].cast("double") for i in range(dims)]
    stats = F.array(*[F.struct(F.lit(i).alias("dim"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")) for i, x in enumerate(v)])
    return frames.agg(stats.alias("s")).select(F.explode("s").alias("s")).select("s.*")


def merged_stats(parts: DataFrame, quantiles: tuple[float, ...] = ()) -> DataFrame:
    """One row for each feature and dim from rows of several parts: count-weighted means, variances with the distance of
    means, and count-weighted quantiles (an approximation) where all parts have them. Sketches are merged where all parts have
    them, and give quantiles with a known error. A feature may be in some parts only."""
    n, mean, std = F.col("count"), F.col("mean"), F.col("std")
    named = [quantile_name(q) for q in quantiles]
    g = parts.groupBy("feature", "dim").agg(
        F.sum(n).alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum(n * mean).alias("_m"), F.sum(n * (std * std + mean * mean)).alias("_s"),
        *[F.when(F.count_if(F.col(q).isNull()) == 0, F.sum(n * F.col(q))).alias(f"_{q}") for q in named],
    )
    m = F.col("_m") / F.col("count")
    out = g.select("feature", "dim", "count", "min", "max", m.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("_s") / F.col("count") - m * m)).alias("std"), *[(F.col(f"_{q}") / F.col("count")).alias(q) for q in named])
    return out.join(merged_sketches(parts, ("feature", "dim")), ["feature", "dim"], "left") if "sketch" in parts.columns else out


def as_document(stats: DataFrame, names: tuple[str, ...] = ("min", "max", "mean", "std", "count")) -> DataFrame:
    """(feature, stat, value): each statistic as one array over the dims."""
    melted = stats.select("feature", "dim", F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("v")) for s in names])).alias("x"))
    return melted.groupBy("feature", F.col("x.stat").alias("stat")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", F.col("x.v").alias("v")))), lambda r: r.v).alias("value"))


def histogram_quantiles(values: DataFrame, v: str, quantiles: tuple[float, ...], bins: int = 5000, keys: tuple[str, ...] = ("dim",)) -> DataFrame:
    """Quantiles by linear interpolation in a histogram of equal bins between the smallest and the largest value.

    A histogram has `bins` rows for each key at most, however many values it counts; the first bin gives its lower edge.
    """
    ends = values.groupBy(*keys).agg((F.min(v) - 1e-10).alias("_lo"), (F.max(v) + 1e-10).alias("_hi"), F.count(v).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    binned = values.join(ends, list(keys)).withColumn("_b", F.least(F.floor((F.col(v) - F.col("_lo")) / width), F.lit(bins - 1))).groupBy(*keys, "_b").agg(F.count("*").alias("_c"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_n").alias("_n"))
    up = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b"))
    seen = binned.withColumn("_up", up)
    out = []
    for q in quantiles:
        target = F.col("_n") * q
        lower = F.col("_lo") + F.col("_b") * width
        inside = F.when(F.col("_b") == 0, lower).otherwise(lower + (target - (F.col("_up") - F.col("_c"))) / F.col("_c") * width)
        out.append(F.min(F.when(F.col("_up") >= target, F.struct("_b", inside.alias("x")))).getField("x").alias(quantile_name(q)))
    return seen.groupBy(*keys).agg(*out)


def row_stats(vector: str) -> list[Column]:
    """min, max and mean over the elements of each row's vector."""
    v = F.col(vector).cast("array<double>")
    return [F.array_min(v).alias("min"), F.array_max(v).alias("max"), (F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).alias("mean")]


def channel_stats(images: DataFrame, image: str, stride: int = 1) -> DataFrame:
    """Per channel of channel-first pixel arrays: min, max, mean and population std of pixels / 255, every stride-th row and
    column; count is the number of images, not of pixels."""
    thin = lambda a: F.filter(a, lambda _, i: i % stride == 0)
    channels = images.select(F.posexplode(image).alias("channel", "_rows"))
    pixels = channels.select("channel", F.explode(F.flatten(F.transform(thin(F.col("_rows")), thin))).alias("v"))
    v = F.col("v").cast("double") / 255
    stats = pixels.groupBy("channel").agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    return stats.join(channels.groupBy("channel").agg(F.count("*").alias("count")), "channel")


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def success_report(episodes: DataFrame, label: Column) -> DataFrame:
    e = episodes.select(label.alias("l"))
    ok, bad = F.count_if(F.col("l") == "success"), F.count_if(F.col("l") == "failure")
    return e.agg(F.count("*").alias("episodes"), ok.alias("success"), bad.alias("failure"), (F.count("*") - ok - bad).alias("unlabelled"), ratio(ok, F.count("*")).alias("success_ratio"), ratio(ok, ok + bad).alias("labelled_success_ratio"))


def intervention_report(frames: DataFrame, flag: str = "is_intervention") -> DataFrame:
    """Frames with a flag over 0 and the episodes that have any; the report's threshold is 0, that of labels 0.5."""
    on = F.coalesce(F.col(flag), F.lit(0.0)) > 0
    hit = F.count_distinct(F.when(on, F.col("episode_index")))
    return frames.agg(F.count_if(on).alias("frames"), hit.alias("episodes"), ratio(F.count_if(on), F.count("*")).alias("frame_ratio"), ratio(hit, F.count_distinct("episode_index")).alias("episode_ratio"))


def histogram(values: DataFrame, v: str, bins: int = 20) -> DataFrame:
    """(bin, low, high, n) of equal bins; the largest value is in the last one, a constant column in the first."""
    ends = values.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(v) - F.col("lo")) / F.when(width == 0, 1.0).otherwise(width)), F.lit(bins - 1)))
    counts = values.where(F.col(v).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))  # ends: one row
    edges = values.sparkSession.range(bins).withColumnRenamed("id", "bin").crossJoin(F.broadcast(ends))
    return edges.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def distinct_in_order(rows: DataFrame, lists: str, order: list[str], out: str = "task") -> DataFrame:
    """(out, first): the distinct elements of list columns with the place each is first seen at, numbered from 0."""
    seen = rows.select(*order, F.posexplode(lists).alias("_pos", out)).groupBy(out).agg(F.min(F.struct(*order, "_pos")).alias("_first"))
    return seen.withColumn("first", (F.row_number().over(Window.orderBy("_first")) - 1).cast("long")).select(out, "first")  # one row for each distinct value


def indicator_stats(rows: DataFrame, flag: str) -> DataFrame:
    x = F.col(flag)
    return rows.agg(F.count(x).alias("total"), F.count_if(x == 1).alias("positives"), F.count_if(~x.isin(0, 1)).alias("invalid"), ratio(F.count_if(x == 1), F.count(x)).alias("positive_ratio"))


def joint_limits(frames: DataFrame, vector: str, warm_up: float = 1.0, digits: int = 4) -> DataFrame:
    """Smallest and largest value of each dim after the first warm_up seconds of an episode, rounded half to even."""
    v = long_vectors(frames.where(F.col("timestamp") >= warm_up), [vector])
    return v.groupBy("dim").agg(F.bround(F.min("v"), digits).alias("low"), F.bround(F.max("v"), digits).alias("high"))


def temporal_proportions(annotations: DataFrame) -> DataFrame:
    """(name, proportion): the mean over episodes of each subtask's share of the episode, brought to a sum of 1.

    annotations: episode_index, pos, name, start, end; of subtasks with one name in an episode the last counts.
    """
    last = annotations.groupBy("episode_index", "name").agg(F.max(F.struct("pos", (F.col("end") - F.col("start")).cast("double").alias("d"))).alias("m")).select("episode_index", "name", F.col("m.d").alias("d"))
    share = last.withColumn("p", ratio(F.col("d"), F.sum("d").over(Window.partitionBy("episode_index"))))
    mean = share.groupBy("name").agg(F.avg("p").alias("p"))
    return mean.withColumn("proportion", ratio(F.col("p"), F.sum("p").over(Window.partitionBy()))).select("name", "proportion")


def rollout_summary(steps: DataFrame) -> DataFrame:
    """Per episode over the steps up to the first done, that one included: sum and max of reward, any success.

    steps: episode_index, step, reward, done, success. Episodes that are never done count whole.
    """
    first = F.min(F.when(F.col("done"), F.col("step"))).over(Window.partitionBy("episode_index"))
    kept = steps.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("step") <= F.col("_first")))
    return kept.groupBy("episode_index").agg(F.sum("reward").alias("sum_reward"), F.max("reward").alias("max_reward"), F.bool_or("success").alias("success"))


def evaluation_rollup(episodes: DataFrame, group: str, task: str) -> DataFrame:
    """Per task, per group and overall: means without NaN of sum_reward and max_reward, success in percent, and n."""
    clean = lambda c: F.avg(F.when(~F.isnan(c), F.col(c)))
    return episodes.rollup(group, task).agg(clean("sum_reward").alias("avg_sum_reward"), clean("max_reward").alias("avg_max_reward"), (F.avg(F.col("success").cast("double")) * 100).alias("pc_success"), F.count("*").alias("n_episodes"))


def inferred_success(label: Column, flag: Column) -> Column:
    """The label, else by the largest next.success, else success."""
    return F.coalesce(label, F.when(flag > 0, "success").when(flag <= 0, "failure"), F.lit("success"))


def latency_summary(rows: DataFrame, value: str, order: str, keys: list[str], last: int = 100) -> DataFrame:
    """Over the last values of each key: max, median, p95; and the average rate (n - 1) / duration, order being seconds."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    newest = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    return newest.groupBy(*keys).agg(F.max(value).alias("max"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"), ratio(F.count("*") - 1, F.max(order) - F.min(order)).alias("rate"))


def length_summary(rows: DataFrame, array: str, reference: Column) -> DataFrame:
    n = F.size(array)
    whole = rows.agg(F.avg(n).alias("mean"), F.min(n).alias("min"), F.max(n).alias("max"), ratio(F.sum(reference), F.sum(n)).alias("ratio"))
    return whole.crossJoin(F.broadcast(exact_quantiles(rows.select(n.alias("n")), "n", {"p99": 0.99}))).select("mean", "p99", "min", "max", "ratio")  # one row each


def finite_bounds(rows: DataFrame, series: list[str], pad: float = 0.5) -> DataFrame:
    """The smallest and largest finite value of all series, padded where they are equal."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    e = rows.agg(F.least(*[F.min(finite(c)) for c in series], F.lit(None).cast("double")).alias("low"), F.greatest(*[F.max(finite(c)) for c in series], F.lit(None).cast("double")).alias("high"))
    flat = F.col("low") == F.col("high")
    return e.select(F.when(flat, F.col("low") - pad).otherwise(F.col("low")).alias("low"), F.when(flat, F.col("high") + pad).otherwise(F.col("high")).alias("high"))


def totals(frames: DataFrame) -> DataFrame:
    return frames.agg(F.count_distinct("episode_index").alias("total_episodes"), F.count("*").alias("total_frames"), F.count_distinct("task_index").alias("total_tasks"), F.concat(F.lit("0:"), F.count_distinct("episode_index").cast("string")).alias("train_split"))


def episode_bounds(frames: DataFrame) -> DataFrame:
    """[from, to) of each episode in a densely indexed frame table."""
    return frames.groupBy("episode_index").agg(F.min("index").alias("from"), (F.max("index") + 1).alias("to"))


def run_bounds(rows: DataFrame, key: str, order: str, within: list[str]) -> DataFrame:
    """[from, to) of each run of equal keys in order, where a key may come back; runs end where a partition of `within` does."""
    w = Window.partitionBy(*within).orderBy(order)
    starts = F.when(F.col(key).eqNullSafe(F.lag(key).over(w)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    return rows.withColumn("_s", starts).withColumn("_run", F.sum("_s").over(w)).groupBy(*within, key, "_run").agg(F.min(order).alias("from"), (F.max(order) + 1).alias("to")).drop("_run")
