"""Dataset surgery: adding, removing and renaming features, deleting, splitting, merging and re-tasking episodes."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from framewright.operators.indexing import dense_rank_of, reindexed, with_offsets

DEFAULT_FEATURES = ("timestamp", "frame_index", "episode_index", "index", "task_index")
STORED = ("stats/", "data/", "meta/", "videos/")


def add_feature(frames: DataFrame, name: str, values: DataFrame | Column, key: str = "index") -> DataFrame:
    """frames with a new feature from a (key, value) table, or from an expression; a name in use raises ValueError."""
    if name in frames.columns:
        raise ValueError(f"feature {name} exists")
    if isinstance(values, Column):
        return frames.withColumn(name, values)
    value = next(c for c in values.columns if c != key)
    return frames.join(values.select(key, F.col(value).alias(name)), key, "left")


def add_feature_by(frames: DataFrame, name: str, function: Callable, kind: str, *columns: str) -> DataFrame:
    """A new feature by a function of whole columns (pandas.Series -> pandas.Series), in Arrow batches."""
    return add_feature(frames, name, F.pandas_udf(function, kind)(*columns))


def remove_features(frames: DataFrame, stats: DataFrame | None, *names: str) -> tuple[DataFrame, DataFrame | None]:
    """frames and long statistics without the features; unknown names and default features raise ValueError."""
    if bad := [n for n in names if n not in frames.columns or n in DEFAULT_FEATURES]:
        raise ValueError(f"can't be removed: {bad}")
    return frames.drop(*names), stats.where(~F.col("feature").isin(*names)) if stats is not None else None


def rename_features(frames: DataFrame, stats: DataFrame | None, names: dict[str, str]) -> tuple[DataFrame, DataFrame | None]:
    pairs = F.create_map(*[F.lit(x) for p in names.items() for x in p])
    return frames.withColumnsRenamed(names), stats.withColumn("feature", F.coalesce(pairs[F.col("feature")], F.col("feature"))) if stats is not None else None


def select_features(frames: DataFrame, patterns: list[str], prefixes: list[str] = (), images: tuple[str, ...] = (), use_images: bool = False) -> DataFrame:
    """Columns that match any pattern, images only on demand, each without the first prefix that it has."""
    keep = [c for c in frames.columns if any(re.search(p, c) for p in patterns) and (use_images or c not in images)]
    short = lambda c: next((c.removeprefix(p) for p in prefixes if c.startswith(p)), c)
    return frames.select([F.col(f"`{c}`").alias(short(c)) for c in keep])


def combine_features(*features: dict[str, dict]) -> dict[str, dict]:
    """One dictionary of features: named vectors take the names of all in first-seen order, other features the last one; vectors of different types raise ValueError."""
    out: dict[str, dict] = {}
    for name, spec in (item for f in features for item in f.items()):
        old = out.get(name)
        if old and isinstance(old.get("names"), list) and isinstance(spec.get("names"), list):
            if old["dtype"] != spec["dtype"]:
                raise ValueError(f"{name}: {old['dtype']} and {spec['dtype']}")
            names = list(dict.fromkeys([*old["names"], *spec["names"]]))
            out[name] = {**old, "names": names, "shape": (len(names),)}
        else:
            out[name] = dict(spec)
    return out


def packed_vector(names: list[str]) -> Column:
    return F.array(*[F.col(n).cast("float") for n in names])


def unpacked_vector(vector: str, names: list[str], suffix: str = ".pos") -> list[Column]:
    """A column for each element; a vector of another length raises."""
    ok = F.when(F.size(vector) != len(names), F.raise_error(F.lit(f"{vector} must have {len(names)} elements")).cast("double"))
    return [F.coalesce(ok, F.get(vector, i).cast("double")).alias(f"{n}{suffix}") for i, n in enumerate(names)]


def to_transition(frames: DataFrame) -> DataFrame:
    """One row of structs: observation.*, action, reward 0, done and truncated false where missing, complementary_info.*."""
    group = lambda p: F.struct(*[F.col(f"`{c}`").alias(c.removeprefix(p)) for c in frames.columns if c.startswith(p)] or [F.lit(None).cast("string").alias("none")])
    value = lambda c, d: F.coalesce(F.col(f"`{c}`"), F.lit(d)) if c in frames.columns else F.lit(d)
    action = F.col("action") if "action" in frames.columns else F.lit(None).cast("array<float>")
    return frames.select("index", group("observation.").alias("observation"), action.alias("action"), value("next.reward", 0.0).alias("reward"), value("next.done", False).alias("done"), value("next.truncated", False).alias("truncated"), group("complementary_info.").alias("complementary"))


def from_transition(rows: DataFrame) -> DataFrame:
    flat = lambda s, p: [F.col(f"{s}.`{f}`").alias(p + f) for f in rows.schema[s].dataType.names if f != "none"]
    return rows.select("index", *flat("observation", "observation."), "action", F.col("reward").alias("next.reward"), F.col("done").alias("next.done"), F.col("truncated").alias("next.truncated"), *flat("complementary", "complementary_info."))


def usable_episodes(episodes: DataFrame, requested: DataFrame | None = None, omit_failed: bool = True) -> DataFrame:
    """Episodes that aren't labelled failure (no label counts as usable), of the requested ones."""
    e = episodes.join(requested, "episode_index", "left_semi") if requested is not None else episodes
    if not omit_failed or "episode_success" not in episodes.columns:
        return e
    return e.where(F.coalesce(F.lower(F.trim("episode_success")), F.lit("")) != "failure")


def trimmed(frames: DataFrame, episodes: DataFrame, first: int = 0, last: int = 0) -> DataFrame:
    """Frames without the first and last ones of each episode, of the given episodes."""
    e = episodes.select("episode_index", F.col("dataset_from_index").alias("_a"), F.col("dataset_to_index").alias("_b"))
    return frames.join(e, "episode_index").where((F.col("index") >= F.col("_a") + first) & (F.col("index") < F.col("_b") - last)).drop("_a", "_b")


def delete_episodes(frames: DataFrame, episodes: DataFrame, gone: list[int]) -> tuple[DataFrame, DataFrame]:
    """The frames that stay, densely renumbered, and their episode table with its extra columns.

    An empty list, unknown episodes and a list of all episodes raise ValueError.
    """
    found = episodes.agg(F.count("*").alias("n"), F.count_if(F.col("episode_index").isin(gone)).alias("g")).first()
    if not gone or found.g != len(set(gone)) or found.g == found.n:
        raise ValueError("delete some of the existing episodes, not all of them")
    kept, table = reindexed(frames.where(~F.col("episode_index").isin(gone)))
    extra = [c for c in episodes.columns if c not in ("episode_index", "length", "dataset_from_index", "dataset_to_index")]
    return kept, table.join(episodes.select(F.col("episode_index").alias("source_episode_index"), *extra), "source_episode_index")


def split_labels(episodes: DataFrame, fractions: dict[str, float]) -> DataFrame:
    """(episode_index, split): splits take the floor of their fraction of the sorted episodes, the last one all the rest; a split of none is dropped.

    The product is one of doubles, as in the reference: 0.7 of 90 episodes are 62.
    """
    if not fractions or sum(fractions.values()) > 1 + 1e-9 or min(fractions.values()) <= 0:
        raise ValueError("fractions must be positive and not over 1 together")
    n = episodes.count()
    sizes = [int(n * f) for f in fractions.values()]
    ends, at = [], 0
    for i, (name, size) in enumerate(zip(fractions, sizes, strict=True)):
        at = n if i == len(sizes) - 1 else at + size
        ends.append((name, at))
    label = reduce(lambda c, e: c.when(F.col("_r") < e[1], e[0]), ends[1:], F.when(F.col("_r") < ends[0][1], ends[0][0]))
    return dense_rank_of(episodes, rank="_r").select("episode_index", label.alias("split"))


def split_names(episodes: DataFrame, lists: DataFrame) -> list[str]:
    """The splits of lists (episode_index, split); an episode in two of them or an unknown one raises ValueError, and so do no lists at all."""
    found = lists.groupBy("episode_index").agg(F.count_distinct("split").alias("n")).join(episodes.select("episode_index", F.lit(1).alias("there")), "episode_index", "left")
    bad = found.agg(F.count("*").alias("all"), F.count_if((F.col("n") > 1) | F.col("there").isNull()).alias("bad")).first()
    if not bad["all"] or bad.bad:
        raise ValueError("splits must be disjoint lists of existing episodes")
    return sorted(r.split for r in lists.select("split").distinct().collect())  # a few names


def split_datasets(frames: DataFrame, episodes: DataFrame, lists: DataFrame) -> dict[str, DataFrame]:
    """The frames of each split, densely renumbered, from lists (episode_index, split), that split_names() checks."""
    names = split_names(episodes, lists)
    return {name: reindexed(frames.join(lists.where(F.col("split") == name).select("episode_index").distinct(), "episode_index", "left_semi"))[0] for name in names}


def retasked(episodes: DataFrame, default: str | None = None, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """episodes (with tasks) given one task each: its override, else the default, else its first task; and the task table, ids by name."""
    e = episodes.join(overrides.select("episode_index", F.col("task").alias("_o")), "episode_index", "left") if overrides is not None else episodes.withColumn("_o", F.lit(None).cast("string"))
    e = e.withColumn("task", F.coalesce("_o", F.lit(default).cast("string"), F.get("tasks", 0))).drop("_o")
    tasks = e.select("task").distinct().withColumn("task_index", (F.row_number().over(Window.orderBy("task")) - 1).cast("long"))  # the task table is small
    return e.drop("task_index").join(tasks, "task"), tasks


def aligned(source: DataFrame, target: DataFrame, source_index: int, is_expert: bool, visual: tuple[str, ...] = ()) -> DataFrame:
    """source in the columns of target plus provenance: unknown columns go, missing ones are zero, missing visual ones raise ValueError."""
    if lost := [v for v in visual if v in target.columns and v not in source.columns]:
        raise ValueError(f"visual features are missing: {lost}")
    zero = {"boolean": F.lit(False), "string": F.lit("")}
    fill = lambda f: F.array().cast(f.dataType) if f.dataType.typeName() == "array" else zero.get(f.dataType.typeName(), F.lit(0)).cast(f.dataType)
    columns = [(F.col(f"`{f.name}`").cast(f.dataType) if f.name in source.columns else fill(f)).alias(f.name) for f in target.schema]
    return source.select(*columns, F.lit(is_expert).alias("is_expert"), F.lit(source_index).cast("long").alias("source_dataset_index"))


def violations(frames: DataFrame, features: dict[str, dict]) -> DataFrame:
    """(feature, problem, rows): missing and extra features, and rows with a wrong length or no value."""
    default = set(DEFAULT_FEATURES)
    found = [(n, "missing", None) for n in features if n not in frames.columns] + [(c, "extra", None) for c in frames.columns if c not in features and c not in default]
    present = [n for n in features if n in frames.columns]
    checks = []
    for n in present:
        c = F.col(f"`{n}`")
        shape = features[n]["shape"]
        checks.append(F.struct(F.lit(n).alias("feature"), F.lit("null").alias("problem"), F.count_if(c.isNull()).alias("rows")))
        if shape != (1,) and dict(frames.dtypes)[n].startswith("array"):
            checks.append(F.struct(F.lit(n).alias("feature"), F.lit("length").alias("problem"), F.count_if(F.size(c) != shape[0]).alias("rows")))
    spark = frames.sparkSession
    schema = spark.createDataFrame(found, "feature string, problem string, rows long")
    return schema.unionByName(frames.agg(F.array(*checks).alias("c")).select(F.explode("c").alias("c")).select("c.*").where("rows > 0")) if checks else schema


def check_episode(buffer: DataFrame, next_episode: int, features: set[str]) -> None:
    """Raises ValueError unless the rows are one non-empty episode with the next id and exactly the features."""
    r = buffer.agg(F.count("*").alias("n"), F.min("episode_index").alias("lo"), F.max("episode_index").alias("hi")).first()
    if not r.n or r.lo != next_episode or r.hi != next_episode or set(buffer.columns) != features:
        raise ValueError("not the next episode with the dataset's features")


def checked_episodes(buffer: DataFrame, features: set[str], next_episode: int | None = None) -> DataFrame:
    """(episode_index, n) of a buffer of whole episodes; raises ValueError for other features, and when the result is read for
    an episode whose frames aren't 0, 1, ... or, with next_episode, ids that aren't the next ones in a row."""
    if set(buffer.columns) != features:
        raise ValueError("not the dataset's features")
    if next_episode is not None:
        ids = buffer.agg(F.min("episode_index").alias("lo"), F.max("episode_index").alias("hi"), F.count_distinct("episode_index").alias("n")).first()
        if not ids.n or ids.lo != next_episode or ids.hi != next_episode + ids.n - 1:
            raise ValueError("not the next episodes")
    e = buffer.groupBy("episode_index").agg(F.count("*").alias("n"), F.min("frame_index").alias("_lo"), F.max("frame_index").alias("_hi"), F.sum("frame_index").alias("_sum"))
    whole = (F.col("_lo") == 0) & (F.col("_hi") == F.col("n") - 1) & (F.col("_sum") == F.col("n") * (F.col("n") - 1) / 2)
    return e.select("episode_index", F.when(whole, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("frames are missing in episode "), F.col("episode_index").cast("string"))).cast("long")).alias("n"))


def without_nan(rows: DataFrame, *vectors: str) -> DataFrame:
    bad = reduce(lambda a, b: a | b, [F.exists(F.col(v), F.isnan) for v in vectors])
    return rows.where(~F.coalesce(bad, F.lit(False)))


def truncated_stats(stats: DataFrame, dims: dict[str, int]) -> DataFrame:
    """Long statistics without the dims beyond their feature's size."""
    size = F.create_map(*[x for f, n in dims.items() for x in (F.lit(f), F.lit(n))])[F.col("feature")]
    return stats.where(size.isNull() | (F.col("dim") < size))


def parsed_episodes(spark, text: str | None, total: int) -> DataFrame:
    """The episodes of "0-3,5", "[0-3,5]", "all" or nothing; reversed and out-of-range parts raise ValueError."""
    text = (text or "").strip().strip("[]").strip()
    if text.lower() in ("", "all"):
        return spark.range(total).withColumnRenamed("id", "episode_index")
    ranges = []
    for part in (p.strip() for p in text.split(",") if p.strip()):
        low, _, high = part.partition("-")
        low, high = int(low), int(high or low)
        if low > high or low < 0 or high >= total:
            raise ValueError(f"not a range of episodes: {part}")
        ranges.append((low, high))
    rows = spark.createDataFrame(ranges, "low long, high long")
    return rows.select(F.explode(F.sequence("low", "high")).alias("episode_index")).distinct().orderBy("episode_index")


def check_compatible(manifests: DataFrame, *columns: str) -> None:
    """Raises ValueError unless all rows agree in the columns (fps, robot_type, features)."""
    r = manifests.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("null"))).alias(c) for c in columns]).first()
    if bad := [c for c in columns if r[c] > 1]:
        raise ValueError(f"sources differ in {bad}")


def cropped(image: Column, top: int, left: int, height: int, width: int) -> Column:
    """A channel-first pixel array cut to a box."""
    return F.transform(image, lambda channel: F.transform(F.slice(channel, top + 1, height), lambda row: F.slice(row, left + 1, width)))


def center_cropped(image: Column, height: int, width: int) -> Column:
    """Cut round the centre; a box larger than the image is clamped to it."""
    h, w = F.size(F.get(image, 0)), F.size(F.get(F.get(image, 0), 0))
    ch, cw = F.least(F.lit(height), h), F.least(F.lit(width), w)
    top, left = F.floor((h - ch) / 2).cast("int"), F.floor((w - cw) / 2).cast("int")
    return F.transform(image, lambda channel: F.transform(F.slice(channel, top + 1, ch), lambda row: F.slice(row, left + 1, cw)))


def without_images(frames: DataFrame, episodes: list[int], images: list[str]) -> DataFrame:
    return frames.where(F.col("episode_index").isin(episodes)).drop(*images)


def reuse_or(frames: DataFrame, column: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """frames if they have the column, else joined with compute(frames), a table (index, column)."""
    return frames if column in frames.columns else frames.join(compute(frames), "index", "left")


def merged_datasets(sources: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """One dataset of (frames with a task column, episodes): ids and indices shifted by the totals before, task ids by first-seen order over sources."""
    frames, tables, at, rows = [], [], 0, 0
    for i, (f, e) in enumerate(sources):
        counts = e.agg(F.count("*").alias("n"), F.sum("length").alias("rows")).first()
        shift = lambda df, at=at, rows=rows: df.withColumns({"episode_index": F.col("episode_index") + at} | ({"index": F.col("index") + rows} if "index" in df.columns else {}))
        frames.append(shift(f).withColumn("source_dataset_index", F.lit(i).cast("long")))
        tables.append(shift(e).withColumns({"dataset_from_index": F.col("dataset_from_index") + rows, "dataset_to_index": F.col("dataset_to_index") + rows}))
        at, rows = at + counts.n, rows + (counts.rows or 0)
    both = reduce(DataFrame.unionByName, frames)
    tasks = both.groupBy("task").agg(F.min(F.struct("source_dataset_index", "index")).alias("first"))
    tasks = tasks.withColumn("task_index", (F.row_number().over(Window.orderBy("first")) - 1).cast("long")).select("task", "task_index")
    return both.drop("task_index").join(tasks, "task"), reduce(DataFrame.unionByName, tables)


def common_features(*frames: DataFrame) -> list[str]:
    """Columns that all have, in the order of the first; none raises RuntimeError."""
    names = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    if not names:
        raise RuntimeError("no feature is common to all datasets")
    return names


def multi_dataset(*frames: DataFrame) -> DataFrame:
    names = [f"`{c}`" for c in common_features(*frames)]
    return reduce(DataFrame.unionByName, [f.select(*names).withColumn("dataset_index", F.lit(i).cast("long")) for i, f in enumerate(frames)])


def concatenated_batches(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of both; columns that one side has are null on the other."""
    return left.unionByName(right, allowMissingColumns=True)


def optional_metadata(episodes: DataFrame, core: tuple[str, ...] = ("length", "dataset_from_index", "dataset_to_index", "tasks")) -> DataFrame:
    """The extra columns of an episode table: neither statistics, nor places of files, nor the model's own."""
    return episodes.select("episode_index", *[f"`{c}`" for c in episodes.columns if c != "episode_index" and c not in core and not c.startswith(STORED)])


def rebased_videos(episodes: DataFrame, fps: float, keys: tuple[str, ...] = ("camera", "chunk_index", "file_index")) -> DataFrame:
    """from_timestamp and to_timestamp of the episodes of each video file, one after the other."""
    w = Window.partitionBy(*keys).orderBy("episode_index")
    end = F.sum(F.col("length") / fps).over(w)
    return episodes.withColumns({"to_timestamp": end, "from_timestamp": end - F.col("length") / fps})


def offsets_of_sources(sources: DataFrame, order: str, length: str) -> DataFrame:
    return with_offsets(sources, order, length, "frame_offset", "frame_end")
