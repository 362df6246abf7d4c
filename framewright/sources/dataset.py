"""Reading and writing packed episode datasets: frames, manifest, tasks, episodes, statistics, sidecars and logs."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from framewright.operators.indexing import BLOCK, placed, with_offsets, with_sums
from framewright.operators.labels import report_label
from framewright.operators.stats import feature_stats, merged_stats, with_sketches
from framewright.operators.surgery import split_names
from framewright.sources import commits
from framewright.sources.schema import schema_of
from framewright.sources.scratch import cut, few

#: Up to so many episodes are a pushed-down list; more are a semi join.
LISTED_EPISODES = 1_000
#: Up to so many files are named in a scan's filter; more are pruned when the join's small side is known.
LISTED_FILES = 1_000


def scan_frames(spark: SparkSession, root: str, features: dict[str, dict] | None = None, episodes: list[int] | DataFrame | None = None) -> DataFrame:
    """All frames under root/data, in the declared features and of the episodes asked for; a missing folder or feature raises."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{root}/data")
    if isinstance(episodes, DataFrame):
        df = df.join(episodes.select("episode_index"), "episode_index", "left_semi")
    elif episodes is not None and len(episodes) <= LISTED_EPISODES:
        df = df.where(F.col("episode_index").isin(episodes))
    elif episodes is not None:
        df = df.join(spark.createDataFrame([(e,) for e in episodes], "episode_index long"), "episode_index", "left_semi")
    if features is None:
        return df
    schema = schema_of(features)
    if lost := [f.name for f in schema if f.name not in df.columns]:
        raise ValueError(f"declared features are missing: {lost}")
    return df.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def write_frames(frames: DataFrame, root: str, rows_per_file: int = 5_000_000) -> None:
    """Frames as files of up to rows_per_file rows that each hold a range of episodes in the order of index."""
    frames.repartitionByRange("episode_index").sortWithinPartitions("episode_index", "index").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(f"{root}/data")


def column_bytes(frames: DataFrame) -> Column:
    """Bytes of a row's columns as they are stored without compression: numbers by width, texts and binaries by length, arrays by element."""
    width = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}

    def of(c: Column, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(c), F.lit(0))
        if kind.startswith("array<"):
            inner = kind[6:-1]
            return F.coalesce(F.size(c) * width[inner] if inner in width else F.aggregate(c, F.lit(0), lambda a, x: a + of(x, inner)), F.lit(0))
        return F.lit(width.get(kind, 8))

    return reduce(lambda a, b: a + b, [of(F.col(f"`{n}`"), t) for n, t in frames.dtypes], F.lit(0)).cast("long")


def write_rotated(frames: DataFrame, root: str, max_mb: float = 100, chunk_files: int = 1000, first_file: int = 0, folder: str = "data") -> DataFrame:
    """Whole episodes in order in files root/folder/chunk_index=.../file_index=..., a new one where the next episode would bring
    the columns' bytes over max_mb. Gives the map (episode_index, chunk_index, file_index), numbered on from first_file.

    A file is one task's work: a file is as large as max_mb or one episode at most.
    """
    sizes = frames.groupBy("episode_index").agg(F.sum(column_bytes(frames)).alias("bytes"), F.count("*").alias("length"))
    place = placed(cut(sizes, "sizes"), "episode_index", "bytes", max_mb * (1 << 20), chunk_files=chunk_files)
    number = F.col("batch") + first_file
    place = cut(place.select("episode_index", F.floor(number / chunk_files).alias("chunk_index"), (number % chunk_files).alias("file_index")), "places")
    rows = frames.join(place, "episode_index").repartition("chunk_index", "file_index").sortWithinPartitions("chunk_index", "file_index", "index")
    _write_files(rows, f"{root}/{folder}", keep=bool(first_file))
    return place


def _write_files(rows: DataFrame, folder: str, keep: bool) -> None:
    """rows, which lie and are sorted by chunk_index and file_index, as a file for each pair of them; with keep beside those that are there.

    In a mounted folder the tasks write with Arrow: Hadoop's file system starts a process for each folder and two for each file there,
    many times what small files take. A file is one task's and gets one name, under which it appears whole, so that a task that
    runs again replaces it. Elsewhere, and for types that Arrow doesn't have, Spark's own writer is as good.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() != "file" or any(re.search("interval|void|variant|udt|geo|time\\(", t) for _, t in rows.dtypes):
        rows.write.mode("append" if keep else "overwrite").partitionBy("chunk_index", "file_index").parquet(folder)
        return
    if not keep:
        fs.delete(path, True)
    fs.mkdirs(path)
    local = path.toUri().getPath() if path.isAbsolute() else fs.makeQualified(path).toUri().getPath()
    rows.mapInArrow(lambda batches: _files_of_task(batches, local), "files long").agg(F.sum("files")).collect()  # one number


#: Bytes of a row group of the files that tasks write themselves, about.
ROW_GROUP_BYTES = 64 << 20


def _files_of_task(batches: Iterator, folder: str) -> Iterator:
    """Writes a task's rows, of which a row group at most is held, and gives the number of its files."""
    import pyarrow as pa
    from pyarrow import parquet

    at, writer, draft, files, waiting = None, None, "", 0, []

    def flush() -> None:
        if waiting:
            writer.write_table(pa.Table.from_batches(waiting))
            waiting.clear()

    def close() -> None:
        flush()
        writer.close()
        os.replace(draft, f"{os.path.dirname(draft)}/part-00000.snappy.parquet")

    for batch in batches:
        pairs = list(zip(batch.column("chunk_index").to_pylist(), batch.column("file_index").to_pylist(), strict=True))
        held = batch.drop_columns(["chunk_index", "file_index"])
        starts = [i for i in range(len(pairs)) if i == 0 or pairs[i] != pairs[i - 1]]
        for low, high in zip(starts, [*starts[1:], len(pairs)], strict=True):
            if pairs[low] != at:
                if writer:
                    close()
                at, files = pairs[low], files + 1
                place = f"{folder}/chunk_index={at[0]}/file_index={at[1]}"
                os.makedirs(place, exist_ok=True)
                draft = f"{place}/_{uuid.uuid4().hex}"
                writer = parquet.ParquetWriter(draft, held.schema, compression="snappy")
            waiting.append(held.slice(low, high - low))
        if sum(w.nbytes for w in waiting) >= ROW_GROUP_BYTES:
            flush()
    if writer:
        close()
    yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})


def appended(spark: SparkSession, root: str, buffer: DataFrame, fps: float, features: list[str], max_mb: float = 100, told: Callable[[str], None] = lambda step: None) -> None:
    """Add the buffer's episodes (source, step, task, ...) to the stored dataset at root, or begin one.

    They take the next ids, indices, tasks and files. Frames, episodes, tasks and statistics go to a part of their own under
    root/data and the like, and all become visible when the record of the next version is committed: a writer that fails on the way leaves
    the dataset as it was, and one that runs again writes another part. Of two writers at once the later one raises Conflict.
    Statistics, with mergeable quantile sketches, are merged with the stored ones. told is called with each step's name before it.
    """
    old = stored(spark, root)
    last = old["episodes"].agg(F.max("episode_index").alias("e"), F.max("dataset_to_index").alias("i"), F.max(F.col("chunk_index") * 1000 + F.col("file_index")).alias("f")).first() if old else None
    name = f"p{uuid.uuid4().hex}"  # a letter first: folders' names that look like numbers are read as such
    frames, episodes, tasks = ingest(buffer, fps, old["tasks"] if old else None, last.e + 1 if old else 0, last.i if old else 0)
    frames = cut(frames, "new-frames")
    told("frames")
    place = write_rotated(frames, root, max_mb, first_file=last.f + 1 if old else 0, folder=f"data/part={name}")
    told("episodes")
    episodes.join(place, "episode_index").write.parquet(f"{root}/episodes/part={name}")
    told("tasks")
    tasks.write.parquet(f"{root}/tasks/part={name}")
    told("stats")
    stats = with_sketches(feature_stats(frames, features, quantiles=()), frames, features)
    (merged_stats(stats.unionByName(old["stats"])) if old else stats).write.parquet(f"{root}/stats/part={name}")
    told("commit")
    before = old["record"]["parts"] if old else []
    commits.commit(spark, root, {"version": len(before), "parts": [*before, {"root": root, "part": name}], "tasks": f"{root}/tasks/part={name}", "stats": f"{root}/stats/part={name}"})


def stored(spark: SparkSession, root: str) -> dict | None:
    """frames, episodes, tasks and stats of the newest version of the dataset at root, and its record; None where there is none.

    A part whose ids or tasks are others in this dataset is read with its shifts and its map of task ids.
    """
    record = commits.newest(spark, root)
    if record is None:
        return None

    frames, episodes = (_read(spark, record["parts"], kind) for kind in ("data", "episodes"))
    return {"frames": frames, "episodes": episodes, "tasks": spark.read.parquet(record["tasks"]), "stats": spark.read.parquet(record["stats"]), "record": record}


def _alike(parts: list[dict]) -> list[list[dict]]:
    """Parts of a record in groups that are shifted alike, which are read together."""
    groups: dict[str, list[dict]] = {}
    for p in parts:
        groups.setdefault(json.dumps({**p, "part": ""}, sort_keys=True), []).append(p)
    return list(groups.values())


def _files_of(spark: SparkSession, group: list[dict], kind: str) -> DataFrame:
    """What the parts of a group hold, as it was written, with the part's name."""
    return spark.read.option("basePath", f"{group[0]['root']}/{kind}").parquet(*[f"{p['root']}/{kind}/part={p['part']}" for p in group])


def _read(spark: SparkSession, parts: list[dict], kind: str) -> DataFrame:
    """The parts' rows: the episodes that are kept of them, with ids, indices and tasks as they are in this dataset."""

    def of(group: list[dict]) -> DataFrame:
        part, df = group[0], _files_of(spark, group, kind)
        indices = [c for c in ("index", "dataset_from_index", "dataset_to_index") if c in df.columns]
        if "kept" in part:
            kept = spark.read.parquet(part["kept"])
            df = _within_files(df, kept) if kind == "data" else df
            df = df.join(few(kept), _PLACE).withColumns({"episode_index": F.col("new_episode_index"), **{c: F.col(c) + F.col("_moved") for c in indices}}).drop("new_episode_index", "_moved")
        moved = {"episode_index": part.get("episodes", 0), **dict.fromkeys(indices, part.get("rows", 0))}
        df = df.drop("part").withColumns({c: F.col(c) + by for c, by in moved.items() if by})
        if "map" in part and "task_index" in df.columns:
            df = df.join(few(spark.read.parquet(part["map"])), "task_index").drop("task_index").withColumnRenamed("new_task_index", "task_index")
        return df

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(of, _alike(parts)))


def merged_by_reference(spark: SparkSession, root: str, sources: list[str]) -> None:
    """A dataset at root that consists of the stored datasets at sources, one after the other, without a copy of their frames.

    Its record names the sources' parts with what their ids and indices are shifted by and a map of their task ids; ids are
    dense over all sources, tasks are numbered in the order that sources have them. Only tasks and statistics are written.
    Later appends to a source don't show in it. Appends to root go on from there.
    """
    name, parts, episodes, rows, tasks, stats = uuid.uuid4().hex, [], 0, 0, None, []
    for k, source in enumerate(sources):
        held = stored(spark, source)
        new = held["tasks"].join(tasks, "task", "left_anti") if tasks is not None else held["tasks"]
        base = tasks.count() if tasks is not None else 0
        new = new.withColumn("task_index", (F.row_number().over(Window.orderBy("task_index")) - 1 + base).cast("long"))  # the task table is small
        tasks = cut(tasks.unionByName(new) if tasks is not None else new, "tasks")
        maps: dict[str | None, str] = {}  # parts with one map of task ids get one map again
        for part in held["record"]["parts"]:
            if (old := part.get("map")) not in maps:
                own = spark.read.parquet(old) if old else held["tasks"].select("task_index", F.col("task_index").alias("new_task_index"))
                there = own.join(held["tasks"].withColumnRenamed("task_index", "new_task_index"), "new_task_index").select("task_index", "task")
                maps[old] = f"{root}/maps/part={name}/{k}-{len(maps)}"
                there.join(tasks.withColumnRenamed("task_index", "new_task_index"), "task").select("task_index", "new_task_index").write.parquet(maps[old])
            parts.append({**part, "episodes": part.get("episodes", 0) + episodes, "rows": part.get("rows", 0) + rows, "map": maps[old]})
        size = held["episodes"].agg(F.max("episode_index").alias("e"), F.max("dataset_to_index").alias("i")).first()
        episodes, rows = episodes + size.e + 1, rows + size.i
        stats.append(held["stats"])
    tasks.write.parquet(f"{root}/tasks/part={name}")
    merged_stats(concatenated(stats)).write.parquet(f"{root}/stats/part={name}")
    commits.commit(spark, root, {"version": len(parts) - 1, "parts": parts, "tasks": f"{root}/tasks/part={name}", "stats": f"{root}/stats/part={name}"})


def split_by_reference(spark: SparkSession, source: str, lists: DataFrame, roots: dict[str, str]) -> None:
    """Datasets at roots, one for each split of lists (episode_index, split), of the stored dataset at source without a copy of its frames.

    A split's record names the source's parts that hold its episodes, with a table of these episodes: the file that each lies in,
    its dense id in the split and what its indices are shifted by. Reading a split opens those files only. Tasks that it uses
    are numbered anew in their order; its statistics are taken from its frames. Lists are checked as split_names() says, a split
    without a root raises ValueError, and so does a root that holds a dataset. Episodes in no list are in no split. Merging, splitting
    and appending go on from a split as from any dataset.
    """
    held = stored(spark, source)
    if held is None:
        raise ValueError(f"no dataset at {source}")
    if set(names := split_names(held["episodes"], lists)) - set(roots):
        raise ValueError("each split needs a root")
    groups = _alike(held["record"]["parts"])
    known = cut(concatenated([_located(spark, g).withColumn("_g", F.lit(k)) for k, g in enumerate(groups)]), "located")
    features = sorted(r.feature for r in held["stats"].select("feature").distinct().collect())  # names of features
    for split in names:
        root, name = roots[split], f"p{uuid.uuid4().hex}"
        if commits.newest(spark, root):
            raise ValueError(f"a dataset is at {root} already")
        mine = known.join(lists.where(F.col("split") == split).select("episode_index").distinct(), "episode_index", "left_semi").withColumn("_one", F.lit(1).cast("long"))
        mine = cut(with_sums(mine, "episode_index", {"_one": ("new_episode_index", "_end"), "length": ("_first", "_last")}), "split")
        mine.select("_g", *[c for c in _PLACE if c != "episode_index"], F.col("_own").alias("episode_index"), "new_episode_index", (F.col("_first") - F.col("_from")).alias("_moved")).write.partitionBy("_g").parquet(f"{root}/kept/part={name}")
        used = held["tasks"].join(mine.select(F.explode("tasks").alias("task")).distinct(), "task", "left_semi")
        tasks = cut(used.withColumn("new_task_index", (F.row_number().over(Window.orderBy("task_index")) - 1).cast("long")), "tasks")  # the task table is small
        tasks.select("task", F.col("new_task_index").alias("task_index")).write.parquet(f"{root}/tasks/part={name}")
        there: dict[int, set[str]] = {}
        for r in mine.select("_g", "part").distinct().collect():  # parts of the record
            there.setdefault(r["_g"], set()).add(r.part)
        parts = []
        for k, held_parts in sorted(there.items()):
            renumbered = tasks.select(F.col("task_index").alias("_old"), "new_task_index")
            own = spark.read.parquet(groups[k][0]["map"]).withColumnRenamed("new_task_index", "_old") if "map" in groups[k][0] else renumbered.select(F.col("_old").alias("task_index"), "_old")
            own.join(renumbered, "_old").select("task_index", "new_task_index").write.parquet(f"{root}/maps/part={name}/{k}")
            parts += [{"root": p["root"], "part": p["part"], "kept": f"{root}/kept/part={name}/_g={k}", "map": f"{root}/maps/part={name}/{k}"} for p in groups[k] if p["part"] in held_parts]
        frames = _read(spark, parts, "data")
        with_sketches(feature_stats(frames, features, quantiles=()), frames, features).write.parquet(f"{root}/stats/part={name}")
        commits.commit(spark, root, {"version": len(parts) - 1, "parts": parts, "tasks": f"{root}/tasks/part={name}", "stats": f"{root}/stats/part={name}"})


#: What tells where an episode lies: its part and file, and its id as it was written.
_PLACE = ["part", "chunk_index", "file_index", "episode_index"]


def _located(spark: SparkSession, group: list[dict]) -> DataFrame:
    """The episodes of a group's parts by the ids that they have in its dataset, with their place, and _own and _from, their id and first index as written."""
    part, e = group[0], _files_of(spark, group, "episodes").withColumns({"_own": F.col("episode_index"), "_from": F.col("dataset_from_index")})
    if "kept" in part:
        e = e.join(few(spark.read.parquet(part["kept"])), _PLACE).withColumn("episode_index", F.col("new_episode_index"))
    return e.select((F.col("episode_index") + part.get("episodes", 0)).alias("episode_index"), "part", "chunk_index", "file_index", "_own", "_from", "length", "tasks")


def _within_files(frames: DataFrame, asked: DataFrame) -> DataFrame:
    """frames with the files named in the filter, if they are few; pruning by a join knows chunks and files, but not which file of which chunk."""
    listed = asked.select("chunk_index", "file_index").distinct().limit(LISTED_FILES + 1).collect()
    if len(listed) > LISTED_FILES:
        return frames
    by_chunk: dict[int, list[int]] = {}
    for r in listed:
        by_chunk.setdefault(r.chunk_index, []).append(r.file_index)
    return frames.where(reduce(lambda a, b: a | b, [(F.col("chunk_index") == c) & F.col("file_index").isin(f) for c, f in by_chunk.items()], F.lit(False)))


def scan_placed(spark: SparkSession, root: str, places: DataFrame, episodes: DataFrame) -> DataFrame:
    """Frames under root/data of the episodes asked for, from the files that places (episode_index, chunk_index, file_index) gives
    them. Only those files are opened: the join is on the folders' columns too, and a few files are named in the scan's filter."""
    asked = places.join(episodes.select("episode_index").distinct(), "episode_index").select("chunk_index", "file_index", "episode_index")
    asked = cut(asked, "asked").where("file_index >= 0")  # always so; without a filter on it Spark doesn't take a side for small
    frames = _within_files(spark.read.parquet(f"{root}/data"), asked)
    return frames.join(few(asked), ["chunk_index", "file_index", "episode_index"])


def write_manifest(spark: SparkSession, root: str, manifest: dict) -> None:
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/meta/info")


def scan_manifest(spark: SparkSession, root: str) -> dict:
    """fps, robot type, totals, path templates and features; lists of shapes are tuples."""
    text = "\n".join(r.value for r in spark.read.text(f"{root}/meta/info*", wholetext=True).collect())  # one small document
    info = json.loads(text)
    for spec in info.get("features", {}).values():
        spec["shape"] = tuple(spec["shape"])
    return info


def scan_tasks(spark: SparkSession, root: str, name: str = "tasks") -> DataFrame:
    """(task, task_index); the text may be stored as an index column without a name."""
    df = spark.read.parquet(f"{root}/meta/{name}.parquet")
    return df.withColumnRenamed("__index_level_0__", name.removesuffix("s"))


def scan_episodes(spark: SparkSession, root: str, with_stats: bool = False) -> DataFrame:
    df = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/meta/episodes")
    return df if with_stats else df.select([f"`{c}`" for c in df.columns if not c.startswith("stats/")])


def named_tasks(episodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """episodes whose lists of task ids become lists of names, in order; an unknown id raises."""
    flat = episodes.select("episode_index", F.posexplode("tasks").alias("_pos", "task_index")).join(tasks, "task_index", "left")
    name = F.when(F.col("task").isNull(), F.raise_error(F.concat(F.lit("no task has the id "), F.col("task_index").cast("string")))).otherwise(F.col("task"))
    lists = flat.groupBy("episode_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", name.alias("t")))), lambda x: x.t).alias("tasks"))
    return episodes.drop("tasks").join(lists, "episode_index", "left")


def ingest(frames: DataFrame, fps: float, tasks: DataFrame | None = None, first_episode: int = 0, first_index: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Buffered frames (source, step, task, ...) as frames, episodes and tasks: dense ids after those in use, timestamps
    by fps where there are none, new tasks appended in the order they are first seen."""
    per = frames.groupBy("source").agg(F.count("*").alias("length"))
    numbered = with_offsets(per.withColumn("_one", F.lit(1).cast("long")), "source", "_one", "_e", "_x")
    episodes = with_offsets(numbered, "source", "length").select("source", (F.col("_e") + first_episode).alias("episode_index"), "length", (F.col("dataset_from_index") + first_index).alias("dataset_from_index"), (F.col("dataset_to_index") + first_index).alias("dataset_to_index"))
    w = Window.partitionBy("source").orderBy("step")
    f = frames.withColumn("frame_index", (F.row_number().over(w) - 1).cast("long")).join(episodes.drop("length", "dataset_to_index"), "source")
    stamp = F.coalesce(F.col("timestamp"), F.col("frame_index") / fps) if "timestamp" in frames.columns else F.col("frame_index") / fps
    f = f.withColumns({"index": F.col("dataset_from_index") + F.col("frame_index"), "timestamp": stamp})
    seen = f.groupBy("task").agg(F.min("index").alias("_first"))
    if tasks is not None:
        seen = seen.join(tasks, "task", "left_anti")
    base = (tasks.agg(F.max("task_index")).first()[0] + 1) if tasks is not None else 0
    new = seen.withColumn("task_index", (F.row_number().over(Window.orderBy("_first")) - 1 + base).cast("long")).select("task", "task_index")  # the task table is small
    table = tasks.unionByName(new) if tasks is not None else new
    lists = f.groupBy("episode_index").agg(F.transform(F.array_sort(F.collect_set(F.struct("task"))), lambda x: x.task).alias("tasks"))
    return f.join(table, "task").drop("dataset_from_index", "step", "source", "task"), episodes.join(lists, "episode_index"), table


def write_sidecar(root: str, tag: str, rows: DataFrame) -> None:
    """(index, numeric columns) as root/advantage/<tag>; other types raise ValueError. Spark's commit makes it appear whole."""
    if bad := [n for n, t in rows.dtypes if n != "index" and t not in ("float", "double", "bigint", "int")]:
        raise ValueError(f"not numeric: {bad}")
    narrow = {n: F.col(n).cast("float") for n, t in rows.dtypes if t == "double"}
    rows.withColumns(narrow).write.mode("overwrite").parquet(f"{root}/advantage/{tag}")


def overlaid(frames: DataFrame, *sidecars: DataFrame, fill: bool = True, order: str | None = None) -> DataFrame:
    """frames with the numeric columns of sidecars by index; gaps are NaN in floats and 0 in integers, or null without fill.

    A later sidecar replaces a column of the same name; of rows with one index the last in order, else the largest, counts.
    """
    for s in sidecars:
        values = [n for n, t in s.dtypes if n not in ("index", order) and t in ("float", "double", "bigint", "int")]
        one = s.groupBy("index").agg(F.max(F.struct(*([order] if order else []), *values)).alias("_m")).select("index", *[F.col(f"_m.{v}").alias(f"_{v}") for v in values])
        frames = frames.drop(*values).join(one, "index", "left")
        kinds = dict(s.dtypes)
        gap = lambda v: F.lit(float("nan")).cast(kinds[v]) if kinds[v] in ("float", "double") else F.lit(0).cast(kinds[v])  # noqa: B023, E731
        frames = frames.withColumns({v: F.coalesce(f"_{v}", gap(v)) if fill else F.col(f"_{v}") for v in values}).drop(*[f"_{v}" for v in values])
    return frames


def upserted(frames: DataFrame, column: str, new: DataFrame) -> DataFrame:
    """frames with column from new (index, column) where it has the index; others keep their value, or NaN or 0 if the column is new."""
    kind = dict(new.dtypes)[column]
    gap = F.lit(float("nan")).cast(kind) if kind in ("float", "double") else F.lit(0).cast(kind)
    old = F.coalesce(F.col(column), gap) if column in frames.columns else gap
    joined = frames.join(new.select("index", F.col(column).alias("_new"), F.lit(True).alias("_hit")), "index", "left")
    return joined.withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(old)).drop("_new", "_hit")


def footer_counts(spark: SparkSession, path: str) -> int:
    """Rows of Parquet files: a count without columns, that only footers answer."""
    return spark.read.parquet(path).count()


def upgraded(frames: DataFrame, episodes: DataFrame, stats: DataFrame) -> DataFrame:
    """The episode table of a packed dataset from per-episode parts: lengths and offsets from the frames, metadata and
    statistics by episode; parts that don't have the same episodes raise."""
    lengths = with_offsets(frames.groupBy("episode_index").agg(F.count("*").alias("length")), "episode_index", "length")
    there = lambda df, n: df.select("episode_index").distinct().withColumn(n, F.lit(1))
    parts = there(frames, "_f").join(there(episodes, "_e"), "episode_index", "full_outer").join(there(stats, "_s"), "episode_index", "full_outer")
    if parts.where("_f is null or _e is null or _s is null").count():
        raise ValueError("frames, episodes and statistics don't have the same episodes")
    wide = stats.groupBy("episode_index").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", F.lit("stats"), "feature", "stat", "dim"), "value"))).alias("stats"))
    return lengths.join(episodes, "episode_index").join(wide, "episode_index")


def imported_episodes(records: DataFrame, path: str) -> DataFrame:
    """Flat frames from records (episode, steps: array of struct(joint, gripper, ...), path): state is joint and gripper
    in float32, success whether path holds /success/."""
    flat = records.select("episode", F.col(path).contains("/success/").alias("success"), F.posexplode("steps").alias("frame_index", "s"))
    return flat.select("episode", F.col("frame_index").cast("long").alias("frame_index"), F.concat("s.joint", "s.gripper").cast("array<float>").alias("state"), F.col("s.instruction").alias("task"), "success")


def exported_log(log: DataFrame, capacity: int, position: int, size: int, ring: str = "ring", block: int = BLOCK) -> DataFrame:
    """Episodes of rings of transitions (ring, slot, done, truncated, ...) in the order they came: a new one after each end, the
    last may be partial. A ring may be large: it is worked on in blocks of slots, and only what blocks add up to, one row each,
    meets in one task: the rows and ends before a block, and where the latest of those ends was.
    """
    age = F.pmod(F.col("slot") - F.lit(position - size), F.lit(capacity))
    rows = log.withColumn("_age", age).where(F.col("_age") < size).withColumn("_block", F.floor(F.col("_age") / block)).withColumn("_end", (F.col("done") | F.col("truncated")).cast("long"))
    inside = Window.partitionBy(ring, "_block").orderBy("_age")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_row": F.row_number().over(inside).cast("long"), "_ends": F.coalesce(F.sum("_end").over(before), F.lit(0))})
    rows = rows.withColumn("_last", F.max(F.when(F.col("_end") == 1, F.col("_row"))).over(before))
    blocks = rows.groupBy(ring, "_block").agg(F.count("*").alias("_n"), F.sum("_end").alias("_e"), F.max(F.when(F.col("_end") == 1, F.col("_row"))).alias("_l"))
    along = Window.partitionBy(ring).orderBy("_block")
    ahead = along.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_rows0", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).withColumn("_ends0", F.coalesce(F.sum("_e").over(ahead), F.lit(0)))
    blocks = blocks.withColumn("_last0", F.coalesce(F.max(F.col("_l") + F.col("_rows0")).over(ahead), F.lit(0))).select(ring, "_block", "_rows0", "_ends0", "_last0")
    placed_ = rows.join(blocks, [ring, "_block"])
    start = F.coalesce(F.col("_last") + F.col("_rows0"), F.col("_last0"))
    out = placed_.withColumns({"episode_index": F.col("_ends") + F.col("_ends0"), "frame_index": F.col("_row") + F.col("_rows0") - start - 1})
    return out.select(*log.columns, "episode_index", "frame_index")


def rollout_dataset(rollouts: DataFrame, labels: DataFrame, bookkeeping: tuple[str, ...] = ()) -> DataFrame:
    """Rollout rows without bookkeeping, next.* and complementary_info.* columns, numbers as float or long, each with its episode's label (failure where it has none)."""
    keep = [c for c in rollouts.columns if c not in bookkeeping and not c.startswith(("next.", "complementary_info."))]
    kinds = dict(rollouts.dtypes)
    cast = lambda c: F.col(f"`{c}`").cast("float") if kinds[c] in ("double", "float") or kinds[c].startswith("decimal") else F.col(f"`{c}`").cast("bigint") if kinds[c] in ("int", "smallint", "tinyint", "boolean") else F.col(f"`{c}`")
    l = labels.select("episode_index", report_label(F.col("episode_success")).alias("_l"))
    return rollouts.select([cast(c).alias(c) for c in keep]).join(l, "episode_index", "left").withColumn("episode_success", F.coalesce("_l", F.lit("failure"))).drop("_l")


def stream_frames(spark: SparkSession, root: str, schema, episodes: list[int] | None = None, files_per_trigger: int = 16) -> DataFrame:
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(f"{root}/data")
    return df.where(F.col("episode_index").isin(episodes)) if episodes is not None else df


def all_sidecars(spark: SparkSession, root: str, tags: list[str]) -> list[DataFrame]:
    return [spark.read.parquet(f"{root}/advantage/{t}") for t in sorted(tags)]


def concatenated(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
