"""Joins of the trajectory model: ranges, stage intervals, nearest times, remaps, checks and overlapping chunks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def episode_of_index(points: DataFrame, episodes: DataFrame, index: str = "index", default: int = 0, block: int = 1 << 16) -> DataFrame:
    """points with the first episode whose [from, to) holds index, else default.

    Ranges are cut at multiples of block, so that the join is on equal blocks and holds at any number of episodes.
    """
    e = episodes.select("episode_index", F.col("dataset_from_index").alias("_from"), F.col("dataset_to_index").alias("_to")).where("_to > _from")
    e = e.select("*", F.explode(F.sequence(F.floor(F.col("_from") / block), F.floor((F.col("_to") - 1) / block))).alias("_b"))
    hit = points.withColumn("_b", F.floor(F.col(index) / block)).join(e, "_b").where((F.col(index) >= F.col("_from")) & (F.col(index) < F.col("_to")))
    first = hit.groupBy(index).agg(F.min_by("episode_index", "_from").alias("episode_index"))
    return points.join(first, index, "left").withColumn("episode_index", F.coalesce("episode_index", F.lit(default)))


def stage_and_tau(frame: Column, names: Column, starts: Column, ends: Column) -> Column:
    """struct(stage, tau) of a frame by lists of subtasks: the first in list order that holds it; in a gap the one before at
    tau 1; before all stage 0 at tau 0; after the last one its stage at tau 0.999."""
    parts = F.arrays_zip(F.sequence(F.lit(0), F.size(names) - 1).alias("i"), starts.alias("s"), ends.alias("e"))
    inside = F.filter(parts, lambda p: (frame >= p.s) & (frame <= p.e))
    before = F.filter(parts, lambda p: frame > p.e)
    hit, gone = F.get(inside, 0), F.array_max(F.transform(before, lambda p: F.struct(p.e.alias("e"), p.i.alias("i"))))
    tau = F.when(hit.e == hit.s, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((frame - hit.s).cast("double"), (hit.e - hit.s).cast("double")))))
    after = F.size(before) == F.size(parts)
    return F.when(F.size(inside) > 0, F.struct(hit.i.alias("stage"), tau.alias("tau"))).when(F.size(before) == 0, F.struct(F.lit(0).alias("stage"), F.lit(0.0).alias("tau"))).otherwise(F.struct(F.when(after, F.size(parts) - 1).otherwise(gone.i).alias("stage"), F.when(after, 0.999).otherwise(1.0).alias("tau")))


def nearest_in_time(queries: DataFrame, data: DataFrame, time: str, value: str, tolerance: float, keys: tuple[str, ...] = ("episode_index",), strict: bool = False) -> DataFrame:
    """queries with the data row nearest in time under the same keys (ties: the earlier), and is_pad where it is farther than
    tolerance; with strict, such a query inside the data's time range raises.

    Both sides are sorted together once: the row before and the row after are running last and first values.
    """
    q = queries.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_q"), F.struct(*queries.columns).alias("_row"), F.lit(None).cast(data.schema[value].dataType).alias("_v"))
    d = data.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_q"), F.lit(None).cast(q.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_t", "_q")
    known = F.when(F.col("_q") == 0, F.struct("_t", "_v"))
    both = q.unionByName(d).withColumn("_a", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    da, db = F.col("_t") - F.col("_a._t"), F.col("_b._t") - F.col("_t")
    earlier = F.col("_b").isNull() | (F.col("_a").isNotNull() & (da <= db))
    best = F.when(earlier, F.col("_a")).otherwise(F.col("_b"))
    far = F.coalesce(F.when(earlier, da).otherwise(db) > tolerance, F.lit(True))
    if strict:
        bad = far & F.col("_a").isNotNull() & F.col("_b").isNotNull()
        far = F.when(bad, F.raise_error(F.lit("a time inside the episode is farther than the tolerance from every frame")).cast("boolean")).otherwise(far)
    return both.where("_q = 1").select("_row.*", best.getField("_v").alias(value), far.alias("is_pad"))


def remapped_ids(rows: DataFrame, source: DataFrame, target: DataFrame, key: str, name: str) -> DataFrame:
    """rows with key replaced: source id -> name -> target id; ids are joined, never taken by position."""
    pairs = source.select(F.col(key), F.col(name)).join(target.select(F.col(key).alias("_new"), F.col(name)), name).select(key, "_new")
    return rows.join(pairs, key, "left").withColumn(key, F.col("_new")).drop("_new")


def relocated(rows: DataFrame, moves: DataFrame, chunk: str, file: str, default: tuple[int, int]) -> DataFrame:
    """rows with (chunk, file) replaced by moves (chunk, file, to_chunk, to_file), else by the default place."""
    joined = rows.join(moves, [chunk, file], "left")
    return joined.withColumns({chunk: F.coalesce("to_chunk", F.lit(default[0])), file: F.coalesce("to_file", F.lit(default[1]))}).drop("to_chunk", "to_file")


def missing_rows(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return expected.select(key).join(found.select(key), key, "left_anti")


def require_all(expected: DataFrame, found: DataFrame, key: str, what: str = "prediction") -> None:
    if n := missing_rows(expected, found, key).count():
        raise RuntimeError(f"{n} rows have no {what}")


def missing_shards(done: DataFrame, n: int, key: str = "rank") -> DataFrame:
    return done.sparkSession.range(n).withColumnRenamed("id", key).join(done.select(key).distinct(), key, "left_anti")


# How much the old and the new action of a timestep count, by the rule's name.
COMBINE_WEIGHTS = {"weighted_average": (0.3, 0.7), "latest_only": (0.0, 1.0), "average": (0.5, 0.5), "conservative": (0.7, 0.3)}


def combining(rule: str) -> Callable:
    """(old, new) -> their weighted sum, for columns and for numbers; a weight of 0 leaves an action out, whatever it is."""
    weights = COMBINE_WEIGHTS[rule]

    def combine(*actions):
        parts = [w * x for w, x in zip(weights, actions, strict=True) if w]
        return reduce(lambda a, b: a + b, parts)

    return combine


def combined(name: str, old: Column, new: Column) -> Column:
    """Two vectors combined by name; unknown names raise ValueError."""
    if name not in COMBINE_WEIGHTS:
        raise ValueError(f"{name} is none of {sorted(COMBINE_WEIGHTS)}")
    rule = combining(name)
    return F.zip_with(old, new, lambda a, b: rule(a, b))


def merged_chunks(queue: DataFrame, incoming: DataFrame, latest: Column | int, how: str = "weighted_average", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, timestep, action): queued and incoming actions after latest; a timestep in both is combined by how."""
    late = latest if isinstance(latest, Column) else F.lit(latest)
    both = queue.select(*keys, "timestep", F.col("action").alias("_old")).join(incoming.select(*keys, "timestep", F.col("action").alias("_new")), [*keys, "timestep"], "full_outer")
    action = F.when(F.col("_old").isNull(), F.col("_new")).when(F.col("_new").isNull(), F.col("_old")).otherwise(combined(how, F.col("_old"), F.col("_new")))
    return both.where(F.col("timestep") > late).select(*keys, "timestep", action.alias("action"))


def instruction_at(instructions: Column, frame: Column) -> Column:
    """The text of the first "start end" range, by its start, that holds frame: start <= frame < end, or frame = start."""
    rows = F.transform(F.map_entries(instructions), lambda e: F.struct(F.split(e.key, " ")[0].cast("long").alias("s"), F.split(e.key, " ")[1].cast("long").alias("e"), e.value.alias("v")))
    return F.get(F.filter(F.array_sort(rows), lambda r: ((frame >= r.s) & (frame < r.e)) | (frame == r.s)), 0).v
