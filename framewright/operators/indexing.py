"""Dense episode ids, frame indices and offsets, from cumulative sums over the episode table alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from framewright.sources.scratch import cut

#: Consecutive keys whose sizes are summed in one window partition.
BLOCK = 65_536
#: Sizes that are summed up exactly.
EXACT = "decimal(38, 9)"


def with_offsets(episodes: DataFrame, key: str = "episode_index", length: str = "length", start: str = "dataset_from_index", end: str = "dataset_to_index", block: float = BLOCK, kind: str = "long") -> DataFrame:
    """Adds [start, end): the sums of length before and up to each key.

    Sums run inside blocks of keys; only the totals of blocks meet in one partition, one row for block keys. Equal keys all
    end at the same sum.
    """
    blocked = episodes.withColumn("_block", F.floor(F.col(key) / block))
    totals = blocked.groupBy("_block").agg(F.sum(length).alias("_sum"))
    before = totals.select("_block", (F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).alias("_before"))
    inside = F.sum(length).over(Window.partitionBy("_block").orderBy(key))
    out = blocked.join(before, "_block").withColumn(end, (inside + F.col("_before")).cast(kind))
    return out.withColumn(start, (F.col(end) - F.col(length)).cast(kind)).select(*episodes.columns, start, end)


def with_sums(episodes: DataFrame, key: str, sums: dict[str, tuple[str, str]], block: float = BLOCK) -> DataFrame:
    """Adds (start, end) for each length in sums (length: (start, end)) in one pass: as with_offsets() for several of them."""
    blocked = episodes.withColumn("_block", F.floor(F.col(key) / block))
    inside = Window.partitionBy("_block").orderBy(key)
    within = blocked.withColumns({end: F.sum(length).over(inside) for length, (_, end) in sums.items()})
    totals = blocked.groupBy("_block").agg(*[F.sum(length).alias(f"_of_{length}") for length in sums])
    before = totals.select("_block", *[(F.sum(f"_of_{n}").over(Window.orderBy("_block")) - F.col(f"_of_{n}")).alias(f"_before_{n}") for n in sums])  # a row for each block
    ended = within.join(before, "_block").withColumns({end: (F.col(end) + F.col(f"_before_{n}")).cast("long") for n, (_, end) in sums.items()})
    return ended.select(*episodes.columns, *[c for n, (start, end) in sums.items() for c in ((F.col(end) - F.col(n)).cast("long").alias(start), F.col(end))])


def dense_rank_of(keys: DataFrame, key: str = "episode_index", rank: str = "new_index", block: int = BLOCK) -> DataFrame:
    """(key, rank): the position, from 0, of each distinct key in order."""
    distinct = keys.select(key).distinct().withColumn("_one", F.lit(1).cast("long"))
    return with_offsets(distinct, key, "_one", rank, "_end", block).select(key, rank)


def reindexed(frames: DataFrame, key: str = "episode_index", order: str = "frame_index") -> tuple[DataFrame, DataFrame]:
    """frames with dense episode ids, contiguous frame_index and index; and the new episode table (old id, new id, length, offsets)."""
    lengths = frames.groupBy(key).agg(F.count("*").alias("length")).withColumn("_one", F.lit(1).cast("long"))
    episodes = with_sums(lengths, key, {"_one": ("new_episode_index", "_end"), "length": ("dataset_from_index", "dataset_to_index")}).drop("_one", "_end")
    w = Window.partitionBy(key).orderBy(order)
    rest = [c for c in frames.columns if c not in (key, order, "index")]
    numbered = frames.withColumn("_frame", (F.row_number().over(w) - 1).cast("long")).join(episodes.select(key, "new_episode_index", "dataset_from_index"), key)
    out = numbered.select((F.col("dataset_from_index") + F.col("_frame")).alias("index"), F.col("new_episode_index").alias(key), F.col("_frame").alias(order), *rest)
    return out, episodes.withColumnsRenamed({key: "source_episode_index", "new_episode_index": key})


def placed(episodes: DataFrame, key: str, size: str, limit: float, max_episodes: int | None = None, max_frames: int | None = None, frames: str = "length", chunk_files: int = 1000) -> DataFrame:
    """(key, batch, chunk_index, file_index): episodes packed in order, a new file where the current one with the next
    would pass a limit; an episode over a limit has a file to itself.

    Sizes and limits are taken in decimals of nine places, so that sums are exact. From the running sums each episode tells where
    the next file would begin if it began one itself; following these steps from the first episode, with jumps that double each
    round, gives the files. No task sees more than a block of episodes, or a sampled range of sums, however sizes differ.
    """
    e = episodes.select(key, F.col(size).cast(EXACT).alias("_s"), F.col(frames).cast("long").alias("_f"))
    e = cut(e.join(dense_rank_of(e, key, "_r"), key), "ranked")
    sums = cut(with_offsets(with_offsets(e, "_r", "_s", "_s0", "_s1", kind=EXACT), "_r", "_f", "_f0", "_f1"), "sums")

    def first_over(low: str, high: str, most: float) -> DataFrame:
        """(_r, _j): the first rank whose sum passes that before _r by more than most, that is the number of sums that don't."""
        points = sums.select(F.col(high).cast(EXACT).alias("_at"), F.lit(0).alias("_asked"), "_r")
        asked = sums.select((F.col(low) + F.lit(most).cast(EXACT)).cast(EXACT).alias("_at"), F.lit(1).alias("_asked"), "_r")
        # ranges are sampled, so each holds about as many rows; at one sum the points come first
        dealt = points.unionByName(asked).repartitionByRange("_at", "_asked", "_r").sortWithinPartitions("_at", "_asked", "_r")
        dealt = cut(dealt.withColumn("_part", F.spark_partition_id()), "dealt")
        totals = dealt.groupBy("_part").agg(F.sum(1 - F.col("_asked")).alias("_n"))
        before = totals.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
        inside = F.sum(1 - F.col("_asked")).over(Window.partitionBy("_part").orderBy("_at", "_asked", "_r"))
        return dealt.withColumn("_in", inside).where("_asked = 1").join(before, "_part").select("_r", (F.col("_in") + F.col("_before")).alias("_j"))

    steps = first_over("_s0", "_s1", limit)
    if max_frames:
        steps = steps.join(first_over("_f0", "_f1", max_frames).withColumnRenamed("_j", "_k"), "_r").select("_r", F.least("_j", "_k").alias("_j"))
    most = F.col("_r") + max_episodes if max_episodes else F.col("_j")
    jump = cut(steps.select("_r", F.greatest(F.col("_r") + 1, F.least("_j", most)).alias("_to")), "steps")
    starts = sums.where("_r = 0").select("_r")
    while True:
        starts = cut(starts.unionByName(starts.join(jump, "_r").select(F.col("_to").alias("_r"))), "starts")
        jump = cut(jump.join(jump.select(F.col("_r").alias("_to"), F.col("_to").alias("_next")), "_to").select("_r", F.col("_next").alias("_to")), "steps")
        if jump.where("_r = 0").isEmpty():
            break
    flagged = e.join(starts.withColumn("_one", F.lit(1).cast("long")), "_r", "left").fillna(0, ["_one"])
    batch = with_offsets(flagged, "_r", "_one", "_", "_end").select(key, (F.col("_end") - 1).alias("batch"))
    return batch.select(key, "batch", F.floor(F.col("batch") / chunk_files).alias("chunk_index"), (F.col("batch") % chunk_files).alias("file_index"))
