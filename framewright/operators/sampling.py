"""Order and sampling by hashes of keys: the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from framewright.operators.indexing import with_offsets
from framewright.sources.scratch import cut, few

#: Digests that are counted together, of 2 ** 60: 65,536 blocks.
BLOCK = 1 << 44


#: Hexadecimal digits of a digest that are used: 60 bits.
DIGITS = 15


def digest(seed: int, *keys: Column) -> Column:
    """A number from 0 to 2 ** 60 - 1 that keys and seed fix, by md5, which other engines have too."""
    text = F.concat_ws(":", *[k.cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def chance(key: Column, seed: int) -> Column:
    """A number in [0, 1) that key and seed fix."""
    return (digest(seed, key) % 1_000_000) / 1_000_000


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """rows in the order of their digests, with their position; positions are summed up in blocks of digests, so that no rows
    but one for each block meet in one partition."""
    placed = with_offsets(rows.withColumns({"_d": digest(seed, F.col(key)), "_one": F.lit(1).cast("long")}), "_d", "_one", "position", "_end", BLOCK)
    return placed.orderBy("_d").drop("_d", "_one", "_end")


def epoch_order(rows: DataFrame, key: str, shard: str, seed: int, epochs: range, open_shards: int = 16, block: int = 65_536) -> DataFrame:
    """rows once for each epoch, with epoch, turn and position: the order in which a reader that has open_shards shards open at a
    time would give them, another one in each epoch.

    Shards are shuffled anew for each epoch and taken open_shards at a time; the frames of one such turn are mixed with each
    other and come before those of the next. Positions are dense within an epoch. A turn is counted in blocks of its digests, of
    about block rows, so that a shard of any size is no one task's; one row for each shard and block meets in a window.
    """
    shards = rows.groupBy(shard).agg(F.count("*").alias("_n")).select(shard, "_n", F.explode(F.array(*[F.lit(e) for e in epochs])).alias("epoch"))
    rank = F.row_number().over(Window.partitionBy("epoch").orderBy(digest(seed, F.col("epoch"), F.col(shard)), shard)) - 1
    turns = cut(shards.withColumn("turn", F.floor(rank / open_shards)), "turns")
    blocks = F.ceil(F.sum("_n").over(Window.partitionBy("epoch", "turn")) / block)
    plan = turns.select(shard, "epoch", "turn", blocks.alias("_blocks"))
    dealt = rows.join(few(plan), shard).withColumn("_d", digest(seed, F.col("epoch"), F.col(key)))
    dealt = cut(dealt.withColumn("_block", F.floor(F.col("_d") / F.ceil(F.lit(1 << 4 * DIGITS) / F.col("_blocks")))), "dealt")
    sizes = dealt.groupBy("epoch", "turn", "_block").agg(F.count("*").alias("_rows"))
    before = sizes.select("epoch", "turn", "_block", (F.sum("_rows").over(Window.partitionBy("epoch").orderBy("turn", "_block")) - F.col("_rows")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("epoch", "turn", "_block").orderBy("_d", key))
    out = dealt.withColumn("_in", inside).join(few(cut(before, "before")), ["epoch", "turn", "_block"])
    return out.select(*rows.columns, "epoch", "turn", (F.col("_in") + F.col("_before") - 1).alias("position"))


def sample_with_replacement(rows: DataFrame, batch: int, size: int, seed: int, row_id: str = "index") -> DataFrame:
    """batch draws from the newest size rows of a densely numbered table."""
    n = rows.agg(F.max(row_id)).first()[0] + 1
    draws = rows.sparkSession.range(batch).select(F.col("id").alias("draw"), (F.lit(max(0, n - size)) + digest(seed, F.col("id")) % min(n, size)).alias(row_id))
    return draws.join(rows, row_id)


def eligible(frames: DataFrame, drop_last: int) -> Column:
    """False for the last drop_last frames of an episode."""
    w = Window.partitionBy("episode_index").orderBy(F.desc("frame_index"))
    return F.row_number().over(w) > drop_last


def sampling_weights(offline: DataFrame, online: DataFrame, online_ratio: float, drop_offline: int = 0, drop_online: int = 0) -> DataFrame:
    """(source, index, weight): uniform over eligible frames of each side, split by online_ratio, summing to 1; uniform over all where no frame is eligible."""
    sides = [f.select(F.lit(s).alias("source"), "index", eligible(f, d).alias("ok")) for s, f, d in (("offline", offline, drop_offline), ("online", online, drop_online))]
    rows = sides[0].unionByName(sides[1])
    counts = rows.groupBy("source").agg(F.count_if("ok").alias("n"))  # two rows
    share = F.when(F.col("source") == "online", online_ratio).otherwise(1 - online_ratio)
    raw = rows.join(few(cut(counts, "counts")), "source").withColumn("w", F.when(F.col("ok"), F.try_divide(share, F.col("n"))).otherwise(0.0))
    total = raw.agg(F.sum("w").alias("total"), F.count("*").alias("rows"))  # one row
    return raw.crossJoin(F.broadcast(total)).select("source", "index", F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(1 / F.col("rows")).alias("weight"))


def sample_count(length: Column, least: int = 100, most: int = 10_000, power: float = 0.75) -> Column:
    return F.greatest(F.least(F.lit(least), length), F.least(F.floor(F.pow(length.cast("double"), F.lit(power))).cast("long"), F.lit(most))).cast("long")


def evenly_spaced(length: Column, n: Column) -> Column:
    """n positions from 0 to length - 1, rounded half to even."""
    return F.when(n <= 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(1))), lambda i: F.bround(i * (length - 1) / (n - 1)).cast("long")))


def sample_per_episode(rows: DataFrame, fraction: float, seed: int, key: str = "frame_index") -> DataFrame:
    """max(1, floor(n * fraction)) rows of each episode without replacement."""
    w = Window.partitionBy("episode_index").orderBy(digest(seed, F.col("episode_index"), F.col(key)), key)
    n = F.count("*").over(Window.partitionBy("episode_index"))
    return rows.withColumn("_r", F.row_number().over(w)).withColumn("_n", n).where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * fraction))).drop("_r", "_n")


def newest(log: DataFrame, capacity: int, seq: str = "index") -> DataFrame:
    """The rows a ring of that capacity holds, from an append-only log numbered by seq."""
    last = log.agg(F.max(seq).alias("_last"))  # one row
    return log.crossJoin(F.broadcast(last)).where(F.col(seq) > F.col("_last") - capacity).drop("_last")


def coarse_to_fine(gap: int, frame: str = "frame_index") -> list[Column]:
    """Sort keys that take every gap-th frame first, then those one after, and so on."""
    return [F.col(frame) % gap, F.col(frame)]
