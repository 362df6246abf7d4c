"""Quantiles of few large groups, without a buffer of a group's values: exact ones, and sketches that can be stored and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Buckets for each factor of e: a bucket holds the values within 0.4 % of each other.
STEPS = 256
#: Buckets of positive numbers begin here, those of negative ones end at minus this.
MIDDLE = 1 << 20


def bucket(v: Column) -> Column:
    """A number that never falls as v rises; NaN is the largest value."""
    size = F.floor(F.log(F.abs(v)) * STEPS) + MIDDLE
    return F.when(F.isnan(v), F.lit(1 << 40)).when(v == 0, F.lit(0)).when(F.abs(v) == float("inf"), F.signum(v).cast("long") * (1 << 30)).otherwise(F.signum(v).cast("long") * size).cast("long")


def exact_quantiles(values: DataFrame, v: str, quantiles: dict[str, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for each key with the linearly interpolated quantiles of v as columns by name; nulls are left out.

    First values are counted by bucket, which tells the bucket of each rank that is asked for; then the values of those buckets
    alone are counted one by one. Both counts are combined before they are shuffled, a group's buckets are some thousands
    however many rows it has, and a bucket of many distinct values is sorted by itself. values is read twice: cut it first if
    it is dear. A table without keys gives one row, also when it is empty.
    """
    rows = values.select(*keys, F.col(v).cast("double").alias("_v")).where("_v is not null").withColumn("_b", bucket(F.col("_v")))
    by = list(keys)
    buckets = rows.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)  # some thousands of buckets
    placed = buckets.select(*by, "_b", "_n", (F.sum("_n").over(w.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_total"))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("_total") - 1) * q).alias("at")) for name, q in quantiles.items()])
    asked = placed.withColumn("_q", F.explode(ranks)).withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_q.at"), F.ceil("_q.at")))))
    asked = asked.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n"))).select(*by, "_b", "_before", "_q.name", "_q.at", "_rank")
    wanted = asked.select(*by, "_b").distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*by, "_b")]

    def joined(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        condition = same[0]
        for s in same[1:]:
            condition = condition & s
        return left.join(right.withColumnsRenamed({k: f"_k_{k}" for k in (*by, "_b")}), condition, how)

    inside = joined(rows, wanted, "left_semi").groupBy(*by, "_b", "_v").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by, "_b").orderBy("_v"))
    inside = inside.withColumn("_high", upto).withColumn("_low", F.col("_high") - F.col("_c"))
    found = joined(inside, asked).where((F.col("_rank") - F.col("_before") >= F.col("_low")) & (F.col("_rank") - F.col("_before") < F.col("_high")))
    share = F.when(F.col("_rank") == F.col("at"), 1.0).when(F.col("_rank") < F.col("at"), F.col("_rank") + 1 - F.col("at")).otherwise(F.col("at") + 1 - F.col("_rank"))
    return found.groupBy(*by).agg(*[F.sum(F.when(F.col("name") == name, F.col("_v") * share)).alias(name) for name in quantiles])


#: A sketch: how many values are in each bucket, by bucket. Values of a bucket are at most 1 / STEPS of their size apart.
SKETCH = "array<struct<bucket: bigint, n: bigint>>"
#: The quantiles of a sketch are off by so much of their size at most.
SKETCH_ERROR = 0.5 / STEPS


def sketches(values: DataFrame, v: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, sketch): a sketch of v for each key; nulls and NaN are left out. A sketch has some thousands of buckets at most."""
    rows = values.where(F.col(v).isNotNull() & ~F.isnan(v)).groupBy(*keys, bucket(F.col(v)).alias("bucket")).agg(F.count("*").alias("n"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("sketch"))


def merged_sketches(parts: DataFrame, keys: tuple[str, ...], sketch: str = "sketch") -> DataFrame:
    """(keys, sketch) of all values that the parts' sketches count; null where a part has none."""
    whole = parts.groupBy(*keys).agg(F.bool_and(F.col(sketch).isNotNull()).alias("_all")).where("_all").drop("_all")
    counted = parts.select(*keys, F.inline(sketch)).groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    return counted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("sketch")).join(whole, list(keys), "left_semi")


def sketch_quantile(sketch: Column, q: float) -> Column:
    """The linearly interpolated quantile; each value stands for the middle of its bucket."""

    def at(rank: Column) -> Column:
        reached = F.aggregate(sketch, F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("found")), lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["found"], F.when(a["seen"] + x["n"] > rank, x["bucket"])).alias("found")), lambda a: a["found"])
        size = F.exp((F.abs(reached) - MIDDLE + 0.5) / STEPS)
        return F.when(reached == 0, 0.0).when(F.abs(reached) == (1 << 30), F.signum(reached) * float("inf")).otherwise(F.signum(reached) * size)

    rank = (F.aggregate(sketch, F.lit(0).cast("long"), lambda a, x: a + x["n"]) - 1) * q
    low, high = at(F.floor(rank)), at(F.ceil(rank))
    return F.when(low == high, low).otherwise(low + (high - low) * (rank - F.floor(rank)))
