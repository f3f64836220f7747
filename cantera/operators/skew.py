"""Per-key results when a few keys hold most rows: compress to (key, value, n) first.

Both shuffles carry map-side combined rows, so a key with a third of all rows sends at most
one row per task and distinct value.  Distinct counts, modes and percentiles are then exact
functions of the weighted values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def compress(df: DataFrame, key: Column | str, value: Column | str) -> DataFrame:
    """``key_value, item, n``: how often each value stands under each non-null key."""
    key = F.col(key) if isinstance(key, str) else key
    value = F.col(value) if isinstance(value, str) else value
    return df.select(key.alias("key_value"), value.alias("item")).filter("key_value is not null").groupBy("key_value", "item").agg(F.count(F.lit(1)).alias("n"))


def key_counts(weighted: DataFrame) -> DataFrame:
    """``key_value, n_rows, n_distinct`` (null values count as rows, not as values)."""
    return weighted.groupBy("key_value").agg(F.sum("n").alias("n_rows"), F.count("item").alias("n_distinct"))


def key_modes(weighted: DataFrame) -> DataFrame:
    """``key_value, mode, mode_n``: the commonest non-null value, the smallest among ties."""
    found = weighted.filter("item is not null").groupBy("key_value")
    return found.agg(F.min_by("item", F.struct(-F.col("n"), "item")).alias("mode"), F.max("n").alias("mode_n"))


def key_percentiles(weighted: DataFrame, fractions: list[float]) -> DataFrame:
    """``key_value, fraction, item``: exact discrete percentiles (smallest value whose share
    of the key's rows reaches the fraction) of the non-null values.

    The weighted values are range-partitioned by (key, value), so a hot key spans several
    tasks; totals per key and partition are prefix-summed and added to the running sums
    within each partition.
    """
    ranged = weighted.filter("item is not null").repartitionByRange("key_value", "item").withColumn("part", F.spark_partition_id())
    ranged = cut(ranged)
    totals = ranged.groupBy("key_value", "part").agg(F.sum("n").alias("part_n"))
    every = Window.partitionBy("key_value")
    before = totals.select("key_value", "part", (F.sum("part_n").over(every.orderBy("part")) - F.col("part_n")).alias("before"), F.sum("part_n").over(every).alias("total"))
    run = Window.partitionBy("key_value", "part").orderBy("item").rowsBetween(Window.unboundedPreceding, 0)
    upto = ranged.withColumn("run", F.sum("n").over(run)).join(before, ["key_value", "part"]).withColumn("upto", F.col("run") + F.col("before"))
    picked = upto.select("key_value", "item", "n", "upto", "total", F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction"))
    rank = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("fraction") * F.col("total")))
    return picked.filter((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank)).select("key_value", "fraction", "item")
