"""Ranking metrics with one relevant item per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_hits(rankings: DataFrame, queries: DataFrame, relevant: Column, k: int | None = None) -> DataFrame:
    """``query, hit, n_retrieved``: the best rank of a relevant document (null without one).

    Every row of ``queries`` (column ``query`` and what ``relevant`` needs) gives a row.
    """
    shown = rankings if k is None else rankings.filter(F.col("rank") <= k)
    joined = queries.join(shown, "query", "left")
    return joined.groupBy("query").agg(F.min(F.when(relevant, F.col("rank"))).alias("hit"), F.count("rank").alias("n_retrieved"))


def overall(hits: DataFrame) -> DataFrame:
    """Recall, precision over all retrieved, F1, MRR and MAP (null without queries)."""
    n, found, shown = F.count(F.lit(1)), F.count("hit"), F.sum("n_retrieved")
    mrr = F.try_divide(F.coalesce(F.sum(1 / F.col("hit")), F.lit(0.0)), n)
    rows = hits.agg(F.try_divide(found, n).alias("recall"), F.try_divide(found, shown).alias("precision"), mrr.alias("mrr"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return rows.select(*[F.round(c, 6).alias(c) for c in ("recall", "precision")], F.round(f1, 6).alias("f1"), F.round("mrr", 6).alias("mrr"), F.round("mrr", 6).alias("map"))


def single_match(hits: DataFrame, upper_median: bool = False) -> DataFrame:
    """Success@k, MRR, mean and median position of hits and the share of perfect matches.

    ``upper_median`` takes the upper of two middle positions, as the prefix metric does.  All
    come from the number of queries at each position, of which there are few.
    """
    at = hits.groupBy("hit").agg(F.count(F.lit(1)).alias("c"))
    n, found = F.sum("c"), F.coalesce(F.sum(F.when(F.col("hit").isNotNull(), F.col("c"))), F.lit(0))
    rows = at.agg(n.alias("n"), found.alias("found"), F.sum(F.col("c") / F.col("hit")).alias("inverse"), F.sum(F.col("c") * F.col("hit")).alias("total"), F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("c"))), F.lit(0)).alias("first"), F.array_sort(F.collect_list(F.when(F.col("hit").isNotNull(), F.struct("hit", "c")))).alias("places"))

    def position(rank: Column) -> Column:
        """The position of the hit of a rank (from 0) in order."""
        start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("hit"))
        step = lambda a, x: F.struct((a["seen"] + x["c"]).alias("seen"), F.when(a["hit"].isNotNull(), a["hit"]).when(a["seen"] + x["c"] > rank, x["hit"].cast("double")).alias("hit"))
        return F.aggregate("places", start, step)["hit"]

    upper = position(F.floor(F.col("found") / 2))
    middle = upper if upper_median else (upper + position(F.floor((F.col("found") - 1) / 2))) / 2
    return rows.select(
        F.round(F.try_divide("found", "n"), 6).alias("success"), F.round(F.try_divide(F.coalesce("inverse", F.lit(0.0)), "n"), 6).alias("mrr"), F.round(F.try_divide("total", "found"), 6).alias("mean_position"), middle.alias("median_position"), F.round(F.try_divide("first", "n"), 6).alias("perfect"),
    )


def position_distribution(hits: DataFrame, k: int) -> DataFrame:
    """``position, share`` for positions 1..k; the shares sum to Success@k."""
    spark = hits.sparkSession
    total = hits.agg(F.count(F.lit(1)).alias("n"))
    counts = hits.filter("hit is not null").groupBy(F.col("hit").cast("bigint").alias("position")).agg(F.count(F.lit(1)).alias("c"))
    # k and one rows: both sides are bounded
    return spark.range(1, k + 1).withColumnRenamed("id", "position").join(counts, "position", "left").join(F.broadcast(total)).select("position", F.round(F.try_divide(F.coalesce("c", F.lit(0)), F.col("n")), 6).alias("share"))
