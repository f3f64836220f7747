"""Marking and reporting of rows whose texts repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stripped(field: str):
    return F.coalesce(F.regexp_replace(field, r"(?U)^\s+|\s+$", ""), F.lit(""))


def text_counts(df: DataFrame, *fields: str) -> DataFrame:
    """The rows with ``<field>_copies``: how many rows have the same stripped text.

    Texts are counted by their digest, and only digests that repeat are joined back, so a row
    is not moved for a text that stands once, nor a text carried through a shuffle; nulls
    count as empty texts.
    """
    out = df
    for f in fields:
        mark = F.unhex(F.sha2(_stripped(f), 256))
        counts = df.groupBy(mark.alias(f"_{f}_mark")).agg(F.count(F.lit(1)).alias(f"{f}_copies")).filter(f"{f}_copies > 1")
        out = out.withColumn(f"_{f}_mark", mark).join(counts, f"_{f}_mark", "left").drop(f"_{f}_mark").withColumn(f"{f}_copies", F.coalesce(f"{f}_copies", F.lit(1)).cast("bigint"))
    return out


def mark_duplicates(df: DataFrame, *fields: str) -> DataFrame:
    """The rows with ``validation``: true where every field's stripped text is unique."""
    counted = text_counts(df, *fields)
    unique = F.lit(True)
    for f in fields:
        unique = unique & (F.col(f"{f}_copies") == 1)
    return counted.withColumn("validation", unique).drop(*[f"{f}_copies" for f in fields])


def unique_items(df: DataFrame, *fields: str) -> DataFrame:
    """The rows a first-seen filter keeps after marking: those whose texts are unique."""
    return mark_duplicates(df, *fields).filter("validation").drop("validation")


def duplicate_summary(df: DataFrame, *fields: str) -> DataFrame:
    """One row per field and one for ``either``: items, validated ones (unique in every field),
    unique ones, duplicates, groups of duplicates (null for ``either``), ratio."""
    counted = text_counts(df, *fields)
    either, valid = F.lit(False), F.lit(True)
    for f in fields:
        either, valid = either | (F.col(f"{f}_copies") > 1), valid & (F.col(f"{f}_copies") == 1)
    one = lambda name, copies: F.struct(F.lit(name).alias("field"), copies.alias("copies"), valid.alias("valid"))
    long = counted.select(F.explode(F.array(*[one(f, F.col(f"{f}_copies")) for f in fields], one("either", F.when(either, 2).otherwise(1).cast("bigint")))).alias("x")).select("x.*")
    n, more = F.sum("k"), F.col("copies") > 1
    # groups of equal size are as many as their rows divided by the size
    sized = long.groupBy("field", "copies", "valid").agg(F.count(F.lit(1)).alias("k"))
    groups = F.when(F.col("field") != "either", F.sum(F.when(more, F.col("k") / F.col("copies")).otherwise(0)).cast("bigint"))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("k"))), F.lit(0)).cast("bigint")
    return sized.groupBy("field").agg(
        n.alias("n_items"), total(F.col("valid")).alias("n_validated"), total(~more).alias("n_unique"), total(more).alias("n_duplicates"), groups.alias("n_groups"), F.round(total(more) / n, 6).alias("ratio")
    )


def duplicate_groups(df: DataFrame, key: str, field: str) -> DataFrame:
    """``text_hash, n_items, first_key``: each stripped text that several rows share."""
    groups = df.select(_stripped(field).alias("text"), F.col(key).alias("k")).groupBy(F.md5("text").alias("text_hash")).agg(F.count(F.lit(1)).alias("n_items"), F.min("k").alias("first_key"))
    return groups.filter("n_items > 1")


def duplicate_members(df: DataFrame, key: str, field: str, *fields: str) -> DataFrame:
    """``text_hash, key, validation``: the rows of each group, a row each (a group may be any size)."""
    counted = text_counts(df, *fields)
    valid = F.lit(True)
    for f in fields:
        valid = valid & (F.col(f"{f}_copies") == 1)
    return counted.filter(F.col(f"{field}_copies") > 1).select(F.md5(_stripped(field)).alias("text_hash"), F.col(key).alias("key"), valid.alias("validation"))


def repeated_only_in(df: DataFrame, field: str, other: str) -> DataFrame:
    """The rows that repeat in ``field`` or ``other`` and whose ``other`` is unique among these."""
    again = mark_duplicates(df, field, other).filter("not validation")
    return text_counts(again, other).filter(f"{other}_copies = 1").drop(f"{other}_copies", "validation")


def duplicate_flags(df: DataFrame, *fields: str) -> DataFrame:
    """The rows that repeat in any field, with ``is_<field>_duplicate`` of each."""
    counted = text_counts(df, *fields)
    flags = [F.col(f"{f}_copies") > 1 for f in fields]
    out = counted
    for f, flag in zip(fields, flags):
        out = out.withColumn(f"is_{f}_duplicate", flag)
    return out.filter(" or ".join(f"is_{f}_duplicate" for f in fields)).drop(*[f"{f}_copies" for f in fields])


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, the same for the same seed (all if there are fewer)."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), key).limit(n)
