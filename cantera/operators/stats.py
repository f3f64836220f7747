"""Word statistics of text fields and parameter statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import space_words


def field_stats(df: DataFrame, *fields: str) -> DataFrame:
    """``field, n_texts, total_words, vocabulary, max_words, mean_words`` of each field.

    Fields are unpivoted first, so the table is read once; nulls are no texts, and a field
    without texts has zeros.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("x")).select("x.*")
    words = long.filter("text is not null").select("field", space_words(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    sizes = words.groupBy("field").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("total_words"), F.max("n").alias("max_words"), F.avg("n").alias("mean_words"))
    vocabulary = words.select("field", F.explode("words").alias("word")).distinct().groupBy("field").agg(F.count(F.lit(1)).alias("vocabulary"))
    zero = F.lit(0)
    return sizes.join(vocabulary, "field", "left").select("field", "n_texts", "total_words", F.coalesce("vocabulary", zero).alias("vocabulary"), "max_words", "mean_words")


def vocabulary(df: DataFrame, field: str) -> DataFrame:
    """``word``: the distinct words of a field."""
    return df.select(F.explode(space_words(F.col(field))).alias("word")).distinct()


def parameter_rows(df: DataFrame, key: str, parameters: str) -> DataFrame:
    """``item_key, parameter_key, parameter_label, value_label, value`` from a map of parameters."""
    entry = df.select(F.col(key).alias("item_key"), F.explode(parameters).alias("parameter_key", "p"))
    return entry.select("item_key", "parameter_key", F.col("p.label").alias("parameter_label"), F.explode("p.values").alias("v")).select(
        "item_key", "parameter_key", "parameter_label", F.col("v.label").alias("value_label"), F.col("v.value").alias("value")
    )


def parameter_stats(rows: DataFrame) -> DataFrame:
    """Counts and word lengths of parameter labels and values, as one row."""
    value, label = F.size(space_words(F.col("value"))), F.size(space_words(F.col("parameter_label")))
    return rows.agg(
        F.count(F.lit(1)).alias("n_parameters"), F.count_distinct("parameter_label").alias("n_labels"), F.max(value).alias("max_value_words"), F.avg(value).alias("mean_value_words"), F.max(label).alias("max_label_words"), F.avg(label).alias("mean_label_words"),
    )


def option_counts(df: DataFrame, parameters: str) -> DataFrame:
    """The rows with the sizes of their option lists and the number of combinations."""
    sizes = F.transform(parameters, lambda p: F.size(p["options"]))
    return df.withColumn("option_counts", sizes).withColumn("n_combinations", F.aggregate(sizes, F.lit(1).cast("bigint"), lambda a, x: a * x))


def parent_counts(df: DataFrame, parent: str) -> DataFrame:
    """``n_items, n_parents`` as one row (null is no parent)."""
    return df.agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct(parent).alias("n_parents"))


def item_parameters(df: DataFrame, key: str, parameters: str) -> DataFrame:
    """``key, n_parameters, n_values``: parameters of each item and their values in all."""
    size = F.aggregate(F.map_values(parameters), F.lit(0), lambda a, p: a + F.coalesce(F.size(p["values"]), F.lit(0)))
    return df.select(F.col(key).alias("key"), F.coalesce(F.size(F.map_keys(parameters)), F.lit(0)).alias("n_parameters"), F.coalesce(size, F.lit(0)).alias("n_values"))
