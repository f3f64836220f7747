"""Items in the older JSON form: one object keyed by code, parameters as a map of choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import expand

ITEM = "struct<parent_key:string,ud:string,concept:string,resumen:string,texto:string,parameters:map<string,struct<label:string,values:array<struct<label:string,value:string>>>>>"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """``item_key`` and the members of each object of the files at a path; absent ones are null."""
    whole = spark.read.text(path, wholetext=True)
    each = whole.select(F.explode(F.from_json("value", f"map<string,{ITEM}>")).alias("item_key", "x"))
    return each.select("item_key", "x.*")


def derived_only(rows: DataFrame) -> DataFrame:
    """The rows that are variants: those whose key is not their parent's."""
    return rows.filter(F.col("item_key") != F.col("parent_key"))


def variants(rows: DataFrame) -> DataFrame:
    """Templates to variants: a row per combination of values, the last parameter fastest.

    A variant's key is the template's without its last character and the labels chosen; each
    of its parameters keeps the one value.  A row without parameters passes through with its
    concept as both texts.  Of rows with the same key the last combination wins.
    """
    has = F.coalesce(F.size("parameters"), F.lit(0)) > 0
    names, choices = F.map_keys("parameters"), F.map_values("parameters")
    sized = rows.filter(has).withColumn("_counts", F.transform(choices, lambda p: F.size(p["values"])))
    chosen = expand.combinations(sized, "_counts")
    picked = F.transform(F.arrays_zip(choices.alias("p"), F.col("selection").alias("s")), lambda z: F.struct(z["p"]["label"].alias("label"), F.array(F.element_at(z["p"]["values"], z["s"])).alias("values")))
    labels = F.array_join(F.transform(picked, lambda p: p["values"][0]["label"]), "")
    stem = F.expr("substring(item_key, 1, length(item_key) - 1)")
    made = chosen.select(F.concat(stem, labels).alias("item_key"), F.col("item_key").alias("parent_key"), "ud", "concept", "resumen", "texto", F.map_from_arrays(names, picked).alias("parameters"), "ordinal")
    plain = rows.filter(~has).select("item_key", F.col("item_key").alias("parent_key"), "ud", "concept", F.col("concept").alias("resumen"), F.col("concept").alias("texto"), "parameters", F.lit(0).cast("bigint").alias("ordinal"))
    every = made.unionByName(plain)
    fields = [c for c in every.columns if c not in ("item_key", "ordinal")]
    last = every.groupBy("item_key").agg(F.max_by(F.struct(*fields), F.struct("ordinal", "parent_key")).alias("x"))
    return last.select("item_key", "x.*")
