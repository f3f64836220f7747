"""Queries of the operators on training text, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import charforms, copies, encodings, leakage, residue, splits, tokens

RATIOS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.related_parents(table(spark, folder, "oeb_texto"), "parent_key", "item_key")


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The component of each row: the smallest parent joined to it, else its item or itself."""
    groups = splits.record_groups(table(spark, folder, "oeb_texto"), "id", "parent_key", "item_key", F.col("ud"))
    return groups.select(F.col("record_id").alias("id"), "component")


def p1_splits(spark: SparkSession, folder: str) -> DataFrame:
    groups = splits.record_groups(table(spark, folder, "oeb_texto"), "id", "parent_key", "item_key", F.col("ud"))
    return splits.grouped_splits(groups, RATIOS).select(F.col("record_id").alias("id"), "split")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copy_sets(table(spark, folder, "items"), "item_id", "resumen", "texto", singletons=False).withColumnRenamed("record_id", "item_id")


def p3_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    return copies.copy_sets(table(spark, folder, "items"), "item_id", "resumen", "texto").withColumnRenamed("record_id", "item_id")


def _values(spark: SparkSession, folder: str) -> DataFrame:
    """``field, row_id, value``: the texts that problem 6 names, each table read once."""
    pair = lambda field, column: F.struct(F.lit(field).alias("field"), F.col(column).alias("value"))
    items = table(spark, folder, "items").select(F.col("item_id").alias("row_id"), F.explode(F.array(pair("items.texto", "texto"), pair("items.resumen", "resumen"))).alias("x"))
    concepts = table(spark, folder, "concepts").select(F.lit("concepts.summary").alias("field"), F.col("line_no").alias("row_id"), F.col("summary").alias("value"))
    return items.select("x.field", "row_id", "x.value").unionByName(concepts).filter("value is not null")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return encodings.misread(_values(spark, folder), ["field", "row_id"], "value", restore=False).select("field", "row_id")


def p6_restored(spark: SparkSession, folder: str) -> DataFrame:
    return encodings.misread(_values(spark, folder), ["field", "row_id"], "value")


def _residue(spark: SparkSession, folder: str) -> DataFrame:
    pair = lambda column: F.struct(F.lit(column).alias("field"), F.col(column).alias("value"))
    values = table(spark, folder, "items").select("item_id", F.explode(F.array(pair("resumen"), pair("texto"))).alias("x")).select("item_id", "x.field", "x.value").filter("value is not null")
    # 40 shared families at every scale: the field names that placeholders mention
    names = sorted(r[0] for r in table(spark, folder, "families").select(F.explode("params.name")).distinct().collect() if r[0])
    return residue.residue(values, ["item_id", "field"], "value", names)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _residue(spark, folder).select("item_id", "field")


def p7_excluded(spark: SparkSession, folder: str) -> DataFrame:
    """The values to drop whole: residue covers half of them or more."""
    return _residue(spark, folder).filter("coverage >= 0.5").select("item_id", "field", "kind")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encoded(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("record_id", "doc_id")


def _leaks(spark: SparkSession, folder: str, **how) -> DataFrame:
    return leakage.matches(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_passages"), "passage_id", "text", **how)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "passage_id")


def p9_near(spark: SparkSession, folder: str) -> DataFrame:
    """Proximity matches: up to two differing words between agreeing stretches."""
    return _leaks(spark, folder, gap=2)


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = charforms.lookalike_pairs(table(spark, folder, "documents"), "doc_id", "text")
    return pairs.select(F.col("record_a").alias("doc_a"), F.col("record_b").alias("doc_b"))


def p10_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each document of a look stored in several ways, with its class."""
    return charforms.lookalike_classes(table(spark, folder, "documents"), "doc_id", "text").select(F.col("record_id").alias("doc_id"), "class_id")


def p10_forms(spark: SparkSession, folder: str) -> DataFrame:
    return charforms.normalized(table(spark, folder, "documents").select("doc_id", "text"), "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p1_splits, p3_found, p3_collapsed, p6_found, p6_restored, p7_found, p7_excluded, p8_ids, p9_found, p9_near, p10_found, p10_classes, p10_forms)}

_CANON = r"array_to_string(list_transform(list_filter(range(1, length({s}) + 1), lambda i: regexp_matches(substr({s}, i, 1), '[\p{{L}}\p{{M}}\p{{N}}]') OR (NOT regexp_matches(substr({s}, i, 1), '[\s\p{{Z}}_]') AND i > 1 AND substr({s}, i - 1, 1) BETWEEN '0' AND '9' AND substr({s}, i + 1, 1) BETWEEN '0' AND '9')), lambda i: substr({s}, i, 1)), '')"

_COPIES = f"""
WITH f AS (
  SELECT item_id, lower(resumen) AS r, unnest(regexp_split_to_array(lower(texto), '[\\n\\r;]')) AS x FROM items WHERE resumen IS NOT NULL AND texto IS NOT NULL
), k AS (
  SELECT item_id, any_value({_CANON.format(s="r")}) AS r, list_sort(list_filter(list({_CANON.format(s="x")}), lambda y: y <> '')) AS t FROM f GROUP BY item_id
), real AS (
  SELECT * FROM k WHERE r <> '' AND len(t) > 0
)
"""

SQL = {
    "p1_found": """
WITH RECURSIVE e AS (
  SELECT DISTINCT a.parent_key AS x, b.parent_key AS y FROM oeb_texto a JOIN oeb_texto b USING (item_key) WHERE a.parent_key <> b.parent_key
), r AS (
  SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
)
SELECT x AS parent_a, y AS parent_b FROM r WHERE x < y
""",
    "p1_groups": """
WITH RECURSIVE e AS (
  SELECT DISTINCT a.parent_key AS x, b.parent_key AS y FROM oeb_texto a JOIN oeb_texto b USING (item_key) WHERE a.parent_key <> b.parent_key
), r AS (
  SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
), low AS (SELECT x, least(x, min(y)) AS root FROM r GROUP BY x),
q AS (SELECT item_key, min(parent_key) AS p FROM oeb_texto WHERE parent_key IS NOT NULL AND item_key IS NOT NULL GROUP BY item_key)
SELECT o.id, coalesce('p:' || coalesce(low.root, coalesce(o.parent_key, q.p)), 'i:' || o.item_key, 'r:' || o.id) AS component
FROM oeb_texto o LEFT JOIN q ON o.parent_key IS NULL AND q.item_key = o.item_key LEFT JOIN low ON low.x = coalesce(o.parent_key, q.p)
""",
    "p3_found": _COPIES + "SELECT min(item_id) AS item_id, count(*) AS n_copies FROM real GROUP BY r, t HAVING count(*) > 1",
    "p3_collapsed": _COPIES + "SELECT min(item_id) AS item_id, count(*) AS n_copies FROM real GROUP BY r, t UNION ALL SELECT item_id, 1 FROM items WHERE item_id NOT IN (SELECT item_id FROM real)",
}
