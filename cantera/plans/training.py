"""Queries p2, p4 and p5 over the driver's tables, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy, nested, skew
from ..session import cut, table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.node_paths(hierarchy.chapter_links(table(spark, folder, "decompositions")))


def p2_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.chapter_links(table(spark, folder, "decompositions")))


def p2_items(spark: SparkSession, folder: str) -> DataFrame:
    """How many items hang below each chapter by their own ``chapter_path``, directly or not
    (``p2_hanging`` also counts by ``parent_key``).

    Each item names its whole path, so the links are its neighbours; one item counts once for
    each of its chapters.
    """
    items = table(spark, folder, "items").select("item_id", F.explode(F.array_distinct(F.transform("chapter_path", hierarchy.clean_key))).alias("node_key"))
    return items.filter("node_key <> ''").groupBy("node_key").agg(F.count(F.lit(1)).alias("n_items"))


def p2_item_places(spark: SparkSession, folder: str) -> DataFrame:
    """The node that each item's ``parent_key`` names, with its root, depth and path."""
    items = table(spark, folder, "items").select("item_id", hierarchy.clean_key(F.col("parent_key")).alias("node_key"))
    return p2_found(spark, folder).join(items, "node_key").select("item_id", "node_key", "root_key", "depth", "node_path")


def p2_hanging(spark: SparkSession, folder: str) -> DataFrame:
    """How many items hang at or below each node: by ``parent_key``, which may be any node of the
    chapter trees and brings the nodes above it, and by ``chapter_path``; an item counts once
    for each of its nodes.

    Items of one parent and one path count as one group, so a common parent is one row.
    """
    links = hierarchy.chapter_links(table(spark, folder, "decompositions"))
    paths = F.coalesce(F.transform("chapter_path", hierarchy.clean_key), F.array().cast("array<string>"))
    keys = F.array_sort(F.array_distinct(F.filter(paths, lambda k: k != "")))
    items = table(spark, folder, "items").select(hierarchy.clean_key(F.col("parent_key")).alias("at"), keys.alias("path"))
    groups = cut(items.groupBy("at", "path").agg(F.count(F.lit(1)).alias("n")))
    chains, cyclic = hierarchy.decompose(links)
    loose = cyclic.select(F.col("node_key").alias("at"), F.array("node_key").alias("upward"))
    upward = hierarchy.placed(chains).select(F.col("node_key").alias("at"), "upward").unionByName(loose)
    nodes = F.array_union("path", F.coalesce("upward", F.array().cast("array<string>")))
    return groups.join(upward, "at", "left").select("n", F.explode(nodes).alias("node_key")).groupBy("node_key").agg(F.sum("n").alias("n_items"))


def _weighted(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "items": skew.compress(table(spark, folder, "items"), "family", "code"),
        "oeb_texto": skew.compress(table(spark, folder, "oeb_texto"), "parent_key", "item_key"),
    }


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    found = [skew.key_counts(w).select(F.lit(name).alias("table_name"), "key_value", "n_rows", F.col("n_distinct").alias("n_codes")) for name, w in _weighted(spark, folder).items()]
    return found[0].unionByName(found[1])


def p4_modes(spark: SparkSession, folder: str) -> DataFrame:
    found = [skew.key_modes(w).select(F.lit(name).alias("table_name"), "key_value", F.col("mode").alias("mode_code"), "mode_n") for name, w in _weighted(spark, folder).items()]
    return found[0].unionByName(found[1])


def p4_price_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    prices = skew.compress(table(spark, folder, "items"), "family", "price")
    return skew.key_percentiles(prices, [0.25, 0.5, 0.9]).select("key_value", "fraction", F.col("item").alias("price"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.json_links(table(spark, folder, "raw_items"), "raw_id", "payload").withColumnRenamed("record_id", "raw_id")


def p5_schema(spark: SparkSession, folder: str) -> DataFrame:
    return nested.merged_schema(nested.json_objects(table(spark, folder, "raw_items"), "raw_id", "payload"))


#: The levels of ``raw_items.payload`` and their object paths, both shapes and every depth as one.
_LEVELS = {
    "records": r"^$",
    "lines": r"^decomposition\[\](\.decomposition\[\])*$",
    "parameters": r"^parameters(\[\]|\.[^.\[]+)$",
    "values": r"^parameters(\[\]|\.[^.\[]+)\.values\[\]$",
    "quotes": r"^(decomposition\[\]\.)+supplier_quotes\[\]$",
    "steps": r"^(decomposition\[\]\.)+supplier_quotes\[\]\.steps\[\]$",
}
#: Whatever lies at other paths (aliases and their names, runs and tools, objects that only hold others).
_OTHERS = "others"


def _level(spark: SparkSession, folder: str, level: str) -> DataFrame:
    """One level of the payloads as a typed table with all members of the merged schema."""
    objects = nested.json_objects(table(spark, folder, "raw_items"), "raw_id", "payload")
    named = F.lit(_OTHERS)
    for name, paths in _LEVELS.items():
        named = F.when(F.col("table_path").rlike(paths), name).otherwise(named)
    own = cut(objects.withColumn("table_path", named).filter(F.col("table_path") == level))
    found = nested.child_tables(own).get(level)
    if found is None:
        found = nested.child_table(own, level, [])
    return found.withColumnRenamed("record_id", "raw_id")


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    return _level(spark, folder, "records")


def p5_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The decomposition lines of every depth as one typed table with their parents."""
    return _level(spark, folder, "lines")


def p5_parameters(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters of both shapes; those keyed by letter have the letter at the end of ``obj_path``."""
    return _level(spark, folder, "parameters")


def p5_values(spark: SparkSession, folder: str) -> DataFrame:
    return _level(spark, folder, "values")


def p5_quotes(spark: SparkSession, folder: str) -> DataFrame:
    return _level(spark, folder, "quotes")


def p5_steps(spark: SparkSession, folder: str) -> DataFrame:
    return _level(spark, folder, "steps")


def p5_others(spark: SparkSession, folder: str) -> DataFrame:
    """The objects of all other paths; a member that an object lacks is null."""
    return _level(spark, folder, _OTHERS)


def p5_item_parameters(spark: SparkSession, folder: str) -> DataFrame:
    return nested.explode_nested(table(spark, folder, "items").select("item_id", "parameters"), "item_id")["parameters"].drop("parent_ord").withColumnRenamed("record_id", "item_id")


def p5_item_lines(spark: SparkSession, folder: str) -> DataFrame:
    return nested.explode_nested(table(spark, folder, "items").select("item_id", "decomposition"), "item_id")["decomposition"].drop("parent_ord").withColumnRenamed("record_id", "item_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_descendants, p2_items, p2_item_places, p2_hanging, p4_found, p4_modes, p4_price_percentiles, p5_found, p5_schema, p5_records, p5_lines, p5_parameters, p5_values, p5_quotes, p5_steps, p5_others, p5_item_parameters, p5_item_lines)}

_LINKS = r"""
WITH RECURSIVE raw AS (
  SELECT regexp_replace(trim(child), '[#\s]+$', '') AS node_key, regexp_replace(trim(parent), '[#\s]+$', '') AS parent_key, line_no
  FROM decompositions WHERE rtrim(parent) LIKE '%#'
), links AS (
  SELECT node_key, arg_min(parent_key, line_no) AS parent_key FROM raw WHERE node_key <> '' AND parent_key <> '' GROUP BY node_key
), nodes AS (
  SELECT node_key FROM links UNION SELECT parent_key FROM links
), tree AS (
  SELECT node_key, node_key AS root_key, 0 AS depth, node_key AS node_path FROM nodes WHERE node_key NOT IN (SELECT node_key FROM links)
  UNION ALL
  SELECT l.node_key, t.root_key, t.depth + 1, t.node_path || '/' || l.node_key FROM links l JOIN tree t ON l.parent_key = t.node_key
)
"""

SQL = {
    "p2_found": _LINKS
    + """, loose AS (
  SELECT node_key FROM nodes WHERE node_key NOT IN (SELECT node_key FROM tree)
), walk AS (
  SELECT node_key, parent_key AS upper_key FROM links WHERE node_key IN (SELECT node_key FROM loose)
  UNION
  SELECT w.node_key, l.parent_key FROM walk w JOIN links l ON l.node_key = w.upper_key
), ring AS (
  SELECT DISTINCT node_key FROM walk WHERE node_key = upper_key
)
SELECT node_key, root_key, depth, node_path FROM tree
UNION ALL
SELECT node_key, '', CASE WHEN node_key IN (SELECT node_key FROM ring) THEN -1 ELSE -2 END, '' FROM loose
""",
    "p2_descendants": _LINKS
    + """, down AS (
  SELECT l.parent_key AS node_key, l.node_key AS descendant_key, 1 AS distance FROM links l WHERE l.node_key IN (SELECT node_key FROM tree)
  UNION ALL
  SELECT d.node_key, l.node_key, d.distance + 1 FROM down d JOIN links l ON l.parent_key = d.descendant_key
)
SELECT node_key, descendant_key, distance FROM down
""",
    "p2_items": r"""
SELECT node_key, count(*) AS n_items FROM (
  SELECT DISTINCT item_id, regexp_replace(trim(c), '[#\s]+$', '') AS node_key FROM items, unnest(chapter_path) AS u(c)
) WHERE node_key <> '' GROUP BY node_key
""",
    "p4_found": """
SELECT 'items' AS table_name, family AS key_value, count(*) AS n_rows, count(DISTINCT code) AS n_codes FROM items WHERE family IS NOT NULL GROUP BY family
UNION ALL
SELECT 'oeb_texto', parent_key, count(*), count(DISTINCT item_key) FROM oeb_texto WHERE parent_key IS NOT NULL GROUP BY parent_key
""",
    "p4_modes": """
WITH w AS (
  SELECT 'items' AS table_name, family AS key_value, code AS v, count(*) AS n FROM items WHERE family IS NOT NULL AND code IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT 'oeb_texto', parent_key, item_key, count(*) FROM oeb_texto WHERE parent_key IS NOT NULL AND item_key IS NOT NULL GROUP BY ALL
)
SELECT table_name, key_value, v AS mode_code, n AS mode_n FROM w
QUALIFY row_number() OVER (PARTITION BY table_name, key_value ORDER BY n DESC, v) = 1
""",
    "p4_price_percentiles": """
WITH r AS (
  SELECT family, price, row_number() OVER (PARTITION BY family ORDER BY price) AS k, count(*) OVER (PARTITION BY family) AS n
  FROM items WHERE family IS NOT NULL AND price IS NOT NULL
)
SELECT family AS key_value, f.fraction, min(price) AS price
FROM r, (VALUES (0.25::double), (0.5::double), (0.9::double)) AS f(fraction)
WHERE k >= greatest(1, ceil(f.fraction * n)) GROUP BY family, f.fraction
""",
    "p5_found": r"""
WITH RECURSIVE walk AS (
  SELECT raw_id, payload::json AS v, '' AS path, '' AS owner, false AS emit FROM raw_items WHERE payload IS NOT NULL AND json_valid(payload)
  UNION ALL
  SELECT w.raw_id, e.value, CASE WHEN w.path = '' THEN e.key ELSE w.path || '.' || e.key END,
    CASE WHEN json_type(w.v) = 'OBJECT' THEN w.path ELSE w.owner END, json_type(e.value) = 'OBJECT'
  FROM walk w, json_each(w.v) e WHERE json_type(w.v) IN ('OBJECT', 'ARRAY') AND json_type(e.value) IN ('OBJECT', 'ARRAY')
)
SELECT raw_id, owner AS parent_path, path AS obj_path FROM walk WHERE emit
""",
    "p5_item_parameters": """
SELECT item_id, p.ord::int AS ord, s['var'] AS var, s['name'] AS name, s['option'] AS option, s['letter'] AS letter, s['label'] AS label
FROM (SELECT item_id, unnest(parameters) AS s, generate_subscripts(parameters, 1) - 1 AS ord FROM items) p WHERE s IS NOT NULL
""",
    "p5_item_lines": """
SELECT item_id, p.ord::int AS ord, s['code'] AS code, s['unit'] AS unit, s['summary'] AS summary, s['type'] AS type,
  s['price'] AS price, s['quantity'] AS quantity, s['amount'] AS amount
FROM (SELECT item_id, unnest(decomposition) AS s, generate_subscripts(decomposition, 1) - 1 AS ord FROM items) p WHERE s IS NOT NULL
""",
}
_ITEM_NODE = r"regexp_replace(trim(i.parent_key), '[#\s]+$', '')"
SQL["p2_item_places"] = f"SELECT i.item_id, p.node_key, p.root_key, p.depth, p.node_path FROM items i JOIN ({SQL['p2_found']}) p ON p.node_key = {_ITEM_NODE}"
SQL["p2_hanging"] = (
    SQL["p2_descendants"].rpartition("SELECT node_key, descendant_key")[0].rstrip()
    + rf""", above AS (
  SELECT node_key AS at, node_key FROM nodes UNION SELECT descendant_key, node_key FROM down
), hung AS (
  SELECT i.item_id, a.node_key FROM items i JOIN above a ON a.at = {_ITEM_NODE}
  UNION
  SELECT item_id, regexp_replace(trim(c), '[#\s]+$', '') FROM items, unnest(chapter_path) AS u(c)
)
SELECT node_key, count(*) AS n_items FROM hung WHERE node_key <> '' GROUP BY node_key
"""
)
