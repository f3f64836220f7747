"""Queries of the catalogue operators over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedupe, documents, hierarchy, metrics, reconcile, retrieval, stats
from ..session import table
from . import expand, pricing

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL it is checked against."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT doc_id, source, item_key FROM documents WHERE starts_with(source, 'pliego') AND item_key <> parent_key")
def q01_key_prefix_filter(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter(F.col("source").startswith("pliego") & (F.col("item_key") != F.col("parent_key"))).select("doc_id", "source", "item_key")


@query("""
SELECT substr(i.code, 1, 1) AS chapter, any_value(h.summary) AS chapter_name, count(*) AS n_items
FROM items i JOIN (SELECT substr(code, 1, 1) AS c, arg_min(summary, code) AS summary FROM families WHERE code LIKE '%0$' GROUP BY 1) h ON h.c = substr(i.code, 1, 1)
WHERE NOT (i.code LIKE '\\%%' ESCAPE '\\' OR i.code LIKE 'AU%' OR starts_with(i.code, 'R_A_I_Z')) GROUP BY 1
""")
def q02_chapter_split(spark: SparkSession, folder: str) -> DataFrame:
    """Items by the first character of their code; chapters without a header row drop out
    (header rows are the families whose number ends in 0)."""
    heads = table(spark, folder, "families").filter(F.col("code").endswith("0$")).groupBy(F.substring("code", 1, 1).alias("chapter")).agg(F.min_by("summary", "code").alias("chapter_name"))
    items = table(spark, folder, "items").filter(~F.col("code").rlike("^(%|R_A_I_Z|AU)")).groupBy(F.substring("code", 1, 1).alias("chapter")).agg(F.count(F.lit(1)).alias("n_items"))
    return items.join(heads, "chapter").select("chapter", "chapter_name", "n_items")


@query("""
SELECT d.line_no, rtrim(trim(d.child), '#') AS child_key, coalesce(b.unit, '') AS unit, coalesce(b.summary, '') AS summary
FROM decompositions d LEFT JOIN base_concepts b ON b.code_key = rtrim(trim(d.child), '#')
""")
def q03_key_normalise_lookup(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "decompositions").select("line_no", X.code_key(F.col("child")).alias("child_key"))
    known = table(spark, folder, "base_concepts").select(F.col("code_key").alias("child_key"), "unit", "summary")
    return rows.join(known, "child_key", "left").select("line_no", "child_key", F.coalesce("unit", F.lit("")).alias("unit"), F.coalesce("summary", F.lit("")).alias("summary"))


@query("SELECT DISTINCT code FROM families WHERE rtrim(code, '$') BETWEEN 'OEB903' AND 'OEB907' OR code IN ('OEB901$', 'OEB905$')")
def q04_range_select(spark: SparkSession, folder: str) -> DataFrame:
    return expand.select_families(table(spark, folder, "families"), "code", [("OEB903", "OEB907$")], ["OEB901", "OEB905$"])


def _places(spark: SparkSession, folder: str) -> DataFrame:
    """Region, nation and supplier as links with keys ``R<n>``, ``N<n>`` and ``S<n>``."""
    nation = table(spark, folder, "nation").select(F.concat(F.lit("R"), "n_regionkey").alias("parent"), F.concat(F.lit("N"), "n_nationkey").alias("child"))
    supplier = table(spark, folder, "supplier").select(F.concat(F.lit("N"), "s_nationkey").alias("parent"), F.concat(F.lit("S"), "s_suppkey").alias("child"))
    return nation.union(supplier).withColumn("line_no", F.xxhash64("child"))


@query("""
SELECT 'R' || n_regionkey AS node_key, 'R' || n_regionkey AS root_key, 0 AS depth, 'R' || n_regionkey AS node_path FROM nation GROUP BY n_regionkey
UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 1, 'R' || n_regionkey || '/N' || n_nationkey FROM nation
UNION ALL SELECT 'S' || s_suppkey, 'R' || n_regionkey, 2, 'R' || n_regionkey || '/N' || n_nationkey || '/S' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def q05_hierarchy_path(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.node_paths(_places(spark, folder))


@query("""
SELECT 'R' || n_regionkey AS node_key, 'S' || s_suppkey AS descendant_key FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def q06_hierarchy_descend(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.descendants(_places(spark, folder)).filter("node_key like 'R%' and descendant_key like 'S%'").select("node_key", "descendant_key")


_ALPHABET = X.LETTERS


@query(f"""
WITH f AS (SELECT code AS family, params[1].options AS a, params[2].options AS b, params[3].options AS c FROM families)
SELECT family, (i - 1) * len(b) * len(c) + (j - 1) * len(c) + k - 1 AS ordinal,
  rtrim(family, '$') || substr('{_ALPHABET}', i::int, 1) || substr('{_ALPHABET}', j::int, 1) || substr('{_ALPHABET}', k::int, 1) AS derived_code,
  a[i] || '|' || b[j] || '|' || c[k] AS labels
FROM f, generate_series(1, 62) x(i), generate_series(1, 62) y(j), generate_series(1, 62) z(k) WHERE i <= len(a) AND j <= len(b) AND k <= len(c)
""")
def q07_combination_expand(spark: SparkSession, folder: str) -> DataFrame:
    """The first three parameters only, as its SQL has it; no complete codes where a family has
    more (``q07_family_expand`` has them all)."""
    families = table(spark, folder, "families").select(F.col("code").alias("family"), F.slice("params", 1, 3).alias("params"))
    sized = families.withColumn("counts", F.transform("params", lambda p: F.size(p["options"])))
    rows = expand.combinations(sized, "counts")
    labels = F.array_join(F.transform(F.arrays_zip("params", "selection"), lambda z: F.element_at(z["params"]["options"], z["selection"])), "|")
    return rows.select("family", "ordinal", expand.derived_code(F.col("family"), F.col("selection")).alias("derived_code"), labels.alias("labels"))


def q07_family_expand(spark: SparkSession, folder: str) -> DataFrame:
    """Every combination of all parameters of every family (671 million rows, so no SQL)."""
    return expand.coded_combinations(table(spark, folder, "families"), "code", "params")


QUERIES["q07_family_expand"] = q07_family_expand


@query(f"""
WITH c AS (SELECT DISTINCT code FROM items WHERE code IS NOT NULL), s AS (SELECT DISTINCT code AS family, rtrim(code, '$') AS stem FROM families)
SELECT c.code, s.family, len(c.code) - len(s.stem) AS n_letters, instr('{_ALPHABET}', substr(c.code, len(s.stem) + 1, 1)) AS first_option
FROM c JOIN s ON starts_with(c.code, s.stem) AND len(c.code) > len(s.stem)
QUALIFY row_number() OVER (PARTITION BY c.code ORDER BY len(s.stem) DESC) = 1
""")
def q08_derived_code_split(spark: SparkSession, folder: str) -> DataFrame:
    codes = table(spark, folder, "items").select("code").filter("code is not null").distinct()
    split = expand.split_derived(codes, "code", table(spark, folder, "families"), "code")
    return split.select("code", "family", F.size("selection").cast("bigint").alias("n_letters"), F.col("selection")[0].cast("bigint").alias("first_option"))


@query(r"""
WITH p AS (SELECT item_id, unnest(parameters) AS p FROM items), v AS (
  SELECT item_id, p['var'] AS var, p['label'] AS label, coalesce(try_cast(replace(regexp_extract(p['label'], '^\s*([-+]?(?:\d+(?:[.,]\d*)?|[.,]\d+))', 1), ',', '.') AS double), 0) AS number FROM p)
SELECT item_id, var, label, number, CASE WHEN number = floor(number) THEN number::bigint::varchar ELSE rtrim(rtrim(printf('%.10f', number), '0'), '.') END AS spelled FROM v WHERE label IS NOT NULL
""")
def q11_atof_ftoa(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "items").select("item_id", F.explode("parameters").alias("p")).filter("p.label is not null")
    return rows.select("item_id", "p.var", "p.label", X.to_number(F.col("p.label")).alias("number")).withColumn("spelled", X.to_text(F.col("number")))


def _order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their lines as ordered arrays, codes ``MO<n>`` or ``MT<n>`` by part."""
    code = F.concat(F.when(F.col("l_partkey") % 2 == 0, "MO").otherwise("MT"), F.col("l_partkey"))
    line = F.struct(
        F.col("l_linenumber").alias("ord"), code.alias("code"), F.lit("u").alias("unit"), F.lit("").alias("summary"), F.lit("1").alias("type"), F.round(F.col("l_extendedprice").cast("decimal(18,2)") / 1000, 2).cast(pricing.MONEY).alias("price"), F.col("l_quantity").cast(pricing.MONEY).alias("quantity"), F.lit(None).cast("string").alias("warning"),
    )
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))


def _share(ord_: int, code: str, quantity: str):
    return F.struct(F.lit(ord_).alias("ord"), F.lit(code).alias("code"), F.lit("%").alias("unit"), F.lit("").alias("summary"), F.lit("%").alias("type"), F.lit(None).cast(pricing.MONEY).alias("price"), F.lit(quantity).cast(pricing.MONEY).alias("quantity"), F.lit(None).cast("string").alias("warning"))


_LINES = """
WITH l AS (
  SELECT l_orderkey, CASE WHEN l_partkey % 2 = 0 THEN 'MO' ELSE 'MT' END AS kind, round((l_quantity::decimal(18,3) * round((l_extendedprice::decimal(18,2) / 1000)::decimal(38,8), 2))::decimal(38,6), 2) AS amount FROM lineitem
), b AS (
  SELECT l_orderkey, sum(amount)::decimal(18,2) AS direct, coalesce(sum(amount) FILTER (kind = 'MO'), 0)::decimal(18,2) AS mo FROM l GROUP BY 1
)
"""


@query(_LINES + "SELECT l_orderkey, direct::double AS direct, round((direct * 0.06)::decimal(38,6), 2)::double AS share, (direct + round((direct * 0.06)::decimal(38,6), 2))::double AS total FROM b")
def q15_percentage_single(spark: SparkSession, folder: str) -> DataFrame:
    lines = pricing.fold_lines(F.array_append("lines", _share(99, "%CIND", "0.06")))
    priced = _order_lines(spark, folder).select("l_orderkey", lines.alias("lines"))
    return priced.select("l_orderkey", pricing.lines_total(F.col("lines"), 2, shares=False).cast("double").alias("direct"), F.element_at("lines", -1)["amount"].cast("double").alias("share"), pricing.lines_total(F.col("lines"), 2).cast("double").alias("total"))


@query(_LINES + """, s AS (SELECT *, round((mo * 0.10)::decimal(38,6), 2) AS x FROM b), t AS (SELECT *, round(((direct + x) * 0.06)::decimal(38,6), 2) AS y FROM s)
SELECT l_orderkey, x::double AS labour_share, y::double AS all_share, (direct + x + y)::double AS total FROM t""")
def q16_percentage_stacked_prefix(spark: SparkSession, folder: str) -> DataFrame:
    lines = pricing.fold_lines(F.concat("lines", F.array(_share(98, "MO%X", "0.10"), _share(99, "%CIND", "0.06"))))
    priced = _order_lines(spark, folder).select("l_orderkey", lines.alias("lines"))
    amount = lambda k: F.element_at("lines", k)["amount"].cast("double")
    return priced.select("l_orderkey", amount(-2).alias("labour_share"), amount(-1).alias("all_share"), pricing.lines_total(F.col("lines"), 2).cast("double").alias("total"))


@query("""
WITH p AS (SELECT 'P' || p_partkey AS k, p_retailprice::decimal(18,2) AS price, p_size, p_brand FROM part),
  b AS (SELECT p_brand, sum(round((price * (p_size / 100.0)::decimal(18,3))::decimal(38,6), 2)) AS price FROM p GROUP BY 1)
SELECT p_brand AS code_key, price::double AS price FROM b UNION ALL SELECT 'ALL', sum(round((price * 0.333)::decimal(38,6), 2))::double FROM b UNION ALL SELECT k, price::double FROM p
""")
def q17_multilevel_pricing(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").withColumn("k", F.concat(F.lit("P"), "p_partkey"))
    text = F.lit("")
    leaves = part.select(F.col("k").alias("code_key"), text.alias("unit"), text.alias("summary"), F.col("p_retailprice").cast("decimal(18,2)").alias("price"), text.alias("type"))
    brands = part.select("p_brand").distinct()
    priceless = brands.select(F.col("p_brand").alias("code_key")).union(spark.createDataFrame([("ALL",)], "code_key string")).select("code_key", text.alias("unit"), text.alias("summary"), F.lit(None).cast("decimal(18,2)").alias("price"), text.alias("type"))
    one = F.lit(1).cast("decimal(18,6)")
    below = part.select(F.col("p_brand").alias("parent_key"), F.col("p_partkey").cast("int").alias("ord"), F.col("k").alias("child"), (F.col("p_size") / 100).cast("decimal(18,6)").alias("factor"), one.alias("yield"))
    top = brands.select(F.lit("ALL").alias("parent_key"), F.abs(F.hash("p_brand")).alias("ord"), F.col("p_brand").alias("child"), F.lit("0.333").cast("decimal(18,6)").alias("factor"), one.alias("yield"))
    return pricing.priced_concepts(leaves.union(priceless), below.union(top)).select("code_key", F.col("price").cast("double").alias("price"))


def q17_catalogue_pricing(spark: SparkSession, folder: str) -> DataFrame:
    """Every code of the catalogue tables priced over its compositions, cycles as errors."""
    key = X.code_key
    concepts = table(spark, folder, "concepts").unionByName(table(spark, folder, "base_concepts")).groupBy("code_key").agg(F.max_by(F.struct("unit", "summary", "price", "type"), "line_no").alias("c")).select("code_key", "c.*")
    links = table(spark, folder, "decompositions").filter(~F.rtrim("parent").endswith("#"))
    rows = links.select("parent_key", "ord", key(F.col("child")).alias("child"), "factor", "yield").distinct()
    return pricing.priced_concepts(concepts, rows).select("code_key", F.col("price").cast("double").alias("price"), F.size("warnings").alias("n_warnings"), "error")


QUERIES["q17_catalogue_pricing"] = q17_catalogue_pricing


def q19_items_json(spark: SparkSession, folder: str) -> DataFrame:
    """Items as JSON lines, nulls written."""
    items = table(spark, folder, "items").drop("loaded_at")
    return items.select("item_id", F.to_json(F.struct(*[c for c in items.columns if c not in ("item_id", "parent_key")]), {"ignoreNullFields": "false"}).alias("line"))


QUERIES["q19_items_json"] = q19_items_json

_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"


@query(rf"""
WITH t AS (SELECT 'resumen' AS field, resumen AS x FROM items UNION ALL SELECT 'texto', texto FROM items),
  w AS (SELECT field, list_filter(regexp_split_to_array(x, '{_SPACE}'), lambda y: y <> '') AS ws FROM t WHERE x IS NOT NULL)
SELECT field, count(*) AS n_texts, sum(len(ws))::bigint AS total_words, (SELECT count(DISTINCT u) FROM (SELECT unnest(ws) AS u, field AS f FROM w) z WHERE z.f = w.field) AS vocabulary, max(len(ws)) AS max_words, avg(len(ws)) AS mean_words
FROM w GROUP BY field
""")
def q20_stats_fields(spark: SparkSession, folder: str) -> DataFrame:
    return stats.field_stats(table(spark, folder, "items"), "resumen", "texto")


@query(rf"SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_split_to_array(text, '{_SPACE}')) AS w FROM oeb_texto) WHERE w <> ''")
def q21_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return stats.vocabulary(table(spark, folder, "oeb_texto"), "text")


_PARAMETERS = "(SELECT item_key, e.key AS parameter_key, e.value['label'] AS parameter_label, unnest(e.value['values']) AS v FROM (SELECT item_key, unnest(map_entries(parameters)) AS e FROM oeb_texto))"


@query(f"SELECT item_key, parameter_key, parameter_label, v['label'] AS value_label, v['value'] AS value FROM {_PARAMETERS}")
def q22_parameter_rows(spark: SparkSession, folder: str) -> DataFrame:
    return stats.parameter_rows(table(spark, folder, "oeb_texto"), "item_key", "parameters")


@query(rf"""
WITH p AS (SELECT parameter_label AS l, len(list_filter(regexp_split_to_array(coalesce(v['value'], ''), '{_SPACE}'), lambda y: y <> '')) AS vw, len(list_filter(regexp_split_to_array(coalesce(parameter_label, ''), '{_SPACE}'), lambda y: y <> '')) AS lw FROM {_PARAMETERS})
SELECT count(*) AS n_parameters, count(DISTINCT l) AS n_labels, max(vw) AS max_value_words, avg(vw) AS mean_value_words, max(lw) AS max_label_words, avg(lw) AS mean_label_words FROM p
""")
def q22_parameter_stats(spark: SparkSession, folder: str) -> DataFrame:
    return stats.parameter_stats(stats.parameter_rows(table(spark, folder, "oeb_texto"), "item_key", "parameters"))


_STRIP = r"coalesce(regexp_replace({c}, '^[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+|[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+$', '', 'g'), '')"
_COUNTED = f"WITH s AS (SELECT *, {_STRIP.format(c='resumen')} AS r, {_STRIP.format(c='texto')} AS t FROM items), c AS (SELECT item_id, resumen, texto, r, t, count(*) OVER (PARTITION BY r) AS rc, count(*) OVER (PARTITION BY t) AS tc FROM s) "


@query(_COUNTED + "SELECT item_id, rc = 1 AND tc = 1 AS validation FROM c")
def q23_mark_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.mark_duplicates(table(spark, folder, "items"), "resumen", "texto").select("item_id", "validation")


@query(_COUNTED + """, x AS (SELECT 'resumen' AS field, rc AS n, rc = 1 AND tc = 1 AS ok, r AS y FROM c UNION ALL SELECT 'texto', tc, rc = 1 AND tc = 1, t FROM c UNION ALL SELECT 'either', CASE WHEN rc > 1 OR tc > 1 THEN 2 ELSE 1 END, rc = 1 AND tc = 1, '' FROM c)
SELECT field, count(*) AS n_items, count(*) FILTER (ok) AS n_validated, count(*) FILTER (n = 1) AS n_unique, count(*) FILTER (n > 1) AS n_duplicates, CASE WHEN field <> 'either' THEN count(DISTINCT y) FILTER (n > 1) END AS n_groups, round(count(*) FILTER (n > 1) / count(*), 6) AS ratio FROM x GROUP BY field""")
def q24_duplicate_summary(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.duplicate_summary(table(spark, folder, "items"), "resumen", "texto")


@query(_COUNTED + "SELECT md5(r) AS text_hash, count(*) AS n_items, min(item_id) AS first_key FROM c GROUP BY r HAVING count(*) > 1")
def q25_duplicate_groups(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.duplicate_groups(table(spark, folder, "items"), "item_id", "resumen")


@query(_COUNTED + "SELECT md5(t) AS text_hash, item_id AS key, rc = 1 AND tc = 1 AS validation FROM c WHERE tc > 1")
def q25_duplicate_members(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.duplicate_members(table(spark, folder, "items"), "item_id", "texto", "resumen", "texto")


@query(_COUNTED + ", d AS (SELECT item_id, count(*) OVER (PARTITION BY r) AS n FROM c WHERE rc > 1 OR tc > 1) SELECT item_id FROM d WHERE n = 1")
def q25_text_only_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.repeated_only_in(table(spark, folder, "items"), "texto", "resumen").select("item_id")


@query(_COUNTED + "SELECT item_id, rc > 1 AS is_resumen_duplicate, tc > 1 AS is_texto_duplicate FROM c WHERE rc > 1 OR tc > 1")
def q25_duplicate_flags(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.duplicate_flags(table(spark, folder, "items"), "resumen", "texto").select("item_id", "is_resumen_duplicate", "is_texto_duplicate")


@query(_COUNTED + "SELECT item_id FROM c WHERE rc = 1 AND tc = 1")
def q26_unique_filter(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe.unique_items(table(spark, folder, "items"), "resumen", "texto").select("item_id")


@query("SELECT md5(item_id || '|resumen') AS id, item_id, code, 'resumen' AS type, resumen AS text FROM items UNION ALL SELECT md5(item_id || '|texto'), item_id, code, 'texto', texto FROM items")
def q27_document_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return documents.document_pairs(table(spark, folder, "items"), "item_id", "resumen", "texto", metadata=("code",))


@query("SELECT md5(id || '|text') AS id, item_key, parent_key, ud, concept, text FROM oeb_texto")
def q27_flat_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with nested metadata, flattened."""
    rows = table(spark, folder, "oeb_texto").withColumnRenamed("id", "row_id")
    pairs = documents.document_pairs(rows, "row_id", "text", metadata=("item_key", "parent_key", "ud", "concept"))
    nested = pairs.select("id", F.struct("item_key", "parent_key", "ud", "concept").alias("metadata"), "text")
    return documents.flattened(nested)


@query("SELECT count(*) AS n_items, count(DISTINCT parent_key) AS n_parents FROM oeb_texto")
def q20_parent_counts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.parent_counts(table(spark, folder, "oeb_texto"), "parent_key")


@query("SELECT id AS key, coalesce(cardinality(parameters), 0)::int AS n_parameters, coalesce(list_sum(list_transform(map_values(parameters), lambda p: len(p['values']))), 0)::int AS n_values FROM oeb_texto")
def q22_item_parameters(spark: SparkSession, folder: str) -> DataFrame:
    return stats.item_parameters(table(spark, folder, "oeb_texto"), "id", "parameters")


@query("SELECT id, n.name, coalesce(CASE WHEN parameters IS NOT NULL THEN parameters[n.name].label END, CASE n.name WHEN 'A' THEN ud WHEN 'Z' THEN concept END, '') AS value FROM oeb_texto, (VALUES ('A'), ('B'), ('Z'), ('?')) n(name)")
def q22_name_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Names as parameters first, then as variables, else empty."""
    labels = F.transform_values("parameters", lambda k, p: p["label"])
    own = F.create_map(F.lit("A"), F.col("ud"), F.lit("Z"), F.col("concept"))
    rows = table(spark, folder, "oeb_texto").select("id", labels.alias("p"), own.alias("v"), F.explode(F.array(*map(F.lit, "ABZ?"))).alias("name"))
    return rows.select("id", "name", X.looked_up(F.col("name"), F.col("p"), F.col("v")).alias("value"))


@query(rf"SELECT doc_id, len(regexp_extract_all(translate(lower(text), '{X.ACCENTED}', '{X.PLAIN}'), '[\p{{L}}\p{{N}}_]+'))::int AS n_tokens FROM documents WHERE text IS NOT NULL")
def q28_normalize_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", F.size(X.plain_tokens(F.col("text"))).alias("n_tokens"))


_INDEX = r"""
WITH t AS (SELECT item_id AS doc, unnest(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')) AS term FROM items WHERE {w}), i AS (SELECT doc, term, count(*) AS tf FROM t GROUP BY 1, 2),
n AS (SELECT count(*) AS n FROM items WHERE {w})
"""


@query(_INDEX.format(c="texto", w="true") + "SELECT term, sum(tf)::bigint AS cf, count(*) AS df, round(ln((any_value(n) + 1.0) / (sum(tf) + 0.5)), 6) AS idf FROM i, n GROUP BY term")
def q29_bm25_term_stats(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "items")
    return retrieval.term_stats(retrieval.postings(items, "item_id", "texto"), items.count()).withColumn("idf", F.round("idf", 6))


@query(_INDEX.format(c="texto", w="true") + "SELECT term, row_number() OVER (ORDER BY term) - 1 AS position FROM (SELECT DISTINCT term FROM i)")
def q29_vocabulary_positions(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.vocabulary(retrieval.postings(table(spark, folder, "items"), "item_id", "texto"))


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    """Short texts of every fiftieth item against the long texts of all."""
    items = table(spark, folder, "items")
    return retrieval.top_k(items, "item_id", "texto", items.filter("item_id % 50 = 0"), "item_id", "resumen", 10)


_W = "{i} * {t} * 2.5 / ({t} + 1.5 * (0.25 + 0.75 * {l} / m))"
_TOPK = (
    _INDEX.format(c="texto", w="true")
    + r"""
, l AS (SELECT item_id AS doc, coalesce(len(regexp_extract_all(lower(texto), '[\p{L}\p{N}_]+')), 0) AS len FROM items), a AS (SELECT avg(len) AS m FROM l),
s AS (SELECT term, ln((any_value(n) + 1.0) / (sum(tf) + 0.5)) AS idf FROM i, n GROUP BY term),
q0 AS (SELECT item_id AS query, unnest(regexp_extract_all(lower(resumen), '[\p{L}\p{N}_]+')) AS term FROM items WHERE item_id %% 50 = 0),
q AS (SELECT query, term, count(*) AS qtf, any_value(qlen) AS qlen FROM q0 JOIN (SELECT query, count(*) AS qlen FROM q0 GROUP BY 1) USING (query) GROUP BY 1, 2),
r0 AS (SELECT query, doc, round(sum((%s) * (%s)), 6) AS score FROM q JOIN s USING (term) JOIN i USING (term) JOIN l USING (doc), a GROUP BY 1, 2),
few AS (SELECT item_id AS doc FROM items ORDER BY item_id LIMIT 20),
r AS (SELECT * FROM r0 UNION ALL SELECT x.item_id, few.doc, 0.0 FROM items x, few WHERE x.item_id %% 50 = 0 AND NOT EXISTS (SELECT 1 FROM r0 WHERE r0.query = x.item_id AND r0.doc = few.doc)),
k AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank, doc, score FROM r QUALIFY rank <= 10),
hit AS (SELECT q.query, min(CASE WHEN doc = q.query THEN rank END) AS hit, count(rank) AS shown FROM (SELECT item_id AS query FROM items WHERE item_id %% 50 = 0) q LEFT JOIN k USING (query) GROUP BY 1)
"""
    % (_W.format(i="s.idf", t="qtf", l="qlen"), _W.format(i="s.idf", t="tf", l="len"))
)


@query(_TOPK + "SELECT query, rank::int AS rank, doc, score FROM k")
def q30_bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(spark, folder)


@query(_TOPK.replace("any_value(qlen) AS qlen", "(SELECT len FROM l ORDER BY doc LIMIT 1) AS qlen") + "SELECT query, rank::int AS rank, doc, score FROM k")
def q30_bm25_reference_length(spark: SparkSession, folder: str) -> DataFrame:
    """Every query taken to be as long as the corpus's first document."""
    items = table(spark, folder, "items")
    return retrieval.top_k(items, "item_id", "texto", items.filter("item_id % 50 = 0"), "item_id", "resumen", 10, query_length="reference")


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "items").filter("item_id % 50 = 0").select(F.col("item_id").alias("query"))
    return metrics.first_hits(_ranked(spark, folder), asked, F.col("doc") == F.col("query"))


@query(_TOPK + "SELECT round(count(hit) / count(*), 6) AS success, round(coalesce(sum(1 / hit), 0) / count(*), 6) AS mrr, round(avg(hit), 6) AS mean_position, median(hit)::double AS median_position, round(count(*) FILTER (hit = 1) / count(*), 6) AS perfect FROM hit")
def q31_metrics_single(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.single_match(_hits(spark, folder))


@query(_TOPK + "SELECT p AS position, round((SELECT count(*) FROM hit WHERE hit = p) / (SELECT count(*) FROM hit), 6) AS share FROM generate_series(1, 10) g(p)")
def q31_position_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.position_distribution(_hits(spark, folder), 10)


@query(_TOPK + ", o AS (SELECT count(hit) / count(*) AS re, count(hit) / sum(shown) AS pr, coalesce(sum(1 / hit), 0) / count(*) AS m FROM hit) SELECT round(re, 6) AS recall, round(pr, 6) AS precision, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, round(m, 6) AS mrr, round(m, 6) AS map FROM o")
def q32_metrics_overall(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.overall(_hits(spark, folder))


@query(_TOPK + """, c AS (SELECT item_id, code FROM items), h AS (SELECT q.item_id AS query, min(CASE WHEN left(d.code, 6) = left(q.code, 6) THEN rank END) AS hit FROM items q LEFT JOIN k ON k.query = q.item_id LEFT JOIN c d ON d.item_id = k.doc WHERE q.item_id % 50 = 0 GROUP BY 1)
SELECT round(count(hit) / count(*), 6) AS success, round(coalesce(sum(1 / hit), 0) / count(*), 6) AS mrr, round(avg(hit), 6) AS mean_position, list_sort(list(hit) FILTER (hit IS NOT NULL))[(count(hit) // 2) + 1]::double AS median_position, round(count(*) FILTER (hit = 1) / count(*), 6) AS perfect FROM h""")
def q33_metrics_prefix(spark: SparkSession, folder: str) -> DataFrame:
    codes = table(spark, folder, "items").select("item_id", "code")
    asked = codes.filter("item_id % 50 = 0").select(F.col("item_id").alias("query"), F.col("code").alias("query_code"))
    ranked = _ranked(spark, folder).join(codes.select(F.col("item_id").alias("doc"), "code"), "doc")
    return metrics.single_match(metrics.first_hits(ranked, asked, F.left("code", F.lit(6)) == F.left("query_code", F.lit(6))), upper_median=True)


_LEFT = """CASE WHEN item_id % 5 = 4 THEN resumen || ' a >= 5, b <= 3, c = 2' ELSE resumen END"""
_PERTURB = """CASE item_id % 5 WHEN 0 THEN resumen WHEN 1 THEN replace(resumen, ' ', '  ') WHEN 2 THEN '"' || replace(resumen, ',', ',"') WHEN 3 THEN resumen || ' x' ELSE resumen || ' a >== 5, b <=== 3, c == "2"' END"""
_UNDONE = f"trim(regexp_replace(regexp_replace(regexp_replace(replace(§, '\"', ''), '([<>])=+', '\\1=', 'g'), '(^|[^<>=])=+', '\\1=', 'g'), '{_SPACE}', ' ', 'g'))"


@query(rf"""
WITH a AS (SELECT item_id AS k, coalesce({_LEFT}, '') AS a FROM items WHERE texto IS NOT NULL), b AS (SELECT item_id AS k, coalesce({_PERTURB}, '') AS b FROM items WHERE code IS NOT NULL AND resumen IS NOT NULL),
  c AS (SELECT a.k AS ka, b.k AS kb, a, b, trim(regexp_replace(a, '{_SPACE}', ' ', 'g')) AS ca, trim(regexp_replace(b, '{_SPACE}', ' ', 'g')) AS cb FROM a FULL OUTER JOIN b USING (k))
SELECT CASE WHEN kb IS NULL THEN 'only_left' WHEN ka IS NULL THEN 'only_right' WHEN a = b THEN 'exact' WHEN ca = cb THEN 'whitespace' WHEN {_UNDONE.replace("§", "ca")} = {_UNDONE.replace("§", "cb")} THEN 'corruption' ELSE 'other' END AS class, count(*) AS n FROM c GROUP BY 1
""")
def q34_reconcile_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Items with a long text against perturbed short texts of items that have one."""
    items = table(spark, folder, "items")
    left = items.filter("texto is not null").select("item_id", F.expr(_LEFT).alias("resumen"))
    right = items.filter("code is not null and resumen is not null").select("item_id", F.expr(_PERTURB).alias("resumen"))
    return reconcile.summary(reconcile.classify(left, right, "item_id", "resumen"))


def q35_sample_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Five documents, the same for the same seed (a sampling operator)."""
    return dedupe.sample_rows(table(spark, folder, "documents").select("doc_id", "text"), 5, "doc_id", seed=7)


QUERIES["q35_sample_texts"] = q35_sample_texts


def q37_parametric_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Parse, expand, evaluate and price the package's own catalogue, invalid items included."""
    from ..sources.records import Catalog
    from . import garden, items

    found = items.items(Catalog.from_text(spark, garden.TEXT), include_invalid=True)
    return found.select("code", "family", "valid", "error", "resumen", "texto", "direct_cost", "price", F.to_json("decomposition").alias("decomposition"), F.array_join("warnings", "; ").alias("warnings"))


QUERIES["q37_parametric_catalogue"] = q37_parametric_catalogue
