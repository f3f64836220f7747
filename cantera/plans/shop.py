"""A catalogue built from the driver's tables as files, and the queries that run the whole
engine on it: decoding, records, tables, chapters, programs, evaluation, prices, items.

Parts are concepts in files per brand, brands are compositions of their parts, regions and
nations are chapters, and each nation is a family with options from the part table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import code_key
from ..lang.syntax import parse
from ..session import table
from ..sources.records import Catalog, split_files
from . import items, pricing

QUERIES, SQL = {}, {}
SHIFTS = ("día", "noche", "alba", "tarde", "ocaso", "veda")
#: The program of a family, § standing for what depends on the nation and the tables.
BODY = r"""§stray\ TYPE \§types\ # one for each type
\SIZE\§sizes\
\SHIFT\§shifts\
$E="No " + $C +
 " work with option "+FTOA(%B)
%E=%A=b & %C=c & %B>40
%M(6,2)=1,2, # of each type, early and late
3,4,5.5,6,7,8,

9,10,11,12.25
$K=FTOA(%A)
%N=ATOF($B)
$F=FTOA(%N*2)
$G=FTOA(%M(%A,1+(%C>3)))
$H=FTOA(ROUND(%N*1.15,1))
$I=FTOA(ROUND(SIN(%B)+COS(%B)+TAN(%B)+ATAN(%B)+ATAN2(%B,%A)+ASIN(%B/50)-ACOS(%B/50)+SQRT(%B)+PI,6))
$S="low"*(%B<=10)+"mid"*(%B>10&%B<=30)+"high"*!(%B<=30)
$U=FTOA(($A="ECONOMY")+2*($A<"M")+4*($B=a))
$V=FTOA(-%B^2+INT(0-%B/4)+ABS(0-3,9))
$W=FTOA((%A=1)@(%C=2)&(%B=3))
$X=FTOA("3"*"2"+ATOF("1-5"))
%Q=7,
LB01 : 0.3333*(%C=a) + 0.5*(%C<>a) # hours
CB$K : %M(%A,1+(%C>3))/10 : 0.1
LB01 : 0.25
MT99 : (%B=1)*0
ZZ%A : 0.5*(%B>45)
MT98 : 0.00004
LB%%X : 0.1
%%OVH : 0.06
%: 2*(%A=f)
§extra\ R \$A for $B,   $C shift\ # short
\TEXTO\size   $B is $F
m $G; r $H
t $I
 s $S, cmp $U
neg $V or $W prod $X
letters %A%B%C 100%%
z $Y\
\C\not shown\
\PLIEGO\one\two\
"""
#: What a nation's number modulo 5 adds: an undefined variable, errors, a direct price, a stray line.
EXTRA = {0: "$Y=FTOA(%Z+1)\n", 1: "", 2: "%D=1/(%B-5)\n", 3: '$L(3)="x","y","z"\n$J=$L(%C)\n', 4: "::%N*10.005\n"}
FAULTS = {0: "\\P\\a\\b\\\n%Q(2)=1\n", 1: "".join(f"\\P{i}\\a\\\n" for i in range(1, 12))}
MATRIX = (1, 2, 3, 4, 5.5, 6, 7, 8, 9, 10, 11, 12.25)


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL it is checked against."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _options(spark: SparkSession, folder: str) -> tuple[str, str]:
    """The types and sizes of the part table (56 values at every scale) as option lists."""
    label = F.concat(F.replace((F.col("p_size") / 4).cast("decimal(6,2)").cast("string"), F.lit("."), F.lit(",")), F.lit(" kV"))
    row = table(spark, folder, "part").agg(F.array_sort(F.collect_set("p_type")).alias("t"), F.array_sort(F.collect_set(F.struct("p_size", label.alias("s")))).alias("s")).first()
    return "\\".join(row["t"]), "\\".join(x["s"] for x in row["s"])


def _bodies(types: str, sizes: str) -> dict[int, str]:
    plain = BODY.replace("§types", types).replace("§sizes", sizes).replace("§shifts", "\\".join(SHIFTS))
    return {k: plain.replace("§stray", "1+1\n" if k == 1 else "").replace("§extra", more) for k, more in EXTRA.items()}


def _chosen(number: Column, texts: dict[int, str]) -> Column:
    return F.element_at(F.array(*[F.lit(texts[k]) for k in sorted(texts)]), (number % len(texts) + 1).cast("int"))


def _joined(lines: DataFrame, path: str, order: str, line: str, head: str) -> DataFrame:
    """Files of lines in order; every other one in UTF-8 with a mark and CRLF, else Latin 1."""
    whole = lines.groupBy(path).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n").alias("text"))
    text = F.concat(F.lit(f"{head}\n"), "text", F.lit("\n"))
    odd = F.concat(F.unhex(F.lit("EFBBBF")), F.encode(F.replace(text, F.lit("\n"), F.lit("\r\n")), "UTF-8"))
    return whole.select(F.col(path).alias("path"), F.when(F.length(path) % 2 == 1, odd).otherwise(F.encode(text, "ISO-8859-1")).alias("content"))


def part_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, content``: parts as concepts and texts, ten thousand keys of a brand a file."""
    part = table(spark, folder, "part").withColumn("path", F.concat(F.lit("part/"), F.replace("p_brand", F.lit("Brand#"), F.lit("")), F.lit("."), F.expr("p_partkey div 10000")))
    price = F.replace(F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    again = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("\n~C|P"), "p_partkey", F.lit("|m|again||010125||"))).otherwise("")
    line = F.concat(F.lit("~C|P"), "p_partkey", F.lit("\\Q"), "p_partkey", F.lit("#| u |"), "p_name", F.lit(" ñ|"), price, F.lit("\\99|010124\\1|3|\n~T|P"), "p_partkey", F.lit("|"), "p_name", F.lit("\nof size "), "p_size", F.lit("||"), again)
    return _joined(part.withColumn("line", line), "path", "p_partkey", "line", "before the first record")


def catalogue_files(spark: SparkSession, folder: str) -> DataFrame:
    """All files of the catalogue."""
    parts = table(spark, folder, "part").withColumn("brand", F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int"))
    yields = F.replace((F.col("p_size") / 100).cast("decimal(4,2)").cast("string"), F.lit("."), F.lit(","))
    listed = parts.groupBy("brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.concat(F.lit("P"), "p_partkey", F.lit(" \\\\"), yields, F.lit("\\")).alias("t")))), lambda x: x["t"]), "").alias("t"))
    blends = listed.select(F.lit("blends").alias("path"), "brand", F.concat(F.lit("~C|CB"), "brand", F.lit("|u|BLEND|1|010124|EA|\n~D|CB"), "brand", F.lit("#|old\\1\\1\\|\n~D|CB"), "brand", F.lit("|"), "t", F.lit(" \\5\\5\\%W\\0,05\\1\\half\\2|")).alias("line"))
    nation = table(spark, folder, "nation")
    bodies = _bodies(*_options(spark, folder))
    code = F.concat(F.lit("F"), "n_nationkey", F.lit("$"))
    families = nation.select(F.concat(F.lit("region/"), "n_regionkey").alias("path"), "n_nationkey", F.concat(F.lit("~C|"), code, F.lit("|u|"), "n_name", F.lit("||||\n~D|N"), "n_nationkey", F.lit("#|"), code, F.lit("\\\\\\|\n~P| "), code, F.lit(" |"), _chosen(F.col("n_nationkey"), bodies), F.lit("|")).alias("line"))
    below = nation.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda k: F.concat(F.lit("N"), k, F.lit("#\\\\\\"))), "").alias("t"))
    faulty = F.concat(F.lit("~P|G"), "n_regionkey", F.lit("$|"), _chosen(F.col("n_regionkey"), FAULTS), F.lit("|"))
    regions = below.select(F.lit("regions").alias("path"), "n_regionkey", F.concat(F.lit("~C|R"), "n_regionkey", F.lit("#||x||||\n~D|ROOT##|R"), "n_regionkey", F.lit("#\\1\\1\\|\n~D|R"), "n_regionkey", F.lit("#|"), "t", F.lit("|\n"), faulty).alias("line"))
    fixed = "~V|owner|FIEBDC-3/2020\\010125|\n~K|1\\1\\1\\1\\1|\n~K|0\\x\\3\\-4\\2\\2\\2\\2\\|\n~C|LB01|h|LABOURER|20.35||1|\n~C|%OVH|%|Overheads|||%|"
    head = spark.createDataFrame([("z", fixed)], "path string, text string").select("path", F.encode("text", "UTF-8").alias("content"))
    made = part_files(spark, folder)
    for lines, order in ((blends, "brand"), (families, "n_nationkey"), (regions, "n_regionkey")):
        made = made.unionByName(_joined(lines, "path", order, "line", "-"))
    return made.unionByName(head)


def catalogue(spark: SparkSession, folder: str) -> Catalog:
    return Catalog(split_files(catalogue_files(spark, folder)))


_FILE = "'part/' || replace(p_brand, 'Brand#', '') || '.' || p_partkey // 10000"


@query(f"""
WITH p AS (SELECT *, {_FILE} AS file, coalesce(sum(4 - (p_partkey % 10 <> 0)::int) OVER (PARTITION BY {_FILE} ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM part)
SELECT file, (before + 2)::int AS line_no, 'C' AS kind, 'P' || p_partkey || '\\Q' || p_partkey || '#¦ u ¦' || p_name || ' ñ¦' || replace(p_retailprice::decimal(18,2)::varchar, '.', ',') || '\\99¦010124\\1¦3' AS fields FROM p
UNION ALL SELECT file, (before + 3)::int, 'T', 'P' || p_partkey || '¦' || p_name || chr(10) || 'of size ' || p_size || '¦' FROM p
UNION ALL SELECT file, (before + 5)::int, 'C', 'P' || p_partkey || '¦m¦again¦¦010125¦' FROM p WHERE p_partkey % 10 = 0
""")
def q38_catalogue_records(spark: SparkSession, folder: str) -> DataFrame:
    """Decoding of both encodings, record starts, continuation lines and fields."""
    return split_files(part_files(spark, folder)).select("file", "line_no", "kind", F.array_join("fields", "¦").alias("fields"))


_CONCEPTS = """
SELECT 'P' || p_partkey AS code_key, CASE WHEN p_partkey % 10 = 0 THEN 'm' ELSE 'u' END AS unit, CASE WHEN p_partkey % 10 = 0 THEN 'again' ELSE p_name || ' ñ' END AS summary, CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice::decimal(18,2)::double END AS price, CASE WHEN p_partkey % 10 = 0 THEN '010125' ELSE '010124' END AS date, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE '3' END AS type FROM part
UNION ALL SELECT 'Q' || p_partkey, 'u', p_name || ' ñ', p_retailprice::decimal(18,2)::double, '010124', '3' FROM part
UNION ALL SELECT DISTINCT 'CB' || replace(p_brand, 'Brand#', ''), 'u', 'BLEND', 1.0, '010124', 'EA' FROM part
UNION ALL SELECT 'F' || n_nationkey || '$', 'u', n_name, NULL, '', '' FROM nation
UNION ALL SELECT DISTINCT 'R' || n_regionkey, '', 'x', NULL, '', '' FROM nation
UNION ALL SELECT 'LB01', 'h', 'LABOURER', 20.35, '', '1' UNION ALL SELECT '%OVH', '%', 'Overheads', NULL, '', '%'
"""


@query(_CONCEPTS)
def q39_catalogue_concepts(spark: SparkSession, folder: str) -> DataFrame:
    return catalogue(spark, folder).concepts.select("code_key", "unit", "summary", F.col("price").cast("double").alias("price"), "date", "type")


_BLENDS = "SELECT 'CB' || replace(p_brand, 'Brand#', '') AS parent_key, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS ord, p_partkey, p_size FROM part"


@query(f"""
WITH b AS ({_BLENDS})
SELECT parent_key, ord::int AS ord, 'P' || p_partkey AS child, 1.0::double AS factor, (p_size / 100.0)::double AS yield FROM b
UNION ALL SELECT parent_key, (count(*) + 1)::int, '%W', 0.05, 1.0 FROM b GROUP BY parent_key
UNION ALL SELECT 'N' || n_nationkey, 0, 'F' || n_nationkey || '$', 1.0, 1.0 FROM nation
UNION ALL SELECT 'R' || n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::int, 'N' || n_nationkey || '#', 1.0, 1.0 FROM nation
UNION ALL SELECT 'ROOT', 0, 'R' || max(n_regionkey) || '#', 1.0, 1.0 FROM nation
""")
def q40_catalogue_links(spark: SparkSession, folder: str) -> DataFrame:
    """Triples of a decomposition: defaults, blank children, a cut-off last triple, later lists."""
    return catalogue(spark, folder).decompositions.select("parent_key", "ord", "child", F.col("factor").cast("double").alias("factor"), F.col("yield").cast("double").alias("yield"))


@query("SELECT 'P' || p_partkey AS code_key, p_name || chr(10) || 'of size ' || p_size AS text FROM part")
def q41_catalogue_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Each concept's text, joined to its concept."""
    c = catalogue(spark, folder)
    return c.texts.join(c.concepts.select("code_key"), "code_key").select("code_key", "text")


@query("SELECT 'FIEBDC-3/2020\\010125' AS version, 0 AS dn, 2 AS dd, 3 AS ds, 4 AS dr, 2 AS di, 2 AS dp, 2 AS dc, 2 AS dm")
def q42_catalogue_properties(spark: SparkSession, folder: str) -> DataFrame:
    c = catalogue(spark, folder)
    return spark.createDataFrame([(c.version(), *c.decimals().values())], "version string, " + ", ".join(f"{k.lower()} int" for k in pricing.DEFAULT_DECIMALS))


@query("""
SELECT 'N' || n_nationkey AS code_key, 'R' || n_regionkey || '#' AS chapters FROM nation
UNION ALL SELECT 'F' || n_nationkey || '$', 'R' || n_regionkey || '# > N' || n_nationkey || '#' FROM nation
UNION ALL SELECT 'old', 'CB' || min(replace(p_brand, 'Brand#', '')::int) || '#' FROM part
""")
def q43_chapter_paths(spark: SparkSession, folder: str) -> DataFrame:
    return items.chapter_paths(catalogue(spark, folder).parents).select("code_key", F.array_join("chapter_path", " > ").alias("chapters"))


@query("SELECT 'F' || n_nationkey || '$' AS code FROM nation WHERE n_regionkey = 1 OR 'F' || n_nationkey BETWEEN 'F2' AND 'F21' OR n_nationkey IN (5, 9)")
def q44_select_families(spark: SparkSession, folder: str) -> DataFrame:
    """The union of a chapter's families at any depth, a range of stems and named families."""
    return items.select_families(catalogue(spark, folder), "R1#", [("F2", "F21")], ["F5", "F9$"])


_OPTIONS = f"""
types AS (SELECT row_number() OVER (ORDER BY p_type) AS a, p_type AS la FROM (SELECT DISTINCT p_type FROM part)),
sizes AS (SELECT row_number() OVER (ORDER BY p_size) AS b, p_size, replace((p_size / 4.0)::decimal(6,2)::varchar, '.', ',') || ' kV' AS lb FROM (SELECT DISTINCT p_size FROM part)),
shifts AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{x}')" for k, x in enumerate(SHIFTS, 1))}) t(c, lc))
"""


@query(f"""
WITH {_OPTIONS}, n AS (SELECT 'F' || n_nationkey || '$' AS code, n_nationkey FROM nation)
SELECT code, 'A' AS var, 'TYPE' AS name, a::int AS option, la AS label FROM n, types
UNION ALL SELECT code, 'B', 'SIZE', b::int, lb FROM n, sizes UNION ALL SELECT code, 'C', 'SHIFT', c::int, lc FROM n, shifts
""")
def q45_family_options(spark: SparkSession, folder: str) -> DataFrame:
    parsed = items.parsed_families(catalogue(spark, folder).families_raw)
    each = parsed.select("code", F.explode("params").alias("p")).select("code", "p.var", "p.name", F.posexplode("p.options").alias("k", "label"))
    return each.select("code", "var", "name", (F.col("k") + 1).alias("option"), "label")


@query(f"""
WITH {_OPTIONS}, s AS (SELECT (SELECT count(*) FROM types) * (SELECT count(*) FROM sizes) * 6 AS n)
SELECT 'F' || n_nationkey || '$' AS code, n AS n_combinations, 'Assign=' || (15 + CASE n_nationkey % 5 WHEN 0 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END) || ', AuxPercent=1, Decomp=8, ParamDef=3' || CASE WHEN n_nationkey % 5 = 4 THEN ', Price=1' ELSE '' END || ', Text=3, TextList=1' AS kinds,
  CASE WHEN n_nationkey % 5 = 1 THEN 'line 1: ignored stray expression ''1+1''' ELSE '' END AS warnings, NULL::int AS error_line FROM nation, s
UNION ALL SELECT DISTINCT 'G' || n_regionkey || '$', 1, '', '', CASE WHEN n_regionkey % 2 = 0 THEN 2 ELSE 11 END FROM nation
""")
def q45_family_programs(spark: SparkSession, folder: str) -> DataFrame:
    """Statements by kind, sizes, warnings, and the line of an error."""
    parsed = items.parsed_families(catalogue(spark, folder).families_raw)
    kinds = F.array_join(F.transform(F.array_sort(F.array_distinct("kinds")), lambda k: F.concat(k, F.lit("="), F.size(F.filter("kinds", lambda x: x == k)).cast("string"))), ", ")
    return parsed.select("code", F.aggregate("counts", F.lit(1).cast("bigint"), lambda a, n: a * n).alias("n_combinations"), kinds.alias("kinds"), F.array_join("warnings", "; ").alias("warnings"), "error_line")


def _ftoa(x: str) -> str:
    return f"CASE WHEN ({x}) = floor({x}) THEN ({x})::bigint::varchar ELSE rtrim(rtrim(printf('%.10f', ({x})::double), '0'), '.') END"


_LETTER = "substr('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', {}::int, 1)"
_MATRIX = ", ".join(f"{x}::double" for x in MATRIX)
_ROWS = f"""
WITH {_OPTIONS}, combos AS (
  SELECT n_nationkey AS k, n_name, n_regionkey AS r, n_nationkey % 5 AS kind, a, la, b, p_size, lb, (p_size / 4.0)::double AS v, c, lc, [{_MATRIX}][((a - 1) * 2 + (c > 3)::int + 1)::int] AS m,
    ((a - 1) * (SELECT count(*) FROM sizes) + b - 1) * 6 + c - 1 AS ordinal FROM nation, types, sizes, shifts
), e AS (
  SELECT *, CASE WHEN kind = 2 AND b = 5 THEN 'evaluation error: division by zero' WHEN kind = 3 AND c > 3 THEN 'evaluation error: index ' || c || ' out of range 1..3 in dimension 1' END AS fault,
    CASE WHEN a = 2 AND c = 3 AND b > 40 THEN 'No ' || lc || ' work with option ' || b END AS excluded FROM combos
), said AS (
  SELECT *, coalesce(fault, excluded) AS error, coalesce(fault, excluded) IS NULL AS valid,
    CASE WHEN fault IS NULL THEN la || ' for ' || lb || ', ' || lc || ' shift' END AS resumen,
    CASE WHEN fault IS NULL THEN 'size ' || lb || ' is ' || {_ftoa("v * 2")} || chr(10) || 'm ' || {_ftoa("m")} || '; r ' || {_ftoa("round((v * 1.15::double)::varchar::decimal(38,18), 1)::double")} || chr(10)
      || 't ' || {_ftoa("round((sin(radians(b)) + cos(radians(b)) + tan(radians(b)) + degrees(atan(b)) + degrees(atan2(b, a)) + degrees(asin(b / 50.0)) - degrees(acos(b / 50.0)) + sqrt(b) + pi())::varchar::decimal(38,18), 6)::double")} || chr(10)
      || 's ' || CASE WHEN b <= 10 THEN 'low' WHEN b <= 30 THEN 'mid' ELSE 'high' END || ', cmp ' || ((la = 'ECONOMY')::int + 2 * (la < 'M')::int + 4 * (v = 1)::int) || chr(10)
      || 'neg ' || (-(b * b) + trunc(-b / 4.0)::bigint + 3) || ' or ' || (a = 1 OR (c = 2 AND b = 3))::int || ' prod 7' || chr(10)
      || 'letters ' || {_LETTER.format("a")} || {_LETTER.format("b")} || {_LETTER.format("c")} || ' 100%' || chr(10) || 'z' || CASE WHEN kind = 0 THEN ' 1' ELSE '' END END AS texto,
    CASE WHEN fault IS NOT NULL THEN '' WHEN kind = 0 THEN 'undefined variable %Z' ELSE 'undefined variable $Y' END AS told FROM e
)
"""
_VALUES = _ROWS + "SELECT 'F' || k || '$' AS family, ordinal, valid, error, resumen, texto, told AS warnings, CASE WHEN fault IS NULL AND kind = 4 THEN v * 10.005::double END AS direct_price, CASE WHEN fault IS NULL THEN (2 * (a = 6)::int) / 100.0::double END AS aux_percent FROM said"


def _values(found: DataFrame) -> DataFrame:
    return found.select("family", "ordinal", "valid", "error", "resumen", "texto", F.array_join("warnings", "; ").alias("warnings"), "direct_price", "aux_percent")


@query(_VALUES)
def q46_language_values(spark: SparkSession, folder: str) -> DataFrame:
    """All operators, functions, templates and errors of the language, by blocks of vectors."""
    return _values(items.evaluations(items.parsed_families(catalogue(spark, folder).families_raw)))


@query(_VALUES)
def q46_language_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The same by programs compiled to JVM plans, one for each of the five programs."""
    bodies = _bodies(*_options(spark, folder))
    nations = table(spark, folder, "nation")
    found = [items.compiled_evaluations(nations.filter(F.col("n_nationkey") % 5 == k).select(F.format_string("F%d$", "n_nationkey").alias("family")), parse(body)) for k, body in bodies.items()]
    return _values(reduce(DataFrame.unionByName, found))


@query(_ROWS + """SELECT 'F' || k || '$' AS family, ordinal, l.ord AS ord, l.code AS code, l.qty AS qty FROM said, LATERAL (
  SELECT (row_number() OVER (ORDER BY pos) - 1)::int AS ord, code, qty FROM (VALUES (1, 'LB01', CASE WHEN c = 1 THEN 0.3333::double + 0.25::double ELSE 0.75::double END), (2, 'CB' || a, m / 10::double * 0.1::double), (3, 'ZZ' || substr('abcdef', a::int, 1), 0.5 * (b > 45)::int::double), (4, 'MT98', 0.00004::double), (5, 'LB%X', 0.1::double), (6, '%OVH', 0.06::double)) t(pos, code, qty) WHERE qty <> 0
) l WHERE fault IS NULL""")
def q46_language_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Decomposition lines of every selection: codes by template, factors, merged codes, zeros dropped."""
    found = items.evaluations(items.parsed_families(catalogue(spark, folder).families_raw))
    return found.select("family", "ordinal", F.explode("lines").alias("l")).select("family", "ordinal", "l.ord", "l.code", "l.qty")


_PRICED = (
    _ROWS
    + f""", blend0 AS (SELECT parent_key, sum(round((coalesce(CASE WHEN p_partkey % 10 <> 0 THEN p.p_retailprice::decimal(18,2) END, 0) * (b.p_size / 100.0)::decimal(18,4))::decimal(38,6), 2))::decimal(18,2) AS base FROM ({_BLENDS}) b JOIN part p USING (p_partkey) GROUP BY 1
), unpriced AS (SELECT parent_key, string_agg('P' || p_partkey || ' has no price', '; ' ORDER BY ord) AS w FROM ({_BLENDS}) WHERE p_partkey % 10 = 0 GROUP BY 1
), blend AS (SELECT parent_key, (base + round((base * 0.05)::decimal(38,6), 2))::decimal(18,2) AS price, concat_ws('; ', w, parent_key || ': computed price ' || (base + round((base * 0.05)::decimal(38,6), 2))::decimal(18,2) || ' differs from declared price 1.000000') AS warning FROM blend0 LEFT JOIN unpriced USING (parent_key)
), l1 AS (
  SELECT s.*, t.price AS cb, t.warning, CASE WHEN c = 1 THEN 0.5833 ELSE 0.75 END::decimal(18,4) AS q1, (m / 100)::decimal(18,4) AS q2 FROM said s JOIN blend t ON t.parent_key = 'CB' || a
), l2 AS (
  SELECT *, round((20.35 * q1)::decimal(38,8), 2) AS a1, round((cb * q2)::decimal(38,8), 2) AS a2 FROM l1
), l3 AS (SELECT *, round((a1 * 0.1)::decimal(38,8), 2) AS a3 FROM l2
), l4 AS (SELECT *, round(((a1 + a2 + a3) * 0.06)::decimal(38,8), 2) AS a4 FROM l3
), l5 AS (SELECT *, CASE WHEN a = 6 THEN round(((a1 + a2 + a3 + a4) * 0.02)::decimal(38,8), 2) ELSE 0 END AS a5 FROM l4)
"""
)


@query(_PRICED + f"""
SELECT 'F' || k || {_LETTER.format("a")} || {_LETTER.format("b")} || {_LETTER.format("c")} AS code, 'F' || k || '$' AS family, 'u' AS unit, n_name AS family_summary, 'R' || r || '# > N' || k || '#' AS chapters, la || '|' || lb || '|' || lc AS labels, resumen, texto, valid, error,
  CASE WHEN valid AND kind <> 4 THEN (a1 + a2)::double END AS direct_cost, CASE WHEN valid AND kind = 4 THEN round((v * 10.005::double)::varchar::decimal(38,18), 2)::double WHEN valid THEN (a1 + a2 + a3 + a4 + a5)::double END AS price,
  CASE WHEN valid AND kind <> 4 THEN 4 + (b > 45)::int + (a = 6)::int ELSE 0 END AS n_lines,
  CASE WHEN valid AND kind <> 4 THEN concat_ws('; ', told, warning, CASE WHEN b > 45 THEN 'unknown concept ZZ' || substr('abcdef', a::int, 1) END) ELSE told END AS warnings, ordinal
FROM l5
""")
def q47_catalogue_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every item of every family, invalid ones included, with its costs and warnings."""
    found = items.items(catalogue(spark, folder), include_invalid=True, ordered=False)
    return found.select("code", "family", "unit", "family_summary", F.array_join("chapter_path", " > ").alias("chapters"), F.array_join(F.transform("parameters", lambda p: p["label"]), "|").alias("labels"), "resumen", "texto", "valid", "error", "direct_cost", "price", F.size("decomposition").alias("n_lines"), F.array_join("warnings", "; ").alias("warnings"), "ordinal")


@query(_PRICED + """
SELECT 'F' || k || '$' AS family, ordinal, l.code, l.unit, l.summary, l.type, l.price::double AS price, l.qty::double AS quantity, l.amount::double AS amount
FROM l5, LATERAL (SELECT * FROM (VALUES ('LB01', 'h', 'LABOURER', '1', 20.35, q1, a1), ('CB' || a, 'u', 'BLEND', 'EA', cb, q2, a2), ('ZZ' || substr('abcdef', a::int, 1), '', '', '', 0, 0.5 * (b > 45)::int, 0), ('LB%X', '%', '', '%', a1, 0.1, a3), ('%OVH', '%', 'Overheads', '%', a1 + a2 + a3, 0.06, a4), ('%', '%', 'Medios auxiliares', '%', a1 + a2 + a3 + a4, 0.02 * (a = 6)::int, a5)) t(code, unit, summary, type, price, qty, amount) WHERE qty <> 0) l
WHERE valid AND kind <> 4
""")
def q48_catalogue_item_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The priced lines of every valid item (the default selection)."""
    found = items.items(catalogue(spark, folder), ordered=False)
    return found.select("family", "ordinal", F.explode("decomposition").alias("l")).select("family", "ordinal", "l.*")


@query(_PRICED + f"SELECT 'F' || k || {_LETTER.format('a')} || {_LETTER.format('b')} || {_LETTER.format('c')} AS code, la || '|' || lb || '|' || lc AS labels, resumen, valid, (a1 + a2 + a3 + a4 + a5)::double AS price FROM l5 WHERE k = 10 AND a = 2 AND b = 3 AND c = 1")
def q49_resolve_code(spark: SparkSession, folder: str) -> DataFrame:
    """One item by its derived code."""
    one = items.resolve(catalogue(spark, folder), "F10bca")
    return one.select("code", F.array_join(F.transform("parameters", lambda p: p["label"]), "|").alias("labels"), "resumen", "valid", "price")


@query(f"""
WITH b AS ({_BLENDS}), p AS (SELECT parent_key, count(*) FILTER (p_partkey % 10 = 0) AS w, sum(round((coalesce(CASE WHEN p_partkey % 10 <> 0 THEN p.p_retailprice::decimal(18,2) END, 0) * (b.p_size / 100.0)::decimal(18,4))::decimal(38,6), 2))::decimal(18,2) AS base FROM b JOIN part p USING (p_partkey) GROUP BY 1)
SELECT parent_key AS code_key, (base + round((base * 0.05)::decimal(38,6), 2))::double AS price, (w + 1)::int AS n_warnings, NULL::varchar AS error FROM p
UNION ALL SELECT 'P' || p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE p_retailprice::decimal(18,2)::double END, (p_partkey % 10 = 0)::int, NULL FROM part
""")
def q50_composite_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Prices of parts and brands: compositions over declared prices, warnings counted."""
    c = catalogue(spark, folder)
    links = c.decompositions.filter(F.startswith("parent_key", F.lit("CB"))).withColumn("child", code_key(F.col("child")))
    own = c.concepts.filter("code_key rlike '^(P|CB)[0-9]'")
    found = pricing.priced_concepts(own, links, c.decimals()).filter("code_key not like '\\%%'")
    return found.select("code_key", F.col("price").cast("double").alias("price"), F.size("warnings").alias("n_warnings"), "error")
