"""From a catalogue to priced items: parse, expand, evaluate, price, assemble."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import code_key, is_percentage, option_letter
from ..lang import columns, vectors
from ..lang.syntax import Program, SyntaxFault, parse
from ..operators import hierarchy
from ..session import Cut, cut, some
from ..sources.records import Catalog
from . import expand, pricing

PARSED = "code string, program string, counts array<int>, params array<struct<var:string,name:string,options:array<string>,line:int>>, kinds array<string>, warnings array<string>, error string, error_line int"
EVALUATED = "family string, ordinal bigint, selection array<int>, valid boolean, error string, resumen string, texto string, lines array<struct<ord:int,code:string,qty:double>>, direct_price double, aux_percent double, warnings array<string>"
SHOWN = "array<struct<code:string,unit:string,summary:string,type:string,price:double,quantity:double,amount:double>>"
KINDS = {"let": "Assign", "line": "Decomp", "price": "Price", "aux": "AuxPercent", "text": "Text", "list": "TextList"}


def parsed_families(families_raw: DataFrame) -> DataFrame:
    """Each family's program as JSON with its parameters and warnings, or its error and line."""
    kind = pa.schema([
        ("code", pa.string()), ("program", pa.string()), ("counts", pa.list_(pa.int32())), ("params", pa.list_(pa.struct([("var", pa.string()), ("name", pa.string()), ("options", pa.list_(pa.string())), ("line", pa.int32())]))), ("kinds", pa.list_(pa.string())), ("warnings", pa.list_(pa.string())), ("error", pa.string()), ("error_line", pa.int32()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for code, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    p = parse(body or "")
                    rows.append({"code": code, "program": p.to_json(), "counts": p.counts(), "params": p.params, "kinds": ["ParamDef"] * len(p.params) + [KINDS[s[0]] for s in p.statements], "warnings": p.warnings})
                except SyntaxFault as e:
                    rows.append({"code": code, "counts": [], "params": [], "kinds": [], "warnings": [], "error": e.message, "error_line": e.line})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return families_raw.select("code", "body").mapInArrow(run, PARSED)


def evaluations(parsed: DataFrame) -> DataFrame:
    """Every selection of every parsed family, evaluated in spread blocks of ordinals.

    A family that does not parse gives no rows; one without parameters gives one.
    """
    total = F.aggregate("counts", F.lit(1).cast("bigint"), lambda a, n: a * n)
    blocked = parsed.filter("program is not null").withColumn("_n", total).filter("_n > 0")
    size = expand.BLOCK
    each = blocked.select(F.col("code").alias("family"), "program", "_n", F.explode(F.expr(f"sequence(0L, (_n - 1) div {size})")).alias("_block"))
    spread = each.repartition("family", "_block").select("family", "program", (F.col("_block") * size).alias("first"), F.least("_n", (F.col("_block") + 1) * size).alias("until"))
    return spread.mapInArrow(vectors.evaluate, EVALUATED)


def compiled_evaluations(families: DataFrame, program: Program) -> DataFrame:
    """The evaluations of all families (``family``) of one program as a single JVM plan (the
    programs of the other backend)."""
    counts = F.array(*[F.lit(n) for n in program.counts()]).cast("array<int>")
    return columns.evaluations(expand.combinations(families.select("family", counts.alias("counts")), "counts").drop("counts"), program)


def chapter_paths(parents: DataFrame) -> DataFrame:
    """``code_key, chapter_path``: the chapters above each child from the top, the root left out.

    Chapters hang below each other to any depth; where one contains itself, the path of what
    hangs there goes up as far as the first chapter that would come twice.
    """
    links = parents.select("parent", F.col("child_key").alias("child"), F.lit(0).alias("line_no"))
    chains, cyclic = hierarchy.decompose(links)
    upward = hierarchy.placed(chains).select(F.col("node_key").alias("code_key"), F.slice("upward", 1, F.size("upward") - 1).alias("upward")).filter("size(upward) > 0")
    up = parents.select(hierarchy.clean_key(F.col("child_key")).alias("key"), "parent")
    if not cyclic.isEmpty():
        own = up.withColumn("over", hierarchy.clean_key(F.col("parent")))
        climbing = Cut(cyclic.select(F.col("node_key").alias("code_key"), F.col("node_key").alias("key"), F.array("node_key").alias("seen")), n=F.count(F.lit(1)))
        while climbing.counts["n"]:
            now = climbing.rows.join(own.select("key", "over"), "key").withColumn("again", F.array_contains("seen", F.col("over")))
            step = Cut(now, n=some("not again"))
            upward = upward.unionByName(step.rows.filter("again").select("code_key", F.reverse(F.slice("seen", 2, F.size("seen") - 1)).alias("upward")))
            if not step.counts["n"]:
                break
            climbing = Cut(step.rows.filter("not again").select("code_key", F.col("over").alias("key"), F.array_append("seen", F.col("over")).alias("seen")), n=F.count(F.lit(1)))
    names = up.select(hierarchy.clean_key(F.col("parent")).alias("key"), "parent").distinct().groupBy("key").agg(F.min("parent").alias("name"))
    named = upward.select("code_key", F.posexplode("upward").alias("at", "key")).join(names, "key").filter(~F.col("name").endswith("##"))
    listed = named.groupBy("code_key").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("c"))
    return listed.select("code_key", F.transform("c", lambda x: x["name"]).alias("chapter_path"))


def chapter_families(catalog: Catalog, chapter: str) -> DataFrame:
    """``code``: the families anywhere below a chapter; ValueError if nothing hangs below it.

    Whatever the links look like (shared parts, cycles), each code is reached once: a round
    adds the children of the codes that the last one added.
    """
    top = chapter.strip().rstrip("#")
    links = Cut(catalog.decompositions.select("parent_key", "child", code_key(F.col("child")).alias("key")).distinct()).rows
    found = Cut(links.filter(F.col("parent_key") == top).select("child", "key").distinct(), n=F.count(F.lit(1)))
    if not found.counts["n"]:
        raise ValueError(f"nothing hangs below {chapter}")
    new = found
    while new.counts["n"]:
        below = links.join(new.rows.select(F.col("key").alias("parent_key")).distinct(), "parent_key", "left_semi").select("child", "key").distinct()
        new = Cut(below.join(found.rows, ["child", "key"], "left_anti"), n=F.count(F.lit(1)))
        found = Cut(found.rows.unionByName(new.rows)) if new.counts["n"] else found
    return catalog.families_raw.select("code").join(found.rows.select(F.col("child").alias("code")), "code", "left_semi")


def select_families(catalog: Catalog, chapter: str | None = None, ranges: list[tuple[str, str]] = (), names: list[str] = ()) -> DataFrame:
    """``code``: the union of a chapter's families, stem ranges and named families."""
    chosen = None
    if ranges or names:
        chosen = expand.select_families(catalog.families_raw, "code", ranges, names)
    if chapter:
        below = chapter_families(catalog, chapter)
        chosen = below if chosen is None else chosen.union(below).distinct()
    if chosen is None or not chosen.limit(1).count():
        raise ValueError("no family is selected")
    return chosen


def _priced(catalog: Catalog, evaluated: DataFrame, decimals: dict[str, int]) -> DataFrame:
    """``family, ordinal, lines`` with the concept of each line of the valid rows."""
    quantity = pricing.rounded(pricing.exact(F.col("l.qty")), decimals["DR"])
    aux = F.when(F.coalesce("aux_percent", F.lit(0.0)) != 0, F.array(F.struct(F.lit(1 << 30).alias("ord"), F.lit("%").alias("code"), F.col("aux_percent").alias("qty")))).otherwise(F.array().cast("array<struct<ord:int,code:string,qty:double>>"))
    lines = evaluated.filter("valid and direct_price is null").select("family", "ordinal", F.explode(F.concat("lines", aux)).alias("l")).select("family", "ordinal", "l.ord", "l.code", quantity.alias("quantity")).filter("quantity <> 0")
    concepts = pricing.priced_concepts(catalog.concepts, catalog.decompositions.withColumn("child", code_key(F.col("child"))), decimals)
    known = concepts.select(F.col("code_key").alias("line_key"), "unit", "summary", "type", "price", "warnings", F.col("error").alias("cycle"), F.lit(True).alias("found"))
    joined = lines.withColumn("line_key", code_key(F.col("code"))).join(known, "line_key", "left")
    share, missing = is_percentage(F.col("code")), F.col("found").isNull()
    unit = F.when(share & (F.coalesce("unit", F.lit("")) == ""), "%").otherwise(F.coalesce("unit", F.lit("")))
    summary = F.when(missing & (F.col("code") == "%"), "Medios auxiliares").otherwise(F.coalesce("summary", F.lit("")))
    kind = F.when(missing & share, "%").otherwise(F.coalesce("type", F.lit("")))
    warning = F.when(missing & ~share, F.concat(F.lit("unknown concept "), "code")).when(F.size("warnings") > 0, F.array_join("warnings", "; "))
    line = F.struct("ord", "code", unit.alias("unit"), summary.alias("summary"), kind.alias("type"), F.coalesce("price", F.lit(0)).cast(pricing.MONEY).alias("price"), F.col("quantity").cast(pricing.MONEY).alias("quantity"), warning.alias("warning"), F.when(~share, F.col("cycle")).alias("cycle"))
    return joined.groupBy("family", "ordinal").agg(F.array_sort(F.collect_list(line)).alias("found"))


def items(catalog: Catalog, families: DataFrame | None = None, include_invalid: bool = False, with_decomposition: bool = True, ordered: bool = True) -> DataFrame:
    """The items of the families (all by default): the fourteen output columns, ``ordinal`` last.

    Evaluation runs once, in spread blocks; concept prices are worked out once and joined.
    """
    decimals = catalog.decimals()
    raw = catalog.families_raw if families is None else catalog.families_raw.join(families.select("code"), "code", "left_semi")
    parsed = cut(parsed_families(raw))
    evaluated = evaluations(parsed)
    evaluated = cut(evaluated if include_invalid else evaluated.filter("valid"))
    full = evaluated.join(_priced(catalog, evaluated, decimals), ["family", "ordinal"], "left")
    no_lines = F.array().cast(f"array<{pricing.LINE}>")
    has = F.col("valid") & F.col("direct_price").isNull()
    folded = F.when(has & F.col("found").isNotNull(), pricing.fold_lines(F.col("found"), decimals)).otherwise(no_lines)
    cycle = F.element_at(F.filter(F.transform("found", lambda x: x["cycle"]), lambda c: c.isNotNull()), 1)
    cycle = F.when(F.size(F.filter(F.coalesce("found", F.array()), lambda x: x["cycle"].isNotNull())) > 0, cycle)
    priced = full.withColumn("cycle", cycle).withColumn("lines", F.when(F.col("cycle").isNull(), folded).otherwise(no_lines))
    fine = F.col("valid") & F.col("cycle").isNull()
    direct = F.when(fine & F.col("direct_price").isNull(), pricing.lines_total(F.col("lines"), decimals["DP"], shares=False))
    price = F.when(fine & F.col("direct_price").isNotNull(), pricing.rounded(pricing.exact(F.col("direct_price")), decimals["DC"])).when(fine, pricing.lines_total(F.col("lines"), decimals["DC"]))
    from_lines = F.filter(F.transform("lines", lambda x: x["warning"]), lambda w: w.isNotNull())
    shown = F.transform("lines", lambda x: F.struct(x["code"].alias("code"), x["unit"].alias("unit"), x["summary"].alias("summary"), x["type"].alias("type"), x["price"].cast("double").alias("price"), x["quantity"].cast("double").alias("quantity"), x["amount"].cast("double").alias("amount")))
    paths = chapter_paths(catalog.parents)
    own = catalog.concepts.select(F.col("code_key").alias("family_key"), "unit", "summary")
    params = F.transform(F.arrays_zip("params", "selection"), lambda z: F.struct(z["params"]["var"].alias("var"), z["params"]["name"].alias("name"), z["selection"].alias("option"), option_letter(z["selection"]).alias("letter"), F.coalesce(F.get(z["params"]["options"], z["selection"] - 1), F.lit("")).alias("label")))
    out = (
        priced.join(parsed.select(F.col("code").alias("family"), "params"), "family")
        .withColumn("family_key", code_key(F.col("family")))
        .join(own, "family_key", "left")
        .join(paths.withColumnRenamed("code_key", "family_key"), "family_key", "left")
        .select(
            expand.derived_code(F.col("family"), F.col("selection")).alias("code"), "family", F.coalesce("unit", F.lit("")).alias("unit"), F.coalesce("summary", F.lit("")).alias("family_summary"), F.coalesce("chapter_path", F.array().cast("array<string>")).alias("chapter_path"), params.alias("parameters"), "resumen", "texto", fine.alias("valid"), F.coalesce("error", F.when(F.col("cycle").isNotNull(), F.concat(F.lit("pricing error: "), "cycle"))).alias("error"), direct.cast("double").alias("direct_cost"), price.cast("double").alias("price"), (shown if with_decomposition else F.array().cast(SHOWN)).alias("decomposition"), F.concat("warnings", from_lines).alias("warnings"), "ordinal",
        )
    )
    return out.orderBy("family", "ordinal") if ordered else out


def resolve(catalog: Catalog, code: str, selection: list[int] | None = None, with_decomposition: bool = True) -> DataFrame:
    """The single item of a derived code, or of a family and a selection.

    Raises ValueError for an unknown code and for options out of range.
    """
    spark = catalog.spark
    if selection is None:
        found = expand.split_derived(spark.createDataFrame([(code,)], "code string"), "code", catalog.families_raw.select("code"), "code").first()
        if found is None or None in found["selection"]:
            raise ValueError(f"no family of {code}")
        family, selection = found["family"], list(found["selection"])
    else:
        family = code if code.endswith("$") else f"{code}$"
    one = catalog.families_raw.filter(F.col("code") == family)
    parsed = parsed_families(one).select("counts", "error").first()
    if parsed is None or parsed["error"]:
        raise ValueError(f"unknown family {family}" if parsed is None else parsed["error"])
    counts = parsed["counts"]
    if len(counts) != len(selection) or any(not 1 <= k <= n for k, n in zip(selection, counts)):
        raise ValueError(f"{family} has options {counts}, not {selection}")
    ordinal = 0
    for k, n in zip(selection, counts):
        ordinal = ordinal * n + k - 1
    return items(catalog, one.select("code"), include_invalid=True, with_decomposition=with_decomposition).filter(F.col("ordinal") == ordinal)


def json_lines(found: DataFrame) -> DataFrame:
    """``value``: items as JSON text in the fixed field order, nulls written."""
    fields = [c for c in found.columns if c != "ordinal"]
    return found.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))

