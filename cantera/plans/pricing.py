"""Exact pricing of ordered lines, percentage lines and nested compositions.

Lines stay arrays: a percentage line needs the rounded amounts before it, so each item is a
fold over its own short array, without a shuffle.  Compositions are priced level by level,
each level a table of its own, joined with the prices known so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_percentage, percentage_prefix
from ..session import Cut, cut

MONEY = "decimal(18,6)"
#: Decimals of quantities, amounts, prices and totals unless a catalogue says otherwise.
DEFAULT_DECIMALS = {"DN": 2, "DD": 2, "DS": 2, "DR": 3, "DI": 2, "DP": 2, "DC": 2, "DM": 2}
LINE = "struct<code:string,unit:string,summary:string,type:string,price:decimal(18,6),quantity:decimal(18,6),amount:decimal(18,6),warning:string>"


def exact(value: Column) -> Column:
    """A double as the decimal of its shortest text."""
    return value.cast("decimal(38,18)")


def rounded(value: Column, places: int) -> Column:
    """Half-up rounding to places (away from zero for negatives)."""
    return F.round(value, places).cast(MONEY)


def fold_lines(lines: Column, decimals: dict[str, int] = DEFAULT_DECIMALS) -> Column:
    """Priced lines from ordered ``struct<code, unit, summary, type, price, quantity, warning>``.

    Quantities are rounded first and lines of quantity zero dropped.  A percentage line's price
    is the rounded sum of the amounts before it whose code begins with its prefix, earlier
    percentage lines included.
    """
    dr, di = decimals["DR"], decimals["DI"]

    def step(done: Column, line: Column) -> Column:
        prefix = percentage_prefix(line["code"])
        base = F.aggregate(F.filter(done, lambda x: F.startswith(x["code"], prefix)), F.lit(0).cast("decimal(38,6)"), lambda a, x: (a + x["amount"]).cast("decimal(38,6)"))
        share = is_percentage(line["code"])
        price = F.when(share, rounded(base, di)).otherwise(line["price"].cast(MONEY))
        quantity = rounded(line["quantity"], dr)
        one = F.struct(
            line["code"].alias("code"), line["unit"].alias("unit"), line["summary"].alias("summary"), line["type"].alias("type"), price.alias("price"), quantity.alias("quantity"), rounded(price * quantity, di).alias("amount"), F.when(~share, line["warning"]).alias("warning"),
        ).cast(LINE)
        return F.when(quantity == 0, done).otherwise(F.array_append(done, one))

    return F.aggregate(lines, F.array().cast(f"array<{LINE}>"), step)


def lines_total(lines: Column, places: int, shares: bool = True) -> Column:
    """The rounded sum of amounts, without percentage lines if ``shares`` is false."""
    kept = lines if shares else F.filter(lines, lambda x: ~is_percentage(x["code"]))
    return rounded(F.aggregate(kept, F.lit(0).cast("decimal(38,6)"), lambda a, x: (a + x["amount"]).cast("decimal(38,6)")), places)


def priced_concepts(concepts: DataFrame, decompositions: DataFrame, decimals: dict[str, int] = DEFAULT_DECIMALS) -> DataFrame:
    """``code_key, unit, summary, type, price, warnings, error`` of every concept and every
    decomposed or referenced code.

    concepts: ``code_key, unit, summary, price, type``; decompositions: ``parent_key, ord, child``
    (key) ``, factor, yield``.  A decomposed concept costs what its lines cost, whatever price it
    declares (a difference is a warning); an undeclared code costs 0 with a warning, so does
    one without price.  Codes that never resolve depend on a cycle and get an error.  Each
    round resolves all codes whose children are known.
    """
    quantity = (F.col("factor") * F.col("yield")).cast("decimal(38,12)")
    refs = decompositions.filter("child is not null and child <> ''").select("parent_key", "ord", F.col("child").alias("child_key"), rounded(quantity, decimals["DR"]).alias("quantity"))
    refs = cut(refs)
    # lines of quantity zero are dropped before any lookup, so they neither block nor warn
    live = refs.filter("quantity <> 0")
    declared = concepts.select("code_key", "unit", "summary", "type", F.col("price").cast(MONEY).alias("declared"), F.lit(True).alias("known"))
    parents = refs.select(F.col("parent_key").alias("code_key")).distinct()
    keys = declared.select("code_key").union(parents).union(live.select("child_key")).distinct()
    every = keys.join(declared, "code_key", "left").join(parents.withColumn("composed", F.lit(True)), "code_key", "left")
    every = cut(every.select("code_key", F.coalesce("unit", F.lit("")).alias("unit"), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("type", F.lit("")).alias("type"), "declared", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("composed", F.lit(False)).alias("composed")))
    none = F.array().cast("array<string>")
    warning = F.when(~F.col("known"), F.array(F.concat(F.lit("unknown concept "), "code_key"))).when(F.col("declared").isNull() & ~is_percentage(F.col("code_key")), F.array(F.concat(F.col("code_key"), F.lit(" has no price")))).otherwise(none)
    done = cut(every.filter("not composed").select("code_key", "unit", "summary", "type", F.coalesce("declared", F.lit(0)).cast(MONEY).alias("price"), warning.alias("warnings")))
    waiting = every.filter("composed")
    left = waiting.count()
    while left:
        todo = waiting.join(done.select("code_key"), "code_key", "left_anti")
        lines = live.join(todo.select(F.col("code_key").alias("parent_key")), "parent_key", "left_semi")
        found = lines.join(done.withColumnRenamed("code_key", "child_key"), "child_key", "left")
        share = is_percentage(F.col("child_key"))
        one = F.struct("ord", F.col("child_key").alias("code"), F.coalesce("unit", F.lit("%")).alias("unit"), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("type", F.lit("%")).alias("type"), "price", "quantity", F.when(F.size("warnings") > 0, F.array_join("warnings", "; ")).alias("warning"))
        ready = found.groupBy("parent_key").agg(F.array_sort(F.collect_list(one)).alias("lines"), F.bool_and(share | F.col("price").isNotNull()).alias("ready"))
        empty = todo.join(live.select(F.col("parent_key").alias("code_key")).distinct(), "code_key", "left_anti").select("code_key", F.array().cast(ready.schema["lines"].dataType).alias("lines"))
        priced = ready.filter("ready").select(F.col("parent_key").alias("code_key"), "lines").unionByName(empty).withColumn("lines", fold_lines(F.col("lines"), decimals)).withColumn("price", lines_total(F.col("lines"), decimals["DC"]))
        differs = F.col("declared").isNotNull() & (F.col("declared") != F.col("price"))
        message = F.concat(F.col("code_key"), F.lit(": computed price "), F.col("price").cast(f"decimal(18,{decimals['DC']})").cast("string"), F.lit(" differs from declared price "), F.col("declared").cast("string"))
        own = F.filter(F.transform("lines", lambda x: x["warning"]), lambda w: w.isNotNull())
        level = priced.join(waiting, "code_key").select("code_key", "unit", "summary", "type", "price", F.concat(own, F.when(differs, F.array(message)).otherwise(none)).alias("warnings"))
        level = Cut(level, n=F.count(F.lit(1)))
        if not level.counts["n"]:
            break
        done, left = done.unionByName(level.rows), left - level.counts["n"]
    stuck = every.join(done.select("code_key"), "code_key", "left_anti").select("code_key", "unit", "summary", "type", F.lit(None).cast(MONEY).alias("price"), none.alias("warnings"), F.concat(F.lit("decomposition cycle at "), "code_key").alias("error"))
    return done.withColumn("error", F.lit(None).cast("string")).unionByName(stuck)
