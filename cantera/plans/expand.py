"""Cartesian expansion of option lists without a cross join, and derived codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import family_stem, option_letter, option_number

#: Rows of one generated block; a family of any number of combinations spreads over blocks.
BLOCK = 4096
#: So many leading selections of ``coded_combinations`` make one row of work.
LEADS = 256


def combinations(df: DataFrame, counts: str) -> DataFrame:
    """Each row times its combinations: ``ordinal`` and ``selection`` (1-based option numbers).

    ``counts`` is an array of option counts; the last parameter runs fastest, no parameters
    give one empty selection, a parameter without options gives none.  Families are cut into
    blocks of 4,096 ordinals and spread, so that one huge family is not one task.
    """
    total = F.aggregate(F.coalesce(F.col(counts), F.array().cast("array<int>")), F.lit(1).cast("bigint"), lambda a, x: a * x)
    blocks = df.withColumn("_n", total).filter("_n > 0").withColumn("_block", F.explode(F.expr(f"sequence(0L, (_n - 1) div {BLOCK})")))
    spread = blocks.repartition("_block", *[c for c in df.columns if dict(df.dtypes)[c] == "string"][:1])
    rows = spread.withColumn("ordinal", F.explode(F.expr(f"sequence(_block * {BLOCK}L, least(_n, (_block + 1) * {BLOCK}L) - 1)")))
    step = F.expr(f"transform(sequence(1, size({counts})), i -> cast((ordinal div aggregate(slice({counts}, i + 1, size({counts})), 1L, (a, x) -> a * x)) % {counts}[i - 1] + 1 as int))")
    none = F.array().cast("array<int>")
    return rows.withColumn("selection", F.when(F.size(counts) > 0, step).otherwise(none)).drop("_n", "_block")


def coded_combinations(families: DataFrame, family: str, params: str) -> DataFrame:
    """``family, ordinal, derived_code, labels`` of every combination of all parameters.

    ``params`` is an array of structs with ``options``; order and ordinals are those of
    ``combinations``, labels are joined by ``|``.  The last parameters, as many as have at most
    4,096 selections together, are spelled once per row of work; each leading selection then
    costs two concatenations a combination, without a shuffle of what comes out.
    """
    given = F.coalesce(F.col(params), F.array().cast(families.schema[params].dataType))
    sized = families.select(F.col(family).alias("family"), given.alias("params")).withColumn("counts", F.transform("params", lambda p: F.size(p["options"])))
    start = "named_struct('n', 1L, 'k', 0, 'open', true)"
    step = f"if(a.open and a.n * x <= {BLOCK}, named_struct('n', a.n * x, 'k', a.k + 1, 'open', true), named_struct('n', a.n, 'k', a.k, 'open', false))"
    some = sized.filter(~F.exists("counts", lambda x: x < 1)).withColumn("last", F.expr(f"aggregate(reverse(counts), {start}, (a, x) -> {step})"))
    parted = some.withColumn("n_lead", F.expr("aggregate(slice(counts, 1, size(counts) - last.k), 1L, (a, x) -> a * x)"))
    work = parted.withColumn("block", F.explode(F.expr(f"sequence(0L, (n_lead - 1) div {LEADS})"))).repartition("block", "family")

    def spelled(option: Column, number: Column) -> Column:
        return F.struct(F.coalesce(option_letter(number), F.lit("")).alias("letters"), F.coalesce(F.concat(F.lit("|"), option), F.lit("")).alias("labels"))

    def joined(a: Column, b: Column) -> Column:
        return F.struct(F.concat(a["letters"], b["letters"]).alias("letters"), F.concat(a["labels"], b["labels"]).alias("labels"))

    none = F.struct(F.lit("").alias("letters"), F.lit("").alias("labels"))
    own = F.transform("params", lambda p: F.transform(p["options"], lambda o, i: spelled(o, i + 1)))
    work = work.select("family", "block", "counts", "last", "n_lead", own.alias("own"))
    tails = F.aggregate(F.expr("slice(own, size(own) - last.k + 1, last.k)"), F.array(none), lambda a, p: F.flatten(F.transform(a, lambda x: F.transform(p, lambda y: joined(x, y)))))
    work = work.withColumn("tails", tails).withColumn("lead", F.explode(F.expr(f"sequence(block * {LEADS}L, least(n_lead, (block + 1) * {LEADS}L) - 1)")))
    digit = "own[i][cast((lead div aggregate(slice(counts, i + 2, size(counts) - last.k - i - 1), 1L, (a, x) -> a * x)) % counts[i] as int)]"
    chosen = F.expr(f"transform(filter(sequence(0, size(counts)), i -> i < size(counts) - last.k), i -> {digit})")
    head = work.select("family", "lead", F.col("last.n").alias("n"), "tails", F.aggregate(chosen, none, joined).alias("head"))
    rows = head.select("family", "lead", "n", F.concat(family_stem(F.col("family")), "head.letters").alias("code"), F.col("head.labels").alias("labels"), F.posexplode("tails").alias("at", "tail"))
    return rows.select("family", (F.col("lead") * F.col("n") + F.col("at")).alias("ordinal"), F.concat("code", "tail.letters").alias("derived_code"), F.substring(F.concat("labels", "tail.labels"), 2, 1 << 30).alias("labels"))


def derived_code(family: Column, selection: Column) -> Column:
    """The family's stem and a letter per selected option."""
    return F.concat(family_stem(family), F.array_join(F.transform(selection, option_letter), ""))


def split_derived(codes: DataFrame, code: str, families: DataFrame, family: str) -> DataFrame:
    """The codes with ``family`` (longest stem that is a proper prefix) and ``selection``.

    An equi-join on the exploded prefixes of each code; codes without a family are dropped,
    letters outside the alphabet give null options.
    """
    stems = families.select(F.col(family).alias("family"), family_stem(F.col(family)).alias("stem")).distinct()
    cut = codes.withColumn("at", F.explode(F.expr(f"sequence(1, length({code}) - 1)"))) if code in codes.columns else codes
    prefixed = cut.filter(F.length(code) > 1).withColumn("stem", F.substring(F.col(code), F.lit(1), F.col("at")))
    best = prefixed.join(stems, "stem").groupBy(*codes.columns).agg(F.max_by(F.struct("family", "stem"), F.length("stem")).alias("m"))
    letters = F.split(F.substring(F.col(code), F.length("m.stem") + 1, F.lit(1000)), "")
    chosen = F.transform(F.filter(letters, lambda x: x != ""), option_number)
    return best.select(*codes.columns, F.col("m.family").alias("family"), chosen.alias("selection"))


def select_families(families: DataFrame, code: str, ranges: list[tuple[str, str]] = (), names: list[str] = ()) -> DataFrame:
    """``code``: the union of inclusive stem ranges and named families (``$`` optional).

    Raises ValueError for a name that is no family and for an empty selection.
    """
    own = families.select(F.col(code).alias("code")).distinct()
    wanted = F.lit(False)
    for low, high in ranges:
        wanted = wanted | family_stem(F.col("code")).between(family_stem(F.lit(low)), family_stem(F.lit(high)))
    named = [n if n.endswith("$") else f"{n}$" for n in names]
    if named:
        found = {r[0] for r in own.filter(F.col("code").isin(named)).collect()}
        if missing := sorted(set(named) - found):
            raise ValueError(f"unknown families: {', '.join(missing)}")
        wanted = wanted | F.col("code").isin(named)
    chosen = own.filter(wanted)
    if not chosen.limit(1).count():
        raise ValueError("no family is selected")
    return chosen
