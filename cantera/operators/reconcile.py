"""Field-by-field comparison of two item sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, undo_corruption


def classify(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """``key, class`` over both sets: exact, whitespace, corruption, other, only_left, only_right.

    Classes are tried in this order; a null text counts as empty.
    """
    a = left.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("a"), F.lit(True).alias("in_a"))
    b = right.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("b"), F.lit(True).alias("in_b"))
    kind = (
        F.when(F.col("in_b").isNull(), "only_left")
        .when(F.col("in_a").isNull(), "only_right")
        .when(F.col("a") == F.col("b"), "exact")
        .when(collapse(F.col("a")) == collapse(F.col("b")), "whitespace")
        .when(undo_corruption(F.col("a")) == undo_corruption(F.col("b")), "corruption")
        .otherwise("other")
    )
    return a.join(b, "key", "full_outer").select("key", kind.alias("class"), "a", "b")


def summary(classified: DataFrame) -> DataFrame:
    """``class, n``."""
    return classified.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def report(classified: DataFrame, title: str, samples: int = 3) -> str:
    """A Markdown report: the counts and some differing texts of each class."""
    lines = [f"# {title}", "", "| class | n |", "|---|---|"]
    for row in summary(classified).orderBy("class").collect():
        lines.append(f"| {row['class']} | {row['n']} |")
    for kind in ("whitespace", "corruption", "other"):
        shown = classified.filter(F.col("class") == kind).orderBy("key").limit(samples).collect()
        if shown:
            lines += ["", f"## {kind}", ""] + [f"- `{r['key']}`: {r['a']!r} / {r['b']!r}" for r in shown]
    return "\n".join(lines) + "\n"
