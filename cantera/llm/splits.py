"""Train, validation and test splits that keep related records together.

Grouped iterative stratification: connected components of records that share a key are found
by alternating star contractions, their label vectors are aggregated, and whole components
are placed, those with the rarest outstanding label first, into the split that needs that
label most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import Cut


def parent_edges(df: DataFrame, parent: str, item: str) -> DataFrame:
    """``u, v``: links between parents that share a non-null item, each to the smallest one."""
    pairs = df.select(F.col(parent).alias("p"), F.col(item).alias("i")).filter("p is not null and i is not null").distinct()
    least = pairs.groupBy("i").agg(F.min("p").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("i", "v")
    return pairs.join(least, "i").filter("p <> v").select(F.col("p").alias("u"), "v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node with an edge; root is the component's smallest node.

    Large-star and small-star steps alternate until the edge set stays the same; the number
    of edges never grows and the rounds are logarithmic for the usual graphs.
    """
    same = {"n": F.count(F.lit(1)), "mark": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    held, before = Cut(edges.select("u", "v").filter("u <> v"), **same), None
    while held.counts != before:
        edges, before = held.rows, held.counts
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        last, held = held, Cut(small.filter("u <> v").distinct(), **same)
        last.drop()
    edges = held.rows
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def related_parents(df: DataFrame, parent: str, item: str) -> DataFrame:
    """``parent_a, parent_b`` (a < b): all pairs of parents whose rows must share a split."""
    stars = components(parent_edges(df, parent, item))
    other = stars.select(F.col("node").alias("parent_b"), "root")
    return stars.select(F.col("node").alias("parent_a"), "root").join(other, "root").filter("parent_a < parent_b").select("parent_a", "parent_b")


def record_groups(df: DataFrame, record_id: str, parent: str, item: str, label: Column) -> DataFrame:
    """``record_id, component, label`` of every row.

    A row without a parent goes with the rows of its item, a row without both keys stands
    alone; repeated ids keep all their rows.
    """
    rows = df.select(F.col(record_id).alias("record_id"), F.col(parent).alias("p"), F.col(item).alias("i"), F.coalesce(label.cast("string"), F.lit("")).alias("label"))
    stars = components(parent_edges(df, parent, item)).select(F.col("node").alias("p"), "root")
    least = rows.filter("p is not null and i is not null").groupBy("i").agg(F.min("p").alias("q"))
    orphan = rows.filter("p is null and i is not null").join(least, "i", "left").select("record_id", F.col("q").alias("p"), "i", "label")
    bare = rows.filter("p is null and i is null")
    held = rows.filter("p is not null").select("record_id", "p", "i", "label").unionByName(orphan).join(stars, "p", "left")
    own = F.coalesce(F.concat(F.lit("p:"), F.coalesce("root", "p")), F.concat(F.lit("i:"), F.col("i")))
    return held.select("record_id", own.alias("component"), "label").unionByName(bare.select("record_id", F.concat(F.lit("r:"), F.col("record_id").cast("string")).alias("component"), "label"))


def label_order(sets: dict[tuple[str, ...], dict[str, int]]) -> list[str]:
    """Labels as iterative stratification takes them: each time the one with the fewest rows in
    components not yet placed.  Given are the rows of each label by set of labels of a component."""
    total: dict[str, int] = {}
    for rows in sets.values():
        for label, n in rows.items():
            total[label] = total.get(label, 0) + n
    left, out = dict(sets), []
    while any(n > 0 for n in total.values()):
        label = min((x for x in total if total[x] > 0), key=lambda x: (total[x], x))
        out.append(label)
        for held in [k for k in left if label in k]:
            for x, n in left.pop(held).items():
                total[x] -= n
    return out


def shares(need: list[float], room: list[float], each: int, copies: int) -> list[int]:
    """How many of equal components go to each split so that the one with the most need always
    takes the next; ties go to the one with more room.  Worked out without a step for each."""
    low, high = min(need) - each * (copies + 1), max(need)
    for _ in range(200):
        level = (low + high) / 2
        if sum(max(0, math.ceil((n - level) / each)) for n in need) > copies:
            low = level
        else:
            high = level
        if high - low < each * 1e-9:
            break
    out = [max(0, math.ceil((n - high) / each)) for n in need]
    while sum(out) < copies:
        k = max(range(len(need)), key=lambda k: (need[k] - each * out[k], room[k], -k))
        out[k] += 1
    return out


class Placing:
    """What each split still needs of each label, and of rows in all."""

    def __init__(self, totals: dict[str, int], ratios: dict[str, float]) -> None:
        self.splits = list(ratios)
        self.need = {x: [r * n for r in ratios.values()] for x, n in totals.items()}
        self.room = [r * sum(totals.values()) for r in ratios.values()]

    def take(self, vector: dict[str, int], label: str, copies: int) -> list[int]:
        """Where the components of one label vector go, placed by the label."""
        out = shares(self.need[label], self.room, vector[label], copies)
        for x, n in vector.items():
            self.need[x] = [a - n * k for a, k in zip(self.need[x], out)]
        self.room = [a - sum(vector.values()) * k for a, k in zip(self.room, out)]
        return out


def grouped_splits(groups: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """``record_id, component, split`` for rows ``record_id, component, label``.

    Rows of one component share their split.  Components of equal label vectors are placed
    together, by how many go where, and dealt out by their rank, so every component of every
    size is placed by the same rule.  The driver takes the labels and their combinations (labels
    are classes, not texts); the label vectors pass through one task in order, which keeps only
    what each split needs.  An empty table gives no rows.
    """
    groups = Cut(groups).rows
    counts = Cut(groups.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))).rows
    pairs = F.array_sort(F.collect_list(F.struct("label", "n")))
    held = counts.groupBy("component").agg(pairs.alias("pairs")).select("component", F.transform("pairs", lambda x: x["label"]).alias("labels"), F.transform("pairs", lambda x: x["n"]).alias("sizes"))
    held = Cut(held).rows
    classes = Cut(held.groupBy("labels", "sizes").agg(F.count(F.lit(1)).alias("copies"))).rows
    each = classes.select("labels", "copies", F.explode(F.arrays_zip("labels", "sizes")).alias("x"))
    sets: dict[tuple[str, ...], dict[str, int]] = {}
    totals: dict[str, int] = {}
    for r in each.groupBy("labels", F.col("x.labels").alias("label")).agg(F.sum(F.col("x.sizes") * F.col("copies")).alias("n")).toLocalIterator():
        sets.setdefault(tuple(r["labels"]), {})[r["label"]] = r["n"]
        totals[r["label"]] = totals.get(r["label"], 0) + r["n"]
    order = label_order(sets)
    at = F.array(*[F.lit(x) for x in order]).cast("array<string>")
    first = F.array_min(F.filter(F.transform("labels", lambda x: F.array_position(at, x)), lambda k: k > 0))
    size = F.element_at("sizes", F.array_position("labels", F.element_at(at, F.col("first").cast("int"))).cast("int"))
    lined = classes.withColumn("first", first).withColumn("size", size).coalesce(1).sortWithinPartitions("first", F.desc("size"), "labels", "sizes")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Placing(totals, ratios)
        for b in batches:
            rows = b.to_pydict()
            made = [state.take(dict(zip(x, n)), order[f - 1], c) for x, n, c, f in zip(rows["labels"], rows["sizes"], rows["copies"], rows["first"])]
            upto = [[sum(m[: k + 1]) for k in range(len(m))] for m in made]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(upto, pa.list_(pa.int64()))], names=["labels", "sizes", "upto"])

    placed = Cut(lined.mapInArrow(place, "labels array<string>, sizes array<bigint>, upto array<bigint>")).rows
    # ranks within a class of any size: ranges of (class, component), counted range by range
    key = F.xxhash64("labels", "sizes")
    ranged = Cut(held.withColumn("class", key).repartitionByRange("class", "component").withColumn("part", F.spark_partition_id())).rows
    ends = ranged.groupBy("class", "labels", "sizes", "part").agg(F.count(F.lit(1)).alias("n"))
    before = ends.withColumn("before", F.sum("n").over(Window.partitionBy("class", "labels", "sizes").orderBy("part")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("class", "labels", "sizes", "part").orderBy("component"))
    ranked = ranged.withColumn("rank", rank).join(before, ["class", "labels", "sizes", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    names = F.array(*[F.lit(s) for s in ratios])
    chosen = F.element_at(names, F.size(F.filter("upto", lambda n: n < F.col("rank"))) + 1)
    found = ranked.join(placed, ["labels", "sizes"]).select("component", chosen.alias("split"))
    return groups.select("record_id", "component").join(found, "component").select("record_id", "component", "split")
