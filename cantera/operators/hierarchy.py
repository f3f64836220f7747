"""Parent-child links to full hierarchies by heavy-path decomposition.

Rounds are logarithmic: subtree sizes and cycle separation come from pointer doubling
(after round k every pointer spans 2^k links), chains of heavy children likewise, and the
tree of chains is never deeper than log2 of the number of nodes.  Each round is a join and
a partial aggregation on a written table; the driver only sees counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Cut, some

ON_CYCLE, BELOW_CYCLE = -1, -2


def clean_key(code: Column) -> Column:
    """A code without the blanks around it and without its trailing ``#``."""
    return F.trim(F.regexp_replace(F.trim(code), r"[#\s]+$", ""))


def parent_links(links: DataFrame, parent: str, child: str, order: str) -> DataFrame:
    """One ``(node_key, parent_key)`` per child; of several parents the first by ``order`` wins.

    Rows whose parent or child is null or blank are no links; repeated links count once.
    """
    pairs = links.select(
        clean_key(F.col(child)).alias("node_key"), clean_key(F.col(parent)).alias("parent_key"), F.col(order).alias("at")
    ).filter("node_key <> '' and parent_key <> ''")
    return pairs.groupBy("node_key").agg(F.min_by("parent_key", F.struct("at", "parent_key")).alias("parent_key"))


def _jumped(state: DataFrame, carried: list[str]) -> DataFrame:
    """One doubling round over ``(node, top, dist, fin)``: every pointer goes twice as far.

    Rows that reached a top keep it; the others take over where their top points.
    """
    ahead = state.select(F.col("node").alias("top"), F.col("top").alias("t2"), F.col("dist").alias("d2"), F.col("fin").alias("f2"))
    moved = state.filter("not fin").join(ahead, "top").select("node", F.col("t2").alias("top"), (F.col("dist") + F.col("d2")).alias("dist"), F.col("f2").alias("fin"), *carried)
    return state.filter("fin").select("node", "top", "dist", "fin", *carried).unionByName(moved)


def _sized(state: DataFrame, span: int) -> DataFrame:
    """A round that also adds to each subtree's size the sizes of the nodes exactly ``span`` below."""
    more = state.filter(F.col("dist") == span).groupBy(F.col("top").alias("node")).agg(F.sum("size").alias("more"))
    return _jumped(state, ["size"]).join(more, "node", "left").select("node", "top", "dist", "fin", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))


def decompose(links: DataFrame, parent: str = "parent", child: str = "child", order: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """``(chains, cyclic)`` of the forest that the links form.

    chains: ``head, root_key, keys`` (the heavy path from the head down) and ``above`` (the
    nodes from the root to the head's parent, empty for a root); every node stands in one
    chain.  cyclic: ``node_key, depth`` with -1 for a node on a cycle and -2 for one below.

    Each round is one written table, with the count of unfinished rows from the same job.
    """
    parents = Cut(parent_links(links, parent, child, order)).rows
    nodes = parents.select("node_key").union(parents.select("parent_key")).distinct()
    is_root = F.col("parent_key").isNull()
    start = nodes.join(parents, "node_key", "left").select(
        F.col("node_key").alias("node"), F.coalesce("parent_key", "node_key").alias("top"), F.when(is_root, 0).otherwise(1).cast("bigint").alias("dist"), is_root.alias("fin"), F.lit(1).cast("bigint").alias("size")
    )
    open_rows = {"left": some("not fin")}
    state, span, before = Cut(start, **open_rows), 1, -1
    while state.counts["left"] not in (0, before):
        # equal counts twice: no acyclic node is deeper than the span, the rest is cyclic
        before, last = state.counts["left"], state
        state, span = Cut(_sized(last.rows, span), **open_rows), span * 2
        last.drop()
    cyclic = _cycles(state.rows.filter("not fin").select("node", "top"), state.counts["left"])
    sizes = state.rows.filter("fin").select(F.col("node").alias("node_key"), F.col("top").alias("root_key"), "size")

    heavy = parents.join(sizes, "node_key").groupBy("parent_key").agg(F.max_by("node_key", F.struct("size", "node_key")).alias("node_key"))
    light = F.col("parent_key").isNull()
    start = sizes.join(heavy, "node_key", "left").select(F.col("node_key").alias("node"), F.coalesce("parent_key", "node_key").alias("top"), F.when(light, 0).otherwise(1).cast("bigint").alias("dist"), light.alias("fin"), "root_key")
    state = Cut(start, **open_rows)
    while state.counts["left"]:
        last = state
        state = Cut(_jumped(last.rows, ["root_key"]), **open_rows)
        last.drop()
    return _chains(state.rows, parents), cyclic


def _cycles(state: DataFrame, n: int) -> DataFrame:
    """Nodes on cycles are the image of a long enough jump; the image stops shrinking there."""
    if n:
        jumped, image = Cut(state), state.select("top").distinct().count()
        while True:
            ahead = jumped.rows.select(F.col("node").alias("top"), F.col("top").alias("t2"))
            jumped = Cut(jumped.rows.join(ahead, "top").select("node", F.col("t2").alias("top")))
            state, before = jumped.rows, image
            image = state.select("top").distinct().count()
            if image == before:
                break
    on = state.select(F.col("top").alias("node")).distinct().withColumn("on", F.lit(True))
    depth = F.when(F.col("on"), ON_CYCLE).otherwise(BELOW_CYCLE).alias("depth")
    return state.select("node").join(on, "node", "left").select(F.col("node").alias("node_key"), depth)


def _chains(state: DataFrame, parents: DataFrame) -> DataFrame:
    """Chains with what stands above them, level by level of the tree of chains."""
    keys = F.transform(F.array_sort(F.collect_list(F.struct("dist", "node"))), lambda x: x["node"])
    chains = state.groupBy(F.col("top").alias("head")).agg(keys.alias("keys"), F.first("root_key").alias("root_key"))
    hangs = parents.select(F.col("node_key").alias("head"), F.col("parent_key").alias("node"))
    at = hangs.join(state.select("node", F.col("top").alias("over"), F.col("dist").cast("int").alias("at")), "node").select("head", "over", "at")
    chains = Cut(chains.join(at, "head", "left")).rows
    none = F.array().cast("array<string>")
    level = Cut(chains.filter("over is null").select("head", "root_key", "keys", none.alias("above")), n=F.count(F.lit(1)))
    done, waiting = [level.rows], chains.filter("over is not null")
    while level.counts["n"]:
        over = level.rows.select(F.col("head").alias("over"), F.col("keys").alias("over_keys"), F.col("above").alias("over_above"))
        above = F.concat("over_above", F.slice("over_keys", 1, F.col("at") + 1)).alias("above")
        level = Cut(waiting.join(over, "over").select("head", "root_key", "keys", above), n=F.count(F.lit(1)))
        done.append(level.rows)
    return reduce(DataFrame.unionByName, done)


def placed(chains: DataFrame) -> DataFrame:
    """``node_key, root_key, upward``: the nodes from the root down to each node, itself included."""
    each = chains.select("root_key", "keys", "above", F.posexplode("keys").alias("pos", "node_key"))
    return each.select("node_key", "root_key", F.concat("above", F.slice("keys", 1, F.col("pos") + 1)).alias("upward"))


def node_paths(links: DataFrame, **columns: str) -> DataFrame:
    """``node_key, root_key, depth, node_path`` of every node.

    A node on a cycle has root '', depth -1 and path '', a node below a cycle depth -2.
    Empty links give no rows.
    """
    chains, cyclic = decompose(links, **columns)
    paths = placed(chains).select("node_key", "root_key", (F.size("upward") - 1).alias("depth"), F.array_join("upward", "/").alias("node_path"))
    none = F.lit("")
    return paths.unionByName(cyclic.select("node_key", none.alias("root_key"), F.col("depth").cast("int").alias("depth"), none.alias("node_path")))


def descendants(links: DataFrame, **columns: str) -> DataFrame:
    """``node_key, descendant_key, distance`` for all nodes off cycles, from chain intervals.

    A chain lies whole below every node above its head, and the interval of a chain after
    each of its own nodes lies below that node; no join is needed.
    """
    chains, _ = decompose(links, **columns)
    nodes = chains.select("above", "keys", F.posexplode("keys").alias("pos", "descendant_key"))
    over = nodes.select("descendant_key", (F.size("above") + F.col("pos")).alias("depth"), F.posexplode(F.concat("above", F.slice("keys", 1, F.col("pos")))).alias("p", "node_key"))
    return over.select("node_key", "descendant_key", (F.col("depth") - F.col("p")).cast("int").alias("distance"))


def chapter_links(decompositions: DataFrame) -> DataFrame:
    """The links of a decomposition table whose parent is a chapter (its code ends in ``#``)."""
    return decompositions.filter(F.rtrim("parent").endswith("#"))
