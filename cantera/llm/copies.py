"""Copies hidden by formatting: canonical digests, two merged filters, exact grouping.

A first pass turns each record into a 16-byte digest of its canonical form.  The filter lies
in blocks of hash ranges, as many as the records need: every partition contributes the marks
that it saw once and repeatedly, and a merged block answers "can this digest occur twice?"
without false negatives.  Only possible repeats are shuffled for exact grouping, all others
are singletons where they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Cut

#: Records and cells of one block of the filter (8 cells a record); blocks grow in number with the data.
RECORDS, CELLS = 1 << 20, 1 << 23
#: The least number of blocks, so that small tables spread too.
SPREAD = 16

_WORD = r"\p{L}\p{M}\p{N}"
_BLANK = r"\s\p{Z}\x1c-\x1f\x{85}_"
_NOISE = rf"[{_BLANK}]|(?<![0-9])[^{_WORD}]|[^{_WORD}](?![0-9])"
_BREAK = r"[\n\r;\x0b\x0c\x{85}\x{2028}\x{2029}]"


def canonical(text: Column) -> Column:
    """Lower-cased letters, digits, raised figures and fractions; other signs between digits."""
    return F.regexp_replace(F.lower(text), _NOISE, "")


def canonical_fields(text: Column) -> Column:
    """The non-empty canonical fields of a text in a fixed order, repeats kept."""
    return F.array_sort(F.filter(F.transform(F.split(text, _BREAK), canonical), lambda x: x != ""))


def digests(df: DataFrame, record_id: str, title: str, body: str) -> DataFrame:
    """``record_id, digest``; the digest is null where either text is null or has no letters
    or digits, such rows being copies of nothing."""
    keyed = df.select(F.col(record_id).alias("record_id"), canonical(F.col(title)).alias("t"), canonical_fields(F.col(body)).alias("b"))
    whole = F.concat_ws("\x02", "t", F.array_join("b", "\x01"))
    # without the filter's letters and digits there is nothing to compare
    real = F.col("t").rlike(r"[\p{L}\p{N}]") & F.array_join("b", "").rlike(r"[\p{L}\p{N}]")
    return keyed.select("record_id", F.when(real, F.substring(F.unhex(F.sha2(whole, 256)), 1, 16)).alias("digest"))


def _pair(mark: np.ndarray) -> np.ndarray:
    """The two cells of each mark, as a column each."""
    bits = mark.view(np.uint64)
    return np.stack([bits & np.uint64(CELLS - 1), (bits >> np.uint64(23)) & np.uint64(CELLS - 1)], axis=1).astype(np.int64)


def possible_repeats(marks: DataFrame, blocks: int) -> DataFrame:
    """``mark``: the marks (64-bit hashes, a column) that may stand in two or more rows.

    A block of the filter covers a range of hashes.  Each partition sends a block the marks
    that it saw once and those that it saw again; merged, a cell that was set once by one
    partition only stands in the first plane, any other in the second.  A mark is passed if
    both of its cells stand in the second plane: no repeat is missed.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b.column(0).to_numpy(zero_copy_only=False) for b in batches if b.num_rows]
        if not found:
            return
        mark, n = np.unique(np.concatenate(found), return_counts=True)
        block = ((mark.view(np.uint64) >> np.uint64(46)) % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        mark, n, block = mark[order], n[order], block[order]
        edges = np.flatnonzero(np.diff(block, prepend=-1))
        rows = [(int(block[a]), mark[a:b][n[a:b] == 1].tobytes(), mark[a:b][n[a:b] > 1].tobytes()) for a, b in zip(edges, [*edges[1:], len(mark)])]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "once", "again"])

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        once = np.frombuffer(b"".join(pdf["once"]), np.int64)
        again = np.frombuffer(b"".join(pdf["again"]), np.int64)
        count = np.zeros(CELLS, np.uint8)
        for mark, n in ((once, 1), (again, 2)):
            pair = _pair(mark)
            for cells in (pair[:, 0], pair[:, 1][pair[:, 0] != pair[:, 1]]):
                at, k = np.unique(cells, return_counts=True)
                count[at] = np.minimum(count[at] + np.minimum(k, 2) * n, 2)
        own = np.unique(np.concatenate([once, again]))
        return pd.DataFrame({"mark": own[(count[_pair(own)] == 2).all(axis=1)]})

    parts = marks.mapInArrow(local, "block int, once binary, again binary")
    return parts.groupBy("block").applyInPandas(merge, "mark bigint")


def split_repeats(df: DataFrame, record_id: str, title: str, body: str) -> DataFrame:
    """``record_id, digest, maybe``: false where the digest surely occurs once (or is null).

    Nothing is broadcast but what the planner knows to be small: the possible repeats are a
    written table, joined by their marks.
    """
    keyed = Cut(digests(df, record_id, title, body).withColumn("mark", F.when(F.col("digest").isNotNull(), F.xxhash64("digest"))), n=F.count("digest"))
    blocks = max(SPREAD, -(-keyed.counts["n"] // RECORDS))
    found = Cut(possible_repeats(keyed.rows.filter("mark is not null").select("mark"), blocks)).rows.withColumn("maybe", F.lit(True))
    return keyed.rows.join(found, "mark", "left").select("record_id", "digest", F.coalesce("maybe", F.lit(False)).alias("maybe"))


def copy_sets(df: DataFrame, record_id: str, title: str, body: str, singletons: bool = True) -> DataFrame:
    """``record_id, n_copies``: one row per set of copies, its smallest id and its size.

    With ``singletons`` rows without copies (null and empty texts included) follow with 1.
    Map-side combining shrinks a set that holds a third of all rows to a row per task.
    """
    marked = split_repeats(df, record_id, title, body)
    sets = marked.filter("maybe").groupBy("digest").agg(F.min("record_id").alias("record_id"), F.count(F.lit(1)).alias("n_copies")).select("record_id", "n_copies")
    if not singletons:
        return sets.filter("n_copies > 1")
    return sets.unionByName(marked.filter("not maybe").select("record_id", F.lit(1).cast("bigint").alias("n_copies")))
