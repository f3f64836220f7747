"""Evaluation passages inside a corpus, by a distributed positional inverted index.

The corpus becomes postings ``(term, doc_id, positions)`` of the terms that occur in any
passage.  A passage leaks where enough consecutive words of it stand consecutively in a
document: every window of that length has an anchor, its rarest term in the corpus, whose
postings give the candidate offsets; the remaining terms' position lists, moved by that
offset, confirm or refute each word, and runs of confirmed words decide.

Proximity matches may differ in any word, rare ones too, so no single word can anchor them:
``near_matches`` compares every equal pair of words of a document and the passages.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import Cut
from .charforms import words

#: So many words of passages the driver takes at once; more are searched in parts.
MOST_WORDS = 2_000_000
#: So many candidate documents are broadcast to thin out the index (8 MB); more are joined.
FEW_HOLDERS = 1_000_000
#: Documents are compared in stretches of this many words, in steps of so many pairs of equal words.
STRETCH, PAIRS = 4096, 4_000_000


def in_parts(passages: DataFrame, passage_id: str, text: str) -> list[DataFrame]:
    """The passages in parts of about ``MOST_WORDS`` words, by a hash of their id.

    A match concerns one passage, so the parts' matches together are all matches.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(words(t)) for t in b.column(0).to_pylist() if t)], pa.int64())], names=["n"])

    total = passages.select(text).mapInArrow(count, "n bigint").agg(F.sum("n")).first()[0] or 0
    n = -(-total // MOST_WORDS) or 1
    part = F.pmod(F.xxhash64(F.col(passage_id)), F.lit(n))
    return [passages] if n == 1 else [passages.filter(part == k) for k in range(n)]


def passage_terms(passages: DataFrame, passage_id: str, text: str) -> dict[int, list[str]]:
    """The words of each passage; null and empty ones are left out."""
    rows = passages.select(passage_id, text).toLocalIterator()
    return {r[0]: found for r in rows if r[1] and (found := words(r[1]))}


def postings(df: DataFrame, record_id: str, text: str, terms: dict[str, int]) -> DataFrame:
    """``term, doc_id, positions`` (word positions in order) for the given terms."""
    shared = df.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for b in batches:
            ids, where, doc = [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                if t:
                    codes = np.fromiter((known(w, -1) for w in words(t)), np.int32)
                    at = np.flatnonzero(codes >= 0).astype(np.int32)
                    ids.append(codes[at])
                    where.append(at)
                    doc.append(np.full(len(at), k, np.int64))
            if not ids:
                continue
            code, pos, row = np.concatenate(ids), np.concatenate(where), np.concatenate(doc)
            order = np.lexsort((pos, code, row))
            code, pos, row = code[order], pos[order], row[order]
            first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(pos)).astype(np.int32)), pa.array(pos))
            yield pa.RecordBatch.from_arrays([pa.array(code[first]), b.column(0).take(pa.array(row[first])), lists], names=["term", "doc_id", "positions"])

    return df.select(F.col(record_id).cast("bigint"), F.col(text)).mapInArrow(run, "term int, doc_id bigint, positions array<int>")


def anchors(passages: dict[int, list[int]], frequency: dict[int, int], run: int) -> list[tuple]:
    """``(passage, term1, place1, ... term3, place3)``: the three rarest words of every window
    of ``run`` words, rarest first (repeated where a window has fewer words)."""
    out = set()
    for passage, terms in passages.items():
        n = min(run, len(terms))
        for start in range(len(terms) - n + 1):
            if all(frequency.get(t) for t in terms[start : start + n]):
                places = sorted(range(start, start + n), key=lambda p: (frequency[terms[p]], p))[:3]
                places += places[:1] * (3 - len(places))
                out.add((passage, *(x for p in places for x in (terms[p], p))))
    return sorted(out)


def _agreeing(found: DataFrame, index: DataFrame, k: int, terms: set[int]) -> DataFrame:
    """The candidates whose k-th rarest word stands at its offset."""
    term, place = f"term{k}", f"place{k}"
    some = index.join(F.broadcast(index.sparkSession.createDataFrame([(t,) for t in sorted(terms)], "term int")), "term", "left_semi")
    joined = found.join(some.withColumnRenamed("term", term), ["doc_id", term])
    return joined.filter(F.array_contains("positions", F.col("at") + F.col(place))).drop("positions")


def _slices(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``first[k] .. first[k] + size[k] - 1`` of every k, one after the other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


class NearPassages:
    """Coded passages beside each other, and the places of every term in them."""

    def __init__(self, coded: dict[int, list[int]], n_terms: int, run: int, gap: int) -> None:
        self.gap, self.ids = gap, list(coded)
        self.length = np.array([len(c) for c in coded.values()], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.need = np.minimum(run, self.length)
        self.code = np.concatenate([np.asarray(c, np.int64) for c in coded.values()])
        self.owner = np.repeat(np.arange(len(coded)), self.length)
        self.by_term = np.argsort(self.code, kind="stable")
        self.n_places = np.bincount(self.code, minlength=n_terms)
        self.first_place = np.cumsum(self.n_places) - self.n_places

    def _chains(self, group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of the chains of places (in order within a group) with gaps of at most ``gap``
        words, and the number of each place's chain."""
        new = np.ones(len(place), bool)
        new[1:] = (np.diff(group) != 0) | (np.diff(place) > self.gap + 1)
        chain = np.cumsum(new) - 1
        return np.bincount(chain), chain

    def longest(self, doc: np.ndarray) -> dict[int, int]:
        """The longest match of each passage that the coded document (-1: other words) holds."""
        out: dict[int, int] = {}
        step = max(STRETCH, int(self.length.max()))
        for at in range(0, max(1, len(doc) - int(self.length.max()) + 1), step):
            # a match spans at most the longest passage, so it lies within some stretch
            for k, n in self._stretch(doc[at : at + step + int(self.length.max())]):
                out[k] = max(n, out.get(k, 0))
        return out

    def _stretch(self, doc: np.ndarray) -> Iterator[tuple[int, int]]:
        where = np.flatnonzero(doc >= 0)
        where = where[np.argsort(doc[where], kind="stable")]
        terms, first, n = np.unique(doc[where], return_index=True, return_counts=True)
        if not len(terms):
            return
        # places whose word the document holds at all; a match needs a long enough chain of them
        size = self.n_places[terms]
        place = self.by_term[_slices(self.first_place[terms], size)]
        first, n = np.repeat(first, size), np.repeat(n, size)
        order = np.argsort(place)
        place, first, n = place[order], first[order], n[order]
        sizes, chain = self._chains(self.owner[place], place)
        kept = sizes[chain] >= self.need[self.owner[place]]
        place, first, n = place[kept], first[kept], n[kept]
        if not len(place):
            return
        passages, at = np.unique(self.owner[place], return_index=True)
        widths = len(doc) + self.length[passages] - 1
        step = (np.cumsum(np.add.reduceat(n, at) + widths) - 1) // PAIRS
        cuts = np.flatnonzero(np.diff(step)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(passages)]):
            part = slice(at[a], at[b] if b < len(passages) else None)
            yield from self._offsets(where, passages[a:b], widths[a:b], place[part], first[part], n[part])

    def _offsets(self, where: np.ndarray, passages: np.ndarray, widths: np.ndarray, place: np.ndarray, first: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int]]:
        """Matches among all pairs of a place and a position of the same word."""
        pos, place = where[_slices(first, n)], np.repeat(place, n)
        k = np.searchsorted(passages, self.owner[place])
        # one number for each passage and offset
        line = (np.cumsum(widths) - widths)[k] + pos - (place - self.start[passages][k]) + self.length[passages][k] - 1
        need = self.need[passages][k]
        kept = np.bincount(line)[line] >= need
        line, place, need, k = line[kept], place[kept], need[kept], k[kept]
        order = np.argsort(line, kind="stable")
        line, place, need, k = line[order], place[order], need[order], k[order]
        if len(line):
            sizes, chain = self._chains(line, place)
            for j in np.flatnonzero(sizes[chain] >= need):
                yield self.ids[passages[k[j]]], int(sizes[chain[j]])


def near_matches(df: DataFrame, record_id: str, text: str, coded: dict[int, list[int]], terms: dict[str, int], run: int, gap: int) -> DataFrame:
    """``doc_id, passage_id, n_words`` with gaps, in one pass over the documents.

    No candidates are picked: offsets with fewer equal words than a match needs are the only
    ones dropped before the chains of equal words are counted.
    """
    spark = df.sparkSession
    if not coded:
        return spark.createDataFrame([], "doc_id bigint, passage_id bigint, n_words bigint")
    shared = spark.sparkContext.broadcast((terms, coded))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value[0].get
        passages = NearPassages(shared.value[1], len(shared.value[0]), run, gap)
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    doc = np.fromiter((known(w, -1) for w in words(t)), np.int64)
                    rows += [(i, p, n) for p, n in passages.longest(doc).items()]
            columns = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "passage_id", "n_words"])

    return df.select(F.col(record_id).cast("bigint"), F.col(text)).mapInArrow(search, "doc_id bigint, passage_id bigint, n_words bigint")


def matches(df: DataFrame, record_id: str, text: str, passages: DataFrame, passage_id: str, passage_text: str, run: int = 12, gap: int = 0) -> DataFrame:
    """``doc_id, passage_id, n_words``: the longest match of each leaked passage.

    A match is ``run`` consecutive words of the passage (all its words if it has fewer)
    standing consecutively in the document.  With ``gap`` (proximity) up to that many words may
    differ between two agreeing stretches, whichever words they are; ``n_words`` counts the
    agreeing ones.  Null and empty texts match nothing.
    """
    parts = [_matches(df, record_id, text, p, passage_id, passage_text, run, gap) for p in in_parts(passages, passage_id, passage_text)]
    return reduce(DataFrame.unionByName, parts)


def _matches(df: DataFrame, record_id: str, text: str, passages: DataFrame, passage_id: str, passage_text: str, run: int, gap: int) -> DataFrame:
    """The matches of one part of the passages."""
    spark = df.sparkSession
    spelled = passage_terms(passages, passage_id, passage_text)
    terms = {w: k for k, w in enumerate(sorted({w for found in spelled.values() for w in found}))}
    coded = {p: [terms[w] for w in found] for p, found in spelled.items()}
    if gap:
        return near_matches(df, record_id, text, coded, terms, run, gap)
    index = Cut(postings(df, record_id, text, terms)).rows
    frequency = {r["term"]: r["n"] for r in index.groupBy("term").agg(F.sum(F.size("positions")).alias("n")).toLocalIterator()}
    windows = anchors(coded, frequency, run)
    columns = "passage_id bigint, term1 int, place1 int, term2 int, place2 int, term3 int, place3 int"
    picked = spark.createDataFrame(windows, columns)
    plan = [(p, t, k, min(run, len(found))) for p, found in coded.items() for k, t in enumerate(found)]
    wanted = spark.createDataFrame(plan, "passage_id bigint, term int, place int, need int")
    # these tables and the lists of terms are bounded by MOST_WORDS
    first = index.join(F.broadcast(picked), F.col("term") == F.col("term1")).select("doc_id", *picked.columns, F.explode("positions").alias("pos"))
    found = first.withColumn("at", F.col("pos") - F.col("place1"))
    for k in (2, 3):
        found = _agreeing(found, index, k, {w[2 * k - 1] for w in windows})
    starts = Cut(found.select("doc_id", "passage_id", "at").distinct()).rows
    holders = starts.select("doc_id").distinct()
    if holders.limit(FEW_HOLDERS + 1).count() <= FEW_HOLDERS:
        index = index.join(F.broadcast(holders), "doc_id", "left_semi")
    expected = starts.join(F.broadcast(wanted), "passage_id").filter("at + place >= 0")
    agreed = expected.join(index, ["doc_id", "term"]).filter(F.array_contains("positions", F.col("at") + F.col("place"))).select("doc_id", "passage_id", "at", "place", "need")
    line = Window.partitionBy("doc_id", "passage_id", "at").orderBy("place")
    parted = agreed.withColumn("cut", F.when(F.col("place") - F.lag("place").over(line) == 1, 0).otherwise(1)).withColumn("stretch", F.sum("cut").over(line))
    runs = parted.groupBy("doc_id", "passage_id", "at", "stretch").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).filter("n >= need")
    return runs.groupBy("doc_id", "passage_id").agg(F.max("n").alias("n_words"))
