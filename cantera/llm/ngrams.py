"""Smoothed character n-gram models of a fixed size: hashed counts, flat numpy scoring."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells of a model's table (a power of 2); its size (4 bytes each) does not depend on the data.
CELLS = 1 << 20
START, END = "\x02", "\x03"
DIGITS = {ord(c): "0" for c in "123456789"}


def _flat(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded code points of all texts, the positions to predict and the text of each."""
    pad = START * (order - 1)
    joined = "".join(f"{pad}{t}{END}" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(t) + order for t in texts), np.int64, len(texts))
    begin = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = np.arange(len(codes)) - begin[owner] >= order - 1
    return codes, np.flatnonzero(inside), owner[inside]


def _grams(codes: np.ndarray, at: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..order the hashes of the n-gram ending at each position and of its context."""
    out = []
    mix = np.uint64(0x9E3779B97F4A7C15)
    for n in range(1, order + 1):
        h = np.full(len(at), n, np.uint64)
        for k in range(n - 1, 0, -1):
            h = (h ^ codes[at - k]) * mix
            h ^= h >> np.uint64(29)
        context = (h ^ np.uint64(0x110000 + n)) * mix
        whole = (h ^ codes[at]) * mix
        out.append(tuple(((x ^ (x >> np.uint64(31))) >> np.uint64(7)).astype(np.int64) for x in (whole, context)))
    return out


def count(texts: Counter, order: int, rows: int = 20_000, size: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """``(cells, counts)`` of all n-grams and contexts of the weighted texts."""
    table = np.zeros(size, np.int64)
    items = list(texts.items())
    for start in range(0, len(items), rows):
        part = items[start : start + rows]
        weights = np.array([n for _, n in part], np.int64)
        codes, at, owner = _flat([t for t, _ in part], order)
        cells = np.concatenate([h & (size - 1) for pair in _grams(codes, at, order) for h in pair])
        table += np.bincount(cells, np.tile(weights[owner], 2 * order), size).astype(np.int64)
    cells = np.flatnonzero(table)
    return cells, table[cells]


def characters(texts: Counter) -> Counter:
    """How often each character stands in the weighted texts."""
    out: Counter = Counter()
    for text, n in texts.items():
        for c in text:
            out[c] += n
    return out


def hashes_of(texts: list[str], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The hashes of every n-gram and context of the texts, for n = 1..order."""
    codes, at, _ = _flat(texts, order)
    return _grams(codes, at, order)


#: Cells of one block of a table on its way to the driver.
BLOCK = 1 << 14


def packed(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A table's filled cells as ``block, cells, counts``, a row for each block."""
    at = np.flatnonzero(table)
    cuts = np.searchsorted(at, np.arange(0, len(table) + BLOCK, BLOCK))
    rows = [(k, (at[a:b] % BLOCK).astype("<u2").tobytes(), table[at[a:b]].astype("<i8").tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "cells", "counts"])


def gathered(values: DataFrame, local: Callable, size: int) -> np.ndarray:
    """The sum of the tables that ``local`` packs over all partitions, merged block by block.

    Tasks are merged to four for each core before they count, so what is shuffled depends on
    the cores and not on the partitions; the driver takes one table.
    """
    tasks = 4 * values.sparkSession.sparkContext.defaultParallelism

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, "<i8")
        for cells, counts in zip(pdf["cells"], pdf["counts"]):
            total[np.frombuffer(cells, "<u2")] += np.frombuffer(counts, "<i8")
        return pd.DataFrame({"block": [key[0]], "total": [total.tobytes()]})

    parts = values.coalesce(tasks).mapInArrow(local, "block int, cells binary, counts binary")
    table = np.zeros(-(-size // BLOCK) * BLOCK, np.int64)
    for row in parts.groupBy("block").applyInPandas(merge, "block int, total binary").toLocalIterator():
        table[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["total"], "<i8")
    return table[:size]


class Model:
    """Interpolated n-gram probabilities: each order is smoothed by the one below."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray, order: int, strength: float = 2.0, alphabet: int = 400, size: int = CELLS) -> None:
        self.table = np.zeros(size, np.float32)
        self.table[cells] = counts
        self.order, self.strength, self.alphabet = order, strength, alphabet
        #: what the rarity of each character costs, where that was counted
        self.rarity: np.ndarray | None = None

    def log_probs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The log probability of each character (and of each text's end) and its text."""
        codes, at, owner = _flat(texts, self.order)
        p = np.full(len(at), 1 / self.alphabet)
        return np.log(self.adapted(p, _grams(codes, at, self.order), self.strength, 1)), owner

    def adapted(self, p: np.ndarray, hashes: list[tuple[np.ndarray, np.ndarray]], strength: float, least: int) -> np.ndarray:
        """Given probabilities as this model changes them by its n-grams of ``least`` and more
        characters; where it counted nothing they stay as they are."""
        mask = len(self.table) - 1
        for whole, context in hashes[least - 1 :]:
            seen = self.table[whole & mask]
            p = (seen + strength * p) / (np.maximum(self.table[context & mask], seen) + strength)
        return p

    def score(self, texts: list[str]) -> np.ndarray:
        """The log probability of each text."""
        if not texts:
            return np.zeros(0)
        logs, owner = self.log_probs(texts)
        return np.bincount(owner, logs, len(texts))


def model_of(texts: Counter, order: int, size: int = CELLS) -> Model:
    """A model fitted on texts at hand."""
    return Model(*count(texts, order, size=size), order, size=size)
