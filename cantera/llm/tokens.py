"""Whole-corpus encoding by a public byte-level BPE vocabulary in batched numpy merge rounds."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FOLDER = "/opt/tokenizers"
#: Distinct words that a worker remembers before it starts over; bounds memory, not results.
REMEMBERED = 400_000


class ByteBpe:
    """A rank file as sorted pair keys, and the encoding of many words at once."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(ranks[t[:k]] * self.size + ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        table = np.array(sorted(pairs), np.int64)
        self.keys, self.ranks = table[:, 0].copy(), table[:, 1].copy()
        self.split = regex.compile(PATTERN)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one flat array, and where each word begins (one more at the end).

        Each round merges in every word the pairs of its lowest rank, the leftmost first
        where two overlap, and only words that merged stay in play.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        done_ids, done_word, done_at = [], [], []
        at = np.arange(len(ids))
        while len(ids):
            key = ids[:-1] * self.size + ids[1:]
            found = np.searchsorted(self.keys, key)
            found[found == len(self.keys)] = 0
            rank = np.where((self.keys[found] == key) & (word[:-1] == word[1:]), self.ranks[found], self.size)
            best = np.full(len(words), self.size, np.int64)
            np.minimum.at(best, word[:-1], rank)
            live = best[word] < self.size
            if not live.all():
                done_ids.append(ids[~live])
                done_word.append(word[~live])
                done_at.append(at[~live])
            hit = np.flatnonzero((rank < self.size) & (rank == best[word[:-1]]))
            if len(hit):
                # in a row of touching hits (a a a) every second one merges
                row = np.cumsum(np.diff(hit, prepend=-2) != 1)
                begins = np.flatnonzero(np.diff(row, prepend=0))
                hit = hit[(np.arange(len(hit)) - begins[row - 1]) % 2 == 0]
                ids[hit] = rank[hit]
                live[hit + 1] = False
            ids, word, at = ids[live], word[live], at[live]
        ids, word, at = np.concatenate(done_ids), np.concatenate(done_word), np.concatenate(done_at)
        order = np.argsort(at, kind="stable")
        return ids[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def encode(self, texts: list[str | None], known: dict[str, np.ndarray]) -> list[np.ndarray]:
        """The ids of each text; ``known`` keeps words over batches."""
        none = np.zeros(0, np.int64)
        parts = [self.split.findall(t) if t else [] for t in texts]
        new = list({w for p in parts for w in p if w not in known})
        if new:
            ids, begin = self.merge([w.encode("utf-8", "replace") for w in new])
            known.update(zip(new, np.split(ids, begin[1:-1])))
        return [np.concatenate([known[w] for w in p]) if p else none for p in parts]


@cache
def vocabulary_at(path: str) -> ByteBpe:
    """The encoder of a rank file, read once in each worker."""
    return ByteBpe(path)


def encoded(df: DataFrame, record_id: str, text: str, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """``record_id, ids``: the token ids of each text, without special tokens.

    Null and empty texts have an empty list; every row of the input has one.  The vocabulary
    file must be at the same place on every executor.
    """
    path = os.path.join(folder, f"{vocabulary}.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = vocabulary_at(path), {}
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                if len(known) > REMEMBERED:
                    known.clear()
                ids = model.encode(part.column(1).to_pylist(), known)
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate(ids) if ids else np.zeros(0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))], names=["record_id", "ids"])

    kind = df.schema[record_id].dataType.simpleString()
    return df.select(F.col(record_id), F.col(text)).mapInArrow(run, f"record_id {kind}, ids array<int>")
