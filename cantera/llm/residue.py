"""Template residue, filler and error-page text in place of content.

Character n-gram models of placeholders, filler and notices are fitted on a labelled sample
(``specimens``), the model of natural prose on the whole corpus.  Windows of whole words are
scored: each residue model, starting afresh and falling back on natural prose where it knows
nothing, against natural prose that goes on or starts a clause afresh.  A value holds
residue where the log-likelihood ratio of a window exceeds a margin, and is excluded where
such windows cover enough of it.

Distinct clauses are counted once, and judged once for each recount.  Residue that recurs would teach the natural model to expect it, so prose is counted again
without the clauses found so far; labelled descriptions that read alike speak for natural
prose.  What stands in quotation marks is mentioned (the words of a sign), so no window
begins there.  Digits count as one, case does not count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Cut
from . import ngrams
from .specimens import specimens

#: Orders of the natural and of the labelled models.
PROSE, ORDER = 4, 6
#: Cells of the labelled models, many for few texts, so that strangers hardly ever meet theirs.
WIDE = 1 << 22
#: Distinct clauses that a worker remembers before it starts over; bounds memory, not results.
REMEMBERED = 300_000
#: How often prose is counted again without the residue found.
RECOUNTS = 2
#: The log odds of a clause being natural before it is read, the margin of a window.
MARGIN = 5.5
#: The log probability that natural prose starts a clause afresh at a word.
AFRESH = -2.0
#: How much the models below weigh in the labelled ones; from this order on they count for prose.
STRENGTH, LOOKED = 2.0, 4
#: The most that one character tells against a window.
WORST = 5.0
_BLANK = re.compile(r"\s+")
_BEGIN = re.compile(r"(?<=\s)\S|^\S|(?<=\w)[\[\]{}<>$%#@&?_!]+|(?<![\s\w])\w")
_QUOTED = re.compile('«[^»]*»|“[^”]*”|"[^"]*"')


class Levels(dict):
    """Clauses lower-cased, with white space and digits levelled, filled as they occur."""

    def __missing__(self, part: str) -> str:
        if len(self) > REMEMBERED:
            self.clear()
        self[part] = value = _BLANK.sub(" ", part.lower().translate(ngrams.DIGITS)).strip()
        return value


def segments(text: str, levels: dict[str, str]) -> list[str]:
    """The lines and clauses of a text, levelled."""
    parts = text.replace(". ", ".\n").replace(", ", ",\n").replace("; ", ";\n").split("\n")
    return [s for p in parts if (s := levels[p])]


@cache
def labelled_models(names: tuple[str, ...], fitted: Callable[[tuple], bool] | None = None) -> tuple[ngrams.Model, dict[str, ngrams.Model]]:
    """The model of look-alikes and those of residue by kind, built once in each worker."""
    texts: dict[str, Counter] = {}
    for x in specimens(list(names)):
        if fitted is None or fitted(x):
            texts.setdefault(x[0], Counter()).update([x[2]])
    alike = Counter({f" {x}{end} ": n for x, n in texts.pop("natural").items() for end in ("", ".", ",")})
    return ngrams.model_of(alike, ORDER, WIDE), {kind: ngrams.model_of(found, ORDER, WIDE) for kind, found in texts.items()}


class Judge:
    """The labelled models, and natural prose as counted so far."""

    def __init__(self, names: tuple[str, ...], prose: np.ndarray, fitted: Callable[[tuple], bool] | None = None) -> None:
        self.prose = ngrams.Model(np.arange(ngrams.CELLS), prose, PROSE)
        self.alike, self.kinds = labelled_models(names, fitted)
        self.known: dict[str, tuple[float, str, int]] = {}

    def natural(self, texts: list[str]) -> np.ndarray:
        """The log probability of each character as prose, labelled look-alikes included."""
        base, _ = self.prose.log_probs(texts)
        return np.maximum(base, np.log(self.alike.adapted(np.exp(base), ngrams.hashes_of(texts, ORDER), 1.0, LOOKED)))

    def windows(self, found: list[str]) -> list[tuple[float, str, int]]:
        """For each clause the best window's log-likelihood ratio, its kind and its length."""
        padded = [f" {s} " for s in found]
        place = [(k, m.start()) for k, s in enumerate(padded) for q in [[x.span() for x in _QUOTED.finditer(s)]] for m in _BEGIN.finditer(s) if not any(a <= m.start() < b for a, b in q)]
        out: list[tuple[float, str, int]] = [(0.0, "", 0)] * len(found)
        if not place:
            return out
        rest = [padded[k][p:-1] for k, p in place]
        # every row of these arrays is a character of what follows a place, its end included
        size = np.array([len(x) + 1 for x in rest])
        begin = np.cumsum(size) - size
        own = np.repeat(np.arange(len(rest)), size)
        pos = np.arange(size.sum()) - begin[own]
        last = pos == size[own] - 1
        clause = np.cumsum([0, *(len(s) + 1 for s in padded)])
        on = self.natural(padded)[np.array([clause[k] + p for k, p in place])[own] + pos]
        anew = np.delete(self.natural([f" {x}" for x in rest]), np.cumsum(size + 1) - size - 1)
        on[last] = anew[last] = 0

        def upto(x: np.ndarray) -> np.ndarray:
            total = np.cumsum(x)
            return total - np.concatenate([[0.0], total])[begin][own]

        prose = np.maximum(upto(on), upto(anew) + AFRESH)
        letters = np.frombuffer("".join(f"{x}\x03" for x in rest).encode("utf-32-le", "surrogatepass"), np.uint32)
        some, code = np.unique(letters, return_inverse=True)
        inside = np.array([chr(c).isalnum() for c in some])[code]
        ends = ~(inside & np.append(inside[1:], False)) & ~last
        hashes = ngrams.hashes_of(rest, ORDER)
        for kind, model in self.kinds.items():
            tells = np.maximum(np.log(model.adapted(np.exp(on), hashes, STRENGTH, 1)), on - WORST)
            tells[last] = 0
            ratio = np.where(ends, upto(tells) - prose, -np.inf)
            best = np.maximum.reduceat(ratio, begin)
            for j in np.flatnonzero(best > 0).tolist():
                k = place[j][0]
                if best[j] > out[k][0]:
                    at = int(np.argmax(ratio[begin[j] : begin[j] + size[j]]))
                    out[k] = (float(best[j]), kind, at + 1)
        return out

    def learn(self, clauses: set[str]) -> None:
        """Judge the clauses not yet known; most recur."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [s for s in clauses if s not in self.known]
        for k in range(0, len(new), 4000):
            self.known.update(zip(new[k : k + 4000], self.windows(new[k : k + 4000])))


def clauses(values: DataFrame, text: str) -> DataFrame:
    """``clause, n``: every distinct clause of all values, counted within partitions first."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, levels = Counter(), Levels()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["clause", "n"])
            found.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    found.update(segments(t, levels))
            if len(found) > REMEMBERED:
                yield flush()
        yield flush()

    each = values.select(F.col(text)).mapInArrow(local, "clause string, n bigint").groupBy("clause").agg(F.sum("n").alias("n"))
    return Cut(each.repartition(2 * values.sparkSession.sparkContext.defaultParallelism)).rows


def counted(found: DataFrame, names: tuple[str, ...], before: np.ndarray | None) -> np.ndarray:
    """The table of natural prose over all clauses, or over those that are no residue by the
    prose counted before."""
    shared = found.sparkSession.sparkContext.broadcast(None if before is None else before.astype(np.float32))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = None if shared.value is None else Judge(names, shared.value)
        table = np.zeros(ngrams.CELLS, np.int64)
        for b in batches:
            said, n = (c.to_pylist() for c in b.columns)
            fine = [w[0] < MARGIN for k in range(0, len(said), 4000) for w in judge.windows(said[k : k + 4000])] if judge else [True] * len(said)
            cells, counts = ngrams.count(Counter({f" {s} ": c for s, c, ok in zip(said, n, fine) if ok}), PROSE)
            table[cells] += counts
        yield from ngrams.packed(table)

    return ngrams.gathered(found, local, ngrams.CELLS)


def residue(values: DataFrame, key: list[str], text: str, names: list[str], margin: float = MARGIN) -> DataFrame:
    """The key columns of each value with residue, ``kind``, ``ratio`` and ``coverage``.

    ``coverage`` is the share of the value's characters inside windows above the margin.
    Null and blank values give no row; an empty table gives no rows.
    """
    named, prose, found = tuple(names), None, clauses(values, text)
    for _ in range(1 + RECOUNTS):
        prose = counted(found, named, prose)
    shared = values.sparkSession.sparkContext.broadcast(prose.astype(np.float32))
    kinds = {f.name: f.dataType.simpleString() for f in values.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, levels = Judge(named, shared.value), Levels()
        for b in batches:
            cut = [segments(t, levels) if t else () for t in b.column(len(key)).to_pylist()]
            judge.learn({s for ss in cut for s in ss})
            rows, made = [], []
            for k, ss in enumerate(cut):
                hits = [w for s in ss if (w := judge.known[s])[0] >= margin]
                if hits:
                    top = max(hits)
                    rows.append(k)
                    made.append((top[1], top[0], min(1.0, sum(w[2] for w in hits) / sum(len(s) + 1 for s in ss))))
            took = [b.column(k).take(pa.array(rows, pa.int64())) for k in range(len(key))]
            yield pa.RecordBatch.from_arrays([*took, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64()), pa.array([m[2] for m in made], pa.float64())], names=[*key, "kind", "ratio", "coverage"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "kind string", "ratio double", "coverage double"])
    return values.select(*key, text).mapInArrow(run, schema)
