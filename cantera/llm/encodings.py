"""Text read in a wrong encoding: find it and restore what can be restored.

Smoothed character n-gram models are trained on all clean values in one pass.  Each word with
characters outside ASCII is then scored under every encode-decode chain; the likeliest chain
is accepted if it gains more than a margin that is validated on all words of the corpus, garbled
on purpose.  The model has a fixed size, and a worker scores each distinct word once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Cut
from . import ngrams

ORDER = 4
#: Encodings that text was wrongly read in, and those it was really in.
READ_AS = ("cp1252", "cp437", "cp850", "mac_roman", "cp1250", "iso8859_15")
TRULY = ("utf-8", "cp1252", "cp850", "mac_roman")
LOST = "�"
#: Distinct words a worker remembers.
REMEMBERED = 300_000
#: Characters that are counted exactly; any above count as the last.
CHARACTERS = 1 << 16
#: How many times commoner than itself a garbled word's repair is.
GARBLED = 10
_RUN = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(r"[^ \t\n\r]+")
#: A repair's characters that are rarer than this share in clean text speak against it, the
#: more so the rarer they are (one never seen counts as seen half a time).
KNOWN = 3e-6
_SOLID = re.compile(r"[A-Za-z0-9]")
_CONTROL = re.compile(r"[\x00-\x1f\x7f-\x9f�]")


def _bytes(text: str, codec: str) -> bytes | None:
    """The bytes that read as this text; bytes that cp1252 leaves undefined stand for themselves."""
    out = bytearray()
    for c in text:
        try:
            out += c.encode(codec)
        except UnicodeEncodeError:
            if codec in ("cp1252", "cp1250") and 0x80 <= ord(c) < 0x100:
                out.append(ord(c))
            else:
                return None
    return bytes(out)


def _words(text: str) -> list[str]:
    """The parts of a text between blanks, tabs and line ends."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def _step(text: str, read_as: str, truly: str) -> str | None:
    raw = _bytes(text, read_as)
    if raw is None:
        return None
    try:
        return raw.decode(truly)
    except UnicodeDecodeError:
        return None


CHAINS = [c for c in product(READ_AS, TRULY) if c[0] != c[1]]
#: A name for each chain, chains of repeated misreadings included.
NAMES = {c: f"{c[1]} read as {c[0]}" for c in CHAINS}


def repairs(run: str) -> dict[str, str]:
    """What a run of characters outside ASCII becomes under each chain that applies."""
    out: dict[str, str] = {}
    for chain in CHAINS:
        got, name, depth = _step(run, *chain), NAMES[chain], 1
        while got is not None and got != run:
            if not _CONTROL.search(got):
                out[name] = got
            if chain[1] != "utf-8" or depth == 3 or got.isascii():
                break
            got, depth = _step(got, *chain), depth + 1
            name = f"{NAMES[chain]} {depth} times"
    return out


class _Runs(dict):
    """Repairs of runs, filled as runs occur."""

    def __missing__(self, run: str) -> dict[str, str]:
        if len(self) > 100_000:
            self.clear()
        self[run] = value = repairs(run)
        return value


class _Clean(dict):
    """Whether a word has no lost character and nothing that decodes as UTF-8 under any chain."""

    def __missing__(self, word: str) -> bool:
        if len(self) > REMEMBERED:
            self.clear()
            self.runs = _Runs()
        self[word] = value = LOST not in word and not any(name.startswith("utf-8") for run in _RUN.findall(word) for name in self.runs[run])
        return value

    def __init__(self) -> None:
        super().__init__()
        self.runs = _Runs()


def rarity(counts: np.ndarray) -> np.ndarray:
    """What each character costs a repair: the log of how much rarer than ``KNOWN`` it is."""
    least = KNOWN * counts.sum()
    cost = np.log(np.maximum(1.0, least / np.maximum(counts, 0.5)))
    cost[:128] = 0
    return cost.astype(np.float32)


def train(values: DataFrame, text: str) -> tuple[ngrams.Model, Cut]:
    """The model of all clean values, and ``word, n`` for all their words outside ASCII.

    Counts cover every value; each partition sends the cells it filled, at most the size of
    the model.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, clean = Counter(), _Clean()
        # n-gram cells, and behind them exact counts of characters
        table = np.zeros(ngrams.CELLS + CHARACTERS, np.int64)

        def flush() -> None:
            level = Counter()
            for w, n in words.items():
                level[w.translate(ngrams.DIGITS)] += n
            cells, counts = ngrams.count(level, ORDER)
            table[cells] += counts
            for c, n in ngrams.characters(level).items():
                table[ngrams.CELLS + min(ord(c), CHARACTERS - 1)] += n
            words.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    parts = _words(t)
                    if t.isascii() or all(clean[w] for w in parts if not w.isascii()):
                        words.update(parts)
            if len(words) > ngrams.CELLS // 4:
                flush()
        flush()
        yield from ngrams.packed(table)

    def special(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, clean = Counter(), _Clean()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                if t and not t.isascii():
                    odd = [w for w in _words(t) if not w.isascii()]
                    if all(clean[w] for w in odd):
                        found.update(w.translate(ngrams.DIGITS) for w in odd)
            if len(found) > REMEMBERED:
                yield flush()
        yield flush()

    only = values.select(F.col(text))
    table = ngrams.gathered(only, local, ngrams.CELLS + CHARACTERS)
    words = only.mapInArrow(special, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    words = Cut(words)
    model = ngrams.Model(np.arange(ngrams.CELLS), table[: ngrams.CELLS], ORDER)
    model.rarity = rarity(table[ngrams.CELLS :])
    return model, words


def _candidates(word: str, runs: _Runs) -> dict[str, str]:
    """The word under each chain, applied to those of its runs that the chain can repair."""
    options: dict[str, str] = {}
    found = {run: runs[run] for run in _RUN.findall(word)}
    for name in dict.fromkeys(n for named in found.values() for n in named):
        if not name.startswith("utf-8") and not _SOLID.search(word):
            continue  # a lone sign read through a one-byte chain is no evidence
        options[name] = _RUN.sub(lambda m, name=name: found[m.group()].get(name, m.group()), word)
    return options


def costs(texts: list[str], rare: np.ndarray) -> np.ndarray:
    """What the rarity of its characters costs each text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(owner, rare[np.minimum(codes, CHARACTERS - 1)], len(texts))


def best_chains(words: list[str], model: ngrams.Model, runs: _Runs) -> list[tuple[str, float] | None]:
    """The likeliest chain of each word and its gain over the word as it stands, if positive."""
    options = [list(_candidates(w, runs).items()) for w in words]
    texts = [t.translate(ngrams.DIGITS) for w, o in zip(words, options) if o for t in (w, *(x for _, x in o))]
    scores, out, at = model.score(texts) - costs(texts, model.rarity), [], 0
    for o in options:
        if not o:
            out.append(None)
            continue
        gains = scores[at + 1 : at + 1 + len(o)] - scores[at]
        at += 1 + len(o)
        k = int(np.argmax(gains))
        out.append((o[k][0], float(gains[k])) if gains[k] > 0 else None)
    return out


def _spoiled(words: list[str]) -> list[str]:
    """The words garbled by each chain that changes them and leaves no control character."""
    out = []
    for read_as, truly in CHAINS:
        for w in words:
            raw = _bytes(w, truly) if truly != "utf-8" else w.encode()
            try:
                bad = raw.decode(read_as) if raw is not None else w
            except UnicodeDecodeError:
                continue
            if bad != w and not _CONTROL.search(bad):
                out.append(bad)
    return out


def validate(words: DataFrame, model: ngrams.Model, least: float = 1.5, most: float = 12.0) -> float:
    """The margin with the fewest errors on the words (``word, n``) that occur more than once:
    clean ones that would be changed, and ones garbled by each chain that would not be restored.

    Every word is tried; the driver takes the errors at each margin.
    """
    spark = words.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism
    shared = spark.sparkContext.broadcast((model.table, model.order, model.rarity))
    margins = np.arange(least, most, 0.5)

    def own() -> ngrams.Model:
        table, order, rare = shared.value
        made = ngrams.Model(np.arange(len(table)), table, order)
        made.rarity = rare
        return made

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, runs = own(), _Runs()
        for b in batches:
            clean = b.column(0).to_pylist()
            best = best_chains(clean, fitted, runs)
            fixed = [x and _candidates(w, runs)[x[0]] for w, x in zip(clean, best)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fixed, pa.string()), pa.array([x[1] if x else 0.0 for x in best], pa.float64())], names=["word", "n", "fixed", "gain"])

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, runs = own(), _Runs()
        n, wrong, spoiled, missed = 0, np.zeros(len(margins), np.int64), 0, np.zeros(len(margins), np.int64)
        for b in batches:
            gain = b.column(1).to_numpy()
            n, wrong = n + len(gain), wrong + (gain[:, None] >= margins).sum(0)
            plain = b.column(0).filter(pa.array(gain < least)).to_pylist()
            for k in range(0, len(plain), 500):
                found = np.array([x[1] if x else 0.0 for x in best_chains(_spoiled(plain[k : k + 500]), fitted, runs)])
                spoiled, missed = spoiled + len(found), missed + (found[:, None] < margins).sum(0)
        columns = [np.arange(len(margins)), np.full(len(margins), n), wrong, np.full(len(margins), spoiled), missed]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["margin", "n", "wrong", "spoiled", "missed"])

    found = words.filter("n > 1").repartition(tasks, "word").mapInArrow(judged, "word string, n bigint, fixed string, gain double")
    # a word whose repair is far commoner than itself is garbled, not a false alarm
    found = found.join(words.select(F.col("word").alias("fixed"), F.col("n").alias("commoner")), "fixed", "left")
    gain = F.when(F.col("commoner") > GARBLED * F.col("n"), 0.0).otherwise(F.col("gain"))
    each = found.select("word", gain.alias("gain")).repartition(tasks, "word").mapInArrow(errors, "margin bigint, n bigint, wrong bigint, spoiled bigint, missed bigint")
    # one row for each margin
    at = each.groupBy("margin").agg(*[F.sum(c).alias(c) for c in ("n", "wrong", "spoiled", "missed")]).orderBy("margin").collect()
    if not at or not at[0]["n"] or not at[0]["spoiled"]:
        return (least + most) / 2
    return float(margins[int(np.argmin([r["missed"] / r["spoiled"] + r["wrong"] / r["n"] for r in at]))])


def _verdict(coded: list[str], verdicts: dict[str, tuple[str, float] | None], margin: float) -> tuple[str, float] | None:
    """The chain that explains the value best and its gain, if that exceeds the margin.

    Words that gain half the margin count; a value of several such words needs none above.
    """
    votes: Counter = Counter()
    for w in coded:
        if (v := verdicts[w]) and v[1] >= margin / 2:
            votes[v[0]] += v[1]
    if not votes:
        return None
    top = votes.most_common(1)[0]
    return top if top[1] >= margin else None


def misread(values: DataFrame, key: list[str], text: str, model: ngrams.Model | None = None, margin: float | None = None, restore: bool = True) -> DataFrame:
    """The key columns of each misread value with ``chain, gain`` and, if wanted, ``restored``.

    A value is misread if a word in it gains more than the margin under some chain, or if it
    has lost characters (U+FFFD); those cannot be had back, ``chain`` is then 'lost' where no
    chain applies.  Words are repaired by their own chain above the margin, and by the
    value's chain if that makes them likelier at all.  Null and blank values give no row.
    """
    if model is None:
        model, words = train(values, text)
        margin = validate(words.rows, model) if margin is None else margin
        words.drop()
    shared = values.sparkSession.sparkContext.broadcast((model.table, margin, model.rarity))
    order, names = model.order, [*key, "chain", "gain", *["restored"] * restore]
    kinds = {f.name: f.dataType.simpleString() for f in values.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, least, rare = shared.value
        own = ngrams.Model(np.arange(len(table)), table, order)
        own.rarity = rare
        runs, verdicts = _Runs(), {}
        for b in batches:
            texts = b.column(len(key)).to_pylist()
            coded = [[w for w in _words(t) if not w.isascii()] if t and not t.isascii() else () for t in texts]
            if len(verdicts) > REMEMBERED:
                verdicts.clear()
            new = list({w for ws in coded for w in ws if w not in verdicts})
            for k in range(0, len(new), 5000):
                verdicts.update(zip(new[k : k + 5000], best_chains(new[k : k + 5000], own, runs)))
            rows, found = [], []
            for k, (t, ws) in enumerate(zip(texts, coded)):
                if not ws:
                    continue
                verdict = _verdict(ws, verdicts, least)
                if verdict or LOST in t:
                    chain, gain = verdict or ("lost", 0.0)
                    rows.append(k)
                    found.append((chain, gain, _WORD.sub(lambda m: _fix(m.group(), verdicts, chain, least, runs), t) if restore else None))
            took = [b.column(k).take(pa.array(rows, pa.int64())) for k in range(len(key))]
            made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*took, *made[: 2 + restore]], names=names)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "chain string", "gain double", *["restored string"] * restore])
    return values.select(*key, text).mapInArrow(run, schema)


def _fix(word: str, verdicts: dict[str, tuple[str, float] | None], chain: str, margin: float, runs: _Runs) -> str:
    verdict = None if word.isascii() else verdicts.get(word)
    if not verdict:
        return word
    options = _candidates(word, runs)
    return options[verdict[0]] if verdict[1] >= margin else options.get(chain, word)
