"""Evaluate programs over blocks of selections, all rows of a block at once.

Programs are straight-line and their types are known beforehand, so each statement is one
step over vectors: numbers are numpy arrays, texts are codes into their distinct words, and
whatever numpy lacks is done once per distinct value.  An error only marks its rows; the
first one of a row in order of evaluation counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

from ..functions.text import LETTERS
from .syntax import PARAMETERS, Program

#: Fixed value: the message of an exclusion without one of its own.
EXCLUDED = "Combinación no válida"
_NUMBER = re.compile(r"\s*([-+]?(?:\d+(?:[.,]\d*)?|[.,]\d+))")
_LINE = pa.struct([("ord", pa.int32()), ("code", pa.string()), ("qty", pa.float64())])

RESULT = pa.schema([
    ("family", pa.string()), ("ordinal", pa.int64()), ("selection", pa.list_(pa.int32())), ("valid", pa.bool_()), ("error", pa.string()), ("resumen", pa.string()), ("texto", pa.string()),
    ("lines", pa.list_(_LINE)), ("direct_price", pa.float64()), ("aux_percent", pa.float64()), ("warnings", pa.list_(pa.string())),
])


class EvalFault(ValueError):
    """An error of the rows that hold a value."""


def number_of(text: str) -> float:
    m = _NUMBER.match(text)
    return float(m[1].replace(",", ".")) if m else 0.0


def text_of(value: float) -> str:
    if not math.isfinite(value):
        raise EvalFault("number out of range")
    return str(int(value)) if value == int(value) else f"{value:.10f}".rstrip("0").rstrip(".")


def rounded(value: float, places: float = 0.0) -> float:
    return float(Decimal(repr(value)).quantize(Decimal(1).scaleb(-int(places)), rounding=ROUND_HALF_UP))


def levelled(text: str) -> str:
    """One blank for each run of blanks and tabs, no white space around lines and whole."""
    return "\n".join(" ".join(re.split(r"[ \t]+", x)).strip() for x in text.split("\n")).strip()


def power(a: float, b: float) -> float:
    if a == 0 and b < 0:
        raise EvalFault("zero to a negative power")
    if a < 0 and b != math.floor(b):
        raise EvalFault("power of a negative number")
    return a**b


def angle(name: str, value: float) -> float:
    if abs(value) > 1:
        raise EvalFault(f"outside the domain of {name}")
    return math.degrees(math.asin(value) if name == "ASIN" else math.acos(value))


def root(value: float) -> float:
    if value < 0:
        raise EvalFault("square root of negative number")
    return math.sqrt(value)


UNARY: dict[str, Callable[[float], float]] = {
    "ABS": abs, "INT": lambda x: float(math.trunc(x)), "ROUND": rounded, "SIN": lambda x: math.sin(math.radians(x)), "COS": lambda x: math.cos(math.radians(x)), "TAN": lambda x: math.tan(math.radians(x)), "ASIN": lambda x: angle("ASIN", x), "ACOS": lambda x: angle("ACOS", x), "ATAN": lambda x: math.degrees(math.atan(x)), "SQRT": root,
}
BINARY: dict[str, Callable[[float, float], float]] = {"ROUND": rounded, "ATAN2": lambda y, x: math.degrees(math.atan2(y, x)), "^": power}
COMPARE: dict[str, Callable] = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b}


class Words:
    """A vector of texts: codes into words (which may repeat)."""

    __slots__ = ("codes", "words")

    def __init__(self, codes: np.ndarray, words: list[str]) -> None:
        self.codes, self.words = codes, words

    def each(self, f: Callable[[str], object], kind) -> np.ndarray:
        """A function of every word, spread over the rows."""
        return np.array([f(w) for w in self.words], kind)[self.codes]

    def mapped(self, f: Callable[[str], str]) -> Words:
        return Words(self.codes, [f(w) for w in self.words])

    def paired(self, other: Words) -> tuple[np.ndarray, list[tuple[str, str]]]:
        """The distinct pairs of two vectors and each row's pair."""
        if len(self.words) == 1 or len(other.words) == 1:
            codes = other.codes if len(self.words) == 1 else self.codes
            return codes, [(a, b) for a in self.words for b in other.words]
        n = len(other.words)
        some, codes = np.unique(self.codes.astype(np.int64) * n + other.codes, return_inverse=True)
        return codes, [(self.words[k // n], other.words[k % n]) for k in some.tolist()]


class Block:
    """One program over ``n`` selections; statements leave their results in its fields."""

    def __init__(self, program: Program, selections: np.ndarray) -> None:
        self.n = len(selections)
        self.errors: list[str | None] = [None] * self.n
        self.fine, self.allowed = np.ones(self.n, bool), np.ones(self.n, bool)
        self.warnings: dict[str, None] = {}
        self.lines: list[tuple[Words, np.ndarray]] = []
        self.texts: dict[str, Words | list[Words]] = {}
        self.price = self.aux = None
        self.values: dict[str, tuple] = {}
        for k, (var, p) in enumerate(zip(PARAMETERS, program.params)):
            self.values["%" + var] = ("num", selections[:, k].astype(float))
            self.values["$" + var] = ("text", Words(selections[:, k] - 1, p["options"]))
        with np.errstate(all="ignore"):
            for kind, *parts in program.statements:
                getattr(self, f"do_{kind}")(*parts)

    # errors

    def fail(self, rows: np.ndarray | bool, message: str) -> None:
        for k in np.flatnonzero(self.fine & rows).tolist():
            self.errors[k] = f"evaluation error: {message}"
        self.fine &= ~np.asarray(rows)

    def _tried(self, f: Callable, arguments: list, codes: np.ndarray, failed):
        """The function of each distinct argument; where it raises, its rows fail."""
        out = []
        for k, a in enumerate(arguments):
            try:
                out.append(f(*a))
            except EvalFault as e:
                self.fail(codes == k, str(e))
                out.append(failed)
            except (ArithmeticError, ValueError):
                self.fail(codes == k, "number out of range")
                out.append(failed)
        return out

    def each(self, f: Callable[[float], float], x: np.ndarray) -> np.ndarray:
        some, codes = np.unique(x, return_inverse=True)
        return np.array(self._tried(f, [(v,) for v in some.tolist()], codes, 0.0), float)[codes]

    def both(self, f: Callable[[float, float], float], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        pair = np.empty(self.n, complex)
        pair.real, pair.imag = x, y
        some, codes = np.unique(pair, return_inverse=True)
        return np.array(self._tried(f, [(v.real, v.imag) for v in some.tolist()], codes, 0.0), float)[codes]

    # values: ("num", array), ("text", Words), ("nums" | "texts", (shape, cells))

    def same(self, value: float) -> np.ndarray:
        return np.full(self.n, value)

    def said(self, text: str) -> Words:
        return Words(np.zeros(self.n, np.int64), [text])

    def single(self, value: tuple, use: str) -> tuple:
        if value[0] in ("num", "text"):
            return value
        self.fail(True, f"matrix used as {use}")
        return ("num", self.same(0.0))

    def num(self, value: tuple) -> np.ndarray:
        kind, x = self.single(value, "a number")
        return x.each(number_of, float) if kind == "text" else x

    def txt(self, value: tuple) -> Words:
        kind, x = self.single(value, "text")
        if kind == "text":
            return x
        some, codes = np.unique(x, return_inverse=True)
        return Words(codes, self._tried(text_of, [(v,) for v in some.tolist()], codes, ""))

    def holds(self, value: tuple) -> np.ndarray:
        kind, x = self.single(value, "a condition")
        return x.each(bool, bool) if kind == "text" else x != 0

    # expressions

    def value(self, e: list) -> tuple:
        return getattr(self, f"on_{e[0]}")(*e[1:])

    def on_num(self, x: float) -> tuple:
        return ("num", self.same(x))

    def on_str(self, x: str) -> tuple:
        return ("text", self.said(x))

    def on_fault(self, message: str) -> tuple:
        self.fail(True, message)
        return ("num", self.same(0.0))

    def on_neg(self, e: list) -> tuple:
        return ("num", -self.num(self.value(e)))

    def on_not(self, e: list) -> tuple:
        return ("num", (~self.holds(self.value(e))).astype(float))

    def on_var(self, sign: str, name: str, indices: list | None) -> tuple:
        index, key = [self.value(i) for i in indices or []], sign + name
        empty = ("num", self.same(0.0)) if sign == "%" else ("text", self.said(""))
        if key not in self.values:
            self.warnings.setdefault(f"undefined variable {key}")
        kind, held = self.values.get(key, empty)
        if kind in ("num", "text"):
            if index:
                self.fail(True, f"{key} is not a matrix")
            return (kind, held)
        shape, cells = held
        if not index and len(cells) == 1:
            return (empty[0], cells[0])
        if len(index) != len(shape):
            self.fail(True, f"{key} has {len(shape)} dimensions and is read with {len(index)} indices")
            return empty
        return (empty[0], self.cell(shape, cells, [self.num(i) for i in index]))

    def cell(self, shape: list[int], cells: list, index: list[np.ndarray]) -> np.ndarray | Words:
        """The cell of each row; indices are rounded half to even and count from 1."""
        near = [np.rint(np.nan_to_num(i, posinf=1e15, neginf=-1e15)).astype(np.int64) for i in index]
        for d, (k, size) in enumerate(zip(near, shape), 1):
            for v in np.unique(k[(k < 1) | (k > size)]).tolist():
                # fixed value: the words of this message
                self.fail(k == v, f"index {v} out of range 1..{size} in dimension {d}")
        at = np.ravel_multi_index([k - 1 for k in near], shape, mode="clip")
        if isinstance(cells[0], Words):
            begin = np.cumsum([0, *(len(c.words) for c in cells)])
            own = np.stack([c.codes for c in cells])[at, np.arange(self.n)]
            return Words(begin[at] + own, [w for c in cells for w in c.words])
        return np.stack(cells)[at, np.arange(self.n)]

    def on_bin(self, op: str, left: list, right: list) -> tuple:
        a, b = self.value(left), self.value(right)
        if op in "@&":
            p, q = self.holds(a), self.holds(b)
            return ("num", (p | q if op == "@" else p & q).astype(float))
        texts = (a[0] == "text") + (b[0] == "text")
        if op in COMPARE:
            if texts == 2:
                codes, pairs = a[1].paired(b[1])
                return ("num", np.array([float(COMPARE[op](*p)) for p in pairs])[codes])
            return ("num", COMPARE[op](self.num(a), self.num(b)).astype(float))
        if op == "+" and texts:
            codes, pairs = self.txt(a).paired(self.txt(b))
            return ("text", Words(codes, [x + y for x, y in pairs]))
        if op == "*" and texts == 1:
            text, shown = (a[1], self.num(b)) if a[0] == "text" else (b[1], self.num(a))
            return ("text", Words(np.where(shown != 0, text.codes, len(text.words)), [*text.words, ""]))
        x, y = self.num(a), self.num(b)
        if op == "^":
            return ("num", self.both(power, x, y))
        if op == "/":
            self.fail(y == 0, "division by zero")
            return ("num", x / np.where(y == 0, 1.0, y))
        return ("num", x + y if op == "+" else x - y if op == "-" else x * y)

    def on_call(self, name: str, arguments: list) -> tuple:
        found = [self.value(a) for a in arguments]
        if name == "FTOA":
            return ("text", self.txt(("num", self.num(found[0]))))
        if name == "ATOF":
            return ("num", self.txt(found[0]).each(number_of, float))
        x = self.num(found[0])
        if name in BINARY and len(found) > 1:
            return ("num", self.both(BINARY[name], x, self.num(found[1])))
        return ("num", self.each(UNARY[name], x))

    def shown(self, pieces: list) -> Words:
        """A template's text; numbers are shown as the letter of an option."""
        out = self.said("")
        for p in pieces:
            if isinstance(p, str):
                out = out.mapped(lambda w, p=p: w + p)
                continue
            value = self.value(p)
            if p[0] == "fault" or p[1] == "$":
                more = self.txt(value)
            else:
                x = self.num(value)
                some, codes = np.unique(x, return_inverse=True)
                more = Words(codes, self._tried(lambda v, name=p[2]: self.letter(v, name), [(v,) for v in some.tolist()], codes, ""))
            codes, pairs = out.paired(more)
            out = Words(codes, [x + y for x, y in pairs])
        return out

    @staticmethod
    def letter(value: float, name: str) -> str:
        k = round(value)
        if not 1 <= k <= len(LETTERS):
            raise EvalFault(f"%{name} = {k} cannot be written as an option letter")
        return LETTERS[k - 1]

    # statements

    def do_let(self, sign: str, name: str, shape: list[int] | None, values: list) -> None:
        found = [self.value(v) for v in values]
        cells = [self.num(v) if sign == "%" else self.txt(v) for v in found]
        kind = "num" if sign == "%" else "text"
        self.values[sign + name] = (f"{kind}s", (shape, cells)) if shape else (kind, cells[0])
        if sign + name == "%E" and not shape:
            now = self.allowed & self.fine & (cells[0] != 0)
            own = self.values.get("$E", ("", None))
            for k in np.flatnonzero(now).tolist():
                self.errors[k] = (own[1].words[own[1].codes[k]] if own[0] == "text" else "") or EXCLUDED
            self.allowed &= ~now

    def do_line(self, code: list, quantity: list, factor: list | None) -> None:
        name, amount = self.shown(code), self.num(self.value(quantity))
        self.lines.append((name, amount * self.num(self.value(factor)) if factor else amount))

    def do_price(self, e: list) -> None:
        self.price = self.num(self.value(e))

    def do_aux(self, e: list, divisor: float) -> None:
        self.aux = self.num(self.value(e)) / divisor

    def do_text(self, name: str, pieces: list) -> None:
        self.texts[name] = self.shown(pieces).mapped(levelled)

    def do_list(self, name: str, parts: list) -> None:
        self.texts[name] = [self.shown(p).mapped(levelled) for p in parts]

    # results

    def merged(self) -> pa.ListArray:
        """The lines of each row: equal codes summed in order at the first one's place, zeros dropped."""
        words: dict[str, int] = {}
        codes = [name.each(lambda w: words.setdefault(w, len(words)), np.int64) for name, _ in self.lines]
        sums, first = [], []
        for code, (_, amount) in zip(codes, self.lines):
            new = self.fine.copy()
            for k, other in enumerate(codes[: len(sums)]):
                again = new & first[k] & (other == code)
                sums[k] = np.where(again, sums[k] + amount, sums[k])
                new &= ~again
            sums.append(amount.copy())
            first.append(new)
        if not sums:
            return pa.ListArray.from_arrays(pa.array(np.zeros(self.n + 1, np.int32)), pa.array([], _LINE))
        code, total = np.stack(codes, 1), np.stack(sums, 1)
        kept = np.stack(first, 1) & (total != 0)
        order = (np.cumsum(kept, 1) - 1)[kept].astype(np.int32)
        flat = pa.StructArray.from_arrays([pa.array(order), pa.array(list(words)).take(pa.array(code[kept])), pa.array(total[kept])], fields=list(_LINE))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept.sum(1))).astype(np.int32)), flat)

    def arrays(self) -> list[pa.Array]:
        """The columns of the result from ``valid`` on."""

        def text(name: str) -> pa.Array:
            found = self.texts.get(name)
            return pa.nulls(self.n, pa.string()) if found is None else pa.array(found.words, pa.string()).take(pa.array(found.codes, mask=~self.fine))

        def number(x: np.ndarray | None) -> pa.Array:
            return pa.nulls(self.n, pa.float64()) if x is None else pa.array(x, mask=~self.fine)

        said = pa.array([[], list(self.warnings)], pa.list_(pa.string())).take(pa.array(self.fine.astype(np.int8)))
        return [pa.array(self.fine & self.allowed), pa.array(self.errors, pa.string()), text("RESUMEN"), text("TEXTO"), self.merged(), number(self.price), number(self.aux), said]


def selections(ordinals: np.ndarray, counts: list[int]) -> np.ndarray:
    """The 1-based options of each ordinal, the last parameter fastest, a row each."""
    if not counts:
        return np.zeros((len(ordinals), 0), np.int64)
    return np.stack(np.unravel_index(ordinals, counts), axis=1) + 1


def evaluated(program: Program, chosen: np.ndarray, family: str = "", ordinals: np.ndarray | None = None) -> pa.RecordBatch:
    """The evaluation of a program for selections (a row each) as one batch."""
    n = len(chosen)
    at = np.arange(n) if ordinals is None else ordinals
    flat = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * chosen.shape[1]).astype(np.int32)), pa.array(chosen.ravel().astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array([family] * n, pa.string()), pa.array(at, pa.int64()), flat, *Block(program, chosen).arrays()], schema=RESULT)


def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``family, program, first, until`` to batches of evaluations, a block each."""
    known: dict[str, Program] = {}
    for b in batches:
        for family, text, first, until in zip(*(c.to_pylist() for c in b.columns)):
            if family not in known:
                known[family] = Program.from_json(text)
            ordinals = np.arange(first, until)
            yield evaluated(known[family], selections(ordinals, known[family].counts()), family, ordinals)
