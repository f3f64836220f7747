"""One form for text that looks the same, built from the character database by rule."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Cut

#: Letters of other scripts that look like Latin letters, and those letters.
CYRILLIC, CYRILLIC_AS = "аеорсухіјѕһԁԛԝАВЕЅІЈКМНОРСТХУԚԜ", "aeopcyxijshdqwABESIJKMHOPCTXYQW"
GREEK, GREEK_AS = "ονΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovABEZHIKMNOPTYX"
LOOKALIKE = dict(zip(map(ord, CYRILLIC + GREEK), CYRILLIC_AS + GREEK_AS))

#: Compatibility mappings whose result differs visibly from the character itself.
VISIBLE = ("<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>", "<small>")


#: The ranges of the standard's property Default_Ignorable_Code_Point.
IGNORABLE = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)


def ignorable(c: str) -> bool:
    """Whether a character is invisible by default: joiners, fillers, marks of direction."""
    return any(a <= ord(c) <= b for a, b in IGNORABLE)


def visual_char(c: str) -> str:
    """The plain characters that a character looks like (canonically decomposed)."""
    if ignorable(c):
        return ""
    if unicodedata.category(c) == "Zs":
        return " "
    kind, _, rest = unicodedata.decomposition(c).partition(" ")
    if kind.startswith("<"):
        if kind in VISIBLE or rest.startswith("0020"):
            return c
        return "".join(visual_char(chr(int(x, 16))) for x in rest.split())
    if kind:
        return "".join(visual_char(x) for x in unicodedata.normalize("NFD", c))
    return LOOKALIKE.get(ord(c), c)


class _Table(dict):
    """A translation table that is filled as characters occur."""

    def __init__(self, rule) -> None:
        self.rule = rule

    def __missing__(self, key: int) -> str:
        self[key] = value = self.rule(chr(key))
        return value


VISUAL = _Table(visual_char)


def visual_form(text: str) -> str:
    """The text in plain characters, composed: equal for texts that look the same.

    Wide forms, joined letters, look-alike letters and special spaces become plain, invisible
    characters go; case, accents, raised figures, fractions and ordinal signs stay.
    """
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(VISUAL))


def comparison_form(text: str) -> str:
    """Compatibility-composed, case-folded visual form with white space runs as one space."""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", visual_form(text)).casefold())
    return " ".join(folded.split())


def normalized(df: DataFrame, *columns: str, form=comparison_form) -> DataFrame:
    """The table with each named text column in one form; nulls stay null, empty stays empty.

    Each batch is dictionary-encoded, so every distinct value is normalised once.
    """
    names, schema = df.columns, df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = list(b.columns)
            for c in columns:
                k = names.index(c)
                coded = arrays[k].dictionary_encode()
                values = pa.array([form(x) for x in coded.dictionary.to_pylist()], pa.string())
                arrays[k] = pc.take(values, coded.indices)
            yield pa.RecordBatch.from_arrays(arrays, names=b.schema.names)

    return df.mapInArrow(run, schema)


def _settled(c: str) -> bool:
    """Whether a character looks like nothing but itself and folds as its lower case."""
    return visual_form(c) == c and len(c.lower()) == 1 and comparison_form(c) == c.lower() and not unicodedata.combining(c)


#: Settled characters beyond ASCII (Latin 1 and the usual dashes and quotes); texts of these
#: and ASCII never leave the JVM.
SETTLED = "".join(c for c in map(chr, [*range(0xA1, 0x100), 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2022, 0x20AC]) if _settled(c))


def _digest(text: str) -> bytes:
    return md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()


def form_digests(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """``record_id, folded, looks, stored``: digests of the comparison form, the visual form
    and the text itself; null and blank texts give no row.

    Texts of settled characters only are their own visual form and are hashed in the JVM.
    """
    named = df.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(text).alias("text")).filter("text is not null")
    blank = r"\s\x0b\x1c-\x1f"
    plain = F.col("text").rlike(rf"\A[\x00-\x7f{re.escape(SETTLED)}]*\z")
    folded = F.trim(F.regexp_replace(F.lower("text"), f"[{blank}]+", " "))
    own = F.when(plain, F.unhex(F.md5("text")))
    rows = named.select("record_id", F.when(plain, F.unhex(F.md5(folded))).alias("folded"), own.alias("looks"), F.when(~plain, F.col("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = b.filter(pc.is_valid(b.column(1)))
            yield pa.RecordBatch.from_arrays([*done.columns[:3], done.column(2)], names=["record_id", "folded", "looks", "stored"])
            rest = b.filter(pc.is_null(b.column(1)))
            seen: dict[str, tuple] = {}
            out = []
            for i, t in zip(rest.column(0).to_pylist(), rest.column(3).to_pylist()):
                if t not in seen:
                    looks = visual_form(t)
                    seen[t] = (_digest(comparison_form(t)), _digest(looks), _digest(t)) if looks.strip() else None
                if seen[t]:
                    out.append((i, *seen[t]))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["record_id", "folded", "looks", "stored"])

    # a blank text folds to nothing
    return rows.filter("text is not null or folded <> unhex(md5(''))").mapInArrow(run, "record_id bigint, folded binary, looks binary, stored binary")


def lookalike_classes(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """``record_id, class_id, stored``: the records of each look that is stored in several ways,
    the class being its smallest record and ``stored`` a digest of the characters.

    Records meet by comparison form; an exact check on the visual form follows.
    """
    forms = Cut(form_digests(df, record_id, text)).rows
    each = forms.groupBy("folded", "looks").agg(F.min("stored").alias("a"), F.max("stored").alias("b"), F.min("record_id").alias("class_id"))
    return forms.join(each.filter("a <> b"), ["folded", "looks"]).select("record_id", "class_id", "stored")


def lookalike_pairs(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """``record_a, record_b`` (a < b): the classes expanded to all pairs stored differently.

    Copies stored in the same characters are no pair.
    """
    held = Cut(lookalike_classes(df, record_id, text)).rows
    other = held.select("class_id", F.col("record_id").alias("record_b"), F.col("stored").alias("stored_b"))
    return held.withColumnRenamed("record_id", "record_a").join(other, "class_id").filter("record_a < record_b and stored <> stored_b").select("record_a", "record_b")


def word_char(c: str) -> str:
    """What a character is to word matching: its folded letters, nothing, or a space."""
    plain = visual_char(c)
    if not plain:
        return ""
    kept = "".join(x for x in unicodedata.normalize("NFD", plain.casefold()) if unicodedata.category(x) not in ("Mn", "Me"))
    if unicodedata.category(c) in ("Mn", "Me"):
        return ""
    kept = "".join(LOOKALIKE.get(ord(x), x) for x in kept)
    return kept if all(unicodedata.category(x) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nd", "Mc") for x in kept) and kept else " "


WORDS = _Table(word_char)


def words(text: str) -> list[str]:
    """Runs of letters and digits without regard to case, accents and look-alikes."""
    return text.translate(WORDS).split()
