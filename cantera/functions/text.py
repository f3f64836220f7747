"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: letters that number the options of a parameter, from 1.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: Fixed value: accented vowels and their plain forms (ñ and ç stay).
ACCENTED, PLAIN = "áàäâéèëêíìïîóòöôúùüû", "aaaaeeeeiiiioooouuuu"
_WORD = r"[\p{L}\p{N}_]+"


def code_key(code: Column) -> Column:
    """The key of a code: trimmed, without its trailing ``#``."""
    return F.rtrim(F.trim(code), F.lit("#"))


def family_stem(code: Column) -> Column:
    """A family code without its trailing ``$``."""
    return F.rtrim(code, F.lit("$"))


def is_percentage(code: Column) -> Column:
    """Whether a line's code denotes a percentage of other lines."""
    return code.contains("%") | code.contains("&")


def percentage_prefix(code: Column) -> Column:
    """The code prefix that a percentage line applies to."""
    return F.regexp_extract(code, "^([^%&]*)", 1)


def option_letter(number: Column) -> Column:
    """The letter of a 1-based option number; null outside 1..62."""
    number = number.cast("int")
    return F.when(number.between(1, len(LETTERS)), F.substring(F.lit(LETTERS), number, F.lit(1)))


def option_number(letter: Column) -> Column:
    """The 1-based option number of a letter; null for other characters."""
    at = F.instr(F.lit(LETTERS), letter)
    return F.when((F.length(letter) == 1) & (at > 0), at)


def to_number(text: Column) -> Column:
    """The number a text begins with (decimal comma or point, no exponent), else 0."""
    lead = F.regexp_extract(text, r"^\s*([-+]?(?:\d+(?:[.,]\d*)?|[.,]\d+))", 1)
    return F.coalesce(F.replace(lead, F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))


def to_text(number: Column) -> Column:
    """A number as text: no decimals if whole, else up to ten without trailing zeros."""
    whole = F.format_string("%.0f", number)
    rest = F.rtrim(F.rtrim(F.format_string("%.10f", number), F.lit("0")), F.lit("."))
    return F.when(number == F.floor(number), F.when(number == 0, F.lit("0")).otherwise(whole)).otherwise(rest)


def word_tokens(text: Column) -> Column:
    """Lower-cased maximal runs of letters, digits and ``_``."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def plain_tokens(text: Column) -> Column:
    """Word tokens with accented vowels folded."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit(_WORD), F.lit(0))


def space_words(text: Column) -> Column:
    """The words of a text between white space of any kind; null has none."""
    return F.filter(F.coalesce(F.split(text, r"(?U)\s+"), F.array().cast("array<string>")), lambda w: w != "")


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def undo_corruption(text: Column) -> Column:
    """A text as it was before quotes were added and comparison signs repeated."""
    bare = F.replace(collapse(text), F.lit('"'), F.lit(""))
    signs = F.regexp_replace(bare, r"([<>])=+", "$1=")
    return collapse(F.regexp_replace(signs, r"(?<![<>=])=+", "="))


def render_lines(text: Column) -> Column:
    """Runs of blanks and tabs as one blank in each line, lines and whole text trimmed."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), r"(?U)^\s+|\s+$", "")


def looked_up(name: Column, parameters: Column, variables: Column) -> Column:
    """The value of a name: a parameter before a variable, '' where it is neither."""
    return F.coalesce(F.try_element_at(parameters, name), F.try_element_at(variables, name), F.lit(""))
