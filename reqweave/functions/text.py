"""Column functions for text, with Python's notions of white space, digits and length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, and four control characters that Python strips as well.
SPACE = r"[\s\x1c-\x1f]"
#: Characters that count as digits without being decimal: super- and subscripts, circled and parenthesised ones.
OTHER_DIGITS = r"\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{SPACE}+|{SPACE}+$", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{SPACE}+", "")


def is_blank(c: Column) -> Column:
    """Whether nothing is left by ``strip``. Looks no further than the first character that is left."""
    return ~c.rlike(f"(?U)[^{SPACE[1:]}")


def is_digits(stripped: Column) -> Column:
    return stripped.rlike(rf"^[\p{{Nd}}{OTHER_DIGITS}]+$")


def tokens(c: Column) -> Column:
    """The estimate that chunk sizes go by: a quarter of the code points."""
    return F.floor(F.char_length(c) / 4).cast("long")


def preview(c: Column, n: int = 100) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def first_words(stripped: Column, n: int = 5) -> Column:
    return F.array_join(F.slice(F.split(stripped, f"(?U){SPACE}+"), 1, n), " ")


def path_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def path_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def universal_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def base64(c: Column) -> Column:
    """The UTF-8 bytes of a text (or the bytes of a binary) in base64, on one line."""
    return F.regexp_replace(F.base64(c.cast("binary")), r"[\r\n]", "")


def unbase64(c: Column) -> Column:
    """The text that ``base64`` made that of; null for what is no base64."""
    return F.try_to_binary(c, F.lit("base64")).cast("string")
