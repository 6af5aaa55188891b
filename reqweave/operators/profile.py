"""Which lines and beginnings of lines come again: suggestions for cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_words, is_digits


def _top(rows: DataFrame, value: str, n: int) -> DataFrame:
    """The n most frequent values, ties by first occurrence, then those that occur more than once."""
    counted = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "line_no")).alias("first"))
    top = counted.orderBy(F.desc("n"), "first").limit(n).where("n > 1")
    return top.select(value, "n", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"))


def frequent_lines(lines: DataFrame, n: int = 10) -> DataFrame:
    """``lines``: doc_id, line_no, line, stripped and not blank."""
    return _top(lines, "line", n)


def frequent_prefixes(lines: DataFrame, n: int = 10, words: int = 5) -> DataFrame:
    return _top(lines.select("doc_id", "line_no", first_words(F.col("line"), words).alias("prefix")), "prefix", n)


def structure(lines: DataFrame) -> DataFrame:
    """One row: distinct lines, those that are numbers, and those with comments."""
    line = F.col("line")
    return lines.agg(
        F.count_distinct("line").alias("distinct_lines"),
        F.count_distinct(F.when(is_digits(line), line)).alias("digit_lines"),
        F.count_distinct(F.when(line.contains("<!--"), line)).alias("comment_lines"),
    )
