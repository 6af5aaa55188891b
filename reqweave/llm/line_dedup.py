"""Line deduplication by site-relative frequency.

A line is boilerplate on a host when the share of the host's pages that
contain it exceeds a ratio. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import Work, columns, fresh

RATIO, MIN_PAGES = 0.05, 4
#: Up to this many boilerplate lines are broadcast; beyond it the join shuffles.
BROADCAST_LINES = 100_000
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def boilerplate(work: Work, pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """(host, lines): the boilerplate lines of each host that has any.

    A line counts once a page. Counting goes by two 64-bit hashes of the line,
    so long lines do not travel; the lines themselves come along as one
    representative each. Partial sums bound what a hot host or line sends.
    A host has at most (mean lines a page) / ratio such lines, however many pages.
    """
    once = pages.select("host", F.explode(F.array_distinct(_lines(F.col("text")))).alias("line"))
    counts = (
        once.where(F.trim("line") != "")
        .groupBy("host", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("#"), F.col("line")).alias("h2"))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_pages)
    )
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    frequent = (
        counts.join(totals, "host")
        .where(F.col("n") > F.col("pages") * ratio)
        .select("host", "h1", "h2")
    )
    return work.save(frequent, "frequent")


def line_dedup(
    docs: DataFrame,
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text_col``, other columns and rows untouched.

    Lines end at a line feed. A line goes when at least ``min_pages`` pages of
    its host hold it and they are more than ``ratio`` of the host's pages.
    Blank lines (spaces only) always stay. A null host is a host of its own; a
    null text stays null and counts as a page without lines; a page that loses
    every line stays, with an empty text. Repeated rows are pages of their own. Further columns stay, whatever their names.
    """
    work = Work(docs.sparkSession, "lines")
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col)), F.lit(""))
    pages = docs.select(host.alias("host"), F.col(text_col).alias("text"))
    frequent = boilerplate(work, pages, ratio, min_pages)
    n = frequent.count()
    if n == 0:
        return docs
    host_, lines, salt = (fresh(docs, c) for c in ("__host", "__hot", "__salt"))
    hot = frequent.groupBy(F.col("host").alias(host_)).agg(F.collect_list(F.struct("h1", "h2")).alias(lines))
    rows = docs.withColumn(host_, host)
    if n <= BROADCAST_LINES:
        joined = rows.join(F.broadcast(hot), host_, "left")
    else:
        # a host may hold a third of all pages: its lines go to SALTS tasks
        salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
        hot = hot.withColumn(salt, F.explode(salts))
        rows = rows.withColumn(salt, F.pmod(F.xxhash64(text_col), F.lit(SALTS)).cast("int"))
        joined = rows.join(hot, [host_, salt], "left")
    key = lambda line: F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("#"), line).alias("h2"))
    kept = F.filter(_lines(F.col(text_col)), lambda line: ~F.array_contains(lines, key(line)))
    text = F.when(F.col(text_col).isNull() | F.col(lines).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(text_col, text).select(*columns(docs))
