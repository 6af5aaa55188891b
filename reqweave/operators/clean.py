"""Line noise and content blocks of converted documents.

Lines are rows (doc_id, line_no, line). Every window is over the lines of one document, so one
exchange by doc_id serves them all, and a document's lines are in one task: the longest document bounds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import SPACE, is_digits, lstrip, strip

# The patterns that tell noise, headings and requirements.
BANNER = r"(?iud)PROPRIETARY.*CONFIDENTIAL"
COMMENT = rf"(?U)^{SPACE}*<!-"
REQUIREMENT_HEADING = r"(?U)^#{1,6}\s+[A-Z]{2,10}-\d+\b"
REQUIREMENT_LINE = r"(?U)^[A-Z]{2,10}-\d+\b"
NOISE_HEADINGS = ("# juice", "## juice")


def is_page_number(line: Column) -> Column:
    return is_digits(strip(line))


def is_banner(line: Column) -> Column:
    return line.rlike(BANNER)


def is_comment(line: Column) -> Column:
    return line.rlike(COMMENT)


def is_noise(line: Column) -> Column:
    """Blank lines are no noise."""
    return (strip(line) != "") & (is_page_number(line) | is_banner(line) | is_comment(line))


def is_heading(line: Column) -> Column:
    return F.startswith(lstrip(line), F.lit("#"))


def is_requirement_heading(line: Column) -> Column:
    return strip(line).rlike(REQUIREMENT_HEADING)


def is_requirement_line(line: Column) -> Column:
    return strip(line).rlike(REQUIREMENT_LINE)


def clean_noise(lines: DataFrame) -> DataFrame:
    """Without page numbers, banners and pieces of comments."""
    return lines.where(~is_noise(F.col("line")))


def noise_kinds(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """How many lines of each kind of noise a document has."""
    line = F.col("line")
    kinds = {"page_numbers": is_page_number, "banners": is_banner, "comments": is_comment}
    return lines.groupBy(key).agg(*[F.count_if(f(line)).alias(n) for n, f in kinds.items()])


def filter_blocks(lines: DataFrame, key: str = "doc_id", noise_headings: tuple[str, ...] = NOISE_HEADINGS) -> DataFrame:
    """Requirement blocks and other headings: ``lines`` with the column block (null for headings).

    A requirement heading owns the lines up to the next heading; a requirement line outside of such a block owns those up to
    the next heading or requirement line. Blank lines at a block's end go, as do noise headings and what no block owns.
    """
    line = F.col("line")
    doc = W.partitionBy(key)
    so_far = doc.orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    marked = lines.withColumns(
        {"_head": is_heading(line), "_rhead": is_requirement_heading(line), "_rline": is_requirement_line(line), "_blank": strip(line) == ""}
    )
    at = lambda flag: F.max(F.when(F.col(flag), F.col("line_no")))
    owned = marked.withColumns({"_h": at("_head").over(so_far), "_rh": at("_rhead").over(so_far)})
    under = W.partitionBy(key, "_h").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    by_head = F.when(F.col("_rh") == F.col("_h"), F.col("_rh"))
    owned = owned.withColumn("block", F.coalesce(by_head, at("_rline").over(under)))
    last = F.max(F.when(~F.col("_blank"), F.col("line_no"))).over(W.partitionBy(key, "block"))
    in_block = F.col("block").isNotNull() & (F.col("line_no") <= F.col("_last"))
    heading = F.col("block").isNull() & F.col("_head") & ~F.lower(strip(line)).isin(*noise_headings)
    kept = owned.withColumn("_last", last).where(in_block | heading)
    return kept.drop("_head", "_rhead", "_rline", "_blank", "_h", "_rh", "_last")


def block_text(kept: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): the kept lines with terminators, one more after every block."""
    after = F.lead("block").over(W.partitionBy(key).orderBy("line_no"))
    ends = F.col("block").isNotNull() & ~F.coalesce(after == F.col("block"), F.lit(False))
    piece = F.concat("line", F.lit("\n"), F.when(ends, "\n").otherwise(""))
    pieces = kept.select(key, "line_no", piece.alias("piece"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "piece")))
    return pieces.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("text"))
