"""Exact deduplication by distributed MSD radix partitioning.

Every text is a string of bytes, led by its length. One round splits every
group that is still open by the next digit, a slice of successive bytes (the first digit is the
length with the first bytes); a group that holds one row, or whose rows end inside the digit, is settled.
Digits get wider each round (up to a bound), so a text of n bytes needs O(log n) rounds.
Rows meet by the bytes themselves: no digest decides equality, and a group's
name is the smallest row number in it (in the first round a number of its own).

Rows whose first digit no other row has stay where they are: a filter of the shared digits' hashes, of bounded
size, tells which texts have to move at all. Every join sorts and merges, with both sides read from
tables, so Spark splits the rows of a hot digit over several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import Work, may_hold

#: Deleted before texts are compared (fixed values: the six ASCII white-space characters).
WHITESPACE = " \t\n\x0b\x0c\r"
FIRST_DIGIT, WIDER, MAX_DIGIT = 64, 16, 1 << 18
ROW = ["rid", "id", "n_cp", "sha"]


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITESPACE, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so without ASCII white space; a null text
    counts as empty. Of equal texts the longest original stays (code points),
    then the smallest id, null ids last; rows that tie in both (repeated rows)
    are told apart by their place in the input, so each group keeps one row.
    An empty table gives an empty result; other columns are not read.
    """
    work = Work(docs.sparkSession, "exact")
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_cp"),
        normalised(F.col(text_col)).cast("binary").alias("rest"),
    )
    digit, n_bytes = F.substring("rest", 1, FIRST_DIGIT), F.octet_length("rest").cast("long")
    shared = rows.groupBy(n_bytes.alias("gid"), digit.alias("digit")).agg(F.count("*").alias("n")).where("n > 1")
    # the rows are numbered again whenever their plan runs, so the first groups have numbers of their own, below zero
    groups = work.save(shared.select("gid", "digit", (-1 - F.monotonically_increasing_id()).alias("new_gid")), "groups0")
    first = rows.withColumn("gid", n_bytes)
    first = may_hold(first, F.xxhash64("gid", F.substring("rest", 1, FIRST_DIGIT)), groups.select(F.xxhash64("gid", "digit")), "moves")
    dealt = first.select(
        F.monotonically_increasing_id().alias("rid"), "id", "n_cp", "gid", F.sha2("rest", 256).alias("sha"), F.when(F.col("moves"), F.col("rest")).alias("rest"), "moves"
    )
    dealt = work.save(dealt, "dealt", by="moves")
    table = _split(work, dealt.where("moves").drop("moves"), groups, FIRST_DIGIT, 0)
    work.drop("dealt/moves=true")
    alone, settled = [dealt.where("not moves").select(ROW)], []
    width, level = FIRST_DIGIT, 0
    while True:
        alone.append(table.where("state = 'alone'").select(ROW))
        settled.append(table.where("state = 'ended'").select("gid", *ROW))
        if level:
            work.drop(f"level{level - 1}/state=open", f"groups{level}")  # its texts went on into this level
        rows = table.where("state = 'open'").select("gid", *ROW, "rest")
        if rows.isEmpty():
            break
        width, level = min(width * WIDER, MAX_DIGIT), level + 1
        counts = rows.groupBy("gid", F.substring("rest", 1, width).alias("digit")).agg(F.count("*").alias("n"), F.min("rid").alias("new_gid")).where("n > 1")
        table = _split(work, rows, work.save(counts.drop("n"), f"groups{level}"), width, level)
    return _result(work, _union(alone), _union(settled), id_col)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _split(work: Work, rows: DataFrame, groups: DataFrame, width: int, level: int) -> DataFrame:
    """Splits open groups by their next ``width`` bytes: rows that are alone now, groups that ended, and those still open."""
    joined = rows.withColumn("digit", F.substring("rest", 1, width)).join(groups.hint("merge"), ["gid", "digit"], "left")
    state = F.when(F.col("new_gid").isNull(), "alone").when(F.octet_length("rest") <= width, "ended").otherwise("open")
    left = F.when(state == "open", F.expr(f"substring(rest, {width + 1})"))
    return work.save(joined.select(F.coalesce("new_gid", "gid").alias("gid"), *ROW, state.alias("state"), left.alias("rest")), f"level{level}", by="state")


def _result(work: Work, alone: DataFrame, settled: DataFrame, id_col: str) -> DataFrame:
    """Groups' rows with what stays of each group; ``best`` is a table, so a large group's rows need not be in one task."""
    order = F.struct("n_cp", F.col("id").isNotNull(), -F.col("id"), -F.col("rid"))
    best = settled.groupBy("gid").agg(F.count("*").alias("group_size"), F.max_by(F.struct("rid", "id"), order).alias("best"))
    best = work.save(best, "best")
    grouped = settled.join(best.hint("merge"), "gid").select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("best.rid") == F.col("rid")).alias("kept"), F.col("sha").alias("text_sha256")
    )
    single = alone.select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256")
    )
    result = work.save(single.unionByName(grouped), "result")
    work.keep_only("result")
    return result
