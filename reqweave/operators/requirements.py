"""Tables of requirements: union, reports and optional checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def merge(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, none dropped; list_no tells the table, so (list_no, item order) is the order of the union."""
    return reduce(DataFrame.unionByName, [t.withColumn("list_no", F.lit(i).cast("long")) for i, t in enumerate(tables)])


def codes(items: DataFrame) -> DataFrame:
    """The codes, nulls and repetitions with them."""
    return items.select("code")


def duplicate_codes(items: DataFrame) -> DataFrame:
    return items.where("code is not null").groupBy("code").agg(F.count("*").alias("n")).where("n > 1")


def validation(items: DataFrame) -> DataFrame:
    """One row: what the optional checks find. Nothing is changed by it."""
    empty = lambda c: F.count_if(F.coalesce(strip(F.col(c)), F.lit("")) == "")
    untrimmed = lambda c: F.count_if(strip(F.col(c)) != F.col(c))
    return items.agg(
        F.count("*").alias("items"),
        empty("code").alias("empty_codes"),
        empty("description").alias("empty_descriptions"),
        (untrimmed("code") + untrimmed("description")).alias("untrimmed"),
        (F.count("code") - F.count_distinct("code")).alias("repeated_codes"),
    )


def summary(items: DataFrame, key: str = "doc_id", shown: int = 5) -> DataFrame:
    """(key, n, codes, first_codes, more): a report per document. Null and empty codes are left out of the list, not of the count.

    ``items`` has an item order in chunk_no, item_no.
    """
    told = F.when(F.coalesce("code", F.lit("")) != "", F.struct("chunk_no", "item_no", "code"))
    ordered = F.transform(F.array_sort(F.collect_list(told)), lambda x: x["code"])
    report = items.groupBy(key).agg(F.count("*").alias("n"), ordered.alias("all"))
    return report.select(
        key,
        "n",
        F.array_join("all", ", ").alias("codes"),
        F.array_join(F.slice("all", 1, shown), ", ").alias("first_codes"),
        F.greatest(F.size("all") - shown, F.lit(0)).cast("long").alias("more"),
    )
