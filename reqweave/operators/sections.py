"""Markdown sections by headers of two levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import strip

HEADERS = (("#", "Header 1"), ("##", "Header 2"))


def check_headers(headers) -> tuple[tuple[str, str], ...]:
    """The header levels, as (marker, name); raises ValueError for anything else than two pairs, first the upper."""
    headers = HEADERS if headers is None else headers
    ok = isinstance(headers, list | tuple) and len(headers) == 2
    if not ok or any(not isinstance(h, list | tuple) or len(h) != 2 or not all(isinstance(x, str) for x in h) for h in headers):
        raise ValueError("headers: two pairs of marker and name")
    if any(not h[0] or set(h[0]) != {"#"} for h in headers) or len(headers[0][0]) >= len(headers[1][0]):
        raise ValueError("markers: number signs, the upper level's first")
    return tuple(tuple(h) for h in headers)


def sections(lines: DataFrame, key: str = "doc_id", headers=None, strip_headers: bool = False) -> DataFrame:
    """(key, section_no, header1, header2, content) of lines (key, line_no, line).

    A header is a marker alone or one and a space; within fences (``` or ~~~) there are none. A header starts a paragraph and
    clears deeper ones; a blank line ends it. Paragraphs with the same headers are one section, joined by two spaces and a line feed;
    a paragraph that ends in a heading runs on into the deeper section after it. Text before any header has none.
    ``strip_headers`` leaves header lines out. Fences of one document are taken to be neither nested nor mixed.
    """
    (top, _), (low, _) = check_headers(headers)
    doc = W.partitionBy(key).orderBy("line_no")
    so_far = doc.rowsBetween(W.unboundedPreceding, 0)
    text = F.regexp_replace(strip(F.col("line")), r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]", "")
    rows = lines.select(key, "line_no", text.alias("t"))
    fence = F.col("t").rlike(r"^(```|~~~)") & ~F.col("t").rlike(r"^```.*```")
    rows = rows.withColumn("code", F.sum(fence.cast("int")).over(so_far) % 2 == 1)
    name = lambda marker: F.when(
        ~F.col("code") & ((F.col("t") == marker) | F.startswith(F.col("t"), F.lit(f"{marker} "))), strip(F.substring("t", len(marker) + 1, 1 << 30))
    )
    rows = rows.withColumns({"n1": name(top), "n2": name(low)})
    rows = rows.withColumn("head", F.col("n1").isNotNull() | F.col("n2").isNotNull())
    rows = rows.withColumn("blank", ~F.col("code") & (F.col("t") == ""))
    rows = rows.withColumn("h1_at", F.max(F.when(F.col("n1").isNotNull(), F.col("line_no"))).over(so_far))
    rows = rows.withColumn("h1", F.last("n1", ignorenulls=True).over(so_far))
    under = W.partitionBy(key, "h1_at").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("h2", F.last("n2", ignorenulls=True).over(under))
    starts = F.col("head") | F.coalesce(F.lag("blank").over(doc), F.lit(True))
    rows = rows.withColumn("para", F.sum(starts.cast("int")).over(so_far)).where("not blank")
    if strip_headers:
        rows = rows.where("not head")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "t")))
    paras = rows.groupBy(key, "para").agg(
        F.transform(ordered, lambda x: x["t"]).alias("ts"), F.max_by("h1", "line_no").alias("h1"), F.max_by("h2", "line_no").alias("h2")
    )
    paras = paras.withColumn("depth", F.col("h1").isNotNull().cast("int") + F.col("h2").isNotNull().cast("int"))
    order = W.partitionBy(key).orderBy("para")
    same = F.lag("h1").over(order).eqNullSafe(F.col("h1")) & F.lag("h2").over(order).eqNullSafe(F.col("h2"))
    ends_in_heading = F.startswith(F.element_at(F.lag("ts").over(order), -1), F.lit("#"))
    deeper = (F.lag("depth").over(order) < F.col("depth")) & ends_in_heading & F.lit(not strip_headers)
    joins = F.lag("para").over(order).isNotNull() & (same | F.coalesce(deeper, F.lit(False)))
    running = order.rowsBetween(W.unboundedPreceding, 0)
    paras = paras.withColumn("new", (~joins).cast("int"))
    paras = paras.withColumn("section_no", F.sum("new").over(running) - 1)
    pieces = F.array_sort(F.collect_list(F.struct("para", F.array_join("ts", "\n").alias("c"))))
    return paras.groupBy(key, F.col("section_no").cast("long").alias("section_no")).agg(
        F.max_by("h1", "para").alias("header1"),
        F.max_by("h2", "para").alias("header2"),
        F.array_join(F.transform(pieces, lambda x: x["c"]), "  \n").alias("content"),
    )
