"""Chunks of bounded size: oversize sections split, small ones packed by their upper header."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import tokens

MAX_TOKENS, OVERLAP = 3500, 200
SEPARATORS = ("\n\n", "\n", " ", "")


def split_size(max_tokens: int) -> int:
    return int(max_tokens * 3.8)


def oversize(chunks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    return chunks.where(tokens(F.col("content")) > max_tokens)


def _cut(text: str, separator: str) -> list[str]:
    """Pieces of a text, each but the first beginning with the separator."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [p for p in (first, *(separator + r for r in rest)) if p]


def _merged(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Neighbouring pieces together up to the size; each result repeats the last pieces of the one before, up to the overlap."""
    out, window, total = [], [], 0
    for piece in pieces:
        if window and total + len(piece) > size:
            out.append("".join(window))
            while window and (total > overlap or total + len(piece) > size):
                total -= len(window.pop(0))
        window.append(piece)
        total += len(piece)
    if window:
        out.append("".join(window))
    return [t for t in map(str.strip, out) if t]


def recursive_split(text: str, size: int, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Parts of at most ``size`` characters, cut at the first separator that occurs and, where that leaves too much, at the next."""
    k = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    out, fitting = [], []
    for piece in _cut(text, separators[k]):
        if len(piece) < size:
            fitting.append(piece)
            continue
        out += _merged(fitting, size, overlap)
        fitting = []
        deeper = separators[k + 1 :]
        out += recursive_split(piece, size, overlap, deeper) if deeper else [piece]
    return out + _merged(fitting, size, overlap)


def split_oversize(chunks: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, count: Callable[[Column], Column] = tokens) -> DataFrame:
    """``chunks`` with sub_chunk_index: null where the content fits, else its parts from 1. Only the others meet Python."""
    size = split_size(max_tokens)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def parts(content: pd.Series) -> pd.Series:
        return content.map(lambda t: recursive_split(t, size, overlap))

    rest = [F.col(f"`{c}`") for c in chunks.columns if c != "content"]
    big = count(F.col("content")) > max_tokens
    fits = chunks.where(~big).select(*rest, F.lit(None).cast("int").alias("sub_chunk_index"), "content")
    split = chunks.where(big).select(*rest, F.posexplode(parts("content")).alias("sub_chunk_index", "content"))
    return fits.unionByName(split.withColumn("sub_chunk_index", F.col("sub_chunk_index") + 1))


def header_groups(chunks: DataFrame, key: str = "doc_id", count: Callable[[Column], Column] = tokens) -> DataFrame:
    """(key, header1, group_no, members, token_sum): sections by the text of their upper header, far apart or not."""
    return chunks.groupBy(key, F.coalesce("header1", F.lit("unknown")).alias("header1")).agg(
        F.min("section_no").alias("group_no"), F.count("*").alias("members"), F.sum(count(F.col("content"))).alias("token_sum")
    )


def bins(sizes: Column, limit: int) -> Column:
    """For an array of sizes, the bin of each: a new one where the bin holds something and would exceed the limit."""
    start = F.struct(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("held"), F.array().cast("array<bigint>").alias("ids"))

    def step(acc: Column, n: Column) -> Column:
        new = (acc["held"] > 0) & (acc["held"] + n > limit)
        at = acc["bin"] + F.when(new, 1).otherwise(0)
        return F.struct(at.alias("bin"), (F.when(new, 0).otherwise(acc["held"]) + n).alias("held"), F.array_append(acc["ids"], at).alias("ids"))

    return F.aggregate(sizes, start, step, lambda acc: acc["ids"])


def pack(chunks: DataFrame, key: str = "doc_id", max_tokens: int = MAX_TOKENS, count: Callable[[Column], Column] = tokens) -> DataFrame:
    """Chunks (key, section_no, header1, header2, content[, sub_chunk_index]) packed in order within their upper header.

    Gives key, header1, bin_no, content (members joined by a blank line), merged_from (lower headers, UNKNOWN for none), token_count (the
    members' sum by ``count``), chunk_count, and group_no, by which bins are ordered. Texts stay out of the fold that assigns bins.
    """
    sub = F.coalesce("sub_chunk_index", F.lit(0)) if "sub_chunk_index" in chunks.columns else F.lit(0)
    rows = chunks.select(
        F.col(key),
        F.coalesce("header1", F.lit("unknown")).alias("header1"),
        F.struct(
            F.col("section_no").alias("at"), sub.alias("sub"), count(F.col("content")).cast("long").alias("n"), "content", F.coalesce("header2", F.lit("UNKNOWN")).alias("h2")
        ).alias("m"),
    )
    groups = rows.groupBy(key, "header1").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    groups = groups.withColumn("bins", bins(F.transform("ms", lambda m: m["n"]), max_tokens))
    placed = groups.select(key, "header1", F.col("ms")[0]["at"].alias("group_no"), F.explode(F.arrays_zip("ms", "bins")).alias("z"))
    ordered = F.array_sort(F.collect_list("z.ms"))
    packed = placed.groupBy(key, "header1", "group_no", F.col("z.bins").alias("bin_no")).agg(ordered.alias("ms"))
    return packed.select(
        key,
        "header1",
        "group_no",
        "bin_no",
        F.array_join(F.transform("ms", lambda m: m["content"]), "\n\n").alias("content"),
        F.transform("ms", lambda m: m["h2"]).alias("merged_from"),
        F.aggregate("ms", F.lit(0).cast("long"), lambda s, m: s + m["n"]).alias("token_count"),
        F.size("ms").cast("long").alias("chunk_count"),
    )


def optimise(sections: DataFrame, key: str = "doc_id", max_tokens: int = MAX_TOKENS, count: Callable[[Column], Column] = tokens) -> DataFrame:
    """Sections to chunks: the oversize split, then all packed. ``count`` gives the tokens of a column of texts; by default they are estimated."""
    return pack(split_oversize(sections, max_tokens, count=count), key, max_tokens, count)
