"""Sharding by a k-d tree over metadata, its cuts at weighted medians.

The tree's points are the distinct texts, each with the bytes of all its rows and the metadata of its least id; a text
whose rows are more than a small part of a shard is several points. The root holds all points. A node that must
become k shards is cut along its widest dimension (in ranks of the values that occur, in proportion to the root's), so that the
lower side holds floor(k/2)/k of its bytes, until every leaf holds the bytes of one shard. All nodes of a level
are cut together: points carry their node and meet the level's table (node, dimension, cut). A cut is found by
histograms: bins of the key between the node's bounds, summed on the map side, then bins of the bin that the
median falls into, until that bin is lighter than the tolerance or holds one point. Points never move for this; only sums do.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .work import Work

BINS = 1 << 15  # of all nodes of a level together
TOLERANCE = 0.001  # of a shard's target, the weight of the bin that a cut may fall beside
GROUP = 0.05  # of a shard's target, up to which the rows of one text stay together
ROW_BYTES = 16
TIE_BITS = 32
#: Levels after which the points are written with their nodes.
LEVELS = 4
#: Distinct values of a dimension, and large groups, that are broadcast at most; more are joined by a shuffle.
BROADCAST_VALUES = 100_000


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def kd_shards(
    docs: DataFrame,
    target_bytes: int | None = None,
    n_shards: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    Give the bytes of a shard, or the number of shards. ``dims`` maps names to columns of any type that
    can be ordered; by default language, source (reversed, so hosts of a domain are neighbours) and characters. Their values count by
    rank, null first, whatever their length or size. The law is ``bytes``: shards' sizes are equal but for the
    tolerance, for single rows larger than a cut can place, and for groups: rows with equal texts are in one shard,
    unless they are more than ``GROUP`` of a shard, in which case they are cut by hashes of their ids like other rows. Values that
    many rows share are cut too: points with equal values are in the order of their texts' hashes. ``slot`` counts a shard's rows
    from 0 without gaps, in order of id (null ids first). ``grown_shard`` is null: under
    this law one more shard moves rows everywhere. Null texts have no bytes (and are a group with empty ones);
    an empty table gives an empty result; some shards stay empty if there are fewer
    points than shards; further columns are read only by ``dims``.
    """
    if (target_bytes is None) == (n_shards is None):
        raise ValueError("give target_bytes or n_shards")
    work = Work(docs.sparkSession, "shards")
    dims = dims or {"lang": F.col("lang"), "source": F.reverse(F.col("source")), "chars": F.char_length(text_col)}
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = work.save(
        docs.select(
            F.col(id_col).alias("id"),
            size_of(F.col(text_col)).alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            F.xxhash64(text).alias("h1"),
            F.xxhash64(F.lit("#"), text).alias("h2"),
            *[c.alias(f"d{i}") for i, c in enumerate(dims.values())],
        ),
        "rows",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    leaves = n_shards or max(1, math.ceil(total / target_bytes))
    points, rows = _points(work, rows, len(dims), max(1.0, GROUP * total / leaves))
    placed = work.save(_tree(work, points, len(dims), leaves, total).select("h1", "h2", "piece", "shard"), "placed")
    shards = rows.select("id", "size", "crc", "h1", "h2", "piece").join(placed.hint("merge"), ["h1", "h2", "piece"])
    return _numbered(work, shards.select("id", "size", "crc", "shard"), id_col)


def _points(work: Work, rows: DataFrame, n_dims: int, most: float) -> tuple[DataFrame, DataFrame]:
    """Points (h1, h2, piece, size, k0 ...) of ``most`` bytes, about, and ``rows`` with the piece of the text that each is in."""
    heavy = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > most)
    heavy = work.save(heavy.select("h1", "h2", F.ceil(F.col("bytes") / most).alias("pieces")), "heavy")
    heavy = F.broadcast(heavy) if heavy.count() <= BROADCAST_VALUES else heavy.hint("merge")  # 1 / GROUP for each shard at most
    piece = F.coalesce(F.pmod(F.xxhash64("id", "d0"), F.col("pieces")), F.lit(0)).cast("long")
    rows = rows.join(heavy, ["h1", "h2"], "left").withColumn("piece", piece).drop("pieces")
    values = [f"d{i}" for i in range(n_dims)]
    first = F.min_by(F.struct(*values), F.struct(F.col("id").isNull(), "id")).alias("of")
    points = rows.groupBy("h1", "h2", "piece").agg(F.sum("size").alias("size"), first)
    points = work.save(points.select("h1", "h2", "piece", "size", *[F.col(f"of.{d}").alias(d) for d in values]), "points0")
    tie = F.pmod(F.xxhash64("h1", "h2", "piece"), F.lit(1 << TIE_BITS))
    for i, d in enumerate(values):
        # null sorts first by the flag
        ranks = work.save(_ranked(work, points.select(F.col(d).isNotNull().alias("there"), d).distinct(), ["there", d], f"values{i}"), f"ranks{i}")
        table = F.broadcast(ranks) if ranks.count() <= BROADCAST_VALUES else ranks.hint("merge")
        table = table.select(F.col("there").alias("_there"), F.col(d).alias("_value"), "rank")
        points = points.withColumn("there", F.col(d).isNotNull())
        joined = points.join(table, (F.col("there") == F.col("_there")) & F.col(d).eqNullSafe(F.col("_value")))
        points = joined.withColumn(f"k{i}", F.shiftleft("rank", TIE_BITS).bitwiseOR(tie)).drop("there", "_there", "_value", "rank")
    kept = points.select("h1", "h2", "piece", "size", *[f"k{i}" for i in range(n_dims)], F.lit(1).cast("long").alias("node"))
    return work.save(kept, "points"), rows


def _ranked(work: Work, values: DataFrame, by: list[str], name: str) -> DataFrame:
    """``values`` with the column rank, from 0 in the order of ``by``."""
    laid = _laid(work, values, by, name)
    sizes = laid.groupBy("part").agg(F.count("*").alias("n")).collect()  # one row for each partition
    before, total = {}, 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        before[r["part"]], total = total, total + r["n"]
    start = F.element_at(F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)]), F.col("part")) if before else F.lit(0)
    return laid.select(*values.columns, (F.col("pos") + start).cast("long").alias("rank"))


def _laid(work: Work, rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` sorted over all partitions, with each one's partition and its place in it."""
    parts = int(work.spark.conf.get("spark.sql.shuffle.partitions"))
    placed = F.monotonically_increasing_id()
    ordered = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return work.save(ordered.select("*", F.shiftright(placed, 33).alias("part"), placed.bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")), name)


def _tree(work: Work, points: DataFrame, n_dims: int, leaves: int, total: int) -> DataFrame:
    """``points`` with the column shard. The driver holds one row for each node of a level, so at most ``leaves`` of them."""
    spark = work.spark
    keys = F.array(*[F.col(f"k{i}") for i in range(n_dims)])
    first: dict[int, tuple[int, int]] = {1: (0, leaves)}  # node -> first shard, shards
    level, spans, depth = [1], None, 0
    while level := [n for n in level if first[n][1] > 1]:
        inner = _table(spark, [(n,) for n in level], "node long")
        bounds = points.join(F.broadcast(inner), "node").groupBy("node")
        bounds = bounds.agg(F.sum("size").alias("bytes"), *[f(f"k{i}").alias(f"{x}{i}") for i in range(n_dims) for x, f in (("lo", F.min), ("hi", F.max))]).collect()
        open_, goal = {}, {}
        for b in bounds:
            width = [(b[f"hi{i}"] >> TIE_BITS) - (b[f"lo{i}"] >> TIE_BITS) for i in range(n_dims)]
            spans = spans or width
            d = max(range(n_dims), key=lambda i: width[i] / max(1, spans[i]))
            k = first[b["node"]][1]
            open_[b["node"]] = (d, b[f"lo{d}"], b[f"hi{d}"])
            goal[b["node"]] = b["bytes"] * (k // 2) / k
        found = _medians(points, keys, open_, goal, TOLERANCE * total / leaves)
        below = []
        for n in level:
            at, k = first[n]
            first[2 * n], first[2 * n + 1] = (at, k // 2), (at + k // 2, k - k // 2)
            below += [2 * n, 2 * n + 1]
        if open_:
            cuts = _table(spark, [(n, open_[n][0], found[n]) for n in open_], "node long, d int, cut long")
            side = F.when(F.element_at(keys, F.col("d") + 1) <= F.col("cut"), F.col("node") * 2).otherwise(F.col("node") * 2 + 1)
            below_it = F.when(F.col("d").isNull(), F.col("node")).otherwise(side)
            points = points.join(F.broadcast(cuts), "node", "left").withColumn("node", below_it).drop("d", "cut")
        level, depth = below, depth + 1
        if depth % LEVELS == 0:
            points = work.save(points, f"level{depth}")
            work.drop(f"level{depth - LEVELS}")
    shards = _table(spark, [(n, at) for n, (at, k) in first.items() if k == 1], "node long, shard int")
    return points.join(F.broadcast(shards), "node")


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of numbers as a literal, so that no Python worker makes it."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema.replace(' ', ': ').replace(',: ', ', ')}>>")))


def _medians(points: DataFrame, keys: Column, open_: dict, goal: dict, tolerance: float) -> dict[int, int]:
    """For each node, the key up to which its points hold ``goal`` bytes, as near as may be."""
    spark, found = points.sparkSession, {}
    before = dict.fromkeys(open_, 0)  # bytes below the bin that is open
    while open_:
        bins = max(16, BINS // len(open_))
        step = {n: -(-(hi - lo + 1) // bins) for n, (_, lo, hi) in open_.items()}
        table = [(n, d, lo, hi, step[n], float(goal[n] - before[n])) for n, (d, lo, hi) in open_.items()]
        inside = points.join(F.broadcast(_table(spark, table, "node long, d int, lo long, hi long, step long, rest double")), "node")
        inside = inside.withColumn("key", F.element_at(keys, F.col("d") + 1)).where("key between lo and hi")
        hist = inside.groupBy("node", F.expr("(key - lo) div step").alias("bin")).agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.first("rest").alias("rest"))
        run = hist.withColumn("upto", F.sum("w").over(W.partitionBy("node").orderBy("bin")))
        hit = run.where("upto >= rest").groupBy("node").agg(F.min_by(F.struct("bin", "w", "n", "upto"), "bin").alias("b"))
        hits = {r["node"]: r["b"] for r in hit.collect()}
        still = {}
        for n, (d, lo, hi) in open_.items():
            if n not in hits:  # rounding: the goal lies past the last point
                found[n] = hi
                continue
            b, width = hits[n], step[n]
            left, right = lo + b["bin"] * width, min(hi, lo + (b["bin"] + 1) * width - 1)
            under = before[n] + b["upto"] - b["w"]
            if b["n"] == 1 or width == 1 or b["w"] <= tolerance:
                found[n] = right if before[n] + b["upto"] - goal[n] <= goal[n] - under else left - 1
            else:
                still[n], before[n] = (d, left, right), under
        open_ = still
    return found


def _numbered(work: Work, rows: DataFrame, id_col: str) -> DataFrame:
    """Slots: rows sorted over all partitions by shard and id, each partition's offsets from the counts before it."""
    laid = _laid(work, rows, ["shard", "id"], "laid")
    # a row for each partition and shard in it: partitions + shards at most
    runs = laid.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    upto = F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")
    runs = work.save(runs.select("part", "shard", (upto - F.col("first")).alias("shift")), "runs")
    work.keep_only("laid", "runs")
    return laid.join(F.broadcast(runs), ["part", "shard"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("pos") + F.col("shift")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
