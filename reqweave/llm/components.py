"""Connected components of a graph given as a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Work


#: A node with more links than this, and than a share of all links, is a hub; at most 2 / SHARE nodes are hubs.
HUB, SHARE = 256, 1e-5


def _with_least(work: Work, links: DataFrame, total: int, name: str) -> tuple[DataFrame, DataFrame]:
    """``links`` (``total`` at most) with the least neighbour of ``a``, and that least of every node.

    Hubs' links, which may be most of all, stay where they are: the hubs are broadcast.
    """
    least = work.save(links.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("n")), name)
    hubs = least.where(F.col("n") > max(HUB, int(total * SHARE))).select("a", F.col("least").alias("hub_least"))
    marked = links.join(F.broadcast(hubs), "a", "left")
    at_hub = marked.where("hub_least is not null").select("a", "b", F.col("hub_least").alias("least"))
    rest = marked.where("hub_least is null").select("a", "b").join(least.select("a", "least"), "a")
    return at_hub.unionByName(rest), least.select("a", "least")


def _large_star(work: Work, edges: DataFrame, total: int, name: str) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined, _ = _with_least(work, both, 2 * total, name)
    return joined.where("b > a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))


def _small_star(work: Work, edges: DataFrame, total: int, name: str) -> DataFrame:
    joined, least = _with_least(work, edges, 2 * total, name)
    moved = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(work: Work, edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for every node of a link (a, b): root is the smallest node that can be reached.

    Links with equal ends are ignored. A round turns neighbourhoods to stars, once towards larger and
    once towards smaller nodes; the number of rounds grows with the logarithm of the longest path.
    Each round is a table of its own in the shared folder; neighbours are never gathered in lists.
    """
    now = work.save(edges.where("a <> b").select("a", "b").distinct(), f"{name}0")
    seen, k, total = None, 0, now.count()
    while True:
        k += 1
        large = work.save(_large_star(work, now, total, f"{name}{k}_up"), f"{name}{k}_large")
        now = work.save(_small_star(work, large, total, f"{name}{k}_down"), f"{name}{k}")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        work.drop(f"{name}{k - 1}", f"{name}{k}_up", f"{name}{k}_large", f"{name}{k}_down")
        if state == seen:
            break
        seen, total = state, state[0]
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
