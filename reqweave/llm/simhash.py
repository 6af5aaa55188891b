"""SimHash near-deduplication with a Gray-order hierarchical index.

Fingerprints within r bits of each other are linked. The index has two parts:

* Upper nodes are masked bit patterns. A node's free bits are divided over r + 1
  masks; two fingerprints of the node that differ in r bits at most agree on one of
  them, so each is the pattern of a child that both are under, and every other
  child of the mask has differed already and is pruned. Nodes of more than ``CAP``
  fingerprints are divided again. Under the j-th mask only pairs are wanted that differ on each mask
  before, so the bits of the masks after it hold r - j differences at most and r - j + 1 shares of them are
  enough: differences accumulate on the way down. A node that hardly shrinks holds one dense cloud: what is within r of one
  of its fingerprints is connected already, so only the others are compared, with each other and
  with the cloud, in pairs of blocks. No task gets an unbounded node.
* Below, a node's fingerprints are sorted by Gray rank, which lets neighbours share
  long patterns. Leaves of 64 and nodes of 8 leaves keep the bits all of theirs share;
  differences of shared bits are accumulated on the way down and whole groups pruned
  beyond r.

What leaves a node are the links of a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .work import Work, lean

CAP, LEAF, FAN = 4096, 64, 8
#: Bits of a share, at least, where a node is divided by its open bits alone.
SHARE = 4
SEED = 42
ALL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, words: int = 3, n_words: int = 1) -> list[int]:
    """SimHash of a text, 64 bits for each of ``n_words`` seeds: a bit is set if it is in over half the shingles' XXH64."""
    import xxhash

    parts = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return [0] * n_words
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    joined, ends = b" ".join(parts), np.cumsum(lengths + 1) - 1
    starts, k = ends - lengths, min(words, len(parts))
    n, out = len(parts) - k + 1, []
    for seed in range(SEED, SEED + n_words):
        total = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 15):
            spans = zip(starts[at : min(at + (1 << 15), n)].tolist(), ends[at + k - 1 : min(at + (1 << 15), n) + k - 1].tolist())
            hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans], ">u8")
            total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big"))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 64) -> DataFrame:
    """(id, f0 ...) for every row, 64 bits a column. A null text is an empty one, with fingerprint zero."""
    m = bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), words, m) for t in batch.column(1)]
            cols = [pa.array(np.array([f[i] for f in found], np.uint64).view(np.int64)) for i in range(m)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["id", *[f"f{i}" for i in range(m)]])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "id long, " + ", ".join(f"f{i} long" for i in range(m)))


def children(mask: tuple[int, ...], open_: tuple[int, ...], most: int, radius: int) -> list[tuple[tuple[int, ...], tuple[int, ...], int]]:
    """The children of a node whose pairs differ in ``most`` of the ``open_`` bits at most: (mask, open, most) of each.

    A child's mask is the node's and one of most + 1 shares of the open bits. A pair goes by the first share it
    agrees on: it differs in each share before, and these differences are accumulated, so what is left
    for the shares after is that much less. Where those are too few bits to divide, all free bits are open again.
    """
    bits = [(w, b) for w, m in enumerate(open_) for b in range(64) if m >> b & 1]
    cuts = [len(bits) * i // (most + 1) for i in range(most + 2)]

    def words(chosen: list[tuple[int, int]]) -> tuple[int, ...]:
        return tuple(sum(1 << b for w, b in chosen if w == k) for k in range(len(mask)))

    out = []
    for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
        new = tuple(x | y for x, y in zip(mask, words(bits[a:b])))
        if len(bits) - b >= SHARE * (most - j + 1):
            out.append((new, words(bits[b:]), most - j))
        else:
            out.append((new, tuple(ALL & ~x for x in new), radius))
    return out


def gray_rank(f: np.ndarray) -> np.ndarray:
    """The rank of each fingerprint (rows of 64-bit words, the first the highest) in the Gray sequence."""
    out = f.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    # an odd number of bits in the words before turns the words after round
    odd = np.bitwise_count(f).cumsum(axis=1) & 1
    out[:, 1:] ^= np.where(odd[:, :-1] == 1, np.uint64(ALL), np.uint64(0))
    return out


def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j; labels are the smallest members."""
    while len(i):
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:  # paths are followed to their end
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16) if x.shape[-1] > 1 else np.bitwise_count(x ^ y)[..., 0]


def link(f: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (positions in f) among the fingerprints of each node; ``node`` is ascending."""
    order, pairs = close_pairs(f, node, radius)
    label = np.arange(len(f))
    for i, j in pairs:
        _union(label, i, j)
    moved = np.flatnonzero(label != np.arange(len(f)))
    return order[moved], order[label[moved]]


def close_pairs(f: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """The order of the leaves, and blocks of pairs (places in that order) of one node's fingerprints within the radius."""
    order = np.lexsort((*gray_rank(f).T[::-1], node))
    return order, _close_pairs(f[order], node[order], radius)


def _close_pairs(g: np.ndarray, at: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    sizes = np.diff(np.r_[starts, len(g)])
    small = np.flatnonzero(np.repeat(sizes <= LEAF, sizes))
    d = 1
    while len(small):  # each with its d-th neighbour, over all small nodes at once
        small = small[small + d < len(g)]
        small = small[at[small + d] == at[small]]
        near = small[_distance(g[small], g[small + d]) <= radius]
        yield near, near + d
        d += 1
    for s, n in zip(starts[sizes > LEAF], sizes[sizes > LEAF]):
        for i, j in _search(g[s : s + n], radius):
            yield i + s, j + s


def _shared(f: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each group of ``size`` in order: the bits that all of its fingerprints share, as mask and pattern."""
    at = np.arange(0, len(f), size)
    both, any_ = np.bitwise_and.reduceat(f, at, axis=0), np.bitwise_or.reduceat(f, at, axis=0)
    return ~(both ^ any_), both


def _search(g: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs within the radius of one node's fingerprints, which are sorted by Gray rank."""
    upper_m, upper_p = _shared(g, LEAF * FAN)
    leaf_m, leaf_p = _shared(g, LEAF)
    i, j = np.triu_indices(len(upper_m))
    known = upper_m[i] & upper_m[j]
    gone = np.bitwise_count((upper_p[i] ^ upper_p[j]) & known).sum(axis=-1, dtype=np.int16)
    i, j, known, gone = (x[gone <= radius] for x in (i, j, known, gone))
    a = (i[:, None] * FAN + np.repeat(np.arange(FAN), FAN)).ravel()
    b = (j[:, None] * FAN + np.tile(np.arange(FAN), FAN)).ravel()
    known, gone = np.repeat(known, FAN * FAN, axis=0), np.repeat(gone, FAN * FAN)
    ok = (a <= b) & (a < len(leaf_m)) & (b < len(leaf_m))
    a, b, known, gone = a[ok], b[ok], known[ok], gone[ok]
    more = leaf_m[a] & leaf_m[b] & ~known  # bits the nodes above did not share
    gone = gone + np.bitwise_count((leaf_p[a] ^ leaf_p[b]) & more).sum(axis=-1, dtype=np.int16)
    a, b = a[gone <= radius], b[gone <= radius]
    inside = np.arange(LEAF)
    for k in range(0, len(a), 32):
        x, y = a[k : k + 32, None] * LEAF + inside, b[k : k + 32, None] * LEAF + inside
        gx, gy = g[np.minimum(x, len(g) - 1)], g[np.minimum(y, len(g) - 1)]
        far = np.zeros((len(x), LEAF, LEAF), np.uint8)
        for w in range(g.shape[1]):
            far += np.bitwise_count(gx[:, :, None, w] ^ gy[:, None, :, w])
        p, q, r = np.nonzero(far <= radius)
        left, right = x[p, q], y[p, r]
        ok = (left < right) & (right < len(g))
        yield left[ok], right[ok]


def _link_batches(m: int, radius: int, keys: int):
    """Links of rows (nid, key columns, fingerprint), sorted by their keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[np.ndarray]):
            nid, key, f = rows
            new = np.r_[False, (key[1:] != key[:-1]).any(axis=1)]
            a, b = link(f.view(np.uint64), np.cumsum(new), radius)
            return pa.RecordBatch.from_arrays([pa.array(nid[a]), pa.array(nid[b])], ["a", "b"])

        held = None
        for batch in batches:
            cols = [np.ascontiguousarray(batch.column(i)) for i in range(1 + keys + m)]
            rows = [cols[0], np.stack(cols[1 : 1 + keys], axis=1), np.stack(cols[1 + keys :], axis=1)]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            if not len(rows[0]):
                continue
            # the last node may go on in the next batch
            last = int(np.flatnonzero(np.r_[True, (rows[1][1:] != rows[1][:-1]).any(axis=1)])[-1])
            held = [x[last:] for x in rows]
            if last:
                yield done([x[:last] for x in rows])
        if held is not None:
            yield done(held)

    return run


def _paired(dense: DataFrame, key: list[str], fs: list[str], radius: int, cap: int) -> tuple[DataFrame, DataFrame]:
    """Of dense nodes: the links of their clouds, and rows (nid, key, block a, block b, fingerprint) to be compared."""
    pivot = F.min_by(F.struct("nid", *fs), F.xxhash64("nid", F.lit(SEED))).alias("pv")
    near = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"pv.{f}"))) for f in fs), F.lit(0)) <= radius
    marked = dense.select("nid", *key, *fs).join(dense.groupBy(*key).agg(pivot), key).withColumn("near", near)
    stars = marked.where("near and nid <> pv.nid").select(F.col("nid").alias("a"), F.col("pv.nid").alias("b"))
    blocks = lambda c: F.ceil(F.count_if(c) / (cap / 2)).cast("int")
    sizes = marked.groupBy(*key).agg(blocks(F.col("near")).alias("bn"), blocks(~F.col("near")).alias("bo")).where("bo > 0")
    rows = marked.join(sizes, key)
    mine = F.pmod(F.xxhash64("nid"), F.when(F.col("near"), F.col("bn")).otherwise(F.col("bo"))).cast("int")
    rows = rows.withColumn("mine", mine)
    pair = lambda x, y: F.struct(x.cast("long").alias("ua"), y.cast("long").alias("ub"))
    others = F.transform(F.sequence(F.lit(0), F.col("bo") - 1), lambda j: pair(F.least("mine", j), F.greatest("mine", j)))
    cloud = F.when(F.col("bn") > 0, F.transform(F.sequence(F.lit(1), F.greatest("bn", F.lit(1))), lambda j: pair(F.col("mine"), -j)))
    cloud = F.coalesce(cloud, F.array().cast("array<struct<ua: bigint, ub: bigint>>"))
    to_others = F.transform(F.sequence(F.lit(0), F.col("bo") - 1), lambda i: pair(i, -F.col("mine") - 1))
    unit = F.explode(F.when(F.col("near"), to_others).otherwise(F.concat(others, cloud))).alias("u")
    return stars, rows.select("nid", *key, *fs, unit).select("nid", *key, "u.ua", "u.ub", *fs)


def near_links(work: Work, fps: DataFrame, bits: int, radius: int, cap: int = CAP) -> DataFrame:
    """Links (a, b) of numbers ``nid``, enough to connect all fingerprints within ``radius`` of each other.

    ``fps`` has nid and f0 ..., each fingerprint once.
    """
    spark, m = work.spark, bits // 64
    masks, patterns, fs = [f"m{i}" for i in range(m)], [f"p{i}" for i in range(m)], [f"f{i}" for i in range(m)]
    key, found = [*masks, *patterns], []
    rows, level = fps.withColumns({x: F.lit(0).cast("long") for x in masks} | {"up": F.lit(fps.count())}), {(0,) * m: ((ALL,) * m, radius)}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def compared(pairs: DataFrame, keys: list[str]) -> DataFrame:
        dealt = pairs.select("nid", *keys, *fs).repartition(parts, *keys).sortWithinPartitions(*keys)
        return dealt.mapInArrow(_link_batches(m, radius, len(keys)), "a long, b long")

    depth = 0
    while level:
        # one row for each mask that a large node has, and its children: (radius + 1) ** (depth + 1) at most, fewer as differences accumulate
        schema = ", ".join(f"{x} long" for x in masks) + f", kid struct<{', '.join(f'{x}: long' for x in masks)}>"
        kids = {k: children(k, *level[k], radius) for k in sorted(level)}
        table = [(*map(_signed, k), tuple(map(_signed, kid))) for k in kids for kid, _, _ in kids[k]]
        if depth:
            rows = rows.join(F.broadcast(spark.createDataFrame(table, schema)), masks).drop(*masks)
        else:
            first = [F.struct(*[F.lit(v).cast("long").alias(x) for v, x in zip(kid, masks)]) for *_, kid in table]
            rows = rows.withColumn("kid", F.explode(F.array(*first)))
        rows = rows.select("nid", "up", *fs, *[F.col(f"kid.{x}").alias(x) for x in masks])
        rows = rows.withColumns({p: F.col(f).bitwiseAND(F.col(x)) for p, f, x in zip(patterns, fs, masks)})
        sizes = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("nid").alias("first")).where("n > 1")
        free = sum((F.lit(64) - F.bit_count(x) for x in masks), F.lit(0))
        kind = F.when(free <= radius, "whole").when(F.col("n") <= cap, "small").when(F.col("n") * 4 > F.col("up"), "dense").otherwise("large")
        nodes = work.save(rows.join(sizes, key).withColumn("kind", kind), f"nodes{depth}", by="kind")
        kinds = {r["kind"] for r in nodes.select("kind").distinct().collect()}
        links = [compared(nodes.where("kind = 'small'"), key)]
        if "whole" in kinds:  # fewer free bits than the radius: all of the node's fingerprints are near each other
            links.append(nodes.where("kind = 'whole' and nid <> first").select(F.col("nid").alias("a"), F.col("first").alias("b")))
        if "dense" in kinds:
            stars, pairs = _paired(nodes.where("kind = 'dense'"), key, fs, radius, cap)
            links += [stars, compared(pairs, [*key, "ua", "ub"])]
        found.append(work.save(reduce(DataFrame.unionByName, links), f"links{depth}"))
        large = nodes.where("kind = 'large'")
        divided = {tuple(x & ALL for x in r) for r in large.select(*masks).distinct().collect()} if "large" in kinds else set()
        level = {}
        for kid, open_, most in (x for k in kids for x in kids[k] if x[0] in divided):
            # a mask that two ways lead to keeps what holds for both: all free bits, the whole radius
            level[kid] = (open_, most) if kid not in level else (tuple(ALL & ~x for x in kid), radius)
        rows = large.select("nid", *fs, *masks, F.col("n").alias("up"))
        if depth:
            work.drop(f"nodes{depth - 1}")
        depth += 1
    work.drop(f"nodes{depth - 1}")
    return reduce(DataFrame.unionByName, found)


def simhash_components(
    docs: DataFrame,
    words: int = 3,
    bits: int = 64,
    radius: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    cap: int = CAP,
) -> DataFrame:
    """One row per input row: id, fingerprint (hex), component_id.

    Component: fingerprints at most ``radius`` bits apart are linked, and component_id is the smallest
    id that links lead to. Texts of fewer words than a shingle are one shingle; texts without words, and null
    texts, have fingerprint zero and are linked like others. Rows with equal fingerprints
    (repeated rows too) are one component. Null ids never name a component unless all its
    ids are null. An empty table gives an empty result; other columns are not read.
    """
    work = Work(docs.sparkSession, "simhash")
    fs = [f"f{i}" for i in range(bits // 64)]
    rows = work.save(fingerprints(docs, id_col, text_col, words, bits), "rows")
    distinct = rows.groupBy(*fs).agg(F.min("id").alias("least"), F.count("*").alias("n"))
    fps = work.save(distinct.withColumn("nid", F.monotonically_increasing_id()), "fps")
    roots = components(work, near_links(work, fps.select("nid", *fs), bits, radius, cap))
    linked = fps.join(roots, fps["nid"] == roots["node"])
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = linked.join(names, "root").select(*fs, "component_id")
    alone = fps.where("n > 1").join(roots, fps["nid"] == roots["node"], "left_anti").select(*fs, F.col("least").alias("component_id"))
    hexed = F.concat(*[F.lpad(F.lower(F.hex(x)), 16, "0") for x in fs])
    out = rows.join(groups.unionByName(alone), fs, "left").select(
        F.col("id").alias(id_col), hexed.alias("fingerprint"), F.coalesce("component_id", "id").alias("component_id")
    )
    result = work.save(out, "result")
    work.keep_only("result")
    return result
