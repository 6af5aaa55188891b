"""SimHash near-deduplication for a similarity of shingle sets.

The fingerprints and the Gray-order index of ``simhash`` find what is close, and every link is verified on the whole
sets, so nothing below the limit is linked. At a similarity of 0.8 fingerprints differ in about 15 % of their
bits (up to 19 % for texts of a few words), too many for masks that catch every pair for certain: upper nodes are the patterns under
as many masks as make it ``RECALL`` likely that a pair at the limit agrees on one of them, below them
Gray-sorted leaves are compared as in ``simhash``. More similar pairs are missed less often still.

Fingerprints that are close, directly or through others, are a cluster; a node gives the links of a spanning forest, never all
pairs. Within a cluster texts are verified in pairs of blocks of bounded size: a task holds the sets of two blocks,
and compares those that are close and not in one component yet by counts of common bits, so again only links of a forest come out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .simhash import SEED, _paired, _union, close_pairs
from .work import Work, lean, may_hold, slices

BITS, FS = 256, ["f0", "f1", "f2", "f3"]
#: Share of bits that differ at the limit (0.8), at worst, and the radius that all but a few pairs at the limit are within:
#: 8 standard deviations below what unlike texts differ in, so clusters don't grow together by chance.
DIFFER, RADIUS, RECALL = 0.19, 64, 0.995
#: Fingerprints of a node, about (a power of two), and at most where a node is compared at once.
NODE, CAP = 1024, 16384
#: Shingles of a block of texts, about.
BLOCK = 1 << 17


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The set of a text's shingles by their hashes: rows of two 64-bit words, ascending, the first word unique.

    Fewer words than a shingle are one shingle, none are none. Only A-Z are lower-cased, only ASCII white space parts words.
    """
    import xxhash

    parts = (text or "").encode().lower().split()
    k = min(words, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    joined, digest = b" ".join(parts), xxhash.xxh3_128_digest
    spans = zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist()) if k else ()
    found = np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in spans]), np.uint64).reshape(-1, 2)
    return found[np.unique(found[:, 0], return_index=True)[1]]


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0x9FB21C651E98DF25)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(32))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes, as four 64-bit words: a bit is set if it is in over half of them.

    The second half of a hash's 256 bits is made of the first by mixing.
    """
    total = np.zeros(BITS, np.int64)
    wide = np.concatenate([hashes, _mixed(hashes)], axis=1)
    for at in range(0, len(wide), 255):  # as many as a byte can count
        total += np.add.reduce(np.unpackbits(wide[at : at + 255].view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(hashes)).view(np.uint64)


def _rows(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, text, n, s0, s1, f0 ...): the size and the digest of a text's set, and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, 1024):
            sizes, digests, prints = [], [], []
            for t in batch.column(1):
                h = shingle_hashes(t.as_py(), words)
                sizes.append(len(h))
                digests.append(np.frombuffer(xxhash.xxh128_digest(h[:, 0].tobytes()), np.int64))
                prints.append(fingerprint(h).view(np.int64))
            cols = [pa.array(np.ascontiguousarray(c)) for c in (*np.stack(digests).T, *np.stack(prints).T)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), *cols], ["id", "text", "n", "s0", "s1", *FS])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "id long, text string, n long, s0 long, s1 long, " + ", ".join(f"{f} long" for f in FS))


def masks(n: int, node: int = NODE) -> list[tuple[int, ...]]:
    """The upper nodes' masks for n fingerprints, each as signed words.

    A mask has about log2(n / node) bits, eight at least; there are as many masks as the recall takes, so
    what is compared grows as n to the power 1.3. Each draws on all bits in turn.
    """
    width = max(8, round(math.log2(max(n, 1) / node)))
    many = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - DIFFER) ** width))
    rng, deck, out = np.random.default_rng(SEED), [], []
    for _ in range(many):
        if len(deck) < width:
            deck = rng.permutation(BITS).tolist()
        bits, deck = deck[:width], deck[width:]
        words = (sum(1 << (b & 63) for b in bits if b >> 6 == w) for w in range(BITS // 64))
        out.append(tuple(x - (1 << 64) if x >> 63 else x for x in words))
    return out


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Rows sorted by their first columns, in pieces that hold whole groups of the first one. Binary columns stay Arrow arrays' objects."""
    held = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        if not len(rows[0]):
            continue
        last = int(np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])[-1])  # the last group may go on in the next batch
        held = [x[last:].copy() for x in rows]
        if last:
            yield [x[:last] for x in rows]
    if held is not None:
        yield held


def _links_of(nid: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    """Links of each fingerprint to the least number of its component, so many nodes give the same ones."""
    least = nid.copy()
    np.minimum.at(least, label, nid)
    root = least[label]
    moved = nid != root
    return pa.RecordBatch.from_arrays([pa.array(nid[moved]), pa.array(root[moved])], ["a", "b"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of what is close in each node, from rows (node, nid, f0 ...) sorted by node."""
    for node, nid, *fs in _grouped(batches):
        order, blocks = close_pairs(np.stack(fs, axis=1).view(np.uint64), np.cumsum(np.r_[False, node[1:] != node[:-1]]), RADIUS)
        label = np.arange(len(nid))
        for i, j in blocks:
            _union(label, i, j)
        yield _links_of(nid[order], label)


def _clusters(work: Work, fps: DataFrame, cap: int) -> DataFrame:
    """(node: nid, root) of fingerprints (nid, f0 ...) that are close to others, directly or through others."""
    parts = int(work.spark.conf.get("spark.sql.shuffle.partitions"))
    under = [F.struct(F.lit(j).alias("m"), *[F.lit(x).cast("long").alias(f"m{w}") for w, x in enumerate(words)]) for j, words in enumerate(masks(fps.count()))]
    pattern = F.xxhash64("u.m", *[F.col(f).bitwiseAND(F.col(f"u.m{w}")) for w, f in enumerate(FS)])
    nodes = fps.withColumn("u", F.explode(F.array(*under))).select(pattern.alias("key"), "nid", *FS)
    sizes = work.save(nodes.groupBy("key").count().where(F.col("count") > cap).select("key"), "sizes")

    def compared(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lean(_close), "a long, b long")

    if sizes.isEmpty():
        links = compared(nodes)
    else:
        # a large node is mostly one cloud of copies: what is close to one of them, and the others in pairs of blocks
        large = nodes.join(sizes, "key")
        stars, pairs = _paired(large, ["key"], FS, RADIUS, cap)
        units = pairs.select(F.xxhash64("key", "ua", "ub").alias("key"), "nid", *FS)
        links = compared(nodes.join(sizes, "key", "left_anti")).unionByName(stars).unionByName(compared(units))
    return components(work, links, "close")


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits for each set, a bit for each member that several sets hold."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, number, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[number]
    row, bit = np.repeat(np.arange(len(sets)), sizes)[keep], place[number[keep]]
    out = np.zeros((len(sets), max(1, int(shared.sum()) + 63 >> 6)), np.uint64)
    np.bitwise_or.at(out, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


def _verified(limit: Fraction):
    """Links of sets whose similarity reaches the limit, from rows (unit, side, nid, f0 ..., grams) sorted by unit.

    A unit with two sides is a pair of blocks: only texts of different sides meet in it.
    """
    num, den = limit.numerator, limit.denominator

    def unit(side: np.ndarray, nid: np.ndarray, fs: list[np.ndarray], grams: np.ndarray) -> pa.RecordBatch:
        f = np.stack(fs, axis=1).view(np.uint64)
        order, blocks = close_pairs(f, np.zeros(len(nid), np.int64), RADIUS)
        side, nid, sets = side[order], nid[order], [np.frombuffer(grams[k], np.uint64) for k in order]
        size, bits, label = np.fromiter(map(len, sets), np.int64, len(sets)), bitmaps(sets), np.arange(len(nid))
        two = side.min() != side.max()
        step = max(1, (1 << 21) // bits.shape[1])
        for i, j in blocks:
            ok = (label[i] != label[j]) & ((side[i] != side[j]) if two else True)
            ok &= np.minimum(size[i], size[j]) * den >= np.maximum(size[i], size[j]) * num
            i, j = i[ok], j[ok]
            for k in range(0, len(i), step):
                x, y = i[k : k + step], j[k : k + step]
                both = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
                like = both * den >= num * (size[x] + size[y] - both)
                _union(label, x[like], y[like])
        return _links_of(nid, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit_, side, nid, *rest in _grouped(b for b in slices(batches, 256)):
            edges = np.flatnonzero(np.r_[True, unit_[1:] != unit_[:-1]])
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(unit_)]):
                yield unit(side[a:b], nid[a:b], [x[a:b] for x in rest[:-1]], rest[-1][a:b])

    return run


def _links(work: Work, rows: DataFrame, fps: DataFrame, words: int, limit: Fraction, cap: int, block: int) -> DataFrame:
    """Links (a, b) among distinct sets, ``fps`` (nid, n, f0 ...); ``rows`` (nid, text) has their texts."""
    parts = int(work.spark.conf.get("spark.sql.shuffle.partitions"))
    roots = work.save(_clusters(work, fps.select("nid", *FS), cap), "clusters")
    sized = roots.join(fps.select(F.col("nid").alias("node"), "n"), "node").groupBy("root").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    placed = roots.join(work.save(sized, "sized").hint("merge"), "root").select(F.col("node").alias("nid"), "root", "blocks")
    placed = work.save(placed, "placed")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            grams = pa.array([shingle_hashes(t.as_py(), words)[:, 0].tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), grams], ["nid", "grams"])

    # only texts of clusters move
    near = may_hold(rows, F.xxhash64("nid"), placed.select(F.xxhash64("nid")), "may").where("may").join(placed.select("nid"), "nid", "left_semi")
    made = work.save(near.select("nid", "text").mapInArrow(lean(sets), "nid long, grams binary"), "sets")
    mine = F.pmod(F.xxhash64("nid", F.lit(SEED)), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.xxhash64("root", F.least("mine", j), F.greatest("mine", j)).alias("unit"), F.when(F.col("mine") > j, 1).otherwise(0).alias("side")))
    whole = placed.withColumn("mine", mine).join(fps, "nid").join(made, "nid")
    units = whole.select("nid", *FS, "grams", F.explode(others).alias("u")).select("u.unit", "u.side", "nid", *FS, "grams")
    dealt = units.repartition(parts, "unit").sortWithinPartitions("unit")
    links = work.save(dealt.mapInArrow(lean(_verified(limit)), "a long, b long"), "links")
    work.drop("sets", "placed", "sized")
    return links


def near_duplicates(
    docs: DataFrame, words: int = 5, limit: float = 0.8, id_col: str = "doc_id", text_col: str = "text", cap: int = CAP, block: int = BLOCK
) -> DataFrame:
    """One row per input row: id, component_id.

    Component: texts are linked whose shingle sets' Jaccard similarity is ``limit`` at least, and component_id is the
    smallest id that links lead to. Of isolated pairs right at the limit about one in a hundred may be missed, of texts with a handful of
    shingles one in twenty (see ``RECALL``); no pair below it is linked. The radius and the masks are made for limits from 0.8 up, others raise.
    Texts without words, and null texts, have the empty set and are one component.
    Shingles are compared by 64-bit hashes, sets by 128-bit digests. Null ids never name a component
    unless all its ids are null. An empty table gives an empty result; other columns are not read.
    A cluster of many times ``block`` shingles sends each of its texts to as many tasks as it has blocks.
    """
    if not 0.8 <= limit <= 1:
        raise ValueError("the index is made for similarities from 0.8 to 1")
    work = Work(docs.sparkSession, "near")
    rows = work.save(_rows(docs, id_col, text_col, words).withColumn("rid", F.monotonically_increasing_id()), "rows")
    one = F.min(F.struct("rid", "n", *FS)).alias("one")
    sets = rows.groupBy("s0", "s1").agg(F.min("id").alias("least"), one)
    sets = work.save(sets.select("s0", "s1", "least", F.col("one.rid").alias("nid"), "one.n", *[f"one.{f}" for f in FS]), "distinct")
    links = _links(work, rows.select(F.col("rid").alias("nid"), "text"), sets.select("nid", "n", *FS), words, Fraction(str(limit)), cap, block)
    roots = components(work, links)
    linked = sets.join(roots, sets["nid"] == roots["node"], "left").withColumn("root", F.coalesce("root", "nid"))
    names = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = work.save(linked.select("s0", "s1", "root").join(names, "root").drop("root"), "named")
    out = rows.select("id", "s0", "s1").join(named, ["s0", "s1"]).select(F.col("id").alias(id_col), F.coalesce("component_id", "id").alias("component_id"))
    result = work.save(out, "result")
    work.keep_only("result")
    return result
