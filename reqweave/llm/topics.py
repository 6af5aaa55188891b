"""Topics of texts by their shape: k-means over profiles that no language decides, fitted to all texts.

A profile is the shares of a text's characters: each ASCII digit, mark and space by itself, but all letters as
lower-case or upper-case ones. Prose, tables, markup and lists of contacts differ in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import Work, lean, slices

#: Texts that say where the fit to all texts begins (at most), and its rounds.
START, ROUNDS, SEED = 3000, 40, 23
#: Profiles are added up as whole numbers of this part of one, so no order of rows changes a sum.
UNIT = 1 << 20
LOWER, UPPER = ord("a"), ord("A")
#: White space of texts whose words are counted (fixed values: the six ASCII characters).
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _classes() -> np.ndarray:
    of = np.arange(256)
    of[(of >= 128) | ((of >= LOWER) & (of < LOWER + 26))] = LOWER
    of[(of >= UPPER) & (of < UPPER + 26)] = UPPER
    return of


CLASS = _classes()


def profile(data: np.ndarray) -> np.ndarray:
    """Square roots of the shares of each class of characters (so that distances weigh rare marks)."""
    counts = np.bincount(CLASS, weights=np.bincount(data, minlength=256), minlength=256)[:128]
    return np.sqrt(counts / max(1, len(data))).astype(np.float32)


def words(data: np.ndarray) -> int:
    """Runs of characters that are no white space."""
    inside = ~SPACE[data]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(len(inside) > 0 and inside[0])


@dataclass
class Topics:
    """Centres, the one with most texts first; a text's topic is t and the number of the nearest."""

    centres: np.ndarray

    @property
    def names(self) -> list[str]:
        return [f"t{i}" for i in range(len(self.centres))]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(axis=1) - 2 * x @ self.centres.T).argmin(axis=1)

    @classmethod
    def start(cls, x: np.ndarray, k: int) -> np.ndarray:
        """Centres of a few profiles: drawn among them, far ones likelier, then moved until they rest. Fewer than ``k`` if fewer are different."""
        rng = np.random.default_rng(SEED)
        k = max(1, min(k, len(np.unique(x, axis=0))))
        centres = x[:1].copy()
        while len(centres) < k:
            d = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
            centres = np.r_[centres, x[rng.choice(len(x), 1, p=d / d.sum())]]
        for _ in range(ROUNDS):
            near = cls(centres).nearest(x)
            new = np.stack([x[near == i].mean(axis=0) if (near == i).any() else centres[i] for i in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        return centres


def fit(docs: DataFrame, k: int, text_col: str = "text") -> Topics:
    """Topics of all texts, the same ones for the same texts in whatever order. Null and empty texts are left out.

    Profiles are written once; each round of Lloyd's reads them all, and the driver gets the sums and counts of a task's texts. The rounds
    begin where ``START`` texts with the least hashes, and no others, would have their centres; if these are too alike, further centres are
    drawn among all texts by the square of the distance (equal texts are one there).
    """
    texts = docs.select(F.col(text_col).alias("text")).where(F.octet_length(text_col) > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            made = [profile(np.frombuffer(t.as_py().encode(), np.uint8)).tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(made, pa.binary())], ["draw", "profile"])

    work = Work(docs.sparkSession, "topics")
    draw = F.shiftrightunsigned(F.xxhash64("text", F.lit(SEED)), 11) / F.lit(float(1 << 53))
    profiles = work.save(texts.withColumn("draw", draw).mapInArrow(lean(run), "draw double, profile binary"), "profiles")
    n = profiles.count()
    if not n:
        return Topics(np.zeros((1, 128), np.float32))
    some = profiles.where(F.col("draw") < 1.2 * START / n).orderBy("draw", "profile").limit(START).collect()
    some = some or profiles.orderBy("draw", "profile").limit(1).collect()
    centres = Topics.start(_stack([r["profile"] for r in some]), k)
    while len(centres) < k and (far := profiles.mapInArrow(lean(_farthest(centres)), "key double, profile binary").collect()):
        centres = np.r_[centres, _stack([min((r["key"], r["profile"]) for r in far)[1]])]
    for _ in range(ROUNDS):
        sums, sizes = _sums(profiles, Topics(centres))
        new = np.where(sizes[:, None] > 0, sums / UNIT / np.maximum(sizes, 1)[:, None], centres).astype(np.float32)
        if np.allclose(new, centres):
            break
        centres = new
    sizes = _sums(profiles, Topics(centres))[1]
    work.keep_only()
    return Topics(centres[np.argsort(-sizes, kind="stable")])


def _stack(profiles: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(profiles), np.float32).reshape(-1, 128)


def _farthest(centres: np.ndarray):
    """Of a task's profiles the winner of a race in which far ones are faster; none if all are centres."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in slices(batches, 4096):
            x = _stack(batch.column(1).to_pylist())
            d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0).astype(np.float64)
            h = (batch.column(0).to_numpy() * (1 << 53)).astype(np.uint64) ^ np.uint64(len(centres))
            for _ in range(2):
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
            key = np.divide(-np.log(u), d, out=np.full(len(d), np.inf), where=d > 0)
            for i in np.flatnonzero((key == key.min()) & (d > 0)) if len(key) else ():
                best = min(best or (np.inf,), (float(key[i]), x[i].tobytes()))
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]], pa.float64()), pa.array([best[1]], pa.binary())], ["key", "profile"])

    return run


def _sums(profiles: DataFrame, topics: Topics) -> tuple[np.ndarray, np.ndarray]:
    """Of each topic the sum of its profiles, in parts of one, and their number."""
    k = len(topics.centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k, 129), np.int64)
        for batch in slices(batches, 4096):
            x = _stack(batch.column(0).to_pylist())
            near, parts = topics.nearest(x), np.rint(x * np.float32(UNIT)).astype(np.int64)
            for i in range(k):
                out[i, :128] += parts[near == i].sum(axis=0)
                out[i, 128] += np.count_nonzero(near == i)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

    got = profiles.select("profile").mapInArrow(run, "sums binary").collect()
    total = sum((np.frombuffer(r["sums"], np.int64).reshape(k, 129) for r in got), np.zeros((k, 129), np.int64))
    return total[:, :128], total[:, 128]


def assign(docs: DataFrame, topics: Topics, topic: str, tokens: str, text_col: str = "text") -> DataFrame:
    """``docs`` with two columns more: each text's topic and its words (null and empty texts: the first topic, none)."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            data = [np.frombuffer((t.as_py() or "").encode(), np.uint8) for t in batch.column(at)]
            near = topics.nearest(np.stack([profile(d) for d in data]))
            named = [topics.names[i] if len(d) else topics.names[0] for i, d in zip(near, data)]
            cols = [*batch.columns, pa.array(named, pa.string()), pa.array([words(d) for d in data], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names, topic, tokens])

    added = [T.StructField(topic, T.StringType()), T.StructField(tokens, T.LongType())]
    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, *added]))
