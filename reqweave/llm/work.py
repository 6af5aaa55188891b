"""Intermediate tables, in the folder that a cluster shares.

A cluster names that folder in ``spark.checkpoint.dir``; only where the
setting is missing (tests on one machine) a folder of our own is used.
Tables are Parquet, so a lost executor costs a re-read and nothing more,
and the plans that read them carry no lineage.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []
#: Shuffle files of a query go with its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session: on a cluster spark.checkpoint.dir must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="reqweave-"))
        root = _OWN[0]
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Work:
    """The tables of one run of an operator.

    ``save`` writes a table and returns it as read back; ``drop`` deletes one,
    ``keep_only`` all but the named. What a result still reads goes when the
    Python process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/reqweave/{name}-{uuid.uuid4().hex[:12]}"
        self.names: set[str] = set()
        atexit.register(self._at_exit)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Writes ``df``, one folder for each value of ``by`` if that is given; the shuffle files behind it go."""
        self.names.add(name)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            (writer.partitionBy(by) if by else writer).parquet(self.at(name))
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        return self.read(name, df.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self.names.discard(name)
            _delete(self.spark, self.at(name))

    def keep_only(self, *names: str) -> None:
        """Deletes the other tables, and lets Spark drop shuffle files that nothing needs any more."""
        self.drop(*(self.names - set(names)))
        release(self.spark)

    def _at_exit(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                _delete(self.spark, self.path)
        except Exception:  # the JVM has gone first: nothing to talk to
            pass


def release(spark: SparkSession) -> None:
    """Shuffle files of finished jobs go when the driver's garbage is collected; this asks for it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Words of 64 bits that ``may_hold`` broadcasts at most (16 MB).
MOST_WORDS = 1 << 20


def may_hold(rows: DataFrame, key: Column, wanted: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean column ``name``: false where ``key``, a 64-bit hash, is surely not among ``wanted`` (a column of hashes).

    Rows that are false need not move for a join with what is wanted. The filter has 16 bits for each hash up to
    four million of them (one in 16 other rows is true then); beyond that it keeps its size, so more rows are true.
    """
    hashed = wanted.select(F.col(wanted.columns[0]).alias("h"))
    words = min(MOST_WORDS, 1 << (hashed.count() // 4).bit_length())
    word = lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(words - 1))
    bits = hashed.groupBy(word(F.col("h")).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("__bits"))
    marked = rows.withColumn("__key", key).withColumn("__word", word(F.col("__key"))).join(F.broadcast(bits), "__word", "left")
    hit = F.expr("shiftrightunsigned(coalesce(__bits, 0L), cast(__key & 63 as int)) & 1 = 1")
    return marked.withColumn(name, hit).drop("__word", "__bits", "__key")


def without(work: Work, rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` (a whole number) is not among ``gone`` (one column, each once); null keys stay. Few rows move if few go."""
    gone = work.save(gone.select(F.col(gone.columns[0]).cast("long").alias(key)), "gone")
    may = fresh(rows, "__may")
    marked = may_hold(rows, F.xxhash64(F.col(key).cast("long")), gone.select(F.xxhash64(key)), may)
    left = marked.where(may).join(gone, key, "left_anti")
    return marked.where(~F.col(may)).unionByName(left).select(*columns(rows))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column (names are compared as Spark does, without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` rows at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, after which a worker, which lives on for other tasks, gives memory back that it no longer uses."""

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return then


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever characters their names hold."""
    return [F.col(f"`{c}`") for c in df.columns]
