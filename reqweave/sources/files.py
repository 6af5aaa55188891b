"""Files and directories wherever Hadoop's file systems reach, and rows written as single files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def file_exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isFile()


def dir_exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def create_dir(spark: SparkSession, path: str) -> None:
    """The directory with those above it; nothing happens if it is there."""
    at, fs = _at(spark, path)
    if not fs.mkdirs(at):
        raise OSError(f"can't create {path}")


def delete_file(spark: SparkSession, path: str) -> bool:
    """Whether a file was there to be deleted; a directory stays."""
    at, fs = _at(spark, path)
    return file_exists(spark, path) and fs.delete(at, False)


def copy_file(spark: SparkSession, source: str, target: str) -> None:
    """Replaces ``target``; FileNotFoundError if there is no such source."""
    if not file_exists(spark, source):
        raise FileNotFoundError(source)
    (a, from_), (b, to) = _at(spark, source), _at(spark, target)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(from_, a, to, b, False, True, spark.sparkContext._jsc.hadoopConfiguration())


def export(rows: DataFrame, directory: str, name: str = "name", content: str = "content") -> DataFrame:
    """Writes each row's content (text or binary) as a file under ``directory``, which all executors share; gives (name, bytes) of each.

    Names may hold directories. A file is written beside its place and then moved there, so a task that is
    repeated leaves whole files only. Rows are written when the result is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(directory) if "://" in directory else (fs.LocalFileSystem(), directory)
        for batch in batches:
            sizes = []
            for path, data in zip(batch[name], batch[content]):
                raw = data.encode() if isinstance(data, str) else bytes(data or b"")
                target = f"{root.rstrip('/')}/{path}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                beside = f"{target}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(beside) as out:
                    out.write(raw)
                store.move(beside, target)
                sizes.append(len(raw))
            yield pd.DataFrame({"name": batch[name], "bytes": sizes})

    return rows.select(name, content).mapInPandas(run, "name string, bytes long")
