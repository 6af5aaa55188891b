"""A directory of Markdown files as a stream: new files are cleaned, or turned into requirements, as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import EngineConfig
from ..operators import clean, generate
from ..plans import extraction
from ..sources import documents


def markdown_stream(spark: SparkSession, directory: str) -> DataFrame:
    """(doc_id: path, text) of .md files, old ones and those that come later."""
    reader = spark.readStream.format("text").schema("value string").option("wholetext", True).option("pathGlobFilter", "*.md")
    return reader.load(directory).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def clean_stream(spark: SparkSession, directory: str, out: str, checkpoint: str) -> StreamingQuery:
    """Writes the cleaned text of each file to a Parquet table, a batch of files at a time.

    Each batch has a folder of its own, which a repeated batch overwrites, so every file is there once.
    """

    def batch(docs: DataFrame, number: int) -> None:
        kept = clean.filter_blocks(clean.clean_noise(documents.lines(docs)))
        clean.block_text(kept).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return markdown_stream(spark, directory).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def extract_stream(
    spark: SparkSession, directory: str, backend: generate.Backend, out: str, cache_path: str, checkpoint: str, config: EngineConfig = EngineConfig()
) -> StreamingQuery:
    """Writes the requirements of each file: cleaned, chunked, asked and parsed, a batch of files at a time.

    A repeated batch overwrites its folder, and asks only for responses that the cache has not.
    """

    def batch(docs: DataFrame, number: int) -> None:
        extraction.extract(docs, backend, cache_path, config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return markdown_stream(spark, directory).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
