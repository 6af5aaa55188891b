"""Documents from directories and tables, and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, path_stem, strip, universal_newlines


def markdown_files(spark: SparkSession, directory: str) -> DataFrame:
    """(doc_id: path, stem, text) of each .md file of a directory, not of those below it; blank files too."""
    return spark.read.text(directory, wholetext=True, pathGlobFilter="*.md").select(
        F.col("_metadata.file_path").alias("doc_id"), path_stem(F.col("_metadata.file_path")).alias("stem"), F.col("value").alias("text")
    )


def binary_files(spark: SparkSession, directory: str, suffix: str) -> DataFrame:
    """(doc_id: path, stem, content) of each file with that suffix, leading dots aside; directories are no files."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix.lstrip('.')}")
    return reader.load(directory).select(F.col("path").alias("doc_id"), path_stem(F.col("path")).alias("stem"), "content")


def pdf_files(spark: SparkSession, directory: str) -> DataFrame:
    return binary_files(spark, directory, "pdf")


def list_files(spark: SparkSession, directory: str, extension: str | None = None) -> list[str]:
    """Names of a directory's files, sorted; none if the directory is missing. Only names come to the driver."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(directory)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    end = f".{extension.lstrip('.')}" if extension else ""
    return sorted(str(s.getPath()) for s in fs.listStatus(at) if s.isFile() and s.getPath().getName().endswith(end))


def not_blank(docs: DataFrame) -> DataFrame:
    """Documents with something other than white space in them."""
    return docs.where(F.col("text").isNotNull() & ~is_blank(F.col("text")))


def quarantined(docs: DataFrame) -> DataFrame:
    """The others, with the reason: nothing is dropped without a trace."""
    reason = F.when(F.col("text").isNull(), "no text").otherwise("blank")
    return docs.where(F.col("text").isNull() | is_blank(F.col("text"))).select("doc_id", reason.alias("reason"))


def lines(docs: DataFrame) -> DataFrame:
    """``docs`` with a row per line: line_no from 0 and line, without terminators.

    Carriage returns end lines too. A final terminator starts no further line, and an empty text has none.
    """
    parts = F.split(universal_newlines(F.col("text")), "\n", -1)
    kept = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(*rest, F.posexplode(kept).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def nonblank_lines(docs: DataFrame) -> DataFrame:
    """Lines without surrounding white space, blank ones left out."""
    return lines(docs).withColumn("line", strip(F.col("line"))).where("line <> ''")


def saved_responses(spark: SparkSession, path: str) -> DataFrame:
    """Responses as ``sinks.responses`` wrote them."""
    return spark.read.schema("pdf string, page_index long, image string, response string").json(path)
