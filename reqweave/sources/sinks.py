"""Where tables go: spreadsheets, JSON, JSON lines, Parquet and text files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_stem, preview
from .files import export
from .xlsx import XlsxDataSource

#: The spreadsheet's columns, a fixed format.
SHEET = {"code": "Requirement Code", "description": "Description"}


def excel(items: DataFrame, path: str, order: tuple[str, ...] = ()) -> None:
    """A sheet of codes and descriptions, in the given order; a table without rows gives the header alone.

    ValueError for a blank path or a table without the two columns; OSError, with its cause, if the file can't be written.
    """
    if not isinstance(path, str) or not path.strip():
        raise ValueError("the path is empty")
    if not isinstance(items, DataFrame) or not set(SHEET) <= set(items.columns):
        raise ValueError("expected a table with code and description")
    spark = items.sparkSession
    spark.dataSource.register(XlsxDataSource)
    sheet = items.orderBy(*order) if order else items
    try:
        sheet.select(*[F.col(c).alias(n) for c, n in SHEET.items()]).coalesce(1).write.format("xlsx").mode("overwrite").save(path)
    except Exception as e:
        raise OSError(f"can't write {path}") from e


def json_rows(table: DataFrame, path: str) -> None:
    """JSON lines with nulls written out."""
    table.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def chunk_json(chunks: DataFrame) -> DataFrame:
    """(json): content and metadata of each chunk, as one object."""
    rest = [c for c in chunks.columns if c != "content"]
    return chunks.select(F.to_json(F.struct(F.col("content").alias("page_content"), F.struct(*rest).alias("metadata"))).alias("json"))


def raw_responses(responses: DataFrame) -> DataFrame:
    """(chunk_index, chunk_preview, raw_response) of responses with content and response."""
    return responses.select("chunk_index", preview(F.col("content")).alias("chunk_preview"), F.col("response").alias("raw_response"))


def markdown(texts: DataFrame, path: str) -> None:
    """Texts (doc_id, text) as a Parquet table; whole paths are ids, so equal file names don't overwrite each other."""
    texts.write.mode("overwrite").parquet(path)


def markdown_files(texts: DataFrame, directory: str) -> DataFrame:
    """Texts (doc_id, stem, text) as files <stem>.md; of equal stems the one with the greatest id is what is left. Gives (name, bytes)."""
    last = texts.groupBy("stem").agg(F.max_by("text", "doc_id").alias("content"))
    return export(last.select(F.concat("stem", F.lit(".md")).alias("name"), "content"), directory)


def page_files(pages: DataFrame, directory: str) -> DataFrame:
    """Pages (pdf, page_no, png) as files <pdf>/page_<number>.png. Gives (name, bytes)."""
    name = F.concat(path_stem(F.col("pdf")), F.lit("/page_"), F.col("page_no").cast("string"), F.lit(".png"))
    return export(pages.select(name.alias("name"), F.col("png").alias("content")), directory)


def responses(answered: DataFrame, path: str) -> None:
    """Responses (pdf, page_index, image, response) as JSON lines, which ``documents.saved_responses`` reads."""
    json_rows(answered.select("pdf", "page_index", "image", "response"), path)
