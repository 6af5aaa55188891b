"""A directory of Markdown files, cleaned as one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean
from ..sources import documents, sinks


def cleaned(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of documents: noise taken out, then only headings and requirement blocks. One of which nothing is left has an empty text."""
    lines = documents.lines(docs.select("doc_id", "text"))
    kept = clean.block_text(clean.filter_blocks(clean.clean_noise(lines)))
    found = docs.select("doc_id").join(kept, "doc_id", "left")
    return found.withColumn("text", F.coalesce("text", F.lit("")))


def clean_directory(spark: SparkSession, source: str, out: str, as_files: bool = False) -> DataFrame:
    """Cleans every .md file of ``source``; gives (doc_id, stem, text), read back from the table at ``out``.

    With ``as_files`` there are also files <stem>.md in the directory ``<out>-files``.
    """
    docs = documents.markdown_files(spark, source)
    sinks.markdown(docs.select("doc_id", "stem").join(cleaned(docs), "doc_id"), out)
    made = spark.read.schema("doc_id string, stem string, text string").parquet(out)
    if as_files:
        sinks.markdown_files(made, f"{out.rstrip('/')}-files").write.format("noop").mode("overwrite").save()
    return made
