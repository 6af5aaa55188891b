"""The whole way from documents to requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import EngineConfig
from ..operators import chunks, clean, generate, parse, prompts, sections
from ..sources import documents


def chunk_table(docs: DataFrame, config: EngineConfig = EngineConfig(), cleaned: bool = True) -> DataFrame:
    """Documents (doc_id, text) to packed chunks with chunk_no, a document's chunks from 0 in order."""
    lines = documents.lines(documents.not_blank(docs).select("doc_id", "text"))
    if cleaned:
        lines = clean.filter_blocks(clean.clean_noise(lines)).select("doc_id", "line_no", "line")
    packed = chunks.optimise(sections.sections(lines), max_tokens=config.max_tokens)
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("group_no", "bin_no", "header1")) - 1
    return packed.select("doc_id", number.alias("chunk_no"), "group_no", "bin_no", "header1", "content", "merged_from", "token_count", "chunk_count")


def prompt_table(chunk_rows: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Chunks with their prompt and its key."""
    asked = chunk_rows.withColumn("prompt", prompts.prompt(config.prompt, F.col("content")))
    return asked.withColumn("key", generate.prompt_key(config.model, config.temperature, "prompt"))


def extract(docs: DataFrame, backend: generate.Backend, cache_path: str, config: EngineConfig = EngineConfig(), cleaned: bool = True) -> DataFrame:
    """(doc_id, chunk_no, item_no, code, description) of documents.

    Responses are kept at ``cache_path`` before they are parsed, so a retry, or another run, asks only for what is missing.
    A chunk whose call or reply fails has no items; ``failures`` lists those.
    """
    return parse.explode_items(responses(docs, backend, cache_path, config, cleaned), "doc_id", "chunk_no")


def responses(docs: DataFrame, backend: generate.Backend, cache_path: str, config: EngineConfig = EngineConfig(), cleaned: bool = True) -> DataFrame:
    """Chunks with response, error, items and parse_error."""
    generate.preflight(backend, config.model)
    asked = prompt_table(chunk_table(docs, config, cleaned), config)

    def ask(missing: DataFrame) -> DataFrame:
        return generate.respond(
            missing, backend, config.model, prompts.REQUIREMENTS_SCHEMA, temperature=config.temperature, max_retries=config.max_retries, workers=config.workers
        )

    answered = asked.join(generate.cached(asked, cache_path, ask), "key", "left")
    return parse.parse_responses(answered, config.dialect)


def failures(answered: DataFrame) -> DataFrame:
    """Chunks without usable reply, and why."""
    why = F.coalesce("error", F.when(F.col("parse_error"), "reply does not fit"))
    return answered.where(why.isNotNull()).select("doc_id", "chunk_no", why.alias("reason"))
