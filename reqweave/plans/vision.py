"""From PDF files to requirements by images of their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import path_stem
from ..operators import generate, parse, prompts
from ..sources import convert, documents, files, sinks


def page_table(spark: SparkSession, directory: str, using: convert.Converter, path: str) -> DataFrame:
    """(pdf, page_no, png) of all PDF files of a directory, kept at ``path``; files that are there already are not converted again."""
    schema = "pdf string, page_no long, png binary"
    if not files.dir_exists(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)
    known = spark.read.schema(schema).parquet(path).select("pdf").distinct()
    new = documents.pdf_files(spark, directory).join(known.withColumnRenamed("pdf", "doc_id"), "doc_id", "left_anti")
    convert.to_pages(new, using).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def page_prompts(pages: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(pdf, batch_no, page_index, image, images, prompt, key): a request for each few pages, its key made of the prompt and the images."""
    batches = generate.page_batches(pages, config.pages_per_request)
    names = F.transform("pages", lambda n: F.concat(path_stem(F.col("pdf")), F.lit("/page_"), n.cast("string"), F.lit(".png")))
    asked = batches.withColumns({"image": F.array_join(names, ", "), "prompt": F.lit(prompts.VISION_TASK)})
    seen = F.array_join(F.transform("images", lambda i: F.sha2(i, 256)), ",")
    return asked.withColumn("key", generate.prompt_key(config.model, config.temperature, F.col("prompt"), seen))


def responses(pages: DataFrame, backend: generate.Backend, cache_path: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(pdf, batch_no, page_index, image, response, error) for each request. Responses are kept before anything else happens to them."""
    generate.preflight(backend, config.model)
    asked = page_prompts(pages, config)

    def ask(missing: DataFrame) -> DataFrame:
        return generate.respond(
            missing,
            backend,
            config.model,
            prompts.REQUIREMENTS_SCHEMA,
            temperature=config.temperature,
            max_retries=config.max_retries,
            workers=config.workers,
            images="images",
        )

    answers = generate.cached(asked.select("key", "prompt", "images"), cache_path, ask)
    return asked.select("pdf", "batch_no", "page_index", "image", "key").join(answers, "key", "left").drop("key")


def items(answered: DataFrame, dialect: str = "lenient") -> DataFrame:
    """(pdf, page_index, item_no, code, description) of responses, also of those read back from a file."""
    return parse.explode_items(parse.parse_responses(answered, dialect), "pdf", "page_index")


def extract(
    spark: SparkSession, directory: str, using: convert.Converter, backend: generate.Backend, out: str, config: EngineConfig = EngineConfig(), dialect: str = "lenient"
) -> DataFrame:
    """All PDF files of a directory: pages at ``<out>/pages``, the cache at ``<out>/cache``, responses as JSON lines at ``<out>/responses``; gives ``items``."""
    pages = page_table(spark, directory, using, f"{out}/pages")
    sinks.responses(responses(pages, backend, f"{out}/cache", config), f"{out}/responses")
    return items(documents.saved_responses(spark, f"{out}/responses"), dialect)
