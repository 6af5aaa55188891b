"""Commands: python -m reqweave extract|clean|vision|chunks."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import EngineConfig
from .log import counted, logger
from .operators import generate, requirements
from .plans import cleaning, extraction, vision
from .sources import convert, documents, files, sinks


def _docs(spark: SparkSession, config: EngineConfig, kind: str):
    """(doc_id, text) of the input directory: Markdown files, or PDF files that a converter turns into Markdown."""
    if kind == "md":
        return documents.markdown_files(spark, config.input_dir).select("doc_id", "text")
    made = convert.to_markdown(documents.pdf_files(spark, config.input_dir), convert.converter(kind))
    sinks.markdown(made, config.markdown_dir)  # converted once; failures stay in the table
    return spark.read.parquet(config.markdown_dir).where("error is null").select("doc_id", "text")


def _backend(args, config: EngineConfig) -> generate.Backend:
    return generate.RuleBackend(names=(config.model,)) if args.rules else generate.HttpBackend(config.host, config.timeout)


def _report(log, found, out: str, key: str, order: tuple[str, ...]) -> None:
    """The table of requirements, a sheet for all of them, and a line for each of the first documents."""
    found, seen = counted(found, "requirements", without_code="coalesce(code, '') = ''")
    found.write.mode("overwrite").parquet(f"{out}/requirements")
    kept = found.sparkSession.read.parquet(f"{out}/requirements")
    sinks.excel(kept, f"{out}/requirements.xlsx", order)
    log.info("%d requirements, %d of them without code, at %s", seen.get["rows"], seen.get["without_code"], out)
    told = kept if "chunk_no" in kept.columns else kept.withColumn("chunk_no", F.col("page_index"))
    for r in requirements.summary(told, key).orderBy(key).limit(20).collect():
        log.info("%s: %d requirements: %s%s", r[key], r["n"], r["first_codes"], f" and {r['more']} more" if r["more"] else "")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="reqweave", description=__doc__)
    parser.add_argument("command", choices=["extract", "clean", "vision", "chunks"])
    parser.add_argument("--config", help="YAML file of settings")
    parser.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="one setting")
    parser.add_argument("--from", dest="kind", default="md", help="md, or the converter for PDF files")
    parser.add_argument("--rules", action="store_true", help="answers by rules instead of a model server")
    parser.add_argument("--log", default=None, help="log file")
    args = parser.parse_args(argv)
    config = EngineConfig.from_yaml(args.config) if args.config else EngineConfig()
    values = dict(x.split("=", 1) for x in args.set)
    config = EngineConfig.of({**vars(config), **{k: type(getattr(config, k, ""))(v) for k, v in values.items()}})
    log = logger(path=args.log)
    spark = spark or SparkSession.builder.appName("reqweave").getOrCreate()
    if not files.dir_exists(spark, config.input_dir):
        log.error("no directory %s", config.input_dir)
        return 1
    if args.command == "clean":
        made = cleaning.clean_directory(spark, config.input_dir, f"{config.output_dir}/cleaned", as_files=True)
        log.info("%d files cleaned", made.count())
    elif args.command == "chunks":
        sinks.chunk_json(extraction.chunk_table(_docs(spark, config, args.kind), config)).write.mode("overwrite").text(f"{config.output_dir}/chunks")
    elif args.command == "vision":
        kind = "fitz" if args.kind == "md" else args.kind
        found = vision.extract(spark, config.input_dir, convert.converter(kind), _backend(args, config), f"{config.output_dir}/vision", config)
        _report(log, found, config.output_dir, "pdf", ("pdf", "page_index", "item_no"))
    else:
        docs = documents.not_blank(_docs(spark, config, args.kind))
        answered = extraction.responses(docs, _backend(args, config), f"{config.output_dir}/cache", config)
        answered.write.mode("overwrite").parquet(f"{config.output_dir}/answered")
        answered = spark.read.parquet(f"{config.output_dir}/answered")
        sinks.json_rows(sinks.raw_responses(answered.withColumn("chunk_index", F.col("chunk_no"))), f"{config.output_dir}/raw_responses")
        for r in extraction.failures(answered).limit(20).collect():
            log.warning("%s, chunk %s: %s", r["doc_id"], r["chunk_no"], r["reason"])
        found = extraction.parse.explode_items(answered, "doc_id", "chunk_no")
        _report(log, found, config.output_dir, "doc_id", ("doc_id", "chunk_no", "item_no"))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
