"""A corpus in five stages, each calling an operator of reqweave.llm.

Language identification drops documents that no learned language fits, line dedup
takes boilerplate lines out, near-dedup leaves one document of each group, mixing samples to
target weights, and encoding gives what is left as tokens. Each stage is written as Parquet
and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqweave.llm import langid, line_dedup, near_duplicates, queries
from reqweave.llm.work import Work, columns, fresh, without

#: Five-word shingles, and the similarity of their sets from which two texts are near copies.
WORDS, SIMILARITY = 5, 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a learned language; null and letterless texts go, and those that score no better than a guess. Learns from labelled rows of ``docs``."""
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    net = langid.train(docs)
    judged = langid.predict(docs, net, pred_col=pred, score_col=score)
    return judged.where((F.col(pred) != langid.UNKNOWN) & (F.col(score) >= langid.least_score(len(net.langs)))).select(*columns(docs))


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their host's boilerplate lines, n_chars counted anew; no document goes."""
    lean = line_dedup.line_dedup(docs)
    return lean.withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group. Rows with equal ids are one document; null ids stay."""
    groups = near_duplicates.near_duplicates(docs, words=WORDS, limit=SIMILARITY)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return without(Work(spark, "kept"), docs, gone, "doc_id")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by calibrated probabilities."""
    rows, prefix = queries.mixed(docs)
    return rows.where(F.col(f"{prefix}sampled")).select(*columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, their number, and the digests of ids and decoded text."""
    return queries.bpe_digests(docs, "ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_filter),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("bpe", encode),
]

#: A trained network decides the first stage, so SQL can't say what comes out; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    work = Work(spark, "pipeline")
    docs = queries.documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), name)
        work.keep_only(name)
    return docs
