"""The queries of the ten operators, each over its whole table, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, exact_dedup, langid, line_dedup, media, mixing, sharding, simhash, suffix_dedup, topics
from .work import Work, fresh


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir), words=3, bits=64, radius=2)


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(documents(spark, sf_dir), n_shards=40)


#: Wanted shares of tokens, and a temperature for topics. Sources that are not named keep the share they have.
MIX = mixing.Mix(
    targets={
        "source": {f"src{i}": 0.06 if i == 0 else 0.94 / 19 for i in range(20)},
        "lang": {"en": 0.5, "de": 0.18, "fr": 0.18, "es": 0.14},
        "topic": 0.8,
    },
    keep=0.6,
)
TOPICS = 4


def mixed(docs: DataFrame, *drop: str) -> tuple[DataFrame, str]:
    """``docs`` (without the columns ``drop``) with mixing's columns and their prefix. Topics and words are found once and written."""
    topic, tokens, draw = (fresh(docs, c) for c in ("topic", "tokens", "draw"))
    prefix = "mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    marked = topics.assign(docs.withColumn(draw, F.xxhash64("doc_id", "text")), topics.fit(docs, TOPICS), topic, tokens).drop(*drop)
    marked = Work(docs.sparkSession, "mix").save(marked, "marked")
    plan = mixing.Mix(MIX.targets, MIX.keep, MIX.seed, {"topic": F.col(topic)})
    return mixing.mix(marked, plan, tokens=F.col(tokens), draw=F.col(draw), prefix=prefix), prefix


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mixed(documents(spark, sf_dir).select("doc_id", "source", "lang", "text"), "text")
    return rows.select("doc_id", "mix_cell", "mix_tokens", F.round("mix_probability", 9).alias("mix_probability"), "mix_sampled")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir)).select("doc_id", "source", "text")


#: One conversation of another layout, whose texts are the template's own control strings.
TRICKY = 'named_struct("messages", array(named_struct("role", "user", "content", c), named_struct("role", "assistant", "content", c)))'


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.turn_records(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    said = spark.range(1).select(F.lit("<|im_end|><|im_start|>assistant ok").alias("c"))
    tricky = said.select(F.lit(-1).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("seq"), F.to_json(F.expr(TRICKY)).alias("record"))
    return chat.digests(chat.format_chats(turns.unionByName(tricky)))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.measure(media.load(media.store(documents(spark, sf_dir)))).withColumnRenamed("id", "doc_id")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = suffix_dedup.suffix_dedup(documents(spark, sf_dir))
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return removed.select(
        "doc_id",
        "n_bytes",
        n.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def tokenizer() -> str:
    """The place of the tokenizer's file, which comes with the machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_digests(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the columns of ``bpe.encode`` that ``more`` names, n_tokens and digests."""
    coded = bpe.encode(docs, tokenizer(), decoded=True)
    return coded.select(
        "doc_id",
        *more,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    judged = langid.predict(docs.select("doc_id", "text"), langid.train(docs))
    return judged.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_simhash": op2_simhash,
    "op3_kd_shards": op3_kd_shards,
    "op4_media": op4_media,
    "op5_mix": op5_mix,
    "op6_line_dedup": op6_line_dedup,
    "op7_chat": op7_chat,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_bpe": op9_bpe,
    "op10_langid": op10_langid,
}

SQL = {
    "op1_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS cp,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents),
        g AS (
            SELECT norm, count(*) AS group_size FROM n GROUP BY norm),
        r AS (
            SELECT n.*, g.group_size,
                   first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS k
            FROM n JOIN g USING (norm)
            WINDOW w AS (PARTITION BY norm ORDER BY cp DESC, doc_id))
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, k = 1 AS kept, sha256(norm) AS text_sha256
        FROM r""",
    "op6_line_dedup": r"""
        WITH l AS (
            SELECT coalesce('=' || source, '') AS host, doc_id, i, line FROM (
                SELECT source, doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS i,
                       unnest(string_split(text, chr(10))) AS line
                FROM documents)),
        c AS (
            SELECT host, line, count(DISTINCT doc_id) AS n FROM l WHERE trim(line, ' ') <> '' GROUP BY host, line),
        h AS (
            SELECT coalesce('=' || source, '') AS host, count(*) AS pages FROM documents GROUP BY 1),
        f AS (
            SELECT c.host, c.line FROM c JOIN h USING (host) WHERE n >= 4 AND n > pages * 0.05),
        k AS (
            SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY i) AS text
            FROM l ANTI JOIN f ON l.host = f.host AND l.line = f.line GROUP BY l.doc_id)
        SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
        FROM documents d LEFT JOIN k USING (doc_id)""",
    "op7_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        s AS (
            SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body,
                   replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS head
            FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(head) + length(body) + length('<|im_start|>') + length('<|im_end|>') + 2) AS BIGINT) AS formatted_chars
        FROM s GROUP BY conv_id""",
}
