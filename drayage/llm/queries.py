"""One query for each text operator, with production parameters, over its whole table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from drayage.llm import (
    bpe,
    exact_dedup,
    extraction,
    fingerprints,
    lexical,
    mixing,
    near_dedup,
    packing,
    sharding,
    tool_calls,
    toxicity,
    urls,
    whitening,
)
from drayage.llm.common import read

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PACK_END = 1
PACK_CAPACITY = 2048

RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_exact_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return exact_dedup.assignments(read(spark, directory, "documents")).withColumnRenamed("id", "doc_id")


def op2_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return near_dedup.assignments(read(spark, directory, "documents")).withColumnRenamed("id", "doc_id")


def op3_bpe(spark: SparkSession, directory: str) -> DataFrame:
    coded = bpe.encode(read(spark, directory, "documents"), public_tokenizers.path(BYTE_BPE), decoded=True)
    return coded.select(
        F.col("id").alias("doc_id"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_url_filter(spark: SparkSession, directory: str) -> DataFrame:
    judged = urls.judge(read(spark, directory, "pages"), urls.rules_frame(spark, RULES))
    return judged.withColumnRenamed("id", "page_id")


def op5_html_extraction(spark: SparkSession, directory: str) -> DataFrame:
    pages = read(spark, directory, "pages")
    found = extraction.main_texts(pages, extraction.train(pages))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_packing(spark: SparkSession, directory: str) -> DataFrame:
    packed = packing.pack(read(spark, directory, "documents"), public_tokenizers.path(WORD_BPE), PACK_END, PACK_CAPACITY)
    return packed.withColumnRenamed("id", "doc_id")


def op7_tool_calls(spark: SparkSession, directory: str) -> DataFrame:
    calls, results = tool_calls.conversation_calls(read(spark, directory, "conversations"))
    return tool_calls.link(calls, results, tool_calls.SCHEMAS)


def held_out(id_col: str = "doc_id") -> "F.Column":
    """The fifth of the ids that training never sees."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def toxicity_model(spark: SparkSession, docs: DataFrame, directory: str) -> "toxicity.Model | None":
    return toxicity.train(docs, read(spark, directory, "labels").filter(~held_out()))


def op8_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    docs = read(spark, directory, "documents")
    scored = toxicity.score(docs, toxicity_model(spark, docs, directory))
    return scored.select(
        F.col("id").alias("doc_id"),
        held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    docs = read(spark, directory, "documents")
    return fingerprints.neighbours(docs, fingerprints.level_ranks(docs)).withColumnRenamed("id", "doc_id")


def op10_sharding(spark: SparkSession, directory: str) -> DataFrame:
    return sharding.shard(read(spark, directory, "documents")).select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_lexical_search(spark: SparkSession, directory: str) -> DataFrame:
    found = lexical.search(read(spark, directory, "benchmark"), read(spark, directory, "documents"))
    return found.withColumnRenamed("id", "doc_id")


def op12_whitening(spark: SparkSession, directory: str) -> DataFrame:
    return whitening.whiten(read(spark, directory, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_mixing(spark: SparkSession, directory: str) -> DataFrame:
    services = mixing.queue(read(spark, directory, "documents"))
    return mixing.taken(services).withColumnRenamed("id", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_near_dedup,
        op3_bpe,
        op4_url_filter,
        op5_html_extraction,
        op6_packing,
        op7_tool_calls,
        op8_toxicity,
        op9_fingerprints,
        op10_sharding,
        op11_lexical_search,
        op12_whitening,
        op13_mixing,
    )
}


def oracle_sql() -> dict[str, str]:
    from drayage.llm import queries_sql

    return queries_sql.oracle_sql()
