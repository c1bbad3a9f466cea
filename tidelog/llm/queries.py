"""Registered queries of this package, with the SQL they must agree with where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chat_format, collocations, decontaminate, embedding_dups, filter_audit, near_dups, neighbours, secrets, sentencepiece, suffix_dedup, token_counts, toxicity, url_filter

PIECES = "piece_bpe_32k.model"
BYTE_BPE = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_digest(found)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = near_dups.group_near_duplicates(table(spark, sf_dir, "documents"))
    return grouped.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest_neighbours(vectors, vectors.filter("vec_id % 100 = 0"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.chat_digest(chat_format.format_chats(turns.unionByName(chat_format.control_conversation(spark))))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_digest(suffix_dedup.drop_repeated(table(spark, sf_dir, "documents")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.near_copies(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_decontaminate,
        op3_url_filter,
        op4_token_counts,
        op5_toxicity,
        op6_minhash,
        op7_secrets,
        op8_neighbours,
        op9_chat_format,
        op10_suffix_dedup,
        op11_filter_audit,
        op12_embedding_dups,
        op13_collocations,
    )
}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLES = {
    "op2_decontaminate": decontaminate.SQL,
    "op3_url_filter": url_filter.SQL,
    "op6_minhash": near_dups.SQL,
    "op9_chat_format": chat_format.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_embedding_dups": embedding_dups.SQL,
    "op13_collocations": collocations.SQL,
}
