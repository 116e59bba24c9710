"""Queries of this subpackage's operators, with their SQL where SQL can express them."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import chat, jaccard, language, lines, mixing, near_vectors, nearest, packing, private, substrings


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, base = F.col("spans"), F.filter("spans", lambda s: s["kind"] != private.TERM)
    number = [F.size(F.filter(F.transform(spans, lambda s: s["kind"]), lambda x: x == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in private.KINDS]  # noqa: B023
    hashed = F.sha2(private.span_text(base), 256).alias("base_sha256")
    return private.find_private(_documents(spark, sf_dir)).select("doc_id", *number, hashed, private.span_text(spans).alias("spans"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), _tokenizer())


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeated_passages(_documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", language.held_out())
    filters = language.learn_filters(docs.where("not held_out"))
    return language.identify(docs.drop("lang"), filters).select("doc_id", "held_out", "lang_pred", "score", "coverage")


def op7_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text_hash")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(_documents(spark, sf_dir), equal_from=1)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_components(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_disclosure": op1_pii_disclosure,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_language_id": op6_language_id,
    "op7_mixing_rates": op7_mixing_rates,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}

if importlib.util.find_spec("corpus_pipeline"):
    QUERIES["pipeline"] = pipeline

ORACLE_SQL: dict[str, str] = {"op5_chat_formatting": chat.FORMAT_SQL}
