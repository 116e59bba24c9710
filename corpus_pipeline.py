"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of ``docs``, whatever others it
has besides doc_id, text and lang, and an empty table gives an empty one. Rows without a doc_id and rows that repeat
one are documents of their own, but for the n-gram Jaccard join, in which rows with one doc_id share their fate and
rows without one stay. Null and empty texts go in the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import jaccard, language, lines, mixing, packing
from loomwright.llm.common import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; others go, such as texts that are null or without letters."""
    return language.accepted(docs, language.learn_filters(docs.where(~language.held_out())))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document or place has, but for one edit, go; a document without any left goes.

    Documents without a doc_id keep all their lines and take none from others.
    """
    return lines.drop_repeated_lines(docs, equal_from=1)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles connect, the one with the smallest doc_id stays.

    A doc_id that repeats with different texts stays or goes as one.
    """
    later = jaccard.near_duplicate_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates say that give the labelled domains their target shares of tokens.

    Equal rows have equal rates. Without usable labels all domains are as likely and rates meet the targets as far as they can.
    """
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 4096 tokens; repeated rows are packed each on its own."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: SQL cannot learn the classifiers, tokenise or plan the packing; stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
