"""From raw documents to packed sequences: quality, repeated lines, near copies, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; what it returns is written
as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tickloom.llm import decontam, jaccard, line_dedup, packing, quality
from tickloom.llm.common import documents, fresh, staged


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, quality.train(docs, documents(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; those of which nothing is left go."""
    (count,) = fresh(docs.columns, "n_deleted")
    out = line_dedup.line_dedup(docs, count_col=count)
    lost = F.col(count) > 0
    out = out.where(~(lost & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(lost, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def keep_one_of_alike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id."""
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontam.without_leaks(docs, documents(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("line_dedup", drop_repeated_lines), ("jaccard", keep_one_of_alike), ("decontam", drop_leaks), ("packing", pack)]

#: The first stage is a trained classifier, which SQL can't express: tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
