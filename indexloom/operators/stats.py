"""Counts and sizes. All aggregates combine before their shuffle, so a hot group stays small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexloom.functions.text import human_size


def entries_per_collection(entries: DataFrame) -> DataFrame:
    return entries.groupBy("collection").agg(F.count("*").alias("entries"))


def chunk_count(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks"))


def chunks_per_type(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("type").agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "type")


def top_files(chunks: DataFrame, limit: int = 10) -> DataFrame:
    """Files with most chunks; equal counts by path."""
    return chunks.groupBy("path").agg(F.count("*").alias("chunks")).orderBy(F.desc("chunks"), "path").limit(limit)


def hierarchy_counts(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count_if(F.col("parent_id").isNull()).alias("top_level"),
        F.count_if(F.col("parent_id").isNotNull()).alias("nested"),
    )


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count("*").alias("files"))


def corpus_size(entries: DataFrame, n_bytes: Column) -> DataFrame:
    """Entries and size per collection, with the size as people read it."""
    totals = entries.groupBy("collection").agg(F.count("*").alias("entries"), F.sum(n_bytes).alias("bytes"))
    return totals.withColumn("size", human_size(F.col("bytes")))


def token_totals(entries: DataFrame, tokens: Column) -> DataFrame:
    return entries.groupBy("collection").agg(F.sum(tokens).alias("tokens"), F.max(tokens).alias("max_tokens"))
