"""Row filters over chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_collection(df: DataFrame, collection: str) -> DataFrame:
    """`collection` is a partition column of stored tables, so this prunes folders."""
    return df.filter(F.col("collection") == collection)


def by_type(chunks: DataFrame, chunk_type: str | None) -> DataFrame:
    """Empty or None filters nothing."""
    return chunks.filter(F.col("type") == chunk_type) if chunk_type else chunks


def by_parent(chunks: DataFrame, parent_id: str | None) -> DataFrame:
    """None filters nothing; otherwise top-level chunks never qualify."""
    return chunks if parent_id is None else chunks.filter(F.col("parent_id") == parent_id)


def path_like(chunks: DataFrame, part: str) -> DataFrame:
    """Path contains `part`, ignoring case; `%` and `_` in it stay wildcards, a backslash is literal."""
    return chunks.filter(F.col("path").ilike("%" + part.replace("\\", "\\\\") + "%"))


def by_path(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.filter(F.col("path") == path)


def name_matches(chunks: DataFrame, pattern: str) -> DataFrame:
    """Name matches a regular expression somewhere, ignoring case."""
    return chunks.filter(F.col("name").rlike("(?iuU)" + pattern))


def by_id(chunks: DataFrame, chunk_id: str) -> DataFrame:
    return chunks.filter(F.col("id") == chunk_id)


def list_chunks(chunks: DataFrame, path_part: str | None = None, chunk_type: str | None = None) -> DataFrame:
    """The chunk listing, with both of its optional filters."""
    if path_part:
        chunks = path_like(chunks, path_part)
    return by_type(chunks, chunk_type)
