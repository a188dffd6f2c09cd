"""The metadata kept with an entry, and JSON forms of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexloom import schemas


def file_metadata(path: Column, tokens: Column) -> Column:
    """`path, tokens, timestamp` of an embedded file."""
    return F.create_map(
        F.lit("path"), path,
        F.lit("tokens"), tokens.cast("string"),
        F.lit("timestamp"), F.current_timestamp().cast("string"),
    )


def chunk_metadata(tokens: Column, made: Column | None = None) -> Column:
    """Metadata of an embedded chunk, from the chunk's own columns and the time it was made, or now. A NULL parent is left out."""
    full = F.create_map(
        F.lit("tokens"), tokens.cast("string"),
        F.lit("type"), F.col("type"),
        F.lit("name"), F.col("name"),
        F.lit("path"), F.col("path"),
        F.lit("start_line"), F.col("start_line").cast("string"),
        F.lit("end_line"), F.col("end_line").cast("string"),
        F.lit("parent_id"), F.col("parent_id"),
        F.lit("timestamp"), F.current_timestamp().cast("string") if made is None else made,
    )
    return F.map_filter(full, lambda _, v: v.isNotNull())


def encode(metadata: Column) -> Column:
    return F.to_json(metadata)


def decode(text: Column) -> Column:
    return F.from_json(text, schemas.METADATA)


def rows(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per metadata entry."""
    return df.select(key, F.explode("metadata").alias("key", "value"))


def chunk_json(*columns: str) -> Column:
    """A chunk as a JSON object; NULLs and an empty metadata map are left out."""
    fields = [
        F.when(F.size("metadata") > 0, F.col("metadata")).alias("metadata") if c == "metadata" else F.col(c)
        for c in columns
    ]
    return F.to_json(F.struct(*fields))


def chunk_from_json(text: Column, schema) -> Column:
    """The inverse of `chunk_json`; a missing metadata map comes back empty."""
    parsed = F.from_json(text, schema)
    if "metadata" not in schema.fieldNames():
        return parsed
    empty = F.create_map().cast(schema["metadata"].dataType)
    return parsed.withField("metadata", F.coalesce(parsed["metadata"], empty))


def qualified_name() -> Column:
    return F.concat_ws(":", "type", "name")


def summary() -> Column:
    return F.format_string("%s:%s at %s:%d-%d", "type", "name", "path", "start_line", "end_line")


def lines_in_chunk() -> Column:
    return F.col("end_line") - F.col("start_line") + 1
