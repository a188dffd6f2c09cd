"""The fixed schemas of the tables an index consists of."""

from __future__ import annotations

from pyspark.sql import types as T

FILES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("content", T.StringType(), True),
    ]
)

COLLECTIONS = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("model", T.StringType(), False),
        T.StructField("dim", T.IntegerType(), False),
        T.StructField("updated", T.TimestampType(), False),
    ]
)

METADATA = T.MapType(T.StringType(), T.StringType())

EMBEDDINGS = T.StructType(
    [
        T.StructField("collection", T.StringType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("vector", T.ArrayType(T.FloatType(), False), False),
        T.StructField("content", T.StringType(), True),
        T.StructField("metadata", METADATA, True),
        T.StructField("type", T.StringType(), True),  # of chunks: what a search can be restricted by
        T.StructField("path", T.StringType(), True),
        T.StructField("parent_id", T.StringType(), True),
        T.StructField("updated", T.TimestampType(), False),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("collection", T.StringType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("type", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("start_line", T.IntegerType(), False),
        T.StructField("start_col", T.IntegerType(), False),
        T.StructField("end_line", T.IntegerType(), False),
        T.StructField("end_col", T.IntegerType(), False),
        T.StructField("parent_id", T.StringType(), True),
        T.StructField("content", T.StringType(), False),
        T.StructField("decorators", T.ArrayType(T.StringType(), False), True),
        T.StructField("metadata", METADATA, True),
        T.StructField("updated", T.TimestampType(), False),
    ]
)

# Chunks in pre-order: the chunks below one are those whose `first` lies between its own and its `last`.
OUTLINE = T.StructType(
    [
        T.StructField("collection", T.StringType(), False),
        T.StructField("id", T.StringType(), False),
        T.StructField("first", T.LongType(), False),
        T.StructField("last", T.LongType(), False),
        T.StructField("depth", T.IntegerType(), False),
        T.StructField("position", T.LongType(), False),  # among the children of its parent, from 1
        T.StructField("orphaned", T.BooleanType(), False),
        *[f for f in CHUNKS.fields if f.name not in ("collection", "id")],
    ]
)
