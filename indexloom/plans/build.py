"""Build a file index or a chunk index from a table of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexloom.functions.metadata import chunk_metadata, file_metadata
from indexloom.functions.text import is_blank
from indexloom.functions.tokens import word_token_count
from indexloom.operators.embed import Model
from indexloom.operators.extract import detect_language, extract_chunks
from indexloom.operators.hierarchy import outline
from indexloom.operators.upsert import latest
from indexloom.session import written
from indexloom.sources.store import IndexStore

FILE_COLLECTION = "files"
CHUNK_COLLECTION = "chunks"


def file_status(files: DataFrame) -> DataFrame:
    """One status per file: `ok`, `empty` (no characters at all) or `error` (could not be read)."""
    status = F.when(F.col("content").isNull(), "error").when(F.col("content") == "", "empty").otherwise("ok")
    return files.withColumn("status", status)


def not_empty(files: DataFrame) -> DataFrame:
    """Files with any character; white space counts."""
    return files.filter(F.col("content") != "")


def not_blank(chunks: DataFrame) -> DataFrame:
    """Chunks with a character that is not white space."""
    return chunks.filter(~is_blank(F.col("content")))


def embed_entries(rows: DataFrame, model: Model) -> DataFrame:
    """Rows `(id, content, ...)` with their `vector`; rows without a content are dropped."""
    return model.embed(rows, "content")


def last_versions(files: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row per path: the last by `order`, or where that leaves several, the one with the greatest content.

    Versions are reduced in the task that reads them before anything is shuffled.
    """
    return latest(files, ["path"], [*(order or []), "content"])


def index_files(
    store: IndexStore,
    files: DataFrame,
    model: Model,
    collection: str = FILE_COLLECTION,
    force: bool = False,
    count_tokens: Callable[[Column], Column] = word_token_count,
    order: list[str] | None = None,
) -> DataFrame:
    """Embed whole files `(path, content)` into a new collection. Returns a status per path.

    Of a repeated path the last version by the columns `order` counts. The collection is registered when its
    vectors are there, so a failure in reading or embedding leaves no empty collection behind.
    """
    store.require_free(collection, force)
    files = written(last_versions(files, order), "files-read")
    rows = not_empty(files).select(
        F.col("path").alias("id"),
        "content",
        file_metadata(F.col("path"), count_tokens(F.col("content"))).alias("metadata"),
    )
    entries = written(rows, "files-kept").withColumn("path", F.col("id"))
    store.build(collection, model.name, model.dim, entries, force=force, finish={"embeddings": lambda rows: embed_entries(rows, model)})
    return file_status(files).select("path", "status")


def chunk_rows(files: DataFrame, count_tokens: Callable[[Column], Column] = word_token_count) -> DataFrame:
    """Chunks of all supported files, blank ones left out, with what else their metadata is made of."""
    chunks = not_blank(extract_chunks(files))
    return chunks.withColumns({"tokens": count_tokens(F.col("content")), "made": F.current_timestamp().cast("string")})


def index_chunks(
    store: IndexStore,
    files: DataFrame,
    model: Model,
    collection: str = CHUNK_COLLECTION,
    force: bool = False,
    count_tokens: Callable[[Column], Column] = word_token_count,
    order: list[str] | None = None,
) -> DataFrame:
    """Cut files into chunks and embed those into a new collection.

    A chunk enters the chunk table only with its vector. Returns a status per supported file: `ok` when
    at least one of its chunks was stored, else `error`.
    """
    store.require_free(collection, force)
    supported, chunks = _chunks(files, count_tokens, order)
    store.build(collection, model.name, model.dim, chunks.drop("decorators"), chunks, force, _finish(model))
    return _chunk_status(supported, chunks)


def add_chunks(
    store: IndexStore,
    files: DataFrame,
    model: Model,
    collection: str,
    count_tokens: Callable[[Column], Column] = word_token_count,
    order: list[str] | None = None,
) -> DataFrame:
    """Bring the chunks of `files` in an existing collection up to date.

    Of a repeated path the last version by the columns `order` counts. Chunks are inserted or replaced, and those
    that a path had before and has no more are removed.
    """
    supported, chunks = _chunks(files, count_tokens, order)
    # chunks are sorted by path, so few paths read few files
    known = store.lookup("chunks", collection, supported, "path").select("id")
    gone = written(known.join(chunks.select("id"), "id", "left_anti"), "chunks-gone")
    store.upsert(collection, chunks.drop("decorators"), chunks, gone=gone, finish=_finish(model))
    return _chunk_status(supported, chunks)


def _chunks(files: DataFrame, count_tokens: Callable[[Column], Column], order: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """Paths in a supported language and all their chunks, both as tables."""
    supported = detect_language(files).filter(F.col("language").isNotNull())
    last = written(last_versions(supported.select("path", "content", *(order or [])), order), "files-last")
    return last, written(chunk_rows(last, count_tokens), "chunks-cut")


def _finish(model: Model) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """What chunks get as they are stored. Vectors and metadata are many times a chunk's other columns, so they are made last."""

    def described(rows: DataFrame) -> DataFrame:
        return rows.withColumn("metadata", chunk_metadata(F.col("tokens"), F.col("made")))

    return {"embeddings": lambda rows: described(embed_entries(rows, model)), "chunks": described}


def _chunk_status(supported: DataFrame, chunks: DataFrame) -> DataFrame:
    stored = chunks.groupBy("path").agg(F.count("*").alias("chunks"))
    return supported.select("path").join(stored, "path", "left").select(
        "path",
        F.when(F.col("chunks") > 0, "ok").otherwise("error").alias("status"),
        F.coalesce("chunks", F.lit(0)).alias("chunks"),
    )


def build_outline(store: IndexStore, collection: str = CHUNK_COLLECTION) -> None:
    """Number the chunks of a collection in pre-order and store them so, for questions about trees."""
    store.put_outline(collection, outline(store.chunks(collection)))
