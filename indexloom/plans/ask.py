"""Search a stored index and report the results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from indexloom.errors import HierarchyCycle
from indexloom.functions import text
from indexloom.functions.labels import language_label
from indexloom.functions.metadata import lines_in_chunk
from indexloom.operators import filters, hierarchy, stats
from indexloom.operators.embed import Model
from indexloom.operators.search import (
    DEFAULT_LIMIT,
    DEFAULT_THRESHOLD,
    search_batch,
    search_best,
    search_chunks,
)
from indexloom.plans.build import build_outline
from indexloom.session import written
from indexloom.sources.store import IndexStore

LINE_STEPS = 32  # levels that are climbed key by key before an outline is made


def embed_queries(queries: DataFrame, model: Model) -> DataFrame:
    """`(query_id, text)` to `(query_id, vector)`, computed once."""
    return written(model.embed(queries.select("query_id", "text"), "text").drop("text"), "query-vectors")


def one_query(spark: SparkSession, query: str) -> DataFrame:
    return spark.createDataFrame([(0, query)], "query_id long, text string")


def with_entries(hits: DataFrame, store: IndexStore, collection: str) -> DataFrame:
    """Hits with content and metadata, which are read only for the ids found and after the ranking."""
    hits = written(hits, "hits")
    entries = store.lookup("embeddings", collection, hits)
    return hits.join(entries.select("id", "content", "metadata"), "id", "inner")


def query_files(
    store: IndexStore,
    queries: DataFrame,
    model: Model,
    collection: str,
    limit: int = DEFAULT_LIMIT,
    threshold: float = DEFAULT_THRESHOLD,
) -> DataFrame:
    """Best entries for every query text: query_id, rank, id, score, content, metadata."""
    store.require_model(collection, model.name, model.dim)
    entries = store.embeddings(collection)
    hits = search_batch(entries.select("id", "vector"), embed_queries(queries, model), limit, threshold)
    return with_entries(hits, store, collection)


def best_file(store: IndexStore, queries: DataFrame, model: Model, collection: str) -> DataFrame:
    """The single best entry per query; the threshold is 0 whatever the caller would like."""
    store.require_model(collection, model.name, model.dim)
    entries = store.embeddings(collection)
    hits = search_best(entries.select("id", "vector"), embed_queries(queries, model))
    return with_entries(hits, store, collection)


def query_chunks(
    store: IndexStore,
    queries: DataFrame,
    model: Model,
    collection: str,
    limit: int = DEFAULT_LIMIT,
    threshold: float = DEFAULT_THRESHOLD,
    chunk_type: str | None = None,
    parent_id: str | None = None,
    prefilter: bool = False,
) -> DataFrame:
    """Best chunks for every query text, with the columns of the chunk table."""
    store.require_model(collection, model.name, model.dim)
    entries = store.embeddings(collection).select("id", "vector", "type", "parent_id")
    return search_chunks(
        entries,
        store.chunks(collection),
        embed_queries(queries, model),
        limit,
        threshold,
        chunk_type,
        parent_id,
        prefilter,
        lambda hits: store.lookup("chunks", collection, hits),
    )


def with_fallback_content(results: DataFrame, files: DataFrame) -> DataFrame:
    """Where an entry was stored without content, the file's own."""
    own = files.select(F.col("path").alias("id"), F.col("content").alias("_file_content"))
    joined = results.join(own, "id", "left")
    return joined.withColumn("content", F.coalesce("content", "_file_content")).drop("_file_content")


def shown_content(content: Column, context: int | None) -> Column:
    """What a result shows: the middle lines when a context is asked for, else a snippet."""
    if context is not None:
        return text.context_window(content, context)
    cut = text.snippet(content)
    return F.struct(cut["snippet"].alias("content"), F.lit(1).alias("start_line"))


def report(results: DataFrame, context: int | None = None) -> DataFrame:
    """The rows of a result display: rank, id, percent, tokens, language label and the shown text."""
    shown = shown_content(F.col("content"), context)
    return results.select(
        "query_id",
        "rank",
        "id",
        text.percent(F.col("score")).alias("percent"),
        F.try_element_at("metadata", F.lit("tokens")).alias("tokens"),
        language_label(F.col("id")).alias("language"),
        shown["content"].alias("shown"),
        shown["start_line"].alias("start_line"),
        (F.length("content") > 500).alias("truncated") if context is None else F.lit(False).alias("truncated"),
    )


def chunk_report(results: DataFrame) -> DataFrame:
    """The rows of a chunk result display."""
    return results.select(
        "query_id",
        "rank",
        "id",
        "type",
        "name",
        "path",
        "start_line",
        "end_line",
        lines_in_chunk().alias("lines"),
        "parent_id",
        text.percent(F.col("score")).alias("percent"),
        F.try_element_at("metadata", F.lit("tokens")).alias("tokens"),
        language_label(F.col("path")).alias("language"),
    )


# reports over a stored index


def outlined(store: IndexStore, collection: str) -> DataFrame:
    """The stored outline of a collection, made again if chunks were changed since it was stored."""
    found = store.outline(collection)
    if found is None:
        build_outline(store, collection)
        found = store.outline(collection)
    return store.chunks(collection).limit(0) if found is None else found


def list_chunks(store: IndexStore, collection: str, path: str | None = None, chunk_type: str | None = None) -> DataFrame:
    return filters.list_chunks(store.chunks(collection), path, chunk_type)


def chunk_tree(store: IndexStore, collection: str, root_id: str | None = None, orphans_as_roots: bool = False) -> DataFrame:
    return hierarchy.tree(outlined(store, collection), root_id, orphans_as_roots)


def chunk_descendants(store: IndexStore, collection: str, chunk_id: str) -> DataFrame:
    return hierarchy.descendants(outlined(store, collection), chunk_id)


def _line(chunks: DataFrame, chunk_id: str) -> list[str] | None:
    """Ids from a chunk up to its root, each looked up by the Bloom filters of the stored files; none for an unknown id, and
    None where the way up is longer than LINE_STEPS."""
    line, at = [], chunk_id
    while at is not None:
        if at in line:
            raise HierarchyCycle(f"{at!r} is above itself")
        if len(line) == LINE_STEPS:
            return None
        found = chunks.filter(F.col("id") == at).select("parent_id").collect()  # one row: ids are unique
        if not found:
            break
        line.append(at)
        at = found[0]["parent_id"]
    return line


def _relatives(store: IndexStore, collection: str, chunk_id: str) -> DataFrame:
    """One chunk, its ancestors and its children with `relation` and `distance`.

    A stored outline has them in ranges. Without one they are found by their keys, as numbering all chunks is more work than
    a question about one; only for a chunk very far down is the outline made.
    """
    shape, chunks = store.outline(collection), store.chunks(collection)
    line = _line(chunks, chunk_id) if shape is None else None
    if line is None:
        shape = outlined(store, collection) if shape is None else shape
        return hierarchy.show(shape, chunk_id).select(*chunks.columns, "relation", "distance")
    if not line:
        return chunks.filter(F.lit(False)).withColumn("relation", F.lit("self")).withColumn("distance", F.lit(0))
    child = F.coalesce(F.col("parent_id") == chunk_id, F.lit(False))
    near = chunks.filter(child | F.col("id").isin(line))
    up = (F.array_position(F.array(*[F.lit(i) for i in line]), F.col("id")) - 1).cast("int")
    relation = F.when(child, "child").when(F.col("id") == chunk_id, "self").otherwise("ancestor")
    return near.withColumn("relation", relation).withColumn("distance", F.when(child, 1).otherwise(up))


def chunk_ancestors(store: IndexStore, collection: str, chunk_id: str) -> DataFrame:
    """Ancestors of one chunk with `distance`, nearest first."""
    found = _relatives(store, collection, chunk_id).filter("relation = 'ancestor'")
    return found.drop("relation").orderBy("distance")


def show_chunk(store: IndexStore, collection: str, chunk_id: str) -> DataFrame:
    """One chunk, its ancestors and its children, with content and metadata."""
    return _relatives(store, collection, chunk_id)


def chunk_stats(store: IndexStore, collection: str) -> DataFrame:
    """`(report, key, chunks)`: the counts of a collection in all, per type, of its ten largest files, top-level and
    nested, and per depth."""
    chunks, shape = store.chunks(collection), store.outline(collection)
    if shape is None:  # depths alone need only the chunks that have children
        depths = hierarchy.depth_histogram(chunks.select("id", "parent_id")).withColumnRenamed("nodes", "chunks")
    else:
        depths = shape.groupBy("depth").agg(F.count("*").alias("chunks"))

    def part(name: str, df: DataFrame, key: Column) -> DataFrame:
        return df.select(F.lit(name).alias("report"), key.cast("string").alias("key"), F.col("chunks").cast("long"))

    level = F.when(F.col("parent_id").isNull(), "top_level").otherwise("nested")
    parts = [
        part("total", stats.chunk_count(chunks), F.lit("all")),
        part("type", stats.chunks_per_type(chunks), F.col("type")),
        part("file", stats.top_files(chunks), F.col("path")),
        part("hierarchy", chunks.groupBy(level.alias("level")).agg(F.count("*").alias("chunks")), F.col("level")),
        part("depth", depths, F.col("depth")),
    ]
    return reduce(DataFrame.unionByName, parts)
