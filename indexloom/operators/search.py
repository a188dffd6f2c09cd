"""Exact top-k similarity search.

Scores are cosine similarities of double-precision vectors, summed from the first component to the last and rounded to 12
decimals before they are ranked, so that equal vectors tie wherever they are stored; ties go to the smaller id.

The corpus is scanned once and is never shuffled or broadcast. Each Arrow batch of vectors becomes one
matrix product with the query matrix, and a task keeps only its running k best per query. Merging those
takes two windows, each with a partial top-k before its shuffle. A query set too large for one matrix is
written to the shared folder in blocks, which are streamed past the corpus where it is scanned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from indexloom.session import scratch_path, spread, written

DEFAULT_LIMIT = 10
DEFAULT_THRESHOLD = 0.2
OVER_FETCH = 2
SCORE_DECIMALS = 12
MAX_QUERY_BYTES = 32 * 1024 * 1024  # of vectors a task holds as its query matrix
QUERY_BLOCK_BYTES = 32 * 1024 * 1024  # of query vectors in one file of the streamed form
CORPUS_BUFFER_BYTES = 128 * 1024 * 1024  # of corpus vectors that a task holds while queries pass by
STREAM_ROWS = 8192  # query vectors compared at a time
MERGE_WAYS = 16  # parts in which the hits of one query are cut down before they meet


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two array columns; NULL when either vector has no length."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as a (rows, dim) double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column.value_lengths().unique()) > 1 or column.null_count:
        raise ValueError("vectors that are compared must all have the same length")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of `a` and `b`, each summed from its first component to its last."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _rounded(scores: np.ndarray) -> np.ndarray:
    """To SCORE_DECIMALS, halves away from zero."""
    scale = 10.0**SCORE_DECIMALS
    return np.copysign(np.floor(np.abs(scores) * scale + 0.5), scores) / scale


def _best(scores: np.ndarray, ids: np.ndarray, k: int, threshold: float | None) -> np.ndarray:
    """Positions of the k best of one query, ties by id; NaN never qualifies."""
    floor = -np.inf if threshold is None else threshold
    at = np.flatnonzero(scores >= floor)
    if len(at) > k:
        # everything tied with the k-th best stays in until ids decide
        kth = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= kth]
    order = np.lexsort((ids[at], -scores[at]))
    return at[order[:k]]


class _TopK:
    """Running k best per query over the batches of one task.

    `floor` is the score an entry must reach to matter: the threshold, then the k-th best so far. Only
    entries at the floor (less a rounding margin) are looked at one by one, so after the first batches
    nearly all work is the matrix product. That only picks them: how it sums depends on where a row stands, so those it
    picks are scored one sum after the other, and equal vectors have equal scores wherever they are.
    """

    def __init__(self, queries: np.ndarray, k: int, threshold: float | None):
        self.raw, self.squares, self.k, self.threshold = queries, _dots(queries, queries), k, threshold
        with np.errstate(invalid="ignore", divide="ignore"):
            self.queries = queries / np.sqrt(self.squares)[:, None]
        self.floor = np.full(len(queries), -np.inf if threshold is None else threshold)
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, ids: np.ndarray, vectors: np.ndarray, squares: np.ndarray | None = None) -> None:
        """`squares`: the products of the vectors with themselves, where they are known."""
        if not len(ids):
            return
        if vectors.shape[1] != self.queries.shape[1]:
            raise ValueError(f"vectors have {vectors.shape[1]} dimensions, queries {self.queries.shape[1]}")
        squares = _dots(vectors, vectors) if squares is None else squares
        lengths = np.sqrt(squares)
        step = max(1, 4_000_000 // len(ids))  # queries per product, to keep the score matrix small
        for lo in range(0, len(self.queries), step):
            scores = self.queries[lo : lo + step] @ vectors.T
            with np.errstate(invalid="ignore", divide="ignore"):
                scores /= lengths
            q, i = np.nonzero(scores >= self.floor[lo : lo + step, None] - 10.0**-SCORE_DECIMALS)
            starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else []
            for s, e in zip(starts, np.r_[starts[1:], len(q)] if len(q) else []):
                row, cols = lo + int(q[s]), i[s:e]
                near = scores[row - lo, cols]
                if len(cols) > self.k:  # those that cannot be among the best need no exact score
                    kth = np.partition(near, len(near) - self.k)[len(near) - self.k]
                    cols = cols[near >= kth - 2 * 10.0**-SCORE_DECIMALS]
                found = vectors[cols]
                exact = _dots(found, np.broadcast_to(self.raw[row], found.shape)) / np.sqrt(squares[cols] * self.squares[row])
                self._merge(row, ids[cols], _rounded(np.clip(exact, -1.0, 1.0)))

    def _merge(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if query in self.best:
            old_ids, old_scores = self.best[query]
            ids, scores = np.concatenate([old_ids, ids]), np.concatenate([old_scores, scores])
        at = _best(scores, ids, self.k, self.threshold)
        if len(at):
            self.best[query] = ids[at], scores[at]
        if len(at) == self.k:
            self.floor[query] = scores[at[-1]]

    def found(self, query_ids, query_type: pa.DataType, id_type: pa.DataType) -> dict[str, pa.Array]:
        """Columns of all hits kept."""
        kept = sorted(self.best)
        sizes = [len(self.best[j][0]) for j in kept]
        names = np.repeat(np.array([query_ids[j] for j in kept], dtype=object), sizes)
        ids = np.concatenate([self.best[j][0] for j in kept]) if kept else []
        scores = np.concatenate([self.best[j][1] for j in kept]) if kept else []
        return {
            "query_id": pa.array(names, type=query_type),
            "id": pa.array(ids, type=id_type),
            "score": pa.array(scores, type=pa.float64()),
        }


def _hit_schema(queries: DataFrame, corpus: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", corpus.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _scan_hits(corpus: DataFrame, queries: DataFrame, rows: list, k: int, threshold: float | None) -> DataFrame:
    """Local top-k of every task against a query matrix that has passed the size check."""
    schema = _hit_schema(queries, corpus)
    types = [to_arrow_type(schema[name].dataType) for name in ("query_id", "id")]
    query_ids = [r["query_id"] for r in rows]
    matrix = np.array([r["vector"] for r in rows], dtype="f8")
    shared = corpus.sparkSession.sparkContext.broadcast((query_ids, matrix))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix = shared.value
        best = _TopK(matrix, k, threshold)
        for batch in batches:
            best.add(batch.column("id").to_numpy(zero_copy_only=False), _matrix(batch.column("vector")))
        yield pa.RecordBatch.from_pydict(best.found(query_ids, *types))

    return spread(corpus.select("id", "vector")).mapInArrow(score, schema)


def _streamed_hits(corpus: DataFrame, queries: DataFrame, dim: int, k: int, threshold: float | None) -> DataFrame:
    """Top-k of every stretch of the corpus for every query, the queries being streamed past it.

    The queries are a table in the shared folder, in files of bounded size. A task fills a buffer of bounded size with its
    rows of the corpus, reads the query files one after another against it, and goes on with the next buffer. The corpus
    is neither copied nor shuffled, and neither side is whole anywhere.
    """
    schema = _hit_schema(queries, corpus)
    types = [to_arrow_type(schema[name].dataType) for name in ("query_id", "id")]
    spark = corpus.sparkSession
    path = scratch_path(spark, "query-blocks")
    block_rows = max(1, QUERY_BLOCK_BYTES // (8 * dim))
    queries.select("query_id", "vector").write.option("maxRecordsPerFile", block_rows).parquet(path)
    files = spark.read.parquet(path).inputFiles()
    buffer_rows = max(1, CORPUS_BUFFER_BYTES // (8 * dim))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
            squares = _dots(vectors, vectors)
            for file in files:
                system, at = pafs.FileSystem.from_uri(file)
                with pq.ParquetFile(at, filesystem=system) as stored:
                    for block in stored.iter_batches(STREAM_ROWS, columns=["query_id", "vector"]):
                        best = _TopK(_matrix(block.column("vector")), k, threshold)
                        best.add(ids, vectors, squares)
                        yield pa.RecordBatch.from_pydict(best.found(block.column("query_id").to_pylist(), *types))

        # the buffer is the only large thing that a task holds: rows become doubles a batch at a time, in their place
        ids, vectors, n = [], None, 0
        for batch in batches:
            done = 0
            while done < batch.num_rows:
                part = batch.slice(done, buffer_rows - n)
                matrix = _matrix(part.column("vector"))
                if vectors is None:
                    vectors = np.empty((buffer_rows, matrix.shape[1]))
                elif matrix.shape[1] != vectors.shape[1]:
                    raise ValueError("vectors that are compared must all have the same length")
                vectors[n : n + len(matrix)] = matrix
                ids.append(part.column("id").to_numpy(zero_copy_only=False))
                n, done = n + len(matrix), done + len(matrix)
                if n == buffer_rows:
                    yield from compared(np.concatenate(ids), vectors)
                    ids, n = [], 0
        if n:
            yield from compared(np.concatenate(ids), vectors[:n])

    return spread(corpus.select("id", "vector")).mapInArrow(score, schema)


def rank(hits: DataFrame, k: int) -> DataFrame:
    """The k best per query, numbered from 1.

    In two steps: the hits of a query, of which there are k from every task, are first cut down in MERGE_WAYS parts, so
    that no task takes all of them.
    """
    best = [F.desc("score"), F.asc("id")]
    part = F.pmod(F.xxhash64("id"), F.lit(MERGE_WAYS)).cast("int")
    within = Window.partitionBy("query_id", "_part").orderBy(*best)
    some = hits.withColumn("_part", part).withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= k)
    w = Window.partitionBy("query_id").orderBy(*best)
    return some.drop("_part").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search_batch(
    corpus: DataFrame,
    queries: DataFrame,
    limit: int = DEFAULT_LIMIT,
    threshold: float | None = DEFAULT_THRESHOLD,
    max_query_bytes: int = MAX_QUERY_BYTES,
) -> DataFrame:
    """Top `limit` of `corpus (id, vector)` for every row of `queries (query_id, vector)`.

    Columns: query_id, id, score, rank. Only entries with `score >= threshold` count.
    """
    stats = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    dim = max(stats["dim"] or 0, 1)
    query_bytes = stats["n"] * dim * 8
    if 0 < query_bytes <= max_query_bytes:
        rows = queries.select("query_id", "vector").collect()  # within max_query_bytes
        hits = _scan_hits(corpus, queries, rows, limit, threshold)
    else:
        hits = _streamed_hits(corpus, queries, dim, limit, threshold)
    return rank(hits, limit)


def search(
    corpus: DataFrame, vector: list[float], limit: int = DEFAULT_LIMIT, threshold: float | None = DEFAULT_THRESHOLD
) -> DataFrame:
    """Top `limit` entries for one query vector: id, score, best first."""
    spark = corpus.sparkSession
    query = spark.createDataFrame([(0, [float(x) for x in vector])], "query_id int, vector array<double>")
    rows = query.collect()
    hits = _scan_hits(corpus, query, rows, limit, threshold)
    return hits.select("id", "score").orderBy(F.desc("score"), F.asc("id")).limit(limit)


def with_scores(corpus: DataFrame, vector: list[float]) -> DataFrame:
    """`corpus` with the `score` of every row against one query vector, for filters without a ranking."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    return corpus.withColumn("score", F.round(cosine(F.col("vector"), query), SCORE_DECIMALS))


def search_best(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """The best entry per query at the fixed threshold 0; a query with none has no row."""
    return search_batch(corpus, queries, limit=1, threshold=0.0).select("query_id", "id", "score")


def search_chunks(
    corpus: DataFrame,
    chunks: DataFrame,
    queries: DataFrame,
    limit: int = DEFAULT_LIMIT,
    threshold: float = DEFAULT_THRESHOLD,
    chunk_type: str | None = None,
    parent_id: str | None = None,
    prefilter: bool = False,
    lookup: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Chunk rows for the best hits per query.

    The best `2 * limit` entries are taken first and only then meet the threshold, the chunk table and
    the type and parent filters, so fewer than `limit` rows may come back although more would qualify.
    `prefilter=True` searches only entries whose chunk passes the filters. `lookup` gives the chunk rows of a
    table of ids, so that a stored chunk table is read for the hits only.
    """

    def wanted(df: DataFrame) -> DataFrame:
        if chunk_type:
            df = df.filter(F.col("type") == chunk_type)
        if parent_id is not None:
            df = df.filter(F.col("parent_id") == parent_id)
        return df

    if prefilter and {"type", "parent_id"} <= set(corpus.columns):
        corpus = wanted(corpus)  # stored with the vectors: the scan skips what does not qualify
    elif prefilter:
        corpus = corpus.join(wanted(chunks).select("id"), "id", "left_semi")
    hits = search_batch(corpus, queries, limit * OVER_FETCH, threshold=None).drop("rank")
    hits = hits.filter(F.col("score") >= threshold)
    # a popular chunk may be a hit of many queries, so the join is one from many hits to a unique chunk;
    # the planner broadcasts the hits when their size is small and shuffles by id otherwise
    if lookup is not None:
        hits = written(hits, "chunk-hits")
        chunks = lookup(hits)
    found = wanted(hits.join(chunks, "id", "inner"))
    return rank(found, limit)
