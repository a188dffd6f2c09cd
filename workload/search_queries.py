"""Similarity search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexloom.functions.text import percent
from indexloom.operators.embed import hashed_vectors
from indexloom.operators.search import search, search_batch, search_best, search_chunks, with_scores
from indexloom.plans.ask import report
from indexloom.session import written
from workload.inputs import CHUNK_ROWS_SQL, ENTRIES_SQL, chunk_rows, entries, hashed_sql, table
from workload.registry import query

# scores of one query (the vector of entry 0) against every entry
ONE_SQL = f"""WITH {ENTRIES_SQL}, scored AS (
    SELECT e.id, round(list_cosine_similarity(e.vector, q.vector), 12) AS score
    FROM entries e JOIN (SELECT vector FROM entries WHERE id = 0) q ON true)"""

# scores of every entry as a query against every entry, ranked per query
ALL_SQL = f"""WITH {ENTRIES_SQL}, {CHUNK_ROWS_SQL}, scored AS (
    SELECT q.id AS query_id, e.id, round(list_cosine_similarity(e.vector, q.vector), 12) AS score
    FROM entries e JOIN entries q ON true),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)"""


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return entries(spark, sf_dir).filter(F.col("id") == 0).first()["vector"]


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("id", "vector")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select(F.col("id").alias("query_id"), "vector")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(
    "search_topk",
    ONE_SQL
    + """ SELECT s.id, round(s.score, 6) AS score, d.lang AS lang, md5(d.text) AS content
    FROM (SELECT * FROM scored WHERE score >= 0.2 ORDER BY score DESC, id LIMIT 10) s
    LEFT JOIN documents d ON d.doc_id = s.id""",
)
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: best ten entries for one query vector, with their contents."""
    hits = search(_corpus(spark, sf_dir), _vector(spark, sf_dir))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    found = _rounded(hits).join(docs, "id", "left")
    return found.select("id", "score", "lang", F.md5("text").alias("content"))


@query(
    "search_threshold",
    ONE_SQL + " SELECT id, round(score, 6) AS score FROM scored WHERE score >= 0.25",
)
def search_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = with_scores(_corpus(spark, sf_dir), _vector(spark, sf_dir))
    return _rounded(scored.filter(F.col("score") >= 0.25).select("id", "score"))


@query(
    "search_percent",
    ONE_SQL + " SELECT id, round(score * 100, 1) AS percent FROM scored WHERE score >= 0.2 ORDER BY score DESC, id LIMIT 50",
)
def search_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search(_corpus(spark, sf_dir), _vector(spark, sf_dir), limit=50)
    return hits.select("id", percent(F.col("score")).alias("percent"))


@query(
    "search_similar",
    ALL_SQL
    + """, kept AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
                    FROM scored WHERE score >= 0.2)
    SELECT query_id, id, round(score, 6) AS score, rank FROM kept WHERE rank <= 10""",
)
def search_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry as a query against every entry."""
    return _rounded(search_batch(_corpus(spark, sf_dir), _queries(spark, sf_dir)))


@query(
    "search_similar_streamed",
    ALL_SQL
    + """, kept AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
                    FROM scored WHERE score >= 0.1)
    SELECT query_id, id, round(score, 6) AS score, rank FROM kept WHERE rank <= 5""",
)
def search_similar_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search in the form that query sets beyond the size bound take."""
    found = search_batch(_corpus(spark, sf_dir), _queries(spark, sf_dir), limit=5, threshold=0.1, max_query_bytes=0)
    return _rounded(found)


@query(
    "search_best",
    ALL_SQL + " SELECT query_id, id, round(score, 6) AS score FROM ranked WHERE rank = 1 AND score >= 0",
)
def search_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(search_best(_corpus(spark, sf_dir), _queries(spark, sf_dir)))


def _over_fetch_sql(condition: str) -> str:
    return (
        ALL_SQL
        + f""", hits AS (SELECT query_id, id, score FROM ranked WHERE rank <= 20 AND score >= 0.2),
    found AS (SELECT h.query_id, h.id, h.score, c.type, c.name, c.parent_id,
                     row_number() OVER (PARTITION BY h.query_id ORDER BY h.score DESC, h.id) AS rank
              FROM hits h JOIN chunk_rows c ON c.id = h.id WHERE {condition})
    SELECT query_id, id, round(score, 6) AS score, type, name, parent_id, rank FROM found WHERE rank <= 10"""
    )


CHUNK_HIT = ("query_id", "id", "score", "type", "name", "parent_id", "rank")


@query("chunk_search", _over_fetch_sql("true"))
def chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search_chunks(_corpus(spark, sf_dir), chunk_rows(spark, sf_dir), _queries(spark, sf_dir))
    return _rounded(found.select(*CHUNK_HIT))


@query("chunk_search_typed", _over_fetch_sql("c.type = 'fr'"))
def chunk_search_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search_chunks(
        _corpus(spark, sf_dir), chunk_rows(spark, sf_dir), _queries(spark, sf_dir), chunk_type="fr"
    )
    return _rounded(found.select(*CHUNK_HIT))


@query("chunk_search_parent", _over_fetch_sql("c.parent_id = 'src7'"))
def chunk_search_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search_chunks(
        _corpus(spark, sf_dir), chunk_rows(spark, sf_dir), _queries(spark, sf_dir), parent_id="src7"
    )
    return _rounded(found.select(*CHUNK_HIT))


@query(
    "chunk_search_prefilter",
    ALL_SQL
    + """, found AS (SELECT s.query_id, s.id, s.score, c.type, c.name, c.parent_id,
                     row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.id) AS rank
              FROM scored s JOIN chunk_rows c ON c.id = s.id WHERE c.type = 'fr' AND s.score >= 0.2)
    SELECT query_id, id, round(score, 6) AS score, type, name, parent_id, rank FROM found WHERE rank <= 10""",
)
def chunk_search_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search_chunks(
        _corpus(spark, sf_dir), chunk_rows(spark, sf_dir), _queries(spark, sf_dir), chunk_type="fr", prefilter=True
    )
    return _rounded(found.select(*CHUNK_HIT))


@query(
    "embed_hash",
    f"WITH {hashed_sql('documents', 'doc_id', 'text', 'h')} SELECT key AS doc_id, slot, round(w, 6) AS weight FROM h_w",
)
def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = hashed_vectors(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")
    slots = vectors.select("doc_id", F.posexplode("vector").alias("slot", "weight"))
    return slots.withColumn("weight", F.round(F.col("weight").cast("double"), 6))


def _text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = hashed_vectors(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").drop("text")
    questions = written(hashed_vectors(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text").drop("text"), "question-vectors")
    return search_batch(
        docs.withColumnRenamed("doc_id", "id"), questions.withColumnRenamed("item_id", "query_id"), threshold=0.2
    )


TEXT_SQL = f"""WITH {hashed_sql("documents", "doc_id", "text", "d")}, {hashed_sql("benchmark", "item_id", "text", "q")},
scored AS (SELECT q.key AS query_id, d.key AS id, round(list_cosine_similarity(d.vector, q.vector), 12) AS score
           FROM d JOIN q ON true),
kept AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
         FROM scored WHERE score >= 0.2)"""


@query("search_batch", TEXT_SQL + " SELECT query_id, id, round(score, 6) AS score, rank FROM kept WHERE rank <= 10")
def search_batch_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a query against every document, both embedded here."""
    return _rounded(_text_search(spark, sf_dir))


@query(
    "search_report",
    TEXT_SQL
    + r""" SELECT k.query_id, k.rank, 'docs/' || CAST(k.id AS VARCHAR) || '.md' AS id, round(k.score * 100, 1) AS percent,
        CAST(len(regexp_extract_all(d.text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS VARCHAR) AS tokens,
        'markdown' AS language, substring(d.text, 1, 500) AS shown, 1 AS start_line, length(d.text) > 500 AS truncated
    FROM kept k JOIN documents d ON d.doc_id = k.id WHERE k.rank <= 10""",
)
def search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from indexloom.functions.tokens import word_token_count

    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        F.create_map(F.lit("tokens"), word_token_count(F.col("text")).cast("string")).alias("metadata"),
    )
    found = _text_search(spark, sf_dir).join(docs, "id")
    named = found.withColumn("id", F.concat(F.lit("docs/"), F.col("id").cast("string"), F.lit(".md")))
    return report(named)


@query(
    "results_json",
    ALL_SQL
    + """, kept AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
                    FROM scored WHERE score >= 0.2)
    SELECT query_id, rank, to_json({'id': id, 'score': round(score, 6)}) AS json FROM kept WHERE rank <= 3""",
)
def results_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _rounded(search_batch(_corpus(spark, sf_dir), _queries(spark, sf_dir), limit=3))
    return hits.select("query_id", "rank", F.to_json(F.struct("id", "score")).alias("json"))
