"""Upserts and the stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexloom.errors import CollectionExists
from indexloom.operators.embed import get_model
from indexloom.operators.filters import by_collection
from indexloom.operators.search import search
from indexloom.operators.upsert import upsert
from indexloom.plans.ask import query_chunks, query_files
from indexloom.plans.build import add_chunks, index_chunks, index_files
from indexloom.session import scratch_path, written
from indexloom.sources.files import read_files, scan_files
from indexloom.sources.store import IndexStore
from workload.extract_queries import CHUNK_ID_SQL, DEFS_SQL
from workload.inputs import ENTRIES_SQL, FILES_SQL, entries, file_folder, hashed_sql, modules, table
from workload.registry import query

_ITEM_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]


@query(
    "chunk_upsert",
    """WITH existing AS (SELECT 'o:' || CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS type, o_orderpriority AS name FROM orders),
    fresh AS (SELECT id, type, name FROM (
        SELECT 'o:' || CAST(l_orderkey AS VARCHAR) AS id, l_returnflag AS type, CAST(l_partkey AS VARCHAR) AS name,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC,
                                  l_linenumber DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1)
    SELECT * FROM fresh UNION ALL SELECT * FROM existing WHERE id NOT IN (SELECT id FROM fresh)""",
)
def chunk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as stored chunks, all line items as newer versions of them, many per id."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    existing = orders.select(
        F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"),
        F.col("o_orderstatus").alias("type"),
        F.col("o_orderpriority").alias("name"),
    )
    new = items.select(
        F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("id"),
        F.col("l_returnflag").alias("type"),
        F.col("l_partkey").cast("string").alias("name"),
        *_ITEM_ORDER,
    )
    return upsert(existing, new, ["id"], _ITEM_ORDER)


@query(
    "embed_upsert",
    """WITH existing AS (SELECT source AS collection, doc_id AS id, text AS content FROM documents),
    fresh AS (SELECT coalesce(d.source, 'talks') AS collection, c.conv_id AS id, max_by(c.text, c.turn) AS content
              FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id GROUP BY 1, 2)
    SELECT collection, id, md5(content) AS content FROM fresh
    UNION ALL SELECT e.collection, e.id, md5(e.content) FROM existing e ANTI JOIN fresh f USING (collection, id)""",
)
def embed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored entries, all conversation turns as newer contents, the last turn counting; conversations of
    numbers that no document has are new entries of a collection of their own."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("collection"), F.col("doc_id").alias("id"), F.col("text").alias("content")
    )
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn", F.col("text").alias("content"))
    placed = turns.join(docs.select("collection", "id"), "id", "left")
    new = placed.withColumn("collection", F.coalesce("collection", F.lit("talks")))
    merged = upsert(docs, new, ["collection", "id"], ["turn"])
    return merged.select("collection", "id", F.md5("content").alias("content"))


@query(
    "store_upsert",
    """WITH orders_ AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS content FROM orders),
    items AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, max_by(l_returnflag || ' ' || CAST(l_partkey AS VARCHAR),
                     {'a': l_shipdate, 'b': l_partkey, 'c': l_suppkey, 'd': l_linenumber, 'e': l_extendedprice}) AS content
              FROM lineitem GROUP BY 1),
    events_ AS (SELECT 'e' || CAST(event_id AS VARCHAR) AS id, event_type AS content FROM events),
    before AS (SELECT * FROM items UNION ALL SELECT * FROM orders_ ANTI JOIN items USING (id) UNION ALL SELECT * FROM events_)
    SELECT 'merged' AS state, id, content FROM before WHERE id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)
    UNION ALL SELECT 'compacted', id, content FROM before WHERE id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)""",
)
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored collection of orders, then all line items and all events upserted and the ids of customers removed, read
    before and after compaction. Most line items replace, events insert."""
    store, name = IndexStore(spark, scratch_path(spark, "store")), "orders"
    vector, none = F.array(F.lit(1.0).cast("float")), F.lit(None).cast("map<string,string>")

    def rows(df: DataFrame, id_, content, *more: str) -> DataFrame:
        return df.select(id_.cast("string").alias("id"), vector.alias("vector"), content.alias("content"), none.alias("metadata"), *more)

    shown = F.concat_ws(" ", "l_returnflag", F.col("l_partkey").cast("string"))
    store.build(name, "none", 1, rows(table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_orderpriority")))
    store.upsert_embeddings(name, rows(table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), shown, *_ITEM_ORDER), order=_ITEM_ORDER)
    events = rows(table(spark, sf_dir, "events"), F.concat(F.lit("e"), F.col("event_id").cast("string")), F.col("event_type"))
    gone = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    store.upsert_embeddings(name, events, gone=gone)
    merged = store.embeddings(name).select(F.lit("merged").alias("state"), "id", "content")
    store.compact(name)
    return merged.unionByName(store.embeddings(name).select(F.lit("compacted").alias("state"), "id", "content"))


@query(
    "store_search_typed",
    """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS vector FROM embeddings WHERE vec_id = 0),
    s AS (SELECT e.vec_id AS id, d.lang AS type, d.source AS parent_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.vector), 12) AS score
          FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id JOIN q ON true WHERE d.lang = 'fr')
    SELECT CAST(id AS VARCHAR) AS id, type, parent_id, round(score, 6) AS score FROM s WHERE score >= 0.1 ORDER BY s.score DESC, CAST(id AS VARCHAR) LIMIT 20""",
)
def store_search_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of a stored index that is restricted to one type before it ranks: the scan skips the others."""
    store, name = IndexStore(spark, scratch_path(spark, "store")), "vectors"
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("lang").alias("type"), F.col("source").alias("parent_id"))
    vectors = table(spark, sf_dir, "embeddings").join(docs, "vec_id")
    no = F.lit(None)
    store.build(
        name, "given", 64, vectors.select(
            F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), no.cast("string").alias("content"),
            no.cast("map<string,string>").alias("metadata"), "type", "parent_id",
        ),
    )
    query_vector = table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]
    own = store.embeddings(name).filter(F.col("type") == "fr")
    hits = search(own, query_vector, limit=20, threshold=0.1)
    named = hits.join(own.select("id", "type", "parent_id"), "id")
    return named.select("id", "type", "parent_id", F.round("score", 6).alias("score"))


@query("collection_scan", f"WITH {ENTRIES_SQL} SELECT collection, id FROM entries WHERE collection = 'c3'")
def collection_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_collection(entries(spark, sf_dir), "c3").select("collection", "id")


@query(
    "collection_model",
    """SELECT 'files' AS collection, 'hash-64' AS model, count(*) AS entries FROM documents
    UNION ALL SELECT 'turns', 'hash-64', count(*) FROM conversations""",
)
def collection_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two collections written to a store and read back through its catalog."""
    store, model = IndexStore(spark, scratch_path(spark, "store")), get_model("hash-64")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("path"), F.col("text").alias("content")
    )
    index_files(store, docs, model, "files")
    index_files(store, turns, model, "turns")
    return store.info().select("collection", "model", "entries")


@query(
    "collection_modes",
    """SELECT 'first' AS step, 'files' AS collection, (SELECT count(*) FROM documents) AS entries
    UNION ALL SELECT 'again', 'refused', (SELECT count(*) FROM documents)
    UNION ALL SELECT 'forced', 'turns', (SELECT count(*) FROM conversations)""",
)
def collection_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create, refuse to create again, and recreate by force, which drops every other collection."""
    store, model = IndexStore(spark, scratch_path(spark, "store")), get_model("hash-64")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("path"), F.col("text").alias("content")
    )

    def state(step: str, name: str | None = None) -> DataFrame:
        # a count is one number, and the next step may replace the files it was taken from
        rows = [(step, name or r["collection"], r["entries"]) for r in store.info().collect()]
        return spark.createDataFrame(rows, "step string, collection string, entries long")

    index_files(store, docs, model, "files")
    first = state("first")
    try:
        index_files(store, turns, model, "files")
        outcome = "replaced"
    except CollectionExists:
        outcome = "refused"
    again = state("again", outcome)
    index_files(store, turns, model, "turns", force=True)
    return first.unionByName(again).unionByName(state("forced"))


@query(
    "index_reingest",
    f"""WITH {DEFS_SQL}, moved AS (SELECT path, type, name, i + 1 AS i, e + 1 AS e, lines FROM chunks),
    c AS (SELECT {CHUNK_ID_SQL} AS id, path, CAST(i + 1 AS INTEGER) AS start_line, CAST(e + 1 AS INTEGER) AS end_line,
                 md5(array_to_string(lines[i : e], chr(10))) AS content FROM moved)
    SELECT 'chunks' AS stored_in, * FROM c
    UNION ALL SELECT 'embeddings', id, NULL, NULL, NULL, content FROM c""",
)
def index_reingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source indexed, then ingested again in two versions, the later one with all its lines moved down by one."""
    store, model = IndexStore(spark, scratch_path(spark, "store")), get_model("hash-64")
    sources = written(modules(spark, sf_dir).select("path", "content"), "sources")  # read three times
    index_chunks(store, sources, model)
    edited = sources.select("path", F.concat(F.lit("# edited\n"), "content").alias("content"), F.lit(2).alias("version"))
    add_chunks(store, edited.unionByName(sources.withColumn("version", F.lit(1))), model, "chunks", order=["version"])
    digest = F.md5("content").alias("content")
    chunks = store.chunks("chunks").select(F.lit("chunks").alias("stored_in"), "id", "path", "start_line", "end_line", digest)
    entries = store.embeddings("chunks").select(F.lit("embeddings").alias("stored_in"), "id", digest)
    return chunks.unionByName(entries, allowMissingColumns=True)


@query(
    "end_to_end",
    f"""WITH {DEFS_SQL}, cc AS (SELECT {CHUNK_ID_SQL} AS id, type, parent_id,
                                   array_to_string(lines[i + 1 : e + 1], chr(10)) AS content FROM chunks),
    {hashed_sql("cc", "id", "content", "h")}, {hashed_sql("benchmark", "item_id", "text", "q")},
    scored AS (SELECT q.key AS query_id, h.key AS id, round(list_cosine_similarity(h.vector, q.vector), 12) AS score
               FROM h JOIN q ON true  -- a text whose token signs cancel has no direction and cannot be found
               WHERE list_dot_product(h.vector, h.vector) > 0 AND list_dot_product(q.vector, q.vector) > 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored),
    found AS (SELECT r.query_id, r.id, r.score, cc.type, cc.parent_id,
                     row_number() OVER (PARTITION BY r.query_id ORDER BY r.score DESC, r.id) AS rank
              FROM ranked r JOIN cc ON cc.id = r.id WHERE r.rank <= 20 AND r.score >= 0.2 AND cc.type = 'method')
    SELECT query_id, rank, id, round(score, 6) AS score, type, parent_id FROM found WHERE rank <= 10""",
)
def end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources to chunks to vectors to a stored index, then every benchmark text asked of it."""
    store, model = IndexStore(spark, scratch_path(spark, "store")), get_model("hash-64")
    index_chunks(store, modules(spark, sf_dir).select("path", "content"), model)
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = query_chunks(store, questions, model, "chunks", chunk_type="method")
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"), "type", "parent_id")


@query(
    "folder_to_answers",
    f"""WITH {FILES_SQL}, kept AS (SELECT path, content FROM files WHERE length <= 16384 AND content <> ''
        AND NOT (path LIKE '%/node_modules/%' OR path LIKE '%/build/%' OR path LIKE '%/.web_cache/%')),
    {hashed_sql("kept", "path", "content", "h")}, {hashed_sql("benchmark", "item_id", "text", "q")},
    scored AS (SELECT q.key AS query_id, h.key AS id, round(list_cosine_similarity(h.vector, q.vector), 12) AS score
               FROM h JOIN q ON true
               WHERE list_dot_product(h.vector, h.vector) > 0 AND list_dot_product(q.vector, q.vector) > 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored WHERE score >= 0.2)
    SELECT query_id, rank, id, round(score, 6) AS score, md5(k.content) AS content, '.' || k.path AS shown_path
    FROM ranked JOIN kept k ON k.path = ranked.id WHERE rank <= 5""",
)
def folder_to_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files walked, read, embedded and stored, and every benchmark text asked of the index."""
    root = file_folder(spark, sf_dir)
    files = read_files(scan_files(spark, root, max_kb=16), root)
    store, model = IndexStore(spark, scratch_path(spark, "store")), get_model("hash-64")
    index_files(store, files, model)
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = query_files(store, questions, model, "files", limit=5)
    path = F.concat(F.lit("."), F.col("metadata")["path"])
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"), F.md5("content").alias("content"), path.alias("shown_path"))


@query(
    "store_global_ids",
    """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, text AS content FROM documents),
    t AS (SELECT CAST(conv_id AS VARCHAR) AS id, max_by(text, turn) AS content FROM conversations GROUP BY 1)
    SELECT 'docs' AS collection, id, md5(content) AS content FROM d WHERE id NOT IN (SELECT id FROM t)
    UNION ALL SELECT 'talks', id, md5(content) FROM t""",
)
def store_global_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two collections whose ids are global: storing an id in the second one takes it out of the first."""
    store = IndexStore(spark, scratch_path(spark, "store"))

    def rows(df: DataFrame, key: str, *more: str) -> DataFrame:
        vector, none = F.array(F.lit(1.0).cast("float")), F.lit(None).cast("map<string,string>")
        return df.select(F.col(key).cast("string").alias("id"), vector.alias("vector"), F.col("text").alias("content"), none.alias("metadata"), *more)

    store.build("docs", "none", 1, rows(table(spark, sf_dir, "documents"), "doc_id"))
    store.create("talks", "none", 1)
    store.upsert("talks", rows(table(spark, sf_dir, "conversations"), "conv_id", "turn"), order=["turn"], global_ids=True)
    return store.embeddings().select("collection", "id", F.md5("content").alias("content"))
