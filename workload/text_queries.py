"""Text, label and metadata functions over the texts of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexloom.functions import metadata, text
from indexloom.functions.labels import LANGUAGE_NAMES, language_label
from indexloom.functions.tokens import word_token_count
from indexloom.operators.stats import token_totals
from indexloom.plans.ask import with_fallback_content
from workload.inputs import FILES_SQL, files, table
from workload.registry import query

_TURN = "CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("/", "conv_id", "turn").alias("id"), "role", "text"
    )


@query(
    "text_normalise",
    f"""SELECT {_TURN} AS id, role,
        CASE role WHEN 'user' THEN text ELSE replace(text, ' ', chr(10)) END AS text FROM conversations""",
)
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with foreign line ends and broken bytes put in, read back as they should be."""
    raw = (
        F.when(F.col("role") == "user", F.col("text"))
        .when(F.col("role") == "system", F.replace("text", F.lit(" "), F.lit("\r")))
        .otherwise(F.replace("text", F.lit(" "), F.lit("\r\n")))
    )
    damaged = F.concat(F.unhex(F.lit("FFE282")), raw.cast("binary"), F.unhex(F.lit("C080")))
    fixed = text.normalise_newlines(text.decode_utf8_lossy(damaged))
    return _turns(spark, sf_dir).select("id", "role", fixed.alias("text"))


@query(
    "context_window",
    """WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
    w AS (SELECT *, len(lines) // 2 AS m, len(lines) AS n FROM d)
    SELECT doc_id,
        CASE WHEN n > 6 THEN array_to_string(lines[greatest(0, m - 3) + 1 : least(n, m + 3)], chr(10)) ELSE text END AS content,
        CAST(CASE WHEN n > 6 THEN greatest(0, m - 3) + 1 ELSE 1 END AS INTEGER) AS start_line FROM w""",
)
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.context_window(F.col("text"), 3).alias("w")).select("doc_id", "w.*")


@query(
    "snippet",
    "SELECT page_id, substring(html, 1, 500) AS snippet, length(html) > 500 AS truncated FROM pages",
)
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", text.snippet(F.col("html")).alias("s")).select("page_id", "s.*")


@query(
    "file_preview",
    """WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents)
    SELECT doc_id, CASE WHEN len(lines) > 20 THEN array_to_string(lines[1:20], chr(10)) || chr(10) || '... ('
                        || CAST(len(lines) - 20 AS VARCHAR) || ' more lines)' ELSE text END AS preview FROM d""",
)
def file_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.file_preview(F.col("text")).alias("preview"))


_NAMES_SQL = " ".join(f"WHEN '{ext}' THEN '{name}'" for ext, name in LANGUAGE_NAMES.items())


@query(
    "language_label",
    f"""WITH {FILES_SQL} SELECT path,
        CASE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) {_NAMES_SQL} ELSE 'text' END AS label FROM files""",
)
def label_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", language_label(F.col("path")).alias("label"))


_TOKENS_SQL = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))"


@query(
    "token_totals",
    f"""SELECT source AS collection, CAST(sum({_TOKENS_SQL}) AS BIGINT) AS tokens,
        CAST(max({_TOKENS_SQL}) AS BIGINT) AS max_tokens FROM documents GROUP BY source""",
)
def tokens_per_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("collection"), "text")
    return token_totals(docs, word_token_count(F.col("text")))


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks with metadata; the parent is missing for one language."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("type"),
        F.concat(F.lit("doc"), "doc_id").alias("name"),
        F.concat(F.lit("src/"), "source").alias("path"),
        F.lit(1).alias("start_line"),
        F.size(F.split("text", "\n", -1)).alias("end_line"),
        F.when(F.col("lang") != "de", F.col("source")).alias("parent_id"),
        F.col("n_chars"),
    )
    full = docs.withColumn("metadata", metadata.chunk_metadata(F.col("n_chars")))
    return full.withColumn("metadata", F.map_filter("metadata", lambda k, _: k != "timestamp"))


_DESCRIBED_SQL = """described AS (
    SELECT CAST(doc_id AS VARCHAR) AS id, lang AS type, 'doc' || CAST(doc_id AS VARCHAR) AS name, 'src/' || source AS path,
           CAST(len(string_split(text, chr(10))) AS VARCHAR) AS end_line, CAST(n_chars AS VARCHAR) AS tokens,
           CASE WHEN lang <> 'de' THEN source END AS parent_id FROM documents)"""


@query(
    "metadata_rows",
    f"""WITH {_DESCRIBED_SQL}
    SELECT id, 'tokens' AS key, tokens AS value FROM described UNION ALL SELECT id, 'type', type FROM described
    UNION ALL SELECT id, 'name', name FROM described UNION ALL SELECT id, 'path', path FROM described
    UNION ALL SELECT id, 'start_line', '1' FROM described UNION ALL SELECT id, 'end_line', end_line FROM described
    UNION ALL SELECT id, 'parent_id', parent_id FROM described WHERE parent_id IS NOT NULL""",
)
def metadata_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.rows(_described(spark, sf_dir))


@query(
    "metadata_roundtrip",
    f"""WITH {_DESCRIBED_SQL} SELECT id, tokens, name, end_line, parent_id,
        CAST(CASE WHEN parent_id IS NULL THEN 6 ELSE 7 END AS INTEGER) AS entries FROM described""",
)
def metadata_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata through its stored JSON form and back."""
    stored = _described(spark, sf_dir).select("id", metadata.encode(F.col("metadata")).alias("json"))
    back = stored.select("id", metadata.decode(F.col("json")).alias("m"))
    keys = ("tokens", "name", "end_line", "parent_id")
    picked = [F.try_element_at("m", F.lit(k)).alias(k) for k in keys]
    return back.select("id", *picked, F.size("m").alias("entries"))


@query(
    "chunk_json",
    f"""WITH {_DESCRIBED_SQL} SELECT id, '{{"id":"' || id || '","type":"' || type || '","name":"' || name || '"'
        || coalesce(',"parent_id":"' || parent_id || '"', '') || '}}' AS json,
        parent_id, 0 AS metadata_entries FROM described""",
)
def chunk_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk as JSON, without its empty metadata or a missing parent, and read back."""
    empty = F.create_map().cast("map<string,string>")
    chunks = _described(spark, sf_dir).withColumn("metadata", empty).select("id", "type", "name", "parent_id", "metadata")
    written = chunks.select("id", metadata.chunk_json("id", "type", "name", "parent_id", "metadata").alias("json"))
    back = written.withColumn("c", metadata.chunk_from_json(F.col("json"), chunks.schema))
    return back.select("id", "json", F.col("c.parent_id"), F.size("c.metadata").alias("metadata_entries"))


@query(
    "content_fallback",
    """SELECT d.doc_id AS id, md5(CASE WHEN l.doc_id IS NULL THEN d.text ELSE 'stored ' || CAST(d.doc_id AS VARCHAR) END)
        AS content FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def content_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents have stored content; for the others the file's own is used."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(True).alias("labelled"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    stored = F.when(F.col("labelled"), F.concat(F.lit("stored "), F.col("id").cast("string")))
    results = docs.select("id").join(labels, "id", "left").withColumn("content", stored).drop("labelled")
    found = with_fallback_content(results, docs.select(F.col("id").alias("path"), F.col("text").alias("content")))
    return found.select("id", F.md5("content").alias("content"))
