"""Which files belong to a corpus, and how they fare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexloom.functions.text import relative_path
from indexloom.operators.scan import select_files
from indexloom.operators.stats import corpus_size, entries_per_collection, status_counts
from indexloom.plans.build import file_status, not_blank, not_empty
from indexloom.session import written
from indexloom.sources.files import read_files, scan_files
from indexloom.sources.tree import register
from workload.inputs import FILES_SQL, file_folder, files, table
from workload.registry import query

_PRUNED_SQL = "(path LIKE '%/node_modules/%' OR path LIKE '%/build/%' OR path LIKE '%/.web_cache/%')"


@query("scan_prune", f"WITH {FILES_SQL} SELECT path, length FROM files WHERE NOT {_PRUNED_SQL}")
def scan_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = files(spark, sf_dir).withColumn("path", F.concat(F.lit("/data/project/"), "path"))
    below = listing.withColumn("path", relative_path(F.col("path"), "/data/project/"))
    return select_files(below, max_kb=None).select("path", "length")


@query(
    "scan_include",
    f"WITH {FILES_SQL} SELECT path FROM files WHERE NOT {_PRUNED_SQL} OR path LIKE '%.tsx'",
)
def scan_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_files(files(spark, sf_dir), include="*.tsx", max_kb=None).select("path")


@query(
    "scan_exclude",
    f"WITH {FILES_SQL} SELECT path FROM files WHERE NOT {_PRUNED_SQL} AND NOT regexp_matches(path, '/1[0-9]*\\.py$')",
)
def scan_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_files(files(spark, sf_dir), exclude="1*.py", max_kb=None).select("path")


@query(
    "scan_manifest_semi",
    f"""WITH {FILES_SQL} SELECT path FROM files
    WHERE doc_id IN (SELECT doc_id FROM labels) OR lang = 'en' OR path LIKE '%.tsx'""",
)
def scan_manifest_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping lists (labelled documents, English documents) as tracked and untracked files."""
    everything = files(spark, sf_dir)
    tracked = everything.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("path")
    untracked = everything.filter(F.col("lang") == "en").select("path")
    listed = tracked.unionByName(untracked)
    return select_files(everything, listed=listed, include="*.tsx", max_kb=None).select("path")


@query(
    "tree_walk",
    f"""WITH {FILES_SQL} SELECT path, length, md5(content) AS content FROM files
    WHERE (NOT {_PRUNED_SQL} OR path LIKE '%.tsx') AND length <= 8192""",
)
def tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written folder walked, chosen from by name and size, and read."""
    root = file_folder(spark, sf_dir)
    chosen = written(scan_files(spark, root, include="*.tsx", max_kb=8), "chosen")
    return read_files(chosen, root).select("path", "length", F.md5("content").alias("content"))


@query(
    "tree_source",
    f"""WITH {FILES_SQL} SELECT path, length, md5(content) AS content FROM files
    WHERE NOT {_PRUNED_SQL} AND path LIKE 'src/src1%' AND length > 300 AND path NOT LIKE '%7.py'""",
)
def tree_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same kind of folder as a data source, which takes over the filters on path and length."""
    register(spark)
    tree = spark.read.format("file_tree").load(file_folder(spark, sf_dir))
    found = tree.filter(F.col("path").startswith("src/src1") & (F.col("length") > 300) & ~F.col("path").endswith("7.py"))
    return found.select("path", "length", F.md5("raw").alias("content"))


@query("scan_size_filter", f"WITH {FILES_SQL} SELECT path, length FROM files WHERE length <= 4096 AND NOT {_PRUNED_SQL}")
def scan_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_files(files(spark, sf_dir), max_kb=4).select("path", "length")


@query(
    "scan_text_extension",
    f"WITH {FILES_SQL} SELECT path FROM files WHERE regexp_matches(lower(path), '\\.(py|tsx)$') AND NOT {_PRUNED_SQL}",
)
def scan_text_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_files(files(spark, sf_dir), max_kb=None, text_check="extension").select("path")


# every second line of a document blanked out by its language, so that some contents are empty or blank
_BLANKED_SQL = """blanked AS (
    SELECT doc_id, CASE WHEN l.toxic = 1 THEN '' WHEN l.quality = 0 THEN repeat(' ', 3) || chr(10)
                        WHEN l.doc_id IS NULL AND lang = 'es' THEN NULL ELSE text END AS content
    FROM documents LEFT JOIN labels l USING (doc_id))"""


def _blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    unreadable = F.col("labelled").isNull() & (F.col("lang") == "es")
    content = (
        F.when(F.col("toxic") == 1, "")
        .when(F.col("quality") == 0, "   \n")
        .when(unreadable, F.lit(None))
        .otherwise(F.col("text"))
    )
    return docs.select("doc_id", content.alias("content"))


@query(
    "skip_empty",
    f"""WITH {_BLANKED_SQL} SELECT 'file' AS rule, doc_id FROM blanked WHERE content <> ''
    UNION ALL SELECT 'chunk', doc_id FROM blanked WHERE regexp_matches(content, '[^ \n\t\r]')""",
)
def skip_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blanked(spark, sf_dir)
    kept_files = not_empty(rows).select(F.lit("file").alias("rule"), "doc_id")
    return kept_files.unionByName(not_blank(rows).select(F.lit("chunk").alias("rule"), "doc_id"))


@query(
    "ingest_status",
    f"""WITH {_BLANKED_SQL} SELECT CASE WHEN content IS NULL THEN 'error' WHEN content = '' THEN 'empty' ELSE 'ok' END
        AS status, count(*) AS files FROM blanked GROUP BY 1""",
)
def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_counts(file_status(_blanked(spark, sf_dir)))


@query(
    "collection_counts",
    "SELECT 'c' || CAST(label AS VARCHAR) AS collection, count(*) AS entries FROM embeddings GROUP BY 1",
)
def collection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from workload.inputs import entries

    return entries_per_collection(entries(spark, sf_dir))


_SIZE_SQL = "CASE WHEN bytes >= 1073741824 THEN CAST(round(bytes / 1073741824.0::DOUBLE, 2) AS VARCHAR) || ' GB'"
_SIZE_SQL += " WHEN bytes >= 1048576 THEN CAST(round(bytes / 1048576.0::DOUBLE, 2) AS VARCHAR) || ' MB'"
_SIZE_SQL += " WHEN bytes >= 1024 THEN CAST(round(bytes / 1024.0::DOUBLE, 2) AS VARCHAR) || ' KB'"
_SIZE_SQL += " ELSE CAST(CAST(bytes AS DOUBLE) AS VARCHAR) || ' B' END"


@query(
    "corpus_size",
    f"""WITH {FILES_SQL}, t AS (
        SELECT source AS collection, count(*) AS entries, CAST(sum(length) AS BIGINT) AS bytes FROM files GROUP BY 1
        UNION ALL SELECT 'page ' || CAST(page_id AS VARCHAR), 1, strlen(html) FROM pages)
    SELECT collection, entries, bytes, {_SIZE_SQL} AS size FROM t""",
)
def size_per_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = files(spark, sf_dir).select(F.col("source").alias("collection"), "content")
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("collection"), F.col("html").alias("content")
    )
    return corpus_size(docs.unionByName(pages), F.octet_length("content"))
