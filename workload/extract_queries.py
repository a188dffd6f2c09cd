"""Chunk extraction from rendered sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexloom.functions.text import indent_width, is_blank, line_count, split_lines
from indexloom.operators.extract import detect_language, extract_chunks
from workload.inputs import FILES_SQL, ITEM_NAME_SQL, MODULES_SQL, files, item_modules, modules
from workload.registry import query

# The rules of extraction written in SQL over an exploded line table: white space, words, definitions,
# the nearest earlier class with smaller indentation, and the next line that ends a block.
_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_W = r"[\p{L}\p{N}_]"
LINES_SQL = rf"""{MODULES_SQL}, texts AS (
    SELECT doc_id, path, string_split(regexp_replace(content, '\n$', ''), chr(10)) AS lines FROM modules),
numbered AS (SELECT doc_id, path, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM texts),
facts AS (
    SELECT doc_id, path, i, line,
           length(line) - length(regexp_replace(line, '^[{_WS}]+', '')) AS ind,
           regexp_replace(line, '^[{_WS}]+|[{_WS}]+$', '', 'g') AS bare,
           regexp_extract(line, 'class[{_WS}]+({_W}+)(?:[{_WS}]*\([{_WS}]*.*?[{_WS}]*\))?[{_WS}]*:', 1) AS cls,
           regexp_extract(line, 'def[{_WS}]+({_W}+)[{_WS}]*\(.*?\)[{_WS}]*(?:->.*?)?[{_WS}]*:', 1) AS fn
    FROM numbered)"""
DEFS_SQL = rf"""{LINES_SQL},
classes AS (SELECT doc_id, i, ind, path || ':class:' || cls || ':' || CAST(i AS VARCHAR) AS id FROM facts WHERE cls <> ''),
defs AS (SELECT doc_id, path, i, ind, line, 'class' AS kind, cls AS name FROM facts WHERE cls <> ''
         UNION ALL SELECT doc_id, path, i, ind, line, 'function', fn FROM facts WHERE fn <> ''),
parents AS (SELECT d.doc_id, d.i, d.kind, max_by(c.id, c.i) AS parent_id
            FROM defs d JOIN classes c ON c.doc_id = d.doc_id AND c.i < d.i AND c.ind < d.ind GROUP BY 1, 2, 3),
ends AS (SELECT d.doc_id, d.i, d.kind, min(n.i) - 1 AS e
         FROM defs d JOIN facts n ON n.doc_id = d.doc_id AND n.i > d.i AND n.ind <= d.ind AND n.bare <> ''
         GROUP BY 1, 2, 3),
chunks AS (
    SELECT d.doc_id, d.path, d.i, d.name, p.parent_id,
           CASE WHEN d.kind = 'function' AND p.parent_id IS NOT NULL THEN 'method' ELSE d.kind END AS type,
           coalesce(n.e, len(t.lines) - 1) AS e, t.lines
    FROM defs d JOIN texts t ON t.doc_id = d.doc_id
    LEFT JOIN parents p ON p.doc_id = d.doc_id AND p.i = d.i AND p.kind = d.kind
    LEFT JOIN ends n ON n.doc_id = d.doc_id AND n.i = d.i AND n.kind = d.kind)"""
CHUNK_ID_SQL = "path || ':' || type || ':' || name || ':' || CAST(i AS VARCHAR)"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_chunks(modules(spark, sf_dir))


@query(
    "chunk_extract",
    f"""WITH {DEFS_SQL} SELECT {CHUNK_ID_SQL} AS id, type, name, path, CAST(i + 1 AS INTEGER) AS start_line,
        0 AS start_col, CAST(e + 1 AS INTEGER) AS end_line, CAST(length(lines[e + 1]) AS INTEGER) AS end_col,
        parent_id, array_to_string(lines[i + 1 : e + 1], chr(10)) AS content FROM chunks""",
)
def chunk_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).drop("decorators")


@query("chunk_parents", f"WITH {DEFS_SQL} SELECT {CHUNK_ID_SQL} AS id, type, parent_id FROM chunks")
def chunk_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("id", "type", "parent_id")


@query(
    "chunk_spans",
    f"""WITH {DEFS_SQL} SELECT {CHUNK_ID_SQL} AS id, CAST(i + 1 AS INTEGER) AS start_line, CAST(e + 1 AS INTEGER) AS end_line,
        CAST(length(lines[e + 1]) AS INTEGER) AS end_col,
        md5(array_to_string(lines[i + 1 : e + 1], chr(10))) AS content FROM chunks""",
)
def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("id", "start_line", "end_line", "end_col", F.md5("content").alias("content"))


@query(
    "chunk_defs",
    f"WITH {DEFS_SQL} SELECT kind, name, count(*) AS n, count(DISTINCT doc_id) AS files FROM defs GROUP BY 1, 2",
)
def chunk_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("type") == "class", "class").otherwise("function")
    found = _chunks(spark, sf_dir).select("path", kind.alias("kind"), "name")
    per_file = found.groupBy("kind", "name", "path").agg(F.count("*").alias("n"))
    return per_file.groupBy("kind", "name").agg(F.sum("n").alias("n"), F.count("*").alias("files"))


@query(
    "chunk_decorators",
    f"""WITH {DEFS_SQL}, plain AS (
        SELECT c.doc_id, c.i, c.type, max(f.i) AS last_plain
        FROM chunks c LEFT JOIN facts f ON f.doc_id = c.doc_id AND f.i < c.i AND NOT starts_with(f.bare, '@')
        GROUP BY 1, 2, 3)
    SELECT {CHUNK_ID_SQL} AS id,
           array_to_string(list_transform(lines[coalesce(last_plain, -1) + 2 : i], lambda x: trim(x)), '|') AS decorators
    FROM chunks JOIN plain USING (doc_id, i, type)""",
)
def chunk_decorators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("id", F.array_join("decorators", "|").alias("decorators"))


@query(
    "chunk_ids",
    f"WITH {DEFS_SQL} SELECT {CHUNK_ID_SQL} AS id, path, type, name, CAST(i AS INTEGER) AS line FROM chunks",
)
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("id", "path", "type", "name", (F.col("start_line") - 1).alias("line"))


@query(
    "chunk_line_counts",
    f"WITH {DEFS_SQL} SELECT {CHUNK_ID_SQL} AS id, CAST(e - i + 1 AS INTEGER) AS lines FROM chunks",
)
def chunk_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from indexloom.functions.metadata import lines_in_chunk

    return _chunks(spark, sf_dir).select("id", lines_in_chunk().alias("lines"))


@query(
    "chunk_summary",
    f"""WITH {DEFS_SQL} SELECT {CHUNK_ID_SQL} AS id, type || ':' || name AS qualified_name,
        type || ':' || name || ' at ' || path || ':' || CAST(i + 1 AS VARCHAR) || '-' || CAST(e + 1 AS VARCHAR) AS summary
    FROM chunks""",
)
def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from indexloom.functions.metadata import qualified_name, summary

    return _chunks(spark, sf_dir).select(
        "id", qualified_name().alias("qualified_name"), summary().alias("summary")
    )


@query(
    "chunk_roundtrip",
    f"""WITH m AS (SELECT 'items/' || {ITEM_NAME_SQL} || '.py' AS path, * FROM lineitem),
    o AS (SELECT *, path || ':class:Order' || CAST(l_orderkey AS VARCHAR) || ':3' AS top_id,
                 path || ':class:Supplier' || CAST(l_suppkey AS VARCHAR) || ':9' AS sub_id FROM m)
    SELECT path, top_id AS id, 'class' AS type, CAST(NULL AS VARCHAR) AS parent_id, 4 AS start_line, 14 AS end_line,
           '@dataclass|@final' AS decorators FROM o
    UNION ALL SELECT path, path || ':method:part' || CAST(l_partkey AS VARCHAR) || ':6', 'method', top_id, 7, 9, '' FROM o
    UNION ALL SELECT path, sub_id, 'class', top_id, 10, 14, '' FROM o
    UNION ALL SELECT path, path || ':method:ship' || CAST(l_linenumber AS VARCHAR) || ':10', 'method', sub_id, 11, 14, ''
              FROM o
    UNION ALL SELECT path, path || ':function:top' || CAST(l_suppkey AS VARCHAR) || ':14', 'function', NULL, 15, 16, ''
              FROM o""",
)
def chunk_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source per line item; the chunks must be what the columns say, with no parser on the other side."""
    found = extract_chunks(item_modules(spark, sf_dir))
    return found.select(
        "path", "id", "type", "parent_id", "start_line", "end_line", F.array_join("decorators", "|").alias("decorators")
    )


@query(
    "line_count",
    f"WITH {LINES_SQL} SELECT path, CAST(count(*) AS INTEGER) AS lines FROM facts GROUP BY path",
)
def lines_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules(spark, sf_dir).select("path", line_count(F.col("content")).alias("lines"))


@query(
    "line_indent",
    f"""WITH {LINES_SQL} SELECT path, CAST(i AS INTEGER) AS i, CAST(ind AS INTEGER) AS indent, bare = '' AS blank
    FROM facts""",
)
def line_indent(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = modules(spark, sf_dir).select("path", F.posexplode(split_lines(F.col("content"))).alias("i", "line"))
    return lines.select(
        "path", "i", indent_width(F.col("line")).alias("indent"), is_blank(F.col("line")).alias("blank")
    )


@query(
    "language_detect",
    f"""WITH {FILES_SQL} SELECT path, CASE WHEN lower(path) LIKE '%.py' THEN 'python' END AS language FROM files""",
)
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_language(files(spark, sf_dir)).select("path", "language")
