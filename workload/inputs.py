"""The tables of the domain, made from the given ones, in Spark and in SQL.

Every derivation works row by row on whole tables: no grouping, no sampling.
"""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from indexloom.session import scratch_path, spread, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- files: one per document, some below directories that a scan prunes

FILES_SQL = """files AS (
    SELECT doc_id,
           'src/' || CASE source WHEN 'src0' THEN 'node_modules' WHEN 'src1' THEN 'build'
                                 WHEN 'src2' THEN '.web_cache' WHEN 'src3' THEN 'web_cache' ELSE source END
                  || '/' || CAST(doc_id AS VARCHAR)
                  || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.PY' WHEN 'de' THEN '.tsx' ELSE '' END AS path,
           CAST(strlen(text) AS BIGINT) AS length, text AS content, lang, source
    FROM documents)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = (
        F.when(F.col("source") == "src0", "node_modules")
        .when(F.col("source") == "src1", "build")
        .when(F.col("source") == "src2", ".web_cache")
        .when(F.col("source") == "src3", "web_cache")
        .otherwise(F.col("source"))
    )
    ext = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".PY").when(F.col("lang") == "de", ".tsx")
    path = F.concat(F.lit("src/"), folder, F.lit("/"), F.col("doc_id").cast("string"), F.coalesce(ext, F.lit("")))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        path.alias("path"),
        F.octet_length("text").cast("long").alias("length"),
        F.col("text").alias("content"),
        "lang",
        "source",
    )


def file_folder(spark: SparkSession, sf_dir: str) -> str:
    """All documents as files of a folder that executors share."""
    root = scratch_path(spark, "tree")
    rows = files(spark, sf_dir).select("path", F.encode("content", "utf-8").alias("raw"))

    def put(batches):
        system, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for path, raw in zip(batch.column(0), batch.column(1), strict=True):  # a row at a time
                system.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{base}/{path}") as out:
                    out.write(raw.as_buffer() or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    spread(rows).mapInArrow(put, "n long").agg(F.sum("n")).collect()
    return root


# --- modules: every document rendered as a Python source, sentence by sentence

MODULES_SQL = r"""modules AS (
    SELECT doc_id, 'src/' || source || '/' || CAST(doc_id AS VARCHAR) || '.py' AS path,
           array_to_string(list_transform(string_split(replace(text, '. ', '.' || chr(10)), chr(10)),
             lambda line, j: CASE (j - 1) % 8
               WHEN 0 THEN repeat('    ', length(line) % 2) || 'class Doc' || CAST(doc_id AS VARCHAR) || '_'
                           || CAST(j - 1 AS VARCHAR) || CASE WHEN length(line) % 3 = 0 THEN '(Base)' ELSE '' END || ':'
               WHEN 1 THEN '    # ' || line
               WHEN 2 THEN repeat('    ', length(line) % 3) || '@mark'
               WHEN 3 THEN repeat('    ', length(line) % 3) || 'def step_' || CAST(j - 1 AS VARCHAR)
                           || '(self, n: int = ' || CAST(length(line) AS VARCHAR) || ') -> str:'
               WHEN 4 THEN '        return "' || line || '"'
               WHEN 5 THEN ''
               WHEN 6 THEN repeat('    ', length(line) % 2) || 'async def run_' || CAST(j - 1 AS VARCHAR) || '():'
               ELSE '        pass' END), chr(10)) AS content
    FROM documents)"""


def _module_line(line: Column, j: Column) -> Column:
    size, kind = F.length(line), F.pmod(j, F.lit(8))
    number = j.cast("string")

    def pad(n: int) -> Column:
        return F.repeat(F.lit("    "), F.pmod(size, F.lit(n)))

    base = F.when(F.pmod(size, F.lit(3)) == 0, "(Base)").otherwise("")
    return (
        F.when(kind == 0, F.concat(pad(2), F.lit("class Doc"), F.col("doc_id").cast("string"), F.lit("_"), number, base, F.lit(":")))
        .when(kind == 1, F.concat(F.lit("    # "), line))
        .when(kind == 2, F.concat(pad(3), F.lit("@mark")))
        .when(kind == 3, F.concat(pad(3), F.lit("def step_"), number, F.lit("(self, n: int = "), size.cast("string"), F.lit(") -> str:")))
        .when(kind == 4, F.concat(F.lit('        return "'), line, F.lit('"')))
        .when(kind == 5, "")
        .when(kind == 6, F.concat(pad(2), F.lit("async def run_"), number, F.lit("():")))
        .otherwise("        pass")
    )


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(F.replace("text", F.lit(". "), F.lit(".\n")), "\n", -1)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.array_join(F.transform(lines, _module_line), "\n").alias("content"),
    )


# --- item modules: one small source per line item, whose chunks are known from its columns

ITEM_NAME_SQL = (
    "CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_partkey AS VARCHAR) || '_' || CAST(l_suppkey AS VARCHAR)"
    " || '_' || CAST(l_linenumber AS VARCHAR) || '_' || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)"
)


def item_name() -> Column:
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return F.concat_ws("_", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", cents)


def item_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    content = F.concat(
        F.lit("# order line\n@dataclass\n@final\nclass Order"), F.col("l_orderkey").cast("string"), F.lit("(Base):\n"),
        F.lit("    flag = '"), F.col("l_returnflag"), F.lit("'\n\n"),
        F.lit("    def part"), part, F.lit("(self, n: int) -> int:\n        return "), part, F.lit("\n\n"),
        F.lit("    class Supplier"), supp, F.lit(":\n        def ship"), F.col("l_linenumber").cast("string"),
        F.lit("(self):\n            pass\n\n\ndef top"), supp, F.lit("():\n    return 1\n"),
    )
    # dealt out while rows are a few numbers, not the sources made of them
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag"
    )
    return spread(items).select(
        F.concat(F.lit("items/"), item_name(), F.lit(".py")).alias("path"), content.alias("content")
    )


# --- nodes: region <- nation <- customer <- order <- line item as one chunk hierarchy

NODES_SQL = f"""nodes AS (
    SELECT 'r:' || CAST(r_regionkey AS VARCHAR) AS id, 'region' AS type, r_name AS name, 'geo/regions.py' AS path,
           CAST(r_regionkey + 1 AS INTEGER) AS start_line, CAST(r_regionkey + 2 AS INTEGER) AS end_line,
           CAST(NULL AS VARCHAR) AS parent_id FROM region
    UNION ALL
    SELECT 'n:' || CAST(n_nationkey AS VARCHAR), 'nation', n_name, 'geo/nations.py',
           CAST(n_nationkey + 1 AS INTEGER), CAST(n_nationkey + 5 AS INTEGER),
           'r:' || CAST(n_regionkey AS VARCHAR) FROM nation
    UNION ALL
    SELECT 'c:' || CAST(c_custkey AS VARCHAR), 'customer', c_name, 'cust/' || c_mktsegment || '.py',
           CAST(c_custkey + 1 AS INTEGER), CAST(c_custkey + 9 AS INTEGER),
           'n:' || CAST(c_nationkey AS VARCHAR) FROM customer
    UNION ALL
    SELECT 'o:' || CAST(o_orderkey AS VARCHAR), 'order', 'Order' || CAST(o_orderkey AS VARCHAR),
           'orders/' || o_orderpriority || '.py',
           CAST(o_orderkey + 1 AS INTEGER), CAST(o_orderkey + 20 AS INTEGER),
           'c:' || CAST(o_custkey AS VARCHAR) FROM orders
    UNION ALL
    SELECT 'l:' || {ITEM_NAME_SQL}, 'item', 'item' || CAST(l_partkey AS VARCHAR),
           'items/' || l_returnflag || l_linestatus || '.py',
           CAST(l_linenumber AS INTEGER), CAST(l_linenumber + 3 AS INTEGER),
           'o:' || CAST(l_orderkey AS VARCHAR) FROM lineitem)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def node(df: DataFrame, id_: Column, kind: str, name, path, line: str, span: int, parent: Column) -> DataFrame:
        return df.select(
            id_.alias("id"),
            F.lit(kind).alias("type"),
            name.alias("name"),
            path.alias("path"),
            (F.col(line).cast("int") + (0 if kind == "item" else 1)).alias("start_line"),
            (F.col(line).cast("int") + span).alias("end_line"),
            parent.alias("parent_id"),
        )

    def ref(prefix: str, key: str) -> Column:
        return F.concat(F.lit(prefix + ":"), F.col(key).cast("string"))

    def file(folder: str, *parts: str) -> Column:
        return F.concat(F.lit(folder + "/"), *parts, F.lit(".py"))

    regions, nations = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem")
    parts = [
        node(regions, ref("r", "r_regionkey"), "region", F.col("r_name"), F.lit("geo/regions.py"), "r_regionkey", 2,
             F.lit(None).cast("string")),
        node(nations, ref("n", "n_nationkey"), "nation", F.col("n_name"), F.lit("geo/nations.py"), "n_nationkey", 5,
             ref("r", "n_regionkey")),
        node(customers, ref("c", "c_custkey"), "customer", F.col("c_name"), file("cust", "c_mktsegment"), "c_custkey",
             9, ref("n", "c_nationkey")),
        node(orders, ref("o", "o_orderkey"), "order", F.concat(F.lit("Order"), F.col("o_orderkey").cast("string")),
             file("orders", "o_orderpriority"), "o_orderkey", 20, ref("c", "o_custkey")),
        node(items, F.concat(F.lit("l:"), item_name()), "item",
             F.concat(F.lit("item"), F.col("l_partkey").cast("string")),
             file("items", "l_returnflag", "l_linestatus"), "l_linenumber", 3, ref("o", "l_orderkey")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stored_nodes(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The hierarchy as a stored table, which is what operators that read it several times are given."""
    rows = nodes(spark, sf_dir)
    return written(rows.select(*columns) if columns else rows, "nodes", "zstd")


NODE_CONTENT_SQL = "type || ' ' || name || ' in ' || path"


def chunk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hierarchy with all columns of chunks, row by row from the given tables."""
    content = F.concat_ws(" ", "type", "name", F.lit("in"), "path")
    lines = (F.col("end_line") - F.col("start_line") + 1).cast("string")
    return nodes(spark, sf_dir).select(
        "*",
        F.lit(1).alias("start_col"),
        F.lit(1).alias("end_col"),
        content.alias("content"),
        F.create_map(F.lit("lines"), lines).alias("metadata"),
    )


# --- entries: the vectors with the text of the document of that number, one collection per label

ENTRIES_SQL = """entries AS (
    SELECT 'c' || CAST(label AS VARCHAR) AS collection, vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector
    FROM embeddings)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("collection"),
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("vector"),
    )


CHUNK_ROWS_SQL = """chunk_rows AS (
    SELECT doc_id AS id, lang AS type, source AS parent_id, 'doc' || CAST(doc_id AS VARCHAR) AS name,
           text AS content FROM documents)"""


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("type"),
        F.col("source").alias("parent_id"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"),
        F.col("text").alias("content"),
    )


# --- hashed vectors in SQL


def hashed_sql(source: str, key: str, text: str, name: str, dim: int = 64) -> str:
    """CTEs `<name>_w (key, slot, w)` and `<name> (key, vector)` for texts embedded by feature hashing."""
    return rf"""{name}_t AS (
        SELECT {key} AS key, unnest(regexp_split_to_array(lower({text}), '[ \t\n\r\f\v]+')) AS token FROM {source}),
    {name}_c AS (
        SELECT key, CAST(CAST(('0x' || substr(md5(token), 1, 8)) AS UBIGINT) % {dim} AS INTEGER) AS slot,
               sum(CASE WHEN token = '' THEN 0 WHEN substr(md5(token), 32, 1) < '8' THEN 1 ELSE -1 END) AS w
        FROM {name}_t GROUP BY 1, 2),
    {name}_n AS (SELECT key, sqrt(CAST(sum(w * w) AS DOUBLE)) AS norm FROM {name}_c GROUP BY 1),
    {name}_w AS (
        SELECT n.key, r.slot, CAST(CAST(coalesce(CAST(c.w AS DOUBLE) / nullif(n.norm, 0), 0) AS FLOAT) AS DOUBLE) AS w
        FROM {name}_n n JOIN (SELECT CAST(unnest(range({dim})) AS INTEGER) AS slot) r ON true
        LEFT JOIN {name}_c c ON c.key = n.key AND c.slot = r.slot),
    {name} AS (SELECT key, list(w ORDER BY slot) AS vector FROM {name}_w GROUP BY key)"""
