"""Reports over a chunk hierarchy: region, nation, customer, order, line item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexloom.operators import filters, hierarchy, stats
from indexloom.plans import ask
from indexloom.session import scratch_path
from indexloom.sources.store import IndexStore
from workload.inputs import ITEM_NAME_SQL, NODE_CONTENT_SQL, NODES_SQL, chunk_nodes, nodes, stored_nodes
from workload.registry import query

_COLUMNS = "id, type, name, path, start_line, end_line, parent_id"


def _filter_sql(condition: str) -> str:
    return f"WITH {NODES_SQL} SELECT {_COLUMNS} FROM nodes WHERE {condition}"


@query("chunks_by_type", _filter_sql("type = 'order'"))
def chunks_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_type(nodes(spark, sf_dir), "order")


@query("chunks_by_parent", _filter_sql("parent_id = 'n:7'"))
def chunks_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_parent(nodes(spark, sf_dir), "n:7")


@query("chunks_path_like", _filter_sql("path ILIKE '%items/r_.PY%'"))
def chunks_path_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.path_like(nodes(spark, sf_dir), "items/r_.PY")


@query("chunks_by_path", _filter_sql("path = 'cust/BUILDING.py'"))
def chunks_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_path(nodes(spark, sf_dir), "cust/BUILDING.py")


@query("chunks_name_regex", _filter_sql("regexp_matches(name, '(?i)^order[0-9]*7$|r#0*12')"))
def chunks_name_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.name_matches(nodes(spark, sf_dir), "^order[0-9]*7$|r#0*12")


@query("chunk_list", _filter_sql("path ILIKE '%cust%' AND type = 'customer'"))
def chunk_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.list_chunks(nodes(spark, sf_dir), "CUST", "customer")


@query("chunk_by_id", _filter_sql("id = 'o:77'"))
def chunk_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.by_id(nodes(spark, sf_dir), "o:77")


@query("chunk_count", f"WITH {NODES_SQL} SELECT count(*) AS chunks FROM nodes")
def chunk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.chunk_count(nodes(spark, sf_dir))


@query("chunks_per_type", f"WITH {NODES_SQL} SELECT type, count(*) AS chunks FROM nodes GROUP BY type")
def chunks_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.chunks_per_type(nodes(spark, sf_dir))


@query(
    "top_files",
    f"WITH {NODES_SQL} SELECT path, count(*) AS chunks FROM nodes GROUP BY path ORDER BY chunks DESC, path LIMIT 10",
)
def top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_files(nodes(spark, sf_dir))


@query(
    "hierarchy_counts",
    f"""WITH {NODES_SQL} SELECT count(*) FILTER (WHERE parent_id IS NULL) AS top_level,
        count(*) FILTER (WHERE parent_id IS NOT NULL) AS nested FROM nodes""",
)
def hierarchy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hierarchy_counts(nodes(spark, sf_dir))


_DEPTHS_SQL = f"""WITH RECURSIVE {NODES_SQL}, d AS (
    SELECT id, 0 AS depth FROM nodes WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM nodes)
    UNION ALL SELECT n.id, d.depth + 1 FROM nodes n JOIN d ON n.parent_id = d.id)"""


@query("depth_histogram", _DEPTHS_SQL + " SELECT depth, count(*) AS nodes FROM d GROUP BY depth")
def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.depth_histogram(stored_nodes(spark, sf_dir, "id", "parent_id"))


@query("node_depths", _DEPTHS_SQL + " SELECT id, depth FROM d")
def node_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.node_depths(stored_nodes(spark, sf_dir, "id", "parent_id"))


# the same hierarchy without its nations: customers lose their parents
_CUT_SQL = NODES_SQL + ", cut AS (SELECT * FROM nodes WHERE type <> 'nation')"


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_nodes(spark, sf_dir).filter(F.col("type") != "nation")


# said on the keys of the tables, which the engine joins faster than the ids made of them
@query(
    "chunk_orphans",
    f"""SELECT 'c:' || CAST(c_custkey AS VARCHAR) AS id, 'n:' || CAST(c_nationkey AS VARCHAR) AS parent_id FROM customer
    UNION ALL SELECT 'o:' || CAST(o_orderkey AS VARCHAR), 'c:' || CAST(o_custkey AS VARCHAR)
              FROM orders ANTI JOIN customer ON c_custkey = o_custkey
    UNION ALL SELECT 'l:' || {ITEM_NAME_SQL}, 'o:' || CAST(l_orderkey AS VARCHAR)
              FROM lineitem ANTI JOIN orders ON o_orderkey = l_orderkey""",
)
def chunk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.orphans(_cut(spark, sf_dir)).select("id", "parent_id")


@query(
    "depth_histogram_orphans",
    f"""WITH RECURSIVE {_CUT_SQL}, d AS (
        SELECT id, 0 AS depth FROM cut WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM cut)
        UNION ALL SELECT n.id, d.depth + 1 FROM cut n JOIN d ON n.parent_id = d.id)
    SELECT depth, count(*) AS nodes FROM d GROUP BY depth""",
)
def depth_histogram_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.depth_histogram(_cut(spark, sf_dir))


@query(
    "chunk_children",
    f"""SELECT 'n:' || CAST(n_nationkey AS VARCHAR) AS id, 'nation' AS type, 'r:' || CAST(n_regionkey AS VARCHAR) AS parent_id,
           'region' AS parent_type, r_name AS parent_name FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT 'c:' || CAST(c_custkey AS VARCHAR), 'customer', 'n:' || CAST(c_nationkey AS VARCHAR), 'nation', n_name
              FROM customer JOIN nation ON n_nationkey = c_nationkey
    UNION ALL SELECT 'o:' || CAST(o_orderkey AS VARCHAR), 'order', 'c:' || CAST(o_custkey AS VARCHAR), 'customer', c_name
              FROM orders JOIN customer ON c_custkey = o_custkey
    UNION ALL SELECT 'l:' || {ITEM_NAME_SQL}, 'item', 'o:' || CAST(l_orderkey AS VARCHAR), 'order', 'Order' || CAST(o_orderkey AS VARCHAR)
              FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def chunk_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = hierarchy.parent_child_pairs(stored_nodes(spark, sf_dir))
    return pairs.select("id", "type", "parent_id", "parent_type", "parent_name")


@query(
    "children_lists",
    f"""WITH {NODES_SQL} SELECT parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY id) AS position, id FROM nodes""",
)
def children_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.children_lists(stored_nodes(spark, sf_dir, "id", "parent_id"))


_ANCESTORS_SQL = f"""WITH RECURSIVE {NODES_SQL}, up AS (
    SELECT n.*, 0 AS distance FROM nodes n WHERE n.id = 'o:77'
    UNION ALL SELECT p.*, up.distance + 1 FROM nodes p JOIN up ON p.id = up.parent_id)"""


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[IndexStore, str]:
    """The hierarchy as a stored collection of chunks with contents and metadata."""
    store = IndexStore(spark, scratch_path(spark, "store"))
    store.build("nodes", "none", 1, chunks=chunk_nodes(spark, sf_dir))
    return store, "nodes"


@query("chunk_ancestors", _ANCESTORS_SQL + f" SELECT {_COLUMNS}, distance FROM up WHERE distance > 0")
def chunk_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask.chunk_ancestors(*_indexed(spark, sf_dir), "o:77").select(*hierarchy.NODE, "distance")


# sort keys of a node and all above it, which sort as lists in pre-order
_DOWN_SQL = f"""WITH RECURSIVE {NODES_SQL}, down AS (
    SELECT n.*, 0 AS level, [n.path, printf('%010d', n.start_line), n.id] AS trail FROM nodes n WHERE n.parent_id IS NULL
    UNION ALL SELECT c.*, down.level + 1, list_concat(down.trail, [c.path, printf('%010d', c.start_line), c.id])
              FROM nodes c JOIN down ON c.parent_id = down.id),
    numbered AS (SELECT *, row_number() OVER (ORDER BY trail) AS first FROM down)"""


@query(
    "chunk_descendants",
    _DOWN_SQL
    + f""" SELECT {_COLUMNS}, CAST(level - 1 AS INTEGER) AS level, first - (SELECT first FROM numbered WHERE id = 'n:7') AS place
    FROM numbered WHERE list_contains(trail, 'n:7') AND id <> 'n:7'""",
)
def chunk_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One range of the stored outline; the first of them comes right after the root itself."""
    store, name = _indexed(spark, sf_dir)
    root = ask.outlined(store, name).filter("id = 'n:7'").select("first").first()["first"]
    below = ask.chunk_descendants(store, name, "n:7")
    return below.select(*hierarchy.NODE, "level", (F.col("first") - root).alias("place"))


@query(
    "chunk_tree",
    _DOWN_SQL
    + f""" SELECT {_COLUMNS}, level, first, type || ':' || name || ' (lines ' || CAST(start_line AS VARCHAR) || '-'
        || CAST(end_line AS VARCHAR) || ')' AS label FROM numbered""",
)
def chunk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole forest in pre-order. An outline stores what it reads again itself."""
    shape = hierarchy.outline(nodes(spark, sf_dir))
    return hierarchy.tree(shape).select(*hierarchy.NODE, "level", "first", "label")


@query(
    "chunk_outline_orphans",
    f"""WITH RECURSIVE {_CUT_SQL}, down AS (
    SELECT n.*, 0 AS depth, n.parent_id IS NOT NULL AS orphaned, [n.path, printf('%010d', n.start_line), n.id] AS trail
    FROM cut n WHERE n.parent_id IS NULL OR n.parent_id NOT IN (SELECT id FROM cut)
    UNION ALL SELECT c.*, down.depth + 1, down.orphaned, list_concat(down.trail, [c.path, printf('%010d', c.start_line), c.id])
              FROM cut c JOIN down ON c.parent_id = down.id)
    SELECT id, depth, orphaned, row_number() OVER (ORDER BY trail) AS first,
           row_number() OVER (PARTITION BY CASE WHEN depth = 0 THEN NULL ELSE parent_id END ORDER BY path, start_line, id) AS position
    FROM down""",
)
def chunk_outline_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans stand among the roots and are told apart, with all below them."""
    shape = hierarchy.outline(_cut(spark, sf_dir))
    return shape.select("id", "depth", "orphaned", "first", "position")


@query(
    "chunk_show",
    _ANCESTORS_SQL
    + f""", shown AS (SELECT 'self' AS relation, 0 AS distance, {_COLUMNS} FROM nodes WHERE id = 'o:77'
    UNION ALL SELECT 'ancestor', distance, {_COLUMNS} FROM up WHERE distance > 0
    UNION ALL SELECT 'child', 1, {_COLUMNS} FROM nodes WHERE parent_id = 'o:77')
    SELECT *, {NODE_CONTENT_SQL} AS content, CAST(end_line - start_line + 1 AS VARCHAR) AS lines FROM shown""",
)
def chunk_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = ask.show_chunk(*_indexed(spark, sf_dir), "o:77")
    return shown.select("relation", "distance", *hierarchy.NODE, "content", F.col("metadata")["lines"].alias("lines"))


@query(
    "chunk_stats",
    _DEPTHS_SQL
    + """ SELECT 'total' AS report, 'all' AS key, count(*) AS chunks FROM nodes
    UNION ALL SELECT 'type', type, count(*) FROM nodes GROUP BY type
    UNION ALL SELECT * FROM (SELECT 'file', path, count(*) AS n FROM nodes GROUP BY path ORDER BY n DESC, path LIMIT 10)
    UNION ALL SELECT 'hierarchy', CASE WHEN parent_id IS NULL THEN 'top_level' ELSE 'nested' END, count(*) FROM nodes GROUP BY 2
    UNION ALL SELECT 'depth', CAST(depth AS VARCHAR), count(*) FROM d GROUP BY depth""",
)
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reports on a stored collection, as it stands after an upsert changed a part of it twice."""
    store, name = IndexStore(spark, scratch_path(spark, "store")), "nodes"
    rows = chunk_nodes(spark, sf_dir)
    wrong = rows.withColumn("type", F.lit("draft")).withColumn("parent_id", F.lit(None).cast("string"))
    store.build(name, "none", 1, chunks=rows.filter("type <> 'customer'").unionByName(wrong.filter("type = 'draft' AND id LIKE 'c:%'")))
    store.upsert_chunks(name, wrong.filter("id LIKE 'c:1%' OR id LIKE 'n:%'"))
    store.upsert_chunks(name, rows.filter("type IN ('customer', 'nation')"))
    return ask.chunk_stats(store, name)
