import random

import pytest
from pyspark.sql import functions as F

from indexloom.errors import HierarchyCycle
from indexloom.operators import filters, hierarchy
from indexloom.operators.ordering import placed
from indexloom.operators.packed import dealt, in_ranges
from indexloom.session import written


def forest(spark, edges):
    rows = [(i, "t", f"n{i}", "p.py", k, k + 1, up) for k, (i, up) in enumerate(edges)]
    return spark.createDataFrame(
        rows, "id string, type string, name string, path string, start_line int, end_line int, parent_id string"
    )


EDGES = [("a", None), ("b", "a"), ("d", "b"), ("c", "a"), ("e", "gone"), ("f", "e"), ("g", None)]


def test_depths(spark):
    nodes = forest(spark, EDGES)
    assert [tuple(r) for r in hierarchy.depth_histogram(nodes).collect()] == [(0, 3), (1, 3), (2, 1)]
    depths = {r["id"]: r["depth"] for r in hierarchy.node_depths(nodes).collect()}
    assert depths == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 0, "f": 1, "g": 0}


def test_no_links_at_all(spark):
    assert [tuple(r) for r in hierarchy.depth_histogram(forest(spark, [("a", None), ("b", "x")])).collect()] == [(0, 2)]
    assert hierarchy.depth_histogram(forest(spark, EDGES).filter("false")).collect() == []


def test_deep_chain(spark):
    edges = [("0", None)] + [(str(i), str(i - 1)) for i in range(1, 12)]
    nodes = forest(spark, edges)
    assert [tuple(r) for r in hierarchy.depth_histogram(nodes).collect()] == [(i, 1) for i in range(12)]
    shape = hierarchy.outline(nodes)
    assert [r["id"] for r in hierarchy.ancestors(shape, "5").collect()] == ["4", "3", "2", "1", "0"]
    assert [r["id"] for r in hierarchy.descendants(shape, "7").collect()] == ["8", "9", "10", "11"]


def test_a_thousand_levels_take_ten_rounds(spark, monkeypatch):
    rounds = []

    def counted(df, label):
        rounds.append(label)
        return written(df, label)

    monkeypatch.setattr(hierarchy, "written", counted)
    n = 1000
    edges = [("k0", None)] + [(f"k{i}", f"k{i - 1}") for i in range(1, n)]
    depths = {r["id"]: r["depth"] for r in hierarchy.node_depths(forest(spark, edges)).collect()}
    assert depths == {f"k{i}": i for i in range(n)}
    assert len([r for r in rounds if r.startswith("pointers")]) <= 12


def brute_outline(edges):
    """Pre-order numbers, last numbers, depths and positions of a forest whose siblings stand in the order of `edges`."""
    known, kids, out, at = {i for i, _ in edges}, {}, {}, 0
    for i, up in edges:
        kids.setdefault(up if up in known else None, []).append((i, up is not None and up not in known))

    def visit(node, depth, position, orphaned):
        nonlocal at
        at += 1
        first = at
        for k, (child, _) in enumerate(kids.get(node, []), 1):
            visit(child, depth + 1, k, orphaned)
        out[node] = (first, at, depth, position, orphaned)

    for k, (root, orphaned) in enumerate(kids.get(None, []), 1):
        visit(root, 0, k, orphaned)
    return out


def test_outline_is_brute_force(spark):
    draw = random.Random(4)
    edges = []
    for i in range(400):
        up = None if i < 5 else draw.choice([f"n{draw.randrange(i)}", f"n{draw.randrange(max(1, i // 20))}", f"missing{i % 3}"])
        edges.append((f"n{i}", up))
    shape = hierarchy.outline(forest(spark, edges)).collect()
    expected = brute_outline(edges)
    assert {r["id"]: (r["first"], r["last"], r["depth"], r["position"], r["orphaned"]) for r in shape} == expected
    assert len({r["parent_id"] for r in shape if r["orphaned"] and r["depth"] == 0}) == 3
    assert hierarchy.outline(forest(spark, edges).limit(0)).count() == 0


def test_tree_order(spark):
    nodes = hierarchy.outline(forest(spark, EDGES))
    assert [(r["level"], r["id"]) for r in hierarchy.tree(nodes).collect()] == [
        (0, "a"), (1, "b"), (2, "d"), (1, "c"), (0, "g"),
    ]
    with_orphans = hierarchy.tree(nodes, orphans_as_roots=True)
    assert [r["id"] for r in with_orphans.collect()] == ["a", "b", "d", "c", "e", "f", "g"]
    assert [(r["level"], r["id"]) for r in hierarchy.tree(nodes, "b").collect()] == [(0, "b"), (1, "d")]
    assert hierarchy.tree(nodes, "nope").collect() == []
    assert hierarchy.tree(nodes).first()["label"] == "t:na (lines 0-1)"


def test_relatives(spark):
    nodes = forest(spark, EDGES)
    shape = hierarchy.outline(nodes)
    assert [r["id"] for r in hierarchy.descendants(shape, "a").collect()] == ["b", "d", "c"]
    assert hierarchy.descendants(shape, "d").collect() == [] == hierarchy.descendants(shape, "nope").collect()
    assert hierarchy.ancestors(shape, "nope").collect() == [] == hierarchy.show(shape, "nope").collect()
    assert [(r["id"], r["distance"]) for r in hierarchy.ancestors(shape, "d").collect()] == [("b", 1), ("a", 2)]
    assert [r["id"] for r in hierarchy.ancestors(shape, "f").collect()] == ["e"]
    assert [r["id"] for r in hierarchy.orphans(nodes).collect()] == ["e"]
    shown = {(r["relation"], r["id"], r["distance"]) for r in hierarchy.show(shape, "b").collect()}
    assert shown == {("self", "b", 0), ("ancestor", "a", 1), ("child", "d", 1)}
    pairs = {(r["id"], r["parent_name"]) for r in hierarchy.parent_child_pairs(nodes).collect()}
    assert pairs == {("b", "na"), ("c", "na"), ("d", "nb"), ("f", "ne")}


def test_cycles(spark):
    for edges in ([("a", "c"), ("b", "a"), ("c", "b"), ("r", None), ("s", "r")], [("a", "a")]):
        for question in (hierarchy.depth_histogram, hierarchy.node_depths, hierarchy.outline):
            with pytest.raises(HierarchyCycle):
                question(forest(spark, edges))


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_children_of_every_parent_have_one_shape(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = [("r", None)] + [(f"k{i}", "r") for i in range(300)] + [(f"t{i}", None) for i in range(70)] + [("z", "k1")]
        rows = [tuple(r) for r in hierarchy.children_lists(forest(spark, edges)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = []
    for parent in (None, "r", "k1"):
        expected += [(parent, k, i) for k, i in enumerate(sorted(i for i, up in edges if up == parent), 1)]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)


def test_placed_sums(spark):
    draw = random.Random(6)
    rows = [(draw.choice([None, "hot", "hot", "hot", "b", f"g{i}"]), i, draw.randrange(9)) for i in range(500)]
    out = placed(spark.createDataFrame(rows, "g string, i int, w int").repartition(6), "g", [F.col("i")], "position", "w", "before").collect()
    assert len(out) == len(rows)
    for g in {r[0] for r in rows}:
        own, total = sorted((r for r in rows if r[0] == g), key=lambda r: r[1]), 0
        got = sorted((r for r in out if r["g"] == g), key=lambda r: r["i"])
        for k, (r, x) in enumerate(zip(own, got, strict=True), 1):
            assert (x["position"], x["before"]) == (k, total)
            total += r[2]


def test_rows_are_placed_with_one_shuffle(spark):
    rows = spark.createDataFrame([("hot", i, 1) for i in range(400)], "g string, i int, w int").repartition(3)
    out = placed(rows, "g", [F.col("i")], "position", "w", "before")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan
    assert all((r["position"], r["before"]) == (r["i"] + 1, r["i"]) for r in out.collect())


def test_outline_of_parents_with_many_blocks_of_children(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "BLOCK", 8)
    draw = random.Random(8)
    edges = [("r", None)] + [(f"k{i}", draw.choice(["r", "r", "gone", None])) for i in range(120)]
    edges += [(f"m{i}", f"k{draw.randrange(120)}") for i in range(90)]
    shape = hierarchy.outline(forest(spark, edges)).collect()
    assert {r["id"]: (r["first"], r["last"], r["depth"], r["position"], r["orphaned"]) for r in shape} == brute_outline(edges)


def test_whole_rows_of_a_tree_are_shuffled_as_packed_columns(spark):
    tree = hierarchy.tree(hierarchy.outline(forest(spark, EDGES[:4] + EDGES[6:])))
    plan = tree._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan
    assert [r["first"] for r in tree.collect()] == list(range(1, 6)), plan


def test_an_outline_keeps_columns_of_any_type(spark):
    more = [
        "IF(id = 'c', NULL, IF(id = 'd', map(), map('k', name, 'ü,', NULL))) AS kinds", "IF(id = 'a', NULL, IF(id = 'b', array(), array(name, NULL, '', 'é,'))) AS names", "array(1.5D) AS numbers", "timestamp_seconds(start_line) AS at",
        "start_line = 1 AS flag", "CAST(NULL AS INT) AS none", "struct(id, end_line) AS both", "CAST(start_line AS DECIMAL(9, 2)) AS amount",
        "date_add(DATE'2020-01-01', start_line) AS day", "encode(name, 'utf-8') AS raw", "IF(start_line = 2, NULL, name) AS part",
    ]
    nodes = forest(spark, EDGES).selectExpr("*", *more)
    shape = hierarchy.outline(nodes)
    assert [f.dataType for f in shape.schema][: len(nodes.columns)] == [f.dataType for f in nodes.schema]
    for rows in (shape, hierarchy.tree(shape, orphans_as_roots=True)):
        assert sorted(rows.select(*nodes.columns).collect(), key=lambda r: r["id"]) == sorted(nodes.collect(), key=lambda r: r["id"])


def test_ranges_of_packed_rows(spark):
    draw = random.Random(5)
    rows = [(draw.choice([None, "", "a", "\u00e9", "z", "Z"]), draw.choice([None, -3, 0, 7]), i, [None, {"k": "v"}][i % 2]) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, n int, i long, m map<string,string>").repartition(5)
    for parts in (1, 7):
        out = in_ranges(df, ["g", "n", "i"], parts, 900).withColumn("p", F.spark_partition_id()).collect()
        expected = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2]))
        assert [(r["g"], r["n"], r["i"], r["m"]) for r in out] == expected
        sizes = [sum(r["p"] == p for r in out) for p in range(parts)]
        assert [r["p"] for r in out] == sorted(r["p"] for r in out) and max(sizes) < 2 * 900 / parts
    out = dealt(df, F.col("i") % 3, 4).withColumn("p", F.spark_partition_id()).collect()
    assert all(r["p"] == r["i"] % 3 for r in out) and sorted(r["i"] for r in out) == list(range(900))


def test_filters(spark):
    df = forest(spark, [("a", None), ("b", "a")]).withColumn("path", F.when(F.col("id") == "a", r"x\Y.py").otherwise("xy_.py"))
    assert [r["id"] for r in filters.path_like(df, "\\y").collect()] == ["a"]
    assert [r["id"] for r in filters.path_like(df, "Y_.").collect()] == ["b"]
    assert filters.path_like(df, "x%y").count() == 2
    assert filters.by_type(df, "").count() == 2 and filters.by_type(df, None).count() == 2
    assert filters.by_type(df, "T").count() == 0
    assert filters.by_parent(df, None).count() == 2 and filters.by_parent(df, "a").count() == 1
    unicode_names = df.withColumn("name", F.when(F.col("id") == "a", "\u00c9cole").otherwise("other"))
    assert [r["id"] for r in filters.name_matches(unicode_names, "\u00e9c\\w").collect()] == ["a"]
    assert filters.list_chunks(df, "X", "t").count() == 2
