"""Approximate nearest neighbours with a hierarchical k-means tree, searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from indexloom.session import written


@dataclass(frozen=True)
class Search:
    """k: neighbours; sample: vectors that the tree is fitted on (the first by hash; every vector is indexed); branching
    and leaf: of the tree, in sample vectors; calibrate: queries searched by brute force to set the leaf visits; recall:
    what they must reach; chunk: vectors of a leaf that meet queries in one task."""

    k: int = 10
    sample: int = 20_000
    branching: int = 12
    leaf: int = 40
    calibrate: int = 100
    recall: float = 0.98
    chunk: int = 4096
    seed: int = 5
    id_col: str = "vec_id"
    vec_col: str = "embedding"


@dataclass
class Tree:
    """Nodes as arrays: each node's children and their centres; a node without children is a leaf with a number."""

    children: list[list[int]] = field(default_factory=list)
    centres: list[np.ndarray] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest centre at every level."""
        out = np.zeros(len(vectors), dtype=np.int32)
        stack = [(0, np.arange(len(vectors)))]
        while stack:
            node, rows = stack.pop()
            if not self.children[node]:
                out[rows] = self.leaf[node]
                continue
            near = _squares(vectors[rows], self.centres[node]).argmin(axis=1)
            stack += [(child, rows[near == i]) for i, child in enumerate(self.children[node]) if (near == i).any()]
        return out

    def visit(self, query: np.ndarray, leaves: int) -> list[int]:
        """The first `leaves` leaves from a priority queue of branches not taken, nearest centre first."""
        queue, found, count = [(0.0, 0)], [], 0
        while queue and len(found) < leaves:
            _, node = heapq.heappop(queue)
            while self.children[node]:
                far = _squares(query[None], self.centres[node])[0]
                best = int(far.argmin())
                for i, child in enumerate(self.children[node]):
                    if i != best:
                        heapq.heappush(queue, (float(far[i]), child))
                node = self.children[node][best]
                count += 1
            found.append(self.leaf[node])
        return found


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)[None]


def build_tree(sample: np.ndarray, how: Search) -> Tree:
    """k-means, and again within every cluster, until a cluster has few vectors of the sample or no two that differ."""
    random, tree = np.random.default_rng(how.seed), Tree()

    def add(rows: np.ndarray) -> int:
        node = len(tree.children)
        tree.children.append([])
        tree.centres.append(np.zeros((0, sample.shape[1])))
        tree.leaf.append(-1)
        distinct = np.unique(sample[rows], axis=0) if len(rows) > how.leaf else ()
        if len(distinct) > 1:
            centres = distinct[random.permutation(len(distinct))[: how.branching]]
            for _ in range(8):
                near = _squares(sample[rows], centres).argmin(axis=1)
                centres = np.stack([sample[rows][near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
            near = _squares(sample[rows], centres).argmin(axis=1)
            used = [i for i in range(len(centres)) if (near == i).any()]
            if len(used) > 1:
                tree.centres[node] = centres[used]
                tree.children[node] = [add(rows[near == i]) for i in used]
                return node
        tree.leaf[node] = tree.leaves
        tree.leaves += 1
        return node

    add(np.arange(len(sample)))
    return tree


def usable(vectors: DataFrame, how: Search = Search()) -> DataFrame:
    """`id` and `vec` of the rows that take part.

    Rows with a null id and vectors that are null, empty, zero or have null or non-finite components are left out, and so
    are those whose length is not the most frequent one (the longer of equally frequent ones).
    """
    vec = F.col("vec")
    rows = vectors.select(F.col(f"`{how.id_col}`").alias("id"), F.col(f"`{how.vec_col}`").alias("vec"))
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0))
    common = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("vec") == (common["n"] if common else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, as `usable` leaves them, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest other vectors by exact distance, ties to the smaller id."""
    far = np.sqrt(((vectors - query) ** 2).sum(axis=1))
    rest = ids != own
    ids, far = ids[rest], far[rest]
    if len(far) > k:
        edge = np.partition(far, k - 1)[k - 1]
        close = far <= edge
        ids, far = ids[close], far[close]
    order = np.lexsort((ids, far))[:k]
    return ids[order], far[order]


def search(vectors: DataFrame, queries: DataFrame, how: Search = Search()) -> DataFrame:
    """The k nearest found vectors of each query: query_id, rank from 1, the id found, score (Euclidean distance).

    Equal vectors are one place in space: only the k + 1 smallest ids of each can be among k nearest, so a vector with
    very many copies is no large leaf. The tree is bounded by its sample and sent to all tasks; vectors and queries meet
    by leaf, and leaves of many vectors in chunks. How many leaves a query visits is set by calibration: the fewest for
    which the brute-force neighbours of a fixed number of queries are found often enough, which may be all leaves.
    """
    k, kind = how.k, vectors.schema[how.id_col].dataType
    rows = usable(vectors, how)
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    members = written(rows.withColumn("place", place).filter(F.col("place") <= k + 1).select("id", "vec"), "ann-members")
    asked = queries.select(F.col(f"`{how.id_col}`").alias("id"), F.col(f"`{how.vec_col}`").alias("vec"))
    length = members.select(F.size("vec").alias("n")).first()
    columns = T.StructType(
        [
            T.StructField("query_id", kind),
            T.StructField("rank", T.IntegerType()),
            T.StructField(how.id_col, kind),
            T.StructField("score", T.DoubleType()),
        ]
    )
    if length is None:
        return vectors.sparkSession.createDataFrame([], columns)
    asked = usable(queries, how).filter(F.size("vec") == length["n"])
    sample = members.orderBy(F.xxhash64("id", "vec"), "id").limit(how.sample).select("vec").toArrow()
    tree = build_tree(_matrix(sample.column("vec").combine_chunks()), how)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.assign(_matrix(batch.column(1))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], ["id", "vec", "leaf"])

    index = written(members.mapInArrow(placed, T.StructType([*members.schema.fields, T.StructField("leaf", T.IntegerType())])), "ann-index")
    asked = written(asked.select("id", "vec").distinct(), "ann-queries")
    visits = _calibrated(index, asked, tree, how)

    sizes = index.groupBy("leaf").agg(F.ceil(F.count("*") / how.chunk).cast("int").alias("chunks"))
    sizes = written(sizes, "ann-leaves")
    dealt = index.join(sizes, "leaf").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tree.visit(q, visits) for q in _matrix(batch.column(1))] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], ["id", "vec", "leaves"])

    routed = asked.mapInArrow(visiting, T.StructType([*asked.schema.fields, T.StructField("leaves", T.ArrayType(T.IntegerType()))]))
    routed = routed.select("id", "vec", F.explode("leaves").alias("leaf"))
    routed = routed.join(sizes.select(F.col("leaf").alias("of"), F.col("chunks").alias("parts")), F.col("leaf") == F.col("of"))
    routed = routed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found = left.column("id").combine_chunks().to_numpy(zero_copy_only=False), []
        if left.num_rows and right.num_rows:
            vectors = _matrix(left.column("vec").combine_chunks())
            for i, (q, query) in enumerate(zip(right.column("id").to_pylist(), _matrix(right.column("vec").combine_chunks()), strict=True)):
                near, far = _nearest(query, ids, vectors, q, k)
                found.append((i, near, far))
        which = np.concatenate([np.full(len(n), i) for i, n, _ in found]) if found else np.zeros(0, dtype=int)
        picked = right.select(["id", "key"]).take(pa.array(which.astype(np.int64)))
        near = np.concatenate([n for _, n, _ in found]) if found else np.zeros(0, dtype=np.int64)
        far = np.concatenate([f for _, _, f in found]) if found else np.zeros(0)
        return pa.table({"query_id": picked.column("id"), "key": picked.column("key"), "found": pa.array(near).cast(pa_kind), "score": pa.array(far, pa.float64())})

    pa_kind = pa.int32() if isinstance(kind, T.IntegerType) else pa.int64()
    routed = routed.select("id", "vec", "leaf", "chunk", F.xxhash64("vec").alias("key"))
    shape = f"query_id {kind.simpleString()}, key long, found {kind.simpleString()}, score double"
    pairs = dealt.groupBy("leaf", "chunk").cogroup(routed.groupBy("leaf", "chunk")).applyInArrow(compared, shape)
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy("score", "found"))
    best = pairs.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int"), F.col("found").alias(how.id_col), "score")


def brute_force(index: DataFrame, asked: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """Exact neighbours (q, found, leaf, score) of a bounded list of queries: each task's nearest, then the nearest of all."""
    matrix = np.array([v for _, v in asked], dtype=np.float64)
    own = [i for i, _ in asked]
    kind = index.schema["id"].dataType.simpleString()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors, leaves = _matrix(batch.column(1)), dict(zip(ids.tolist(), batch.column(2).to_pylist(), strict=True))
            rows = [(q, i, leaves[i], f) for q, row in enumerate(matrix) for i, f in zip(*(x.tolist() for x in _nearest(row, ids, vectors, own[q], k)), strict=True)]
            q, found, leaf, far = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int32()), pa.array(found, batch.column(0).type), pa.array(leaf, pa.int32()), pa.array(far, pa.float64())],
                ["q", "found", "leaf", "score"],
            )

    pairs = index.mapInArrow(nearest, f"q int, found {kind}, leaf int, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "found"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def _calibrated(index: DataFrame, asked: DataFrame, tree: Tree, how: Search) -> int:
    """The fewest leaf visits for which the calibration queries find enough of their neighbours."""
    chosen = [(r["id"], list(r["vec"])) for r in asked.orderBy(F.xxhash64("id"), "id").limit(how.calibrate).collect()]
    if not chosen:
        return 1
    truth = brute_force(index, chosen, how.k).select("q", "leaf").collect()
    places = [{leaf: i for i, leaf in enumerate(tree.visit(np.array(v, dtype=np.float64), tree.leaves))} for _, v in chosen]
    needed = sorted(places[r["q"]][r["leaf"]] + 1 for r in truth)
    return needed[max(0, int(np.ceil(how.recall * len(needed))) - 1)] if needed else 1
