"""Hard negatives by Four-Russians scoring: exact whole-number inner products from table lookups.

A vector is kept as bit planes: of every eight dimensions the bits of one place value are one byte. An anchor has, for each
eight dimensions, the table of its 256 subset sums. A plane's share of an inner product is a sum of lookups, and the planes
are joined by shifting and adding. Anchors and candidates are dealt into blocks of bounded size that meet in a cogroup; only
the best of each anchor leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from indexloom.session import written

GROUP = 8  # dimensions of one table
_NONE = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Mining:
    """positives: of an anchor; negatives: of an anchor and a positive; low, high: per cent of the positive's score that a
    negative's lies between; scale: components become floor(scale * x); candidates, anchors: in a block at most; together:
    anchors whose tables are held at once."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    scale: int = 256
    candidates: int = 131_072
    anchors: int = 16_384
    together: int = 64
    id_col: str = "vec_id"
    vec_col: str = "embedding"
    label_col: str = "label"


def usable(vectors: DataFrame, label: Column | None = None, how: Mining = Mining()) -> DataFrame:
    """`id`, `label` and whole-number `q` of the rows that take part, equal rows once.

    Rows with a null id, a null label, a null vector or a null or non-finite component take none.
    """
    vec = F.col(f"`{how.vec_col}`")
    rows = vectors.select(
        F.col(f"`{how.id_col}`").cast("long").alias("id"), (F.col(f"`{how.label_col}`") if label is None else label).cast("long").alias("label"), vec.alias("vec")
    )
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & ~bad)
    q = F.transform("vec", lambda x: F.floor(x.cast("double") * how.scale))
    return rows.select("id", "label", q.alias("q")).distinct()


@dataclass(frozen=True)
class Shape:
    """groups: of eight dimensions; planes: place values, the last one that of the sign; wide: whether scores need 64 bits."""

    groups: int
    planes: int
    wide: bool

    @property
    def kind(self):
        return np.int64 if self.wide else np.int32


def shape_of(rows: DataFrame) -> Shape | None:
    """The shape that holds every row; scores that 64 bits cannot hold are an error."""
    greatest = F.array_max(F.transform("q", lambda x: F.when(x < 0, -(x + 1)).otherwise(x)))
    found = rows.agg(F.max(F.size("q")).alias("dims"), F.max(greatest).alias("most")).first()
    if found["dims"] is None:
        return None
    dims, most = max(found["dims"], 1), found["most"] or 0
    if dims * (most + 1) ** 2 >= 1 << 62:
        raise OverflowError(f"inner products of {dims} components of up to {most} do not fit 64 bits")
    return Shape(-(-dims // GROUP), most.bit_length() + 1, dims * (most + 1) ** 2 >= 1 << 30)


def planes_of(q: np.ndarray, shape: Shape) -> np.ndarray:
    """(rows, planes, groups) bytes of whole numbers (rows, 8 * groups), in two's complement."""
    bits = (q[:, None, :] >> np.arange(shape.planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def numbers_of(planes: np.ndarray, shape: Shape) -> np.ndarray:
    """The whole numbers that planes stand for."""
    bits = np.unpackbits(planes, axis=2, bitorder="little").astype(shape.kind)
    weight = np.left_shift(1, np.arange(shape.planes), dtype=shape.kind)
    weight[-1] = -weight[-1]
    return (bits * weight[None, :, None]).sum(axis=1, dtype=shape.kind)


def tables_of(anchors: np.ndarray, shape: Shape) -> np.ndarray:
    """(groups, 256, anchors): of every eight components of each anchor, the sums of all subsets."""
    parts = anchors.T.reshape(shape.groups, GROUP, len(anchors))
    out = np.zeros((shape.groups, 1 << GROUP, len(anchors)), dtype=shape.kind)
    for bit in range(GROUP):
        out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] + parts[:, bit, None]
    return out


def scores_of(tables: np.ndarray, planes: np.ndarray, shape: Shape, step: int = 2048) -> np.ndarray:
    """(anchors, candidates) exact inner products."""
    out = np.empty((tables.shape[2], len(planes)), dtype=shape.kind)
    for start in range(0, len(planes), step):
        part = planes[start : start + step]
        total = np.zeros((len(part), tables.shape[2]), dtype=shape.kind)
        for plane in range(shape.planes - 1, -1, -1):
            share = tables[0][part[:, plane, 0]]
            for group in range(1, shape.groups):
                share += tables[group][part[:, plane, group]]
            if plane == shape.planes - 1:
                total -= share  # the sign's place counts against the others
            else:
                total += share
            if plane:
                total <<= 1
        out[:, start : start + step] = total.T
    return out


def stored(rows: DataFrame, shape: Shape) -> DataFrame:
    """`row` (a number), `id`, `label` and `planes` of each row; shorter vectors end in zeros."""
    width = shape.groups * GROUP

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            q = np.zeros((batch.num_rows, width), dtype=np.int64)
            if batch.num_rows:
                at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                q[np.repeat(np.arange(batch.num_rows), sizes), at] = column.flatten().to_numpy(zero_copy_only=False)
            flat = planes_of(q, shape).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in flat], pa.binary())], ["id", "label", "planes"]
            )

    made = rows.select("id", "label", "q").mapInArrow(coded, "id long, label long, planes binary")
    return written(made.withColumn("row", F.monotonically_increasing_id()), "planes")


def _planes(table: pa.Table, shape: Shape) -> np.ndarray:
    raw = b"".join(table.column("planes").to_pylist())
    return np.frombuffer(raw, dtype=np.uint8).reshape(-1, shape.planes, shape.groups)


def _cells(anchors: DataFrame, candidates: DataFrame, how: Mining) -> tuple[DataFrame, DataFrame]:
    """Both sides with the `a` and `c` of every cell that they stand in; a block is cut by the rows' numbers."""
    tasks = 2 * anchors.sparkSession.sparkContext.defaultParallelism
    n, m = candidates.count(), anchors.count()
    c_blocks = max(1, math.ceil(n / min(how.candidates, max(2048, math.ceil(n / tasks)))))
    a_blocks = max(1, math.ceil(m / how.anchors))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        home = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
        return df.withColumn(own, home).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    return dealt(anchors, "a", a_blocks, "c", c_blocks), dealt(candidates, "c", c_blocks, "a", a_blocks)


class _Candidates:
    """Candidates of a cell, in the order of their labels and ids: the first of equal scores is that of the smaller id."""

    def __init__(self, table: pa.Table, shape: Shape):
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.planes = ids[order], labels[order], _planes(table, shape)[order]
        self.by_id = np.argsort(self.ids, kind="stable")

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))


def _best(scores: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, column and score of the k greatest of each row, the first column of equal ones; `_NONE` never counts."""
    every = np.arange(len(scores))
    for _ in range(min(k, scores.shape[1])):
        column = scores.argmax(axis=1)
        best = scores[every, column]
        there = np.flatnonzero(best != _NONE)
        if not len(there):
            return
        yield there, column[there], best[there]
        scores[every, column] = _NONE


def _positives(anchors: DataFrame, candidates: DataFrame, shape: Shape, how: Mining) -> DataFrame:
    """`(anchor, id, score)`: the best of other ids and the same label, per anchor row."""

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            pool, own = _Candidates(right, shape), numbers_of(_planes(left, shape), shape)
            rows, ids, labels = (left.column(c).to_numpy() for c in ("row", "id", "label"))
            for label in np.unique(labels):
                mates = pool.of_label(label)
                at = np.flatnonzero(labels == label)
                for start in range(0, len(at) if mates.stop > mates.start else 0, how.together):
                    some = at[start : start + how.together]
                    scores = scores_of(tables_of(own[some], shape), pool.planes[mates], shape).astype(np.int64)
                    scores[ids[some][:, None] == pool.ids[mates][None]] = _NONE
                    found += [(rows[some[i]], pool.ids[mates][j], s) for i, j, s in _best(scores, how.positives)]
        return pa.table(dict(zip(("anchor", "id", "score"), _joined(found, 3), strict=True)))

    left, right = _cells(anchors, candidates, how)
    pairs = left.groupBy("a", "c").cogroup(right.groupBy("a", "c")).applyInArrow(scored, "anchor long, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("place", place).filter(F.col("place") <= how.positives)


def _joined(found: list[tuple], n: int) -> list[pa.Array]:
    return [pa.array(np.concatenate([f[k] for f in found]) if found else np.zeros(0, dtype=np.int64), pa.int64()) for k in range(n)]


def _negatives(anchors: DataFrame, candidates: DataFrame, shape: Shape, how: Mining) -> DataFrame:
    """`(anchor, place, id, score)`: of other labels, the best between the bounds of each positive of each anchor row.
    `anchors` have the `scores` of their positives in order."""

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            pool, own = _Candidates(right, shape), numbers_of(_planes(left, shape), shape)
            ids, labels, planes = (x[pool.by_id] for x in (pool.ids, pool.labels, pool.planes))
            rows, of = left.column("row").to_numpy(), left.column("label").to_numpy()
            positive = np.full((left.num_rows, how.positives), _NONE)
            for i, scores in enumerate(left.column("scores").to_pylist()):
                positive[i, : len(scores)] = scores
            for start in range(0, left.num_rows, how.together):
                some = slice(start, start + how.together)
                scores = scores_of(tables_of(own[some], shape), planes, shape).astype(np.int64)
                scores[of[some, None] == labels[None]] = _NONE
                for p in range(how.positives):
                    bound = positive[some, p]
                    # low * p <= 100 * s <= high * p in whole numbers
                    least, most = -((-how.low * bound) // 100), (how.high * bound) // 100
                    fit = (scores >= least[:, None]) & (scores <= most[:, None]) & (bound != _NONE)[:, None]
                    for i, j, s in _best(np.where(fit, scores, _NONE), how.negatives):
                        found.append((rows[some][i], np.full(len(i), p + 1), ids[j], s))
        return pa.table(dict(zip(("anchor", "place", "id", "score"), _joined(found, 4), strict=True)))

    left, right = _cells(anchors, candidates, how)
    pairs = left.groupBy("a", "c").cogroup(right.groupBy("a", "c")).applyInArrow(scored, "anchor long, place long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= how.negatives)


RESULT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("anchor_id", "positive_id")]
    + [T.StructField("rank", T.IntegerType())]
    + [T.StructField(c, T.LongType()) for c in ("negative_id", "positive_score", "negative_score")]
)


def mine(vectors: DataFrame, anchors: Column, label: Column | None = None, how: Mining = Mining()) -> DataFrame:
    """For each anchor (a row where `anchors`, a condition on `id`, holds) and each of its first `positives` rows of the
    same label, the first `negatives` rows of other labels whose score lies between `low` and `high` per cent of the
    positive's: anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score.

    Scores are inner products with the anchor; higher ones come first, ties by the smaller id. `label` stands in for the
    table's own. Rows that `usable` leaves out are neither anchors nor partners; equal rows count once. Rows that share an
    id are no partners of one another, and an id with several rows is an anchor with each. Shorter vectors end in zeros.
    No rows come of an empty table. Columns other than the three named ones are not looked at.
    """
    rows = written(usable(vectors, label, how), "usable")
    shape = shape_of(rows)
    if shape is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    candidates = stored(rows, shape)
    chosen = written(candidates.filter(anchors), "anchors")
    positives = written(_positives(chosen, candidates, shape, how), "positives")
    ordered = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("all"))
    with_scores = chosen.join(ordered, F.col("row") == F.col("anchor")).select(
        "row", "label", "planes", F.transform("all", lambda x: x["score"]).alias("scores")
    )
    found = _negatives(written(with_scores, "anchors-scored"), candidates, shape, how)
    named = found.select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    of = positives.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    ids = chosen.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return named.join(of, ["anchor", "place"]).join(ids, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
