"""Positions and running sums within groups, without sending a group to one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexloom.session import written


def _numbered(group: str, weight: str | None):
    """Batches of a sorted stretch of rows with two more columns: the place in the own group, from 1, and the weights before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, total = None, 0, 0  # the group that the batch before ended in, with its rows and weights so far
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            groups = batch.column(batch.schema.get_field_index(group))
            if weight:
                amounts = pc.fill_null(batch.column(batch.schema.get_field_index(weight)), 0).to_numpy(zero_copy_only=False).astype("i8")
            else:
                amounts = np.zeros(n, "i8")
            codes = groups.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            sizes = np.diff(np.r_[starts, n])
            sums = np.cumsum(amounts)
            position = np.arange(1, n + 1) - np.repeat(starts, sizes)
            before = sums - amounts - np.repeat(sums[starts] - amounts[starts], sizes)
            if last is not None and last[0].equals(groups[0]):
                position[: sizes[0]] += count
                before[: sizes[0]] += total
            count, total = int(position[-1]), int(before[-1] + amounts[-1])
            last = (groups[-1],)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(position), pa.array(before)], [*batch.schema.names, "_position", "_before"])

    return run


def placed(rows: DataFrame, group: str, order: list[Column], position: str, weight: str | None = None, before: str | None = None) -> DataFrame:
    """`rows` with their `position` (from 1) in the total order of their group and, if asked for, the sum of `weight` of
    all rows `before` them. NULL is a group as well.

    Rows are dealt into ranges of (group, order), which is the only time that they are shuffled, and numbered within their
    range as they are written, so a group with most of the rows is many ranges. A range continues one group at most, so the
    sums that carry over are fewer than ranges, whatever the rows.
    """
    keys = [F.asc_nulls_first(group), *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id())
    places = [T.StructField("_position", T.LongType()), T.StructField("_before", T.LongType())]
    schema = T.StructType([*ranged.schema.fields, *places])
    ranged = written(ranged.mapInArrow(_numbered(group, weight), schema), "ranges", "zstd")
    amount = F.col(weight) if weight else F.lit(0)
    sums = ranged.groupBy("_range", F.col(group).alias("_of")).agg(F.count("*").alias("_n"), F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy("_of").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        F.col("_range").alias("_in"), "_of", F.sum("_n").over(earlier).alias("_n_before"), F.sum("_sum").over(earlier).alias("_sum_before")
    ).filter(F.col("_n_before").isNotNull())
    # a table of its own, as callers may read the rows several times
    carried = written(carried, "carried")
    both = ranged.join(F.broadcast(carried), (F.col("_range") == F.col("_in")) & F.col(group).eqNullSafe(F.col("_of")), "left")
    both = both.withColumn(position, F.col("_position") + F.coalesce("_n_before", F.lit(0)))
    if before:
        both = both.withColumn(before, F.col("_before") + F.coalesce("_sum_before", F.lit(0)).cast("long"))
    return both.drop("_range", "_in", "_of", "_n_before", "_sum_before", "_position", "_before")
