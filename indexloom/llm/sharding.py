"""Sharding by a two-pass external shuffle, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexloom.llm.common import running_start
from indexloom.session import written

BUCKET_BYTES = 16 << 20


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text (none for null) plus eight for the row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def external_shuffle(
    df: DataFrame, size: Column, shards: int = 24, seed: int = 11, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """All rows in one random order, cut into `shards` runs whose row counts differ by one at most.

    First pass: a seeded hash of a row's place in the input scatters rows evenly into buckets of about `bucket_bytes`,
    whatever the rows hold, so copies and repeated keys spread like any other row. Second pass: each bucket is a
    Fisher-Yates permutation (`shuffle`) and is written to the shared folder. Row counts of the written buckets give
    the first position of each, and positions give shard and slot. The input should be stored (a scan gives its rows
    the same places when a task is run again). Input columns named shard or slot are replaced. Null texts are rows like
    others, and an empty table gives no rows.
    """
    names = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    total = df.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    place = F.monotonically_increasing_id()
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), place.alias("place"))
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), F.col("place")))
    scattered = rows.withColumn("bucket", F.pmod(F.col("key"), F.lit(buckets))).repartition("bucket")
    gathered = scattered.groupBy("bucket").agg(F.collect_list(F.struct("key", "place", "row")).alias("rows"))

    def by_key(a: Column, b: Column) -> Column:
        x, y = F.struct(a["key"], a["place"]), F.struct(b["key"], b["place"])
        return F.when(x < y, -1).when(x > y, 1).otherwise(0)

    permuted = F.shuffle(F.array_sort("rows", by_key), F.lit(seed))
    passed = written(gathered.select("bucket", F.posexplode(permuted).alias("at", "item")).select("bucket", "at", "item.row"), "shuffled")
    counts = passed.groupBy("bucket").agg(F.count("*").alias("n"))
    starts = written(running_start(counts, "bucket", "n", "start").select("bucket", "start"), "bucket-starts")
    rows_in_all = passed.count()
    position = F.col("start") + F.col("at")
    shard = F.expr(f"(start + at) * {shards} div {max(1, rows_in_all)}")
    first = F.expr(f"(__shard * {rows_in_all} + {shards - 1}) div {shards}")
    dealt = passed.join(starts, "bucket").withColumn("__shard", shard)
    return dealt.select("row.*", F.col("__shard").cast("int").alias("shard"), (position - first).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows in the order of their slots."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
