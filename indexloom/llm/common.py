"""Column helpers and small distributed building blocks shared by the operators of this subpackage."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from indexloom.session import written

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text in order; none for null."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare != "", F.split(bare, SPACE_RUN)).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lowered(text: Column) -> Column:
    """A-Z alone in lower case."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once.

    A lambda that reads an outer expression would compute it again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(hashed: Column) -> Column:
    """A 64-bit hash as a number strictly between 0 and 1."""
    return (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) / float(2**53)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`df` with its rank from 0 in a total order, without sending all rows to one task.

    Rows are dealt into ranges and numbered within each; the ranges' first ranks come from one count per range,
    of which there are no more than shuffle partitions.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    dealt = written(dealt, "ranked")
    return _numbered(dealt, order, name)


def _numbered(dealt: DataFrame, order: list[Column], name: str) -> DataFrame:
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return (
        dealt.join(F.broadcast(bases), "__range")
        .withColumn(name, (F.col("__base") + place - 1).cast("long"))
        .drop("__range", "__base")
    )


def running_start(counts: DataFrame, key: str, count: str, name: str, width: int = 1024) -> DataFrame:
    """For whole-number keys, the sum of `count` over all smaller keys, in two levels of windows."""
    high = counts.withColumn("__high", F.expr(f"`{key}` div {width}"))
    sums = high.groupBy("__high").agg(F.sum(count).alias("__sum"))
    before = Window.orderBy("__high").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("__high", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__high").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__base") + F.coalesce(F.sum(count).over(within), F.lit(0))
    return high.join(bases, "__high").withColumn(name, start.cast("long")).drop("__high", "__base")
