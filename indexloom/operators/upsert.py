"""Insert-or-replace as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ordered(kind: T.DataType) -> bool:
    """Whether values of a type can be compared."""
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _ordered(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def latest(new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by `order`.

    An aggregate, not a window: versions of one key are reduced in the task that reads them, so a key
    with very many versions does not collect in one task. Give an `order` that is unique per key. Where all columns can be
    compared the row itself is the greatest, so that a column of the order, as a content, is held and shuffled once.
    """
    rest = [c for c in new.columns if c not in keys and c not in order]
    if all(_ordered(new.schema[c].dataType) for c in rest):
        own = [c for c in dict.fromkeys(order) if c not in keys]
        return new.groupBy(*keys).agg(F.max(F.struct(*own, *rest)).alias("row")).select(*keys, "row.*").select(*new.columns)
    row = F.max_by(F.struct(*new.columns), F.struct(*order)).alias("row")
    return new.groupBy(*keys).agg(row).select("row.*")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """`existing` with the rows of `new` replacing those of equal key; `new` may repeat a key if `order`
    tells which repetition is last."""
    last = latest(new, keys, order) if order else new
    kept = existing.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last.select(*existing.columns))
