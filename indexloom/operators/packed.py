"""Shuffles of whole rows as packed columns.

A shuffle moves rows one after another, in some four times the bytes that the same rows take as compressed columns. Here a
task cuts its rows into those for each partition, a bounded number at a time, and sends each cut as one compressed block of
columns, which the partition unpacks. Rows, their types and the partition they come to are the same as of a plain shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

PACK_BYTES = 64 * 1024 * 1024  # of rows that a task cuts at once
PART_ROWS = 500_000  # of a partition, at most, where the number of rows is known
LEAST_ROWS = 50_000  # that are worth a partition of their own
PART_BYTES = 32 * 1024 * 1024  # of a partition, as stored, where the planner knows its size
SAMPLE = 100  # rows looked at for each partition to find where ranges begin
NUMBERED, PARTS = "numbered", "parts"  # in the metadata of a column of numbers from 1: the table's rows, and partitions for them

Batches = Iterator[pa.RecordBatch]
Assign = Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]  # rows in the order of their partitions, and those partitions


def parts_for(rows: DataFrame, n: int, most: int = PART_ROWS) -> int:
    """Partitions for `n` rows: as many as shuffles have, but none of few rows, none of more than `most`, and more of them
    where rows are long."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, math.ceil(n / most), min(max(usual, size // PART_BYTES), n // LEAST_ROWS))


def _steps(values: np.ndarray) -> np.ndarray:
    """Numbers as their differences, which numbers in order, as offsets of texts, have small ones of; they wrap around."""
    return np.diff(values, prepend=values.dtype.type(0))


def _offsets(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.frombuffer(column.buffers()[1], "i4")[column.offset : column.offset + n + 1] if n else np.zeros(1, "i4")


def _whole(kind: pa.DataType) -> bool:
    return pa.types.is_integer(kind) or pa.types.is_timestamp(kind) or pa.types.is_date(kind) or pa.types.is_duration(kind)


def _put(column: pa.Array, out: list) -> None:
    """The buffers of a column, offsets as lengths and whole numbers as steps, as `_taken` reads them."""
    kind, n = column.type, len(column)
    out.append(np.packbits(column.is_valid().to_numpy(zero_copy_only=False), bitorder="little") if column.null_count else b"")
    if pa.types.is_string(kind) or pa.types.is_binary(kind):
        at = _offsets(column)
        out.append(np.diff(at))
        out.append(memoryview(column.buffers()[2])[at[0] : at[-1]] if at[-1] > at[0] else b"")
    elif pa.types.is_list(kind) or pa.types.is_map(kind):
        at = _offsets(column)
        out.append(np.diff(at))
        for values in (column.keys, column.items) if pa.types.is_map(kind) else (column.values,):
            _put(values.slice(at[0], at[-1] - at[0]), out)
    elif pa.types.is_struct(kind):
        for k in range(kind.num_fields):
            _put(column.field(k), out)
    elif pa.types.is_boolean(kind):
        out.append(np.packbits(pc.fill_null(column, False).to_numpy(zero_copy_only=False), bitorder="little"))
    elif _whole(kind):
        values = np.frombuffer(column.buffers()[1], f"i{kind.bit_width // 8}")[column.offset : column.offset + n] if n else np.zeros(0, "i8")
        out.append(_steps(values))
    else:  # of any other type, as it is
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("c", kind)])) as stream:
            stream.write_batch(pa.RecordBatch.from_arrays([column], ["c"]))
        out.append(sink.getvalue())


def _taken(kind: pa.DataType, n: int, parts: Iterator[pa.Buffer]) -> pa.Array:
    """The column of `n` rows whose buffers are next."""
    valid = next(parts)
    valid = valid if valid.size else None

    def offsets() -> np.ndarray:
        return np.r_[np.zeros(1, "i4"), np.cumsum(np.frombuffer(next(parts), "i4"), dtype="i4")]

    if pa.types.is_string(kind) or pa.types.is_binary(kind):
        return pa.Array.from_buffers(kind, n, [valid, pa.py_buffer(offsets()), next(parts)])
    if pa.types.is_list(kind):
        at = offsets()
        return pa.Array.from_buffers(kind, n, [valid, pa.py_buffer(at)], children=[_taken(kind.value_type, int(at[-1]), parts)])
    if pa.types.is_map(kind):
        at = offsets()
        pairs = [_taken(k, int(at[-1]), parts) for k in (kind.key_type, kind.item_type)]
        fields = [kind.key_field, kind.item_field]
        return pa.Array.from_buffers(kind, n, [valid, pa.py_buffer(at)], children=[pa.StructArray.from_arrays(pairs, fields=fields)])
    if pa.types.is_struct(kind):
        return pa.Array.from_buffers(kind, n, [valid], children=[_taken(kind.field(k).type, n, parts) for k in range(kind.num_fields)])
    if pa.types.is_boolean(kind):
        return pa.Array.from_buffers(kind, n, [valid, next(parts)])
    if _whole(kind):
        values = np.frombuffer(next(parts), f"i{kind.bit_width // 8}")
        return pa.Array.from_buffers(kind, n, [valid, pa.py_buffer(np.cumsum(values, dtype=values.dtype))])
    return pa.ipc.open_stream(next(parts)).read_next_batch().column(0)


def _block(rows: pa.Table) -> bytes:
    """Rows in one run of bytes: their number, that of the buffers, the sizes of these, and they."""
    out: list = []
    for column in rows.columns:
        _put(column.combine_chunks() if column.num_chunks != 1 else column.chunk(0), out)
    out = [memoryview(b).cast("B") if len(memoryview(b)) else b"" for b in out]
    return b"".join([np.array([rows.num_rows, len(out), *map(len, out)], "i8").tobytes(), *out])


def _rows(block: pa.Buffer, schema: pa.Schema) -> pa.RecordBatch:
    n, count = np.frombuffer(block, "i8", 2)
    sizes = np.frombuffer(block, "i8", count, 16)
    ends = 16 + 8 * count + np.cumsum(sizes)
    parts = iter([block.slice(int(end - size), int(size)) for size, end in zip(sizes, ends, strict=True)])
    return pa.RecordBatch.from_arrays([_taken(f.type, int(n), parts) for f in schema], schema=schema)


TEXTS, TEXT_MAP = T.ArrayType(T.StringType()), T.MapType(T.StringType(), T.StringType())


def _is(kind: T.DataType, other: T.DataType) -> bool:
    return kind.simpleString() == other.simpleString()


def _joined(texts: Column) -> list[Column]:
    """Texts as two: the bytes of each, -1 for null, and all in one."""
    sizes = F.transform(texts, lambda x: F.coalesce(F.octet_length(x), F.lit(-1)).cast("string"))
    return [F.array_join(sizes, ","), F.array_join(texts, "")]


def _split(sizes: pa.Array, whole: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where the texts of each row begin, and the texts, of what `_joined` made."""
    lists = pc.split_pattern(sizes, ",")
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    counts = np.where(pc.fill_null(pc.equal(sizes, ""), False).to_numpy(zero_copy_only=False), 0, counts)
    each = pc.list_flatten(lists)
    each = each.filter(pc.not_equal(each, "")).cast(pa.int32()).to_numpy()
    ends = np.r_[np.zeros(1, "i4"), np.cumsum(np.maximum(each, 0), dtype="i4")]
    at, data = _offsets(whole), whole.buffers()[2]
    data = data.slice(int(at[0]), int(at[-1] - at[0])) if data is not None else pa.py_buffer(b"")
    valid = pa.py_buffer(np.packbits(each >= 0, bitorder="little")) if (each < 0).any() else None
    texts = pa.Array.from_buffers(pa.string(), len(each), [valid, pa.py_buffer(ends), data])
    return np.r_[np.zeros(1, "i4"), np.cumsum(counts, dtype="i4")], texts


def mapped(rows: DataFrame, run: Callable[[Batches], Batches], schema: T.StructType | str) -> DataFrame:
    """`rows.mapInArrow(run, schema)`, with lists and maps of texts handed over as plain texts: Spark works out the size of
    its batches anew at each row, which takes longer for a nested column than all else that is done with it."""
    nested = {f.name: f.dataType for f in rows.schema if _is(f.dataType, TEXTS) or _is(f.dataType, TEXT_MAP)}
    if not nested:
        return rows.mapInArrow(run, schema)
    flat, arrow = [], _arrow(rows.schema)
    for k, f in enumerate(rows.schema):
        if f.name not in nested:
            flat.append(F.col(f"`{f.name}`").alias(f"c{k}"))
            continue
        texts = [F.col(f"`{f.name}`")] if _is(f.dataType, TEXTS) else [F.map_keys(f"`{f.name}`"), F.map_values(f"`{f.name}`")]
        flat += [c.alias(f"c{k}_{j}_{i}") for j, t in enumerate(texts) for i, c in enumerate(_joined(t))]

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = []
        for k, f in enumerate(arrow):
            if f.name not in nested:
                columns.append(batch.column(f"c{k}").cast(f.type))
                continue
            sizes = batch.column(f"c{k}_0_0")
            valid = pa.py_buffer(np.packbits(sizes.is_valid().to_numpy(zero_copy_only=False), bitorder="little")) if sizes.null_count else None
            at, texts = _split(sizes, batch.column(f"c{k}_0_1"))
            if pa.types.is_map(f.type):
                pairs = [texts, _split(batch.column(f"c{k}_1_0"), batch.column(f"c{k}_1_1"))[1]]
                texts = pa.StructArray.from_arrays(pairs, fields=[f.type.key_field, f.type.item_field])
            columns.append(pa.Array.from_buffers(f.type, len(sizes), [valid, pa.py_buffer(at)], children=[texts]))
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.select(*flat).mapInArrow(lambda batches: run(map(whole, batches)), schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, f.type) for f in to_arrow_schema(schema)])


def _packer(assign: Assign, drop: list[str], schema: pa.Schema) -> Callable[[Batches], Batches]:
    def packed(held: list[pa.RecordBatch], codec: pa.Codec) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        order, to = assign(table)
        table = table.drop_columns(drop).take(pa.array(order)).cast(schema).combine_chunks()
        cuts = np.r_[0, np.flatnonzero(to[1:] != to[:-1]) + 1, len(to)]
        sizes, blocks = [], []
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):  # one pass for each partition, not for each row
            whole = _block(table.slice(at, end - at))
            sizes.append(len(whole))
            blocks.append(codec.compress(whole, asbytes=True))
        columns = [pa.array(to[cuts[:-1]], pa.int32()), pa.array(sizes, pa.int64()), pa.array(blocks, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["to", "size", "block"])

    def run(batches: Batches) -> Batches:
        held, size, codec = [], 0, pa.Codec("zstd")
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= PACK_BYTES:
                yield packed(held, codec)
                held, size = [], 0
        if held:
            yield packed(held, codec)

    return run


def _unpacked(batches: Batches, schema: pa.Schema) -> Batches:
    codec = pa.Codec("zstd")
    for batch in batches:
        for size, block in zip(batch.column("size").to_pylist(), batch.column("block"), strict=True):  # a block at a time
            yield _rows(codec.decompress(block.as_buffer(), size), schema)


def _shuffled(rows: DataFrame, assign: Assign, drop: list[str], parts: int, then: Callable[[Batches], Batches] | None, schema: T.StructType | None):
    out = T.StructType([f for f in rows.schema.fields if f.name not in drop])
    arrow = _arrow(out)
    blocks = mapped(rows, _packer(assign, drop, arrow), "to int, size long, block binary").repartitionById(parts, F.col("to"))
    if then is None:
        return blocks.mapInArrow(lambda batches: _unpacked(batches, arrow), out)
    return blocks.mapInArrow(lambda batches: then(_unpacked(batches, arrow)), schema)


def dealt(
    rows: DataFrame, to: Column, parts: int, then: Callable[[Batches], Batches] | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """`rows` in the partitions `to`, from 0 to `parts - 1`; with `then`, what it makes of the rows of each partition."""

    def assign(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        own = table["_to"].to_numpy()
        order = np.argsort(own, kind="stable")
        return order, own[order]

    return _shuffled(rows.withColumn("_to", to.cast("int")), assign, ["_to"], parts, then, schema)


def _bounds(rows: DataFrame, keys: list[str], parts: int, n: int) -> pa.Table:
    """Where all ranges but the first begin, from a sample of the keys."""
    found = rows.select(*keys)
    if n > SAMPLE * parts:
        found = found.sample(SAMPLE * parts / n, 0)
    found = found.toArrow().combine_chunks()
    order = pc.sort_indices(found, sort_keys=[(k, "ascending") for k in keys], null_placement="at_start").to_numpy()
    at = np.unique(np.arange(1, parts) * len(order) // parts) if len(order) else []
    return found.take(pa.array(order[at])) if len(at) else found.slice(0, 0)


def in_ranges(rows: DataFrame, keys: list[str], parts: int, n: int) -> DataFrame:
    """`n` rows in the ascending order of `keys`, nulls first, within partitions and over them.

    The keys are strings, whole numbers, dates or times. Where the one key numbers all rows, ranges follow from the
    number of rows; else they begin at rows of a sample, which is one more pass over the keys.
    """
    total = rows.schema[keys[0]].metadata.get(NUMBERED) if len(keys) == 1 else None
    order = [F.asc_nulls_first(k) for k in keys]
    if total:
        to = F.least(F.floor((F.col(keys[0]) - 1) * parts / total), F.lit(parts - 1))
        return dealt(rows, to, parts).sortWithinPartitions(*order)
    bounds = _bounds(rows, keys, parts, n)

    def assign(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        own = table.select(keys)
        first, rest = bounds.cast(own.schema), len(bounds)
        both = pa.concat_tables([first, own]).append_column("_own", pa.array(np.arange(rest + len(own)) >= rest))
        by = [(k, "ascending") for k in [*keys, "_own"]]
        order = pc.sort_indices(both.combine_chunks(), sort_keys=by, null_placement="at_start").to_numpy().astype("i8")
        begins = order < rest
        return order[~begins] - rest, np.cumsum(begins)[~begins]

    return _shuffled(rows, assign, [], parts, None, None).sortWithinPartitions(*order)
