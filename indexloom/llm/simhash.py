"""Near-duplicates by SimHash fingerprints, linked with BK-trees.

Fingerprints within a few bits are linked, and no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexloom.llm.common import fresh
from indexloom.session import written

BITS = 64


@dataclass(frozen=True)
class Near:
    """radius: bits in which linked fingerprints differ at most; shingle: its words; shard: fingerprints that a shard
    tree is meant to have, which decides how many bits its key has; most: those it has at most, else longer keys split it."""

    radius: int = 3
    shingle: int = 3
    seed: int = 42
    shard: int = 32
    most: int = 4096
    id_col: str = "doc_id"
    text_col: str = "text"


def shingles_of(text: str, shingle: int) -> list[bytes]:
    """Lower-cased (A-Z) word shingles, repeats included; all words where they are fewer; none without words."""
    # lower() of bytes changes A-Z alone, and split() of bytes parts at exactly the six ASCII spaces
    words = text.encode().lower().split()
    if len(words) < shingle:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False)))


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles; zero for a text without words."""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles_of(text, shingle)], dtype="<u8")
    votes = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[start : start + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, keep: list[str], name: str, how: Near = Near()) -> DataFrame:
    """The columns `keep` and the fingerprint of each row's text as a signed 64-bit number. Null texts have no words."""
    at = [docs.columns.index(c) for c in keep]
    text = docs.columns.index(how.text_col)
    schema = T.StructType([docs.schema[i] for i in at] + [T.StructField(name, T.LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py() or "", how.shingle, how.seed) for t in batch.column(text)]
            fps = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in at], fps], [*keep, name])

    return docs.mapInArrow(hashed, schema)


def fingerprints(docs: DataFrame, how: Near = Near(), *more: str) -> DataFrame:
    """`id` and `fp` of each document, and the columns `more`."""
    source = docs.select(*[F.col(f"`{c}`").alias(c) for c in (how.id_col, how.text_col, *more)])
    return with_fingerprints(source, [how.id_col, *more], "fp", how).select(F.col(how.id_col).alias("id"), "fp", *more)


class BKTree:
    """Fingerprints of a shard: children are keyed by their distance to the parent.

    Every node knows a member of its subtree if all of the subtree is one component; a search does not enter a subtree
    that already is the searcher's own component, so groups of many near copies cost no more than a link each.
    """

    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.parent: list[int] = []
        self.children: list[dict[int, int]] = []
        self.uniform: list[int] = []

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def add(self, value: int) -> None:
        """Insert a new value and join it with the components of all values within the radius."""
        new = len(self.values)
        self.values.append(value)
        self.parent.append(new)
        self.children.append({})
        self.uniform.append(new)
        if not new:
            return
        find, values, children, uniform, radius = self.find, self.values, self.children, self.uniform, self.radius
        stack = [0]
        while stack:
            node = stack.pop()
            own = find(new)
            if uniform[node] >= 0 and find(uniform[node]) == own:
                continue
            distance = (values[node] ^ value).bit_count()
            if distance <= radius:
                a, b = find(node), own
                if a != b:
                    self.parent[max(a, b)] = min(a, b)
            below = children[node]
            if len(below) <= 2 * radius + 1:
                stack += [c for edge, c in below.items() if -radius <= edge - distance <= radius]
            else:
                stack += [below[e] for e in range(distance - radius, distance + radius + 1) if e in below]
        node, own, path = 0, find(new), []
        while True:
            path.append(node)
            distance = (values[node] ^ value).bit_count()
            if distance not in children[node]:
                children[node][distance] = new
                break
            node = children[node][distance]
        for node in path:
            if uniform[node] >= 0 and find(uniform[node]) != own:
                uniform[node] = -1

    def links(self) -> Iterator[tuple[int, int]]:
        """One link from each value to the first of its component."""
        for i, value in enumerate(self.values):
            root = self.find(i)
            if root != i:
                yield value, self.values[root]


def block_count(fingerprints: int, how: Near) -> int:
    """In how many blocks the bits are cut.

    Fingerprints within the radius agree in all but `radius` blocks at least, so each choice of the other blocks keys one
    set of shards, and every link is inside a shard of some set. More fingerprints take more blocks: longer keys, more
    sets, shards of the same size. No choice loses a link.
    """
    need = math.log2(max(2.0, fingerprints / how.shard))
    blocks = how.radius + 1
    while BITS * (blocks - how.radius) / blocks < min(need, 44.0):
        blocks += 1
    return blocks


def _masks(blocks: int, radius: int) -> list[int]:
    bounds = [round(BITS * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(bounds, bounds[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def _shards(distinct: DataFrame, how: Near) -> DataFrame:
    """`fp` in each of its shards, named by `level`, `set` and `key`.

    Fingerprints of shards above the bound leave them for a next level of more blocks and longer keys. Two within the radius
    share a shard of each level; either it is kept, or both go on. The last level leaves 12 bits open: 4,096 fingerprints.
    """
    blocks, level, kept = block_count(distinct.count(), how), 0, []
    while True:
        masks = [m - (1 << 64) if m >= 1 << 63 else m for m in _masks(blocks, how.radius)]
        keyed = distinct.select("fp", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("set", "mask"))
        keyed = keyed.select(F.lit(level).alias("level"), "set", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        kept.append(keyed)
        if BITS * how.radius <= 12 * blocks:
            break
        sizes = keyed.groupBy("set", "key").agg(F.count("*").alias("n"))
        large = written(sizes.filter(F.col("n") > how.most).select("set", "key"), "large-shards")
        if large.isEmpty():
            break
        kept[-1] = keyed.join(large, ["set", "key"], "left_anti").select("level", "set", "key", "fp")
        distinct = written(keyed.join(large, ["set", "key"], "left_semi").select("fp").distinct(), "large-shards")
        blocks, level = min(blocks + 4, -(-BITS * how.radius // 12)), level + 1
    return reduce(DataFrame.union, kept)


def links(distinct: DataFrame, how: Near = Near()) -> DataFrame:
    """Links (a, b) that join all fingerprints within the radius, directly or through others. `distinct` has `fp`."""
    shards = _shards(distinct.select("fp"), how).repartition("level", "set", "key").sortWithinPartitions("level", "set", "key", "fp")
    shards = shards.select("fp", F.struct("level", "set").alias("set"), "key")
    radius = how.radius

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pending = None, []

        def closed(values: list[int]) -> Iterator[tuple[int, int]]:
            if len(values) == 2:
                if (values[0] ^ values[1]).bit_count() <= radius:
                    yield values[1], values[0]
            elif len(values) > 2:
                tree = BKTree(radius)
                for v in values:
                    tree.add(v)
                yield from tree.links()

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(found, dtype=np.uint64).view(np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        for batch in batches:
            found: list[tuple[int, int]] = []
            fps = batch.column(0).to_numpy().view(np.uint64).tolist()
            for fp, own in zip(fps, zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True), strict=True):
                if own != key:
                    found += closed(pending)
                    key, pending = own, []
                pending.append(fp)
            if found:
                yield batch_of(found)
        found = list(closed(pending))
        if found:
            yield batch_of(found)

    return shards.mapInArrow(joined, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the links, root being the smallest node of the component.

    Alternating star contraction: every node links its larger neighbours to its smallest one, then its smaller ones,
    until nothing changes. Each round is a table in the shared folder; nothing comes to the driver but two sums.
    """
    current = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = state = (0, None) if current.isEmpty() else None
    while state is None or state != before:
        before = state
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        hung = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = written(hung.union(small_least.select("a", F.col("m").alias("b"))).distinct(), "links")
        state = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def class_table(hashed: DataFrame, how: Near = Near()) -> DataFrame:
    """`fp`, `root` and `component_id` for each fingerprint of a stored table of `id` and `fp`."""
    least = written(hashed.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    return _class_table(least, "fp", components(links(least.select("fp"), how)).withColumnRenamed("node", "fp"))


def _class_table(least: DataFrame, name: str, roots: DataFrame) -> DataFrame:
    placed = least.join(roots, name, "left").withColumn("root", F.coalesce("root", name))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(placed.select(name, "root").join(named, "root"), "class-roots")


def classes(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """One row per document: `id`, `fp`, `root` (the least fingerprint of its component) and `component_id`.

    Documents with one fingerprint are one class, whose trees hold it once: copies add nothing. `component_id` is the
    smallest id of the component; null ids are skipped, and a component of null ids only has none. Empty and null texts
    have fingerprint zero and are linked like others. An empty table has no rows.
    """
    hashed = written(fingerprints(docs, how), "fingerprints")
    return hashed.join(class_table(hashed, how), "fp").select("id", "fp", "root", "component_id")


def hexadecimal(fp):
    """A signed 64-bit number as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicated(docs: DataFrame, how: Near = Near()) -> DataFrame:
    """One document of each component, with the columns of the input: the one with the smallest id.

    Ids need not be unique: of several rows with that id one is kept, by a hash of their texts. Components of null ids
    keep one row likewise. Texts without words are copies of each other.
    """
    row, mark, of, chosen = (fresh(docs, f"__{c}") for c in ("row", "mark", "of", "chosen"))
    identifier, digest = F.col(f"`{how.id_col}`"), F.xxhash64(f"`{how.text_col}`")
    hashed = written(fingerprints(docs.withColumn(mark, digest), how, mark), "fingerprints")
    slim = hashed.select("id", "fp", F.col(mark).alias("h")).join(class_table(hashed, how), "fp")
    # which row stays is settled on ids and hashes; texts are shuffled once, by a mark that only repeated rows share
    own = slim.filter(F.col("component_id").eqNullSafe(F.col("id")))
    kept = own.groupBy("root").agg(F.min(F.struct("h", "id")).alias("k")).select("k.*")
    kept = kept.select(F.xxhash64("id", "h").alias(chosen), F.col("h").alias(of))
    marked = docs.withColumn(mark, F.xxhash64(identifier, digest))
    found = marked.join(kept, (F.col(mark) == F.col(chosen)) & (digest == F.col(of)))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = found.groupBy(mark, of).agg(F.first(whole).alias(row))
    return one.select(f"{row}.*")
