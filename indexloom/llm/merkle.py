"""A Merkle manifest of a dataset: a digest per row, per group and of the whole, and a proof for every row.

Leaves of a group stand in the order of their ids. They are cut into superblocks of 8 ** `depth` consecutive leaves, which
reduce alone; the tops of superblocks are the leaves of the next pass, so no task holds a group. On the way down each
superblock meets the few outer nodes above it in a cogroup, where local reduction, proofs and folding are finished together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexloom.llm.common import ranked
from indexloom.session import written

ARITY = 8


@dataclass(frozen=True)
class Manifest:
    """depth: levels that a superblock reduces, 8 ** depth leaves. fields: columns that make up a leaf, in their order."""

    depth: int = 4
    id_col: str = "doc_id"
    group_col: str = "lang"
    text_col: str = "text"
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")

    @property
    def block(self) -> int:
        return ARITY**self.depth


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values: list[Column]) -> Column:
    """Digest of all values: `-` for null, else the bytes of its UTF-8 form, a colon and the value."""
    parts = []
    for value in values:
        shown = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def levels_of(nodes: list[str], most: int) -> list[list[str]]:
    """All levels above and with `nodes`: every eight, or the fewer that end a level, become one; `most` levels at most."""
    out = [nodes]
    while len(out) <= most and len(out[-1]) > 1:
        last = out[-1]
        out.append([digest("".join(last[i : i + ARITY])) for i in range(0, len(last), ARITY)])
    return out


def block_levels(nodes: list[str], total: int, how: Manifest) -> list[list[str]]:
    """Levels of one superblock of a tree of `total` nodes. One that is not the whole tree always reduces `depth` times."""
    out = levels_of(nodes, how.depth)
    if total > how.block:
        while len(out) <= how.depth:
            out.append([digest(out[-1][0])])
    return out


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands left and right of the path from node `at` in its run of every level, the top left out."""
    out = []
    for level in levels[:-1]:
        start = at - at % ARITY
        out.append(("".join(level[start:at]), "".join(level[at + 1 : start + ARITY])))
        at //= ARITY
    return out


def packed(path: list[tuple[str, str]]) -> str:
    return ";".join(f"{left}|{right}" for left, right in path)


def unpacked(path: str) -> list[tuple[str, str]]:
    return [tuple(level.split("|")) for level in path.split(";")] if path else []


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(f"{left}{node}{right}")
    return node


_NODE = "tree long, total long, at long, node string"


def _blocks(part: pd.DataFrame, how: Manifest) -> Iterator[tuple[tuple[int, int, int], pd.DataFrame]]:
    """Superblocks of the rows of one bin, each in order."""
    part = part.assign(block=part["at"] // how.block).sort_values(["tree", "at"], kind="stable")
    for (tree, total, block), rows in part.groupby(["tree", "total", "block"], sort=False):
        yield (int(tree), int(total), int(block)), rows


def _tops(nodes: DataFrame, how: Manifest) -> DataFrame:
    """The next pass: one node per superblock, with the number of them in its tree."""
    block = how.block

    def reduced(part: pd.DataFrame) -> pd.DataFrame:
        rows = [
            (tree, -(-total // block), at, block_levels(own["node"].tolist(), total, how)[-1][0])
            for (tree, total, at), own in _blocks(part, how)
        ]
        return pd.DataFrame(rows, columns=["tree", "total", "at", "node"])

    return nodes.select("bin", "tree", "total", "at", "node").groupBy("bin").applyInPandas(reduced, _NODE)


def _binned(nodes: DataFrame, how: Manifest) -> DataFrame:
    return nodes.withColumn("bin", F.xxhash64("tree", F.expr(f"at div {how.block}")))


def _climbed(nodes: DataFrame, most: int, least: int, label: str, how: Manifest) -> list[DataFrame]:
    """Tables of the nodes of each pass, at least `least` passes above the first and the last with one node for every
    tree. `most`: nodes of the largest tree."""
    passes = [nodes]
    while len(passes) <= least or most > 1:
        most = -(-most // how.block)
        tops = written(_tops(passes[-1], how), f"{label}-{len(passes)}")
        passes.append(_binned(tops, how))
    return passes


def _paths(nodes: DataFrame, outer: DataFrame, how: Manifest) -> DataFrame:
    """`(tree, at, path)` of nodes, from the `path` that their superblock's top has in the next pass."""

    def joined(part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(zip(above["tree"], above["at"], strict=True), above["path"], strict=True))
        rows = []
        for (tree, total, block), own in _blocks(part, how):
            levels, path = block_levels(own["node"].tolist(), total, how), known[tree, block]
            for at in own["at"].tolist():
                steps = packed(siblings(levels, at - block * how.block))
                rows.append((tree, at, ";".join(x for x in (steps, path) if x)))
        return pd.DataFrame(rows, columns=["tree", "at", "path"])

    left = nodes.select("bin", "tree", "total", "at", "node").groupBy("bin")
    above = outer.select(F.xxhash64("tree", "at").alias("bin"), "tree", "at", "path")
    return left.cogroup(above.groupBy("bin")).applyInPandas(joined, "tree long, at long, path string")


def _descended(passes: list[DataFrame], top: DataFrame, label: str, how: Manifest, down_to: int) -> DataFrame:
    """Paths of the nodes of pass `down_to`, from those (`tree`, `at`, `path`) of the last one."""
    path = top
    for k in range(len(passes) - 2, down_to - 1, -1):
        path = written(_paths(passes[k], path, how), f"{label}-paths-{k}")
    return path


def _proved(leaves: DataFrame, outer: DataFrame, root: str | None, how: Manifest) -> DataFrame:
    """Local reduction, proofs and folding of every superblock, with the path of its top."""

    def finished(part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        known = {(t, at): (path, sub) for t, at, path, sub in zip(above["tree"], above["at"], above["path"], above["subroot"], strict=True)}
        rows = []
        for (tree, total, block), own in _blocks(part, how):
            levels, (path, subroot) = block_levels(own["node"].tolist(), total, how), known[tree, block]
            beyond = unpacked(path)
            for i, (key, leaf, shown) in enumerate(zip(own["id"].tolist(), levels[0], own["shown"].tolist(), strict=True)):
                steps = siblings(levels, i) + beyond
                proof = digest("".join([side for step in steps for side in step]))
                folded = fold(shown, steps)
                rows.append((key, leaf, subroot, root, proof, folded, folded == root))
        return pd.DataFrame(rows, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    shape = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    left = leaves.select("bin", "id", "tree", "total", "at", "node", "shown").groupBy("bin")
    above = outer.select("bin", "tree", "at", "path", "subroot").groupBy("bin")
    return left.cogroup(above).applyInPandas(finished, shape)


def manifest(docs: DataFrame, tamper: Column | None = None, tampered_text: Column | None = None, how: Manifest = Manifest()) -> DataFrame:
    """One row per row of `docs`: its id, leaf, subroot (of its group), root, proof_sha256 (digest of all siblings up to
    the root, joined in their order), folded_root and verified.

    Where `tamper` holds, `tampered_text` stands in for the row's text when the root is folded from its leaf and the
    original siblings, so verified tells whether the row still is what the manifest was made of. Rows of a null id come
    first in their group, a null group first of all. Rows with equal ids follow one another by their leaves; equal rows
    have equal leaves and each its own place, so their proofs may differ. Texts may be null, empty or very long. Columns
    that are not fields are not looked at, whatever their names. An empty table gives no rows.
    """
    values = {c: F.col(f"`{c}`") for c in how.fields}
    other = values if tampered_text is None else values | {how.text_col: tampered_text}
    changed = F.lit(False) if tamper is None else F.coalesce(tamper, F.lit(False))
    leaf = leaf_of(list(values.values()))
    shown = F.when(changed, leaf_of([other[c] for c in how.fields])).otherwise(leaf)
    identifier, group = F.col(f"`{how.id_col}`"), F.col(f"`{how.group_col}`")
    digests = written(docs.select(identifier.alias("id"), group.alias("group"), leaf.alias("node"), shown.alias("shown")), "leaves")
    # equal rows are told apart by their place, so that many of them are no hot key
    digests = digests.withColumn("place", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("group"), F.asc_nulls_first("id"), F.col("node"), F.col("place")]
    placed = written(ranked(digests, order, "rank").drop("place"), "ranked-leaves")

    groups = placed.groupBy("group").agg(F.count("*").alias("total"), F.min("rank").alias("base"))
    groups = written(ranked(groups, [F.asc_nulls_first("group")], "tree"), "groups")
    n = groups.agg(F.coalesce(F.max("total"), F.lit(0)).alias("largest"), F.count("*").alias("trees")).first()
    leaves = placed.join(groups.withColumnRenamed("group", "of"), F.col("group").eqNullSafe(F.col("of"))).drop("of")
    leaves = leaves.withColumn("at", F.col("rank") - F.col("base"))
    # superblocks that begin within one stretch of all leaves share a bin, so many small groups are few tasks' work
    leaves = leaves.withColumn("bin", F.expr(f"(base + (at div {how.block}) * {how.block}) div {how.block}"))
    leaves = leaves.withColumn("id", F.col("id").cast("string"))  # no detour of whole numbers through floats

    passes = _climbed(leaves, n["largest"], 1, "tops", how)
    subroots = passes[-1].select(F.lit(0).cast("long").alias("tree"), F.lit(n["trees"]).cast("long").alias("total"), F.col("tree").alias("at"), "node")
    above = _climbed(_binned(subroots, how), n["trees"], 0, "roots", how)
    whole = above[-1].select("tree", "at", F.lit("").alias("path"))
    to_root = _descended(above, whole, "root", how, 0).select(F.col("at").alias("tree"), F.lit(0).cast("long").alias("at"), "path")
    outer = _descended(passes, to_root, "tree", how, 1)
    named = subroots.select(F.col("at").alias("of"), F.col("node").alias("subroot"))
    bases = groups.select(F.col("tree").alias("from"), "base")
    outer = outer.join(named, F.col("tree") == F.col("of")).join(bases, F.col("tree") == F.col("from"))
    outer = outer.withColumn("bin", F.expr(f"(base + at * {how.block}) div {how.block}"))
    top = above[-1].select("node").first()
    out = _proved(leaves, outer, top["node"] if top else None, how)
    return out.select(F.col("id").cast(docs.schema[how.id_col].dataType).alias(how.id_col), *out.columns[1:])
