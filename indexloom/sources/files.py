"""Directory walks and file reads, spread over executors.

Spark's own file sources skip names that start with `_` or `.`, which would lose `__init__.py`, so the
listing is made here: one job per directory level, with pruned directories dropped before they are
descended into. Storage must be one that all executors reach.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator
from itertools import batched

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from indexloom.functions.globs import basename_matches
from indexloom.functions.text import decode_utf8_lossy, normalise_newlines, relative_path
from indexloom.operators.scan import MAX_KB, PRUNED_DIRECTORIES, select_files
from indexloom.session import written
from indexloom.sources.tree import OPEN_BYTES, PARTITION_BYTES

READ_BATCH_BYTES = 16 * 1024 * 1024  # that a task reads in parallel with others
HELD_BYTES = 4 * 1024 * 1024  # of contents that a task holds at a time, but for a single longer one
LISTED_ROWS = 4096  # entries of a directory that a task holds at a time
_ENTRY = "path string, length long, is_dir boolean"


def _entries(directory: str) -> Iterator[tuple[str, int, bool]]:
    """Path, length and kind of what is in a directory. A local one is read as it goes, whatever it holds; elsewhere the
    file system gives a listing in one piece."""
    system, base = pafs.FileSystem.from_uri(directory)
    within = directory.rstrip("/")
    if system.type_name != "local":
        for info in system.get_file_info(pafs.FileSelector(base)):
            yield f"{within}/{info.base_name}", info.size or 0, info.type == pafs.FileType.Directory
        return
    with os.scandir(base) as found:
        for entry in found:
            if entry.is_dir():
                if not entry.is_symlink():  # linked directories are not entered: they may lead back up
                    yield f"{within}/{entry.name}", 0, True
                continue
            try:
                length = entry.stat().st_size
            except OSError:  # a link to nothing, or gone since
                length = 0
            yield f"{within}/{entry.name}", length, False


def _list_directories(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for directory in frame["path"]:
            for some in batched(_entries(directory), LISTED_ROWS):
                yield pd.DataFrame(list(some), columns=["path", "length", "is_dir"])


def walk(spark: SparkSession, root: str, pruned: tuple[str, ...] = PRUNED_DIRECTORIES) -> DataFrame:
    """All files below `root` as `(path, length)`, not descending into pruned directories."""
    level, depth, files = spark.createDataFrame([(root.rstrip("/"),)], "path string"), 0, None
    while True:
        entries = written(level.mapInPandas(_list_directories, _ENTRY), f"walk-{depth}")
        here = entries.filter(~F.col("is_dir")).select("path", "length")
        files = here if files is None else files.unionByName(here)
        below = entries.filter("is_dir").select("path")
        for pattern in pruned:
            below = below.filter(~basename_matches(F.col("path"), pattern))
        if below.isEmpty():
            return files
        level, depth = below.repartition(spark.sparkContext.defaultParallelism), depth + 1


def scan_files(
    spark: SparkSession,
    root: str,
    listed: DataFrame | None = None,
    include: str | None = None,
    exclude: str | None = None,
    max_kb: int | None = MAX_KB,
    text_check: str = "none",
) -> DataFrame:
    """The corpus below `root` as `(path, length)` with paths relative to it, chosen by `select_files`.

    Only an include pattern or a list of files needs pruned directories to be walked.
    """
    everything = walk(spark, root, () if include or listed is not None else PRUNED_DIRECTORIES)
    relative = everything.withColumn("path", relative_path(F.col("path"), root))
    return select_files(relative, listed, include, exclude, max_kb, text_check)


def _read_batches(root: str):
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = pafs.FileSystem.from_uri(root.rstrip("/"))
        for frame in frames:
            rows, held = [], 0
            for path, length in zip(frame["path"], frame["length"]):
                try:
                    with system.open_input_stream(f"{base}/{path}") as stream:
                        rows.append((path, length, stream.read(), None))
                except OSError as error:
                    rows.append((path, length, None, str(error)))
                held += length
                if held >= HELD_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "length", "raw", "error"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["path", "length", "raw", "error"])

    return read


def read_files(manifest: DataFrame, root: str) -> DataFrame:
    """Contents of the listed files: `(path, length, content, error)`.

    Python only moves bytes; decoding and newlines are column functions. A file that cannot be read
    keeps its row, with a NULL content and the error.
    """
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    # a directory may hold most of the files: deal them out anew, in as many parts as their bytes ask for
    cost = manifest.agg(F.sum(F.coalesce("length", F.lit(0)) + OPEN_BYTES)).first()[0] or 0
    raw = (
        manifest.select("path", "length")
        .repartition(max(math.ceil(cost / PARTITION_BYTES), min(cores, math.ceil(cost / READ_BATCH_BYTES)), 1))
        .mapInPandas(_read_batches(root), "path string, length long, raw binary, error string")
    )
    return raw.select(
        "path", "length", normalise_newlines(decode_utf8_lossy(F.col("raw"))).alias("content"), "error"
    )
