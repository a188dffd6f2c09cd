"""A directory tree as a Spark data source: `spark.read.format("file_tree").load(root)`.

Partitions are planned by summed bytes, so a few large files and very many small ones both spread evenly. Filters on path
and length are taken over: they decide which directories are entered and which files are opened. The tree is listed by the
driver, some directories at a time; for trees that should be listed by executors, see `files.walk`.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from indexloom.operators.scan import PRUNED_DIRECTORIES

PARTITION_BYTES = 64 * 1024 * 1024
OPEN_BYTES = 64 * 1024  # what opening a file costs, as if it were read
BATCH_BYTES = 16 * 1024 * 1024
LISTERS = 16

SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),  # below the root
        T.StructField("length", T.LongType(), False),
        T.StructField("raw", T.BinaryType(), True),
        T.StructField("error", T.StringType(), True),
    ]
)

_TESTS = {
    D.EqualTo: lambda x, v: x == v,
    D.GreaterThan: lambda x, v: x > v,
    D.GreaterThanOrEqual: lambda x, v: x >= v,
    D.LessThan: lambda x, v: x < v,
    D.LessThanOrEqual: lambda x, v: x <= v,
    D.In: lambda x, v: x in v,
    D.StringStartsWith: lambda x, v: x.startswith(v),
    D.StringEndsWith: lambda x, v: x.endswith(v),
    D.StringContains: lambda x, v: v in x,
}
_ORDERED = (D.GreaterThan, D.GreaterThanOrEqual, D.LessThan, D.LessThanOrEqual)


@dataclass
class Files(D.InputPartition):
    files: list[tuple[str, int]]


def planned(files: Iterable[tuple[str, int]], limit: int) -> list[Files]:
    """Files in order, in partitions that end where they reach `limit` bytes."""
    out, held, n = [], [], 0
    for path, length in files:
        held.append((path, length))
        n += length + OPEN_BYTES
        if n >= limit:
            out.append(Files(held))
            held, n = [], 0
    return [*out, Files(held)] if held else out


class TreeReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.pruned = PRUNED_DIRECTORIES if options.get("pruned", "true").lower() == "true" else ()
        self.limit = int(options.get("partitionbytes", PARTITION_BYTES))
        self.content = options.get("content", "true").lower() == "true"
        self.filters: list[D.Filter] = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", (None,))
            # how Spark orders texts beyond ASCII is not how Python does
            if type(f) in _TESTS and (column == ("length",) or column == ("path",) and not isinstance(f, _ORDERED)):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, path: str, length: int) -> bool:
        row = {"path": path, "length": length}
        return all(_TESTS[type(f)](row[f.attribute[0]], f.value) for f in self.filters)

    def _entered(self, folder: str) -> bool:
        """Whether a directory (below the root, ending in a slash) may hold a wanted file."""
        for f in self.filters:
            if f.attribute == ("path",):
                if isinstance(f, D.EqualTo) and not str(f.value).startswith(folder):
                    return False
                if isinstance(f, D.In) and not any(str(v).startswith(folder) for v in f.value):
                    return False
                if isinstance(f, D.StringStartsWith) and not (f.value.startswith(folder) or folder.startswith(f.value)):
                    return False
        return not any(fnmatchcase(folder.rstrip("/").rsplit("/", 1)[-1], p) for p in self.pruned)

    def listing(self) -> list[tuple[str, int]]:
        system, base = pafs.FileSystem.from_uri(self.root)

        def entries(folder: str) -> list[pafs.FileInfo]:
            found = system.get_file_info(pafs.FileSelector(f"{base}/{folder}"))
            if system.type_name == "local":  # linked directories are not entered: they may lead back up
                found = [i for i in found if i.type != pafs.FileType.Directory or not os.path.islink(i.path)]
            return found

        files, level = [], [""]
        with ThreadPoolExecutor(LISTERS) as pool:
            while level:
                below = []
                for folder, found in zip(level, pool.map(entries, level), strict=True):
                    for info in found:
                        path = f"{folder}{info.base_name}"
                        if info.type == pafs.FileType.Directory:
                            below += [f"{path}/"] if self._entered(f"{path}/") else []
                        elif self._wanted(path, info.size or 0):
                            files.append((path, info.size or 0))
                level = below
        return sorted(files)

    def partitions(self) -> Sequence[D.InputPartition]:
        return planned(self.listing(), self.limit) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, base = pafs.FileSystem.from_uri(self.root)
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.string()]
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], SCHEMA.names)

        for path, length in partition.files:
            raw = error = None
            if self.content:
                try:
                    with system.open_input_stream(f"{base}/{path}") as stream:
                        raw = stream.read()
                except OSError as failure:
                    error = str(failure)
            rows.append((path, length, raw, error))
            held += length + 1000
            if held >= BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        if rows:
            yield batch()


class FileTree(D.DataSource):
    """Options: `pruned` (true: directories that a scan does not enter are left out), `content` (false: no bytes are
    read), `partitionBytes`."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> D.DataSourceReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
