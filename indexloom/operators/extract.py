"""Cut source files into classes, functions and methods.

Everything about one file can be worked out from its own row, so extraction is a map over Arrow batches:
one pass over the lines of a file with a stack of open blocks pairs every definition with its parent and
the line that ends its block. There is no shuffle and no join, the work is linear in the lines and in the
contents that come out, and a project that holds a third of all files is spread like any other input.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexloom.functions.text import extension
from indexloom.schemas import CHUNKS
from indexloom.session import spread

# How a definition looks on a single line, anywhere in it: the keyword, a name and what opens its bracket or its block.
_CLASS = re.compile(r"class\s+(\w+)\s*([(:])")
_FUNCTION = re.compile(r"def\s+(\w+)\s*(\()")
# What ends it: a closed bracket and the colon, for functions perhaps with an arrow and anything between.
_CLOSED = re.compile(r"\)\s*:")
_RETURNS = re.compile(r"\)\s*->")


def _last(pattern: re.Pattern, line: str, before: int) -> int:
    """Where the last match that ends at `before` or earlier starts, or -1."""
    return max((m.start() for m in pattern.finditer(line) if m.end() <= before), default=-1)


def class_name(line: str) -> str | None:
    """The name of the class that a line defines. Only the last closing is of interest, so a line is passed over twice."""
    at, closed = 0, None
    while m := _CLASS.search(line, at):
        if m[2] == ":":
            return m[1]
        closed = _last(_CLOSED, line, len(line)) if closed is None else closed
        if closed > m.start(2):
            return m[1]
        at = m.start() + 1
    return None


def function_name(line: str) -> str | None:
    """The name of the function that a line defines, brackets and colon included."""
    m = _FUNCTION.search(line)
    if m is None:
        return None
    closed = max(_last(_CLOSED, line, len(line)), _last(_RETURNS, line, line.rfind(":")))
    return m[1] if closed > m.start(2) else None  # brackets of later ones open further right


# every stored column but those that the store or the build fill in
_LATER = ("collection", "metadata", "updated")
EXTRACTED = T.StructType([T.StructField(f.name, f.dataType) for f in CHUNKS.fields if f.name not in _LATER])
BATCH_CHARS, BATCH_ROWS = 1 << 24, 10_000  # an output batch ends where it reaches either


@dataclass
class Definition:
    kind: str
    name: str
    line: int
    parent: str | None
    first_decorator: int
    end: int | None = None


def chunk_id(path: str | None, kind: str, name: str, line: int) -> str:
    """`path:type:name:line` with a 0-based line; a NULL path is left out."""
    return ":".join([*([] if path is None else [path]), kind, name, str(line)])


def definitions(path: str | None, lines: list[str]) -> list[Definition]:
    """Definitions of a file in order, a class before a function on the same line.

    A parent is the nearest earlier class that is indented less; `classes` holds those that can still be one.
    A block ends before the next line that is not blank and not indented deeper; `running` holds the open
    ones. Both grow in indentation, so a line only looks at their ends. An end that is None is the file's.
    """
    found: list[Definition] = []
    classes: list[tuple[int, str]] = []
    running: list[tuple[int, Definition]] = []
    first_decorator = 0
    for i, line in enumerate(lines):
        bare = line.lstrip()
        if not bare:
            first_decorator = i + 1
            continue
        indent = len(line) - len(bare)
        while running and running[-1][0] >= indent:
            running.pop()[1].end = i - 1
        as_class = class_name(line) if "class" in bare else None
        as_function = function_name(line) if "def" in bare else None
        if as_class or as_function:
            outer = bisect_left(classes, indent, key=itemgetter(0))
            parent = classes[outer - 1][1] if outer else None
            if as_class:
                found.append(Definition("class", as_class, i, parent, first_decorator))
                running.append((indent, found[-1]))
                classes[outer:] = [(indent, chunk_id(path, "class", as_class, i))]
            if as_function:
                kind = "function" if parent is None else "method"
                found.append(Definition(kind, as_function, i, parent, first_decorator))
                running.append((indent, found[-1]))
        if not bare.startswith("@"):
            first_decorator = i + 1
    return found


def _chunks(path: str | None, text: str) -> Iterator[tuple]:
    """Rows of `EXTRACTED` for one text. Contents are cut out of the joined lines only when they are asked for."""
    lines = text.splitlines()
    found = definitions(path, lines)
    if not found:
        return
    whole = "\n".join(lines)
    starts = list(accumulate((len(line) + 1 for line in lines), initial=0))
    for d in found:
        end = len(lines) - 1 if d.end is None else d.end
        yield (
            chunk_id(path, d.kind, d.name, d.line), d.kind, d.name, path, d.line + 1, 0, end + 1, len(lines[end]), d.parent,
            whole[starts[d.line] : starts[end + 1] - 1], [line.strip() for line in lines[d.first_decorator : d.line]],
        )


_TYPES = {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.ArrayType(T.StringType(), False): pa.list_(pa.string())}
_ARROW = pa.schema([(f.name, _TYPES[f.dataType]) for f in EXTRACTED.fields])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    content = EXTRACTED.names.index("content")
    rows: list[tuple] = []
    chars = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW, strict=True)], schema=_ARROW)

    for files in batches:
        for path, text in zip(files.column(0), files.column(1), strict=True):
            for row in _chunks(path.as_py(), text.as_py() or ""):
                rows.append(row)
                chars += len(row[content])
                if chars >= BATCH_CHARS or len(rows) >= BATCH_ROWS:
                    yield batch()
                    rows, chars = [], 0
    if rows:
        yield batch()


def python_chunks(files: DataFrame) -> DataFrame:
    """Files `(path, content)` to chunk rows.

    Chunks of a file keep its order of definitions through `start_line`; a block left open runs to the
    last line. Decorator lines are reported but are not part of the content. A NULL content has no chunks.
    """
    return spread(files.select("path", "content")).mapInArrow(_extract, EXTRACTED)


@dataclass(frozen=True)
class Language:
    """An indexable language: its extensions and the transform from files to chunks."""

    name: str
    extensions: tuple[str, ...]
    extract: Callable[[DataFrame], DataFrame]


_LANGUAGES: dict[str, Language] = {}


def register_language(language: Language) -> None:
    _LANGUAGES[language.name] = language


def languages() -> dict[str, Language]:
    return dict(_LANGUAGES)


register_language(Language("python", (".py",), python_chunks))


def detect_language(files: DataFrame) -> DataFrame:
    """Add `language`, NULL where no registered language claims the extension.

    The registry is a literal map inside the plan, so this is a projection rather than a join.
    """
    pairs = [F.lit(x) for lang in _LANGUAGES.values() for ext in lang.extensions for x in (ext, lang.name)]
    names = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
    return files.withColumn("language", F.try_element_at(names, extension(F.col("path"))))


def extract_chunks(files: DataFrame) -> DataFrame:
    """Chunks of all files in a registered language; other files are left out."""
    spark: SparkSession = files.sparkSession
    tagged = detect_language(files)
    parts = [lang.extract(tagged.filter(F.col("language") == lang.name)) for lang in _LANGUAGES.values()]
    if not parts:
        return python_chunks(spark.createDataFrame([], "path string, content string"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
