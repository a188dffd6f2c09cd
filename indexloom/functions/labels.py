"""Extension to language name, for display."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from indexloom.functions.text import extension

# Extension and the language name shown for it.
LANGUAGE_NAMES = {
    ".py": "python",
    ".js": "javascript",
    ".html": "html",
    ".css": "css",
    ".json": "json",
    ".md": "markdown",
    ".sh": "bash",
    ".java": "java",
    ".c": "c",
    ".cpp": "cpp",
    ".go": "go",
    ".rb": "ruby",
    ".rs": "rust",
    ".ts": "typescript",
    ".tsx": "tsx",
    ".jsx": "jsx",
    ".sql": "sql",
    ".php": "php",
    ".yml": "yaml",
    ".yaml": "yaml",
    ".xml": "xml",
}


def language_label(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(LANGUAGE_NAMES.items())])
    return F.coalesce(F.try_element_at(names, extension(path)), F.lit("text"))
