"""Which files of a listing belong to a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from indexloom.functions.globs import basename_matches, directory_matches
from indexloom.functions.text import extension

MAX_KB = 100

# Globs of directory names that are not descended into. The index's own folder is one.
PRUNED_DIRECTORIES = (
    ".git",
    ".indexloom",
    "node_modules",
    ".DS_Store",
    "build",
    "dist",
    "venv",
    "__pycache__",
    ".*cache",
)

# Extensions accepted by the extension form of the text check.
TEXT_EXTENSIONS = (
    ".txt", ".md", ".js", ".py", ".html", ".css", ".json", ".yaml", ".yml", ".xml", ".csv",
    ".sh", ".bash", ".conf", ".cfg", ".ini", ".rs", ".go", ".java", ".c", ".cpp", ".h", ".hpp",
    ".jsx", ".tsx", ".vue", ".rb", ".php", ".sql", ".swift", ".kt", ".scala", ".ts",
)


def within_size(max_kb: int = MAX_KB) -> Column:
    """At most `max_kb` KB; compared in bytes so that the test reaches the scan."""
    return F.col("length") <= max_kb * 1024


def not_pruned(path: Column, patterns: tuple[str, ...] = PRUNED_DIRECTORIES) -> Column:
    """No directory of the path matches. File names are not tested."""
    return ~directory_matches(path, patterns)


def select_files(
    files: DataFrame,
    listed: DataFrame | None = None,
    include: str | None = None,
    exclude: str | None = None,
    max_kb: int | None = MAX_KB,
    text_check: str = "none",
    pruned: tuple[str, ...] = PRUNED_DIRECTORIES,
) -> DataFrame:
    """Files `(path, length, ...)` of a full listing that belong to the corpus.

    Without `listed`, files below pruned directories are dropped. With it (paths from version control),
    only listed files stay. `include` adds every file whose name matches, wherever it lies; as it picks
    from the same listing this is a disjunction, not a union, and no file appears twice. `exclude` drops
    by name, `text_check="extension"` keeps known text extensions.
    """
    path = F.col("path")
    wanted = basename_matches(path, include) if include else None
    if listed is None:
        keep = not_pruned(path, pruned)
        files = files.filter(keep | wanted if wanted is not None else keep)
    else:
        paths = listed.select("path").distinct()
        if wanted is None:
            files = files.join(paths, "path", "left_semi")
        else:
            flagged = files.join(paths.withColumn("_listed", F.lit(True)), "path", "left")
            files = flagged.filter(F.col("_listed") | wanted).drop("_listed")
    if exclude:
        files = files.filter(~basename_matches(path, exclude))
    if max_kb is not None:
        files = files.filter(within_size(max_kb))
    if text_check == "extension":
        files = files.filter(extension(path).isin(*TEXT_EXTENSIONS))
    elif text_check != "none":
        raise ValueError(f"unknown text check {text_check!r}")
    return files
