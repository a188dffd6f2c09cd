"""Shell globs as regular expressions for `rlike`."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from indexloom.functions.text import basename


def glob_regex(pattern: str) -> str:
    """Body of a regular expression for a glob over one path segment: `*`, `?`, `[ab]`, `[!ab]`."""

    def piece(m: re.Match) -> str:
        token = m.group()
        if token == "*":
            return "[^/]*"
        if token == "?":
            return "[^/]"
        if len(token) > 2 and token[0] == "[":
            negate, members = ("^", token[2:-1]) if token[1] == "!" else ("", token[1:-1])
            return "[" + negate + re.sub(r"([\\\[\]^&~|])", r"\\\1", members) + "]"
        return re.sub(r"([^\w\s])", r"\\\1", token)

    return re.sub(r"\*|\?|\[!?\]?[^\]]*\]|.", piece, pattern, flags=re.S)


def basename_matches(path: Column, pattern: str) -> Column:
    return basename(path).rlike(rf"(?s)\A(?:{glob_regex(pattern)})\z")


def directory_matches(path: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """True when any directory of a relative path matches one of the globs."""
    one = "|".join(glob_regex(p) for p in patterns)
    return path.rlike(rf"(?s)(?:\A|/)(?:{one})/")
