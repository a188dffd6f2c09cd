"""Text columns: decoding, line rules, previews and size labels."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the text rules of the indexed sources count as white space (control breaks, NEL and
# the Unicode space separators), as a character class and as characters, and as a line break.
WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
RARE_BREAKS = ("\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
ANY_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
WORD = r"[\p{L}\p{N}_]"
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")


def decode_utf8_lossy(raw: Column) -> Column:
    """Bytes to text, dropping what is not UTF-8.

    `make_valid_utf8` marks bad bytes with U+FFFD. A U+FFFD that was in the input must survive, so
    it is first written with an escape character, which in turn is escaped itself.
    """
    esc = F.lit("\x1a")
    text = raw.cast("string")
    text = F.replace(text, esc, F.lit("\x1ae"))
    text = F.replace(text, F.lit("\ufffd"), F.lit("\x1ar"))
    text = F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit(""))
    text = F.replace(text, F.lit("\x1ar"), F.lit("\ufffd"))
    return F.replace(text, F.lit("\x1ae"), esc)


def normalise_newlines(text: Column) -> Column:
    """`\\r\\n` and lone `\\r` become `\\n`, as in text-mode reading."""
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def strip_ws(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.trim(text, F.lit(WHITE_CHARS))


def lstrip_ws(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITE_CHARS))


def is_blank(text: Column) -> Column:
    return lstrip_ws(text) == ""


def split_lines(text: Column) -> Column:
    """Lines at every kind of line break; a final break does not open one more line.

    Most texts only have `\\n`; looking for the others byte-wise and splitting at one character is far
    cheaper than splitting by a pattern. The last step names `whole` three times without a condition, so that it is computed once.
    """
    rare = reduce(or_, [F.contains(text, F.lit(mark)) for mark in RARE_BREAKS])
    whole = F.when(rare, F.split(text, ANY_BREAK, -1)).otherwise(F.split(text, "\n", -1))
    return F.slice(whole, 1, F.size(whole) - (F.element_at(whole, -1) == "").cast("int"))


def line_count(text: Column) -> Column:
    return F.size(split_lines(text))


def indent_width(line: Column) -> Column:
    """Number of leading white-space characters; a tab counts as one."""
    return F.length(line) - F.length(lstrip_ws(line))


def human_size(n_bytes: Column) -> Column:
    """`1536 -> '1.5 KB'`: base 1024, two decimals. The unit is found by comparing with integer
    powers, so an exact power of 1024 cannot fall into the unit below."""
    label = F.lit("0 B")
    for power, unit in enumerate(SIZE_UNITS[:7]):  # a bigint ends in the EB range
        value = F.round(n_bytes.cast("double") / float(1024**power), 2)
        label = F.when(n_bytes >= F.lit(1024**power), F.concat_ws(" ", value.cast("string"), F.lit(unit))).otherwise(
            label
        )
    return label


def context_window(text: Column, context: int) -> Column:
    """The middle `2 * context` lines with the first line's number, or the whole text when it is
    not longer than that. Lines end at `\\n` only."""
    lines = F.split(text, "\n", -1)
    n = F.size(lines)
    middle = F.floor(n / 2).cast("int")
    start = F.greatest(F.lit(0), middle - context)
    end = F.least(n, middle + context)
    longer = n > 2 * context
    return F.struct(
        F.when(longer, F.array_join(F.slice(lines, start + 1, end - start), "\n")).otherwise(text).alias("content"),
        F.when(longer, start + 1).otherwise(1).alias("start_line"),
    )


def snippet(text: Column, size: int = 500) -> Column:
    """The first `size` characters and whether anything was cut off."""
    return F.struct(
        F.substring(text, 1, size).alias("snippet"),
        (F.length(text) > size).alias("truncated"),
    )


def file_preview(text: Column, max_lines: int = 20) -> Column:
    """The first lines, then a note with the number of lines left out."""
    lines = F.split(text, "\n", -1)
    left = F.size(lines) - max_lines
    return F.when(
        left > 0,
        F.concat(
            F.array_join(F.slice(lines, 1, max_lines), "\n"),
            F.format_string("\n... (%d more lines)", left),
        ),
    ).otherwise(text)


def percent(score: Column) -> Column:
    return F.round(score * 100, 1)


def relative_path(path: Column, root: str) -> Column:
    """Path below `root`; a path elsewhere stays as it is."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 2**31 - 1)).otherwise(path)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot. Leading dots do not start one, so `.profile` has none."""
    return F.lower(F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$", 1))
