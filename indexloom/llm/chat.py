"""Chat formatting with a grammar round trip."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The grammar: a conversation is turns one after another; a turn is OPEN role ": " text "\n" CLOSE "\n". A control string
# counts as text where an odd number of backslashes stands right before it; half of the others are then the text's own.
OPEN, CLOSE = "### ", "</turn>"
_CONTROL = re.compile(r"(?<!\\)(\\*+)(###|</turn>)")
_ROLE_SAFE = re.compile(r"[^a-z0-9_]")
_SHOWN = {"system": "System", "user": "User", "assistant": "Assistant"}
_BY_NAME = {shown: role for role, shown in _SHOWN.items()}


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1][: (len(m[1]) - 1) // 2] + m[2] if len(m[1]) % 2 else m[0], text)


def _role_name(role: str) -> str:
    return _ROLE_SAFE.sub(lambda m: f"%{ord(m[0]):X};", role)


def _role(name: str) -> str:
    return re.sub(r"%([0-9A-F]+);", lambda m: chr(int(m[1], 16)), name)


def render_turn(role: str, text: str) -> str:
    return f"{OPEN}{_SHOWN.get(role) or _role_name(role)}: {text}\n{CLOSE}\n"


@dataclass(frozen=True)
class Turn:
    """A turn as the parser reads it: `start` and `end` are where its text stands in what was parsed, still escaped."""

    role: str
    text: str
    start: int
    end: int


def parse(text: str) -> list[Turn] | None:
    """The turns of a rendered conversation, or None if the grammar does not hold. Reads from left to right, once."""
    turns, at = [], 0
    while at < len(text):
        colon = text.find(": ", at)
        if not text.startswith(OPEN, at) or colon < 0:
            return None
        name = text[at + len(OPEN) : colon]
        start = colon + 2
        close = None
        for m in _CONTROL.finditer(text, start):
            if len(m[1]) % 2:
                continue
            close = m
            break
        # a control string inside a text ends it, so an opening one there breaks the grammar
        if close is None or close[2] != CLOSE or close[1] or text[close.start() - 1] != "\n" or close.start() <= start:
            return None
        if not text.startswith("\n", close.end()) or "\n" in name:
            return None
        end = close.start() - 1
        turns.append(Turn(_BY_NAME.get(name) or _role(name), unescape(text[start:end]), start, end))
        at = close.end() + 1
    return turns


def format_turn(role: str, text: str) -> str:
    """The turn rendered plain if a parser reads the same turn back, else with its control strings escaped, until it does."""
    for shown in (text, escape(text)):
        out = render_turn(role, shown)
        read = parse(out)
        if read is not None and [(t.role, t.text) for t in read] == [(role, text)]:
            return out
    raise ValueError(f"turn of role {role!r} does not survive a round trip")


PART_CHARS = 1 << 20


def format_conversations(turns: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """Conversations as text: (conv_id, part, text), the parts of one in order, each of whole turns.

    `turns` has conv_id, turn, role and text; other columns are left aside. Rows are sorted by conversation and turn (null
    first; then role and text) and streamed, so a task holds a part and never a conversation; a long conversation has
    several parts, whose texts joined are its text. Every turn is parsed again and compared before it is let out. Null
    texts and roles count as empty, a null conv_id is a conversation of its own, repeated rows are turns each.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    text, role = (F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "role"))
    ordered = turns.select("conv_id", "turn", role, text)
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple | None = None
        part, held, chars = 0, [], 0

        def closed() -> pa.RecordBatch:
            conv = pa.array([own[0]], pa_kind)
            return pa.RecordBatch.from_arrays([conv, pa.array([part], pa.int64()), pa.array(["".join(held)])], ["conv_id", "part", "text"])

        pa_kind = None
        for batch in batches:
            pa_kind = batch.column(0).type
            for conv, r, t in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if own != (conv,) or chars >= part_chars:
                    if held:
                        yield closed()
                    part = part + 1 if own == (conv,) else 0
                    own, held, chars = (conv,), [], 0
                held.append(format_turn(r, t))
                chars += len(held[-1])
        if held:
            yield closed()

    return ordered.mapInArrow(formatted, f"conv_id {kind}, part long, text string")


def with_loss_mask(parts: DataFrame) -> DataFrame:
    """The same with `loss`, the places (start, end) in the part's text on which an assistant is trained."""
    kind = parts.schema["conv_id"].dataType.simpleString()

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"start": t.start, "end": t.end} for t in parse(x) if t.role == "assistant"] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, shape)], ["conv_id", "part", "text", "loss"])

    return parts.mapInArrow(masked, f"conv_id {kind}, part long, text string, loss array<struct<start: long, end: long>>")


def read_back(masked: DataFrame) -> DataFrame:
    """One row per conversation, read from formatted parts with their loss masks in the order they come out in.

    Turns come from the parser, what is trained on from the mask alone; digests are fed part by part.
    """
    kind = masked.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        own, pa_kind = None, None
        n = loss = chars = 0
        turns_digest, loss_digest = hashlib.sha256(), hashlib.sha256()

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            types = [pa_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            pa_kind = batch.column(0).type
            for conv, _, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != (conv,):
                    if own is not None:
                        rows.append((own[0], n, turns_digest.hexdigest(), loss, loss_digest.hexdigest(), chars))
                    own, n, loss, chars = (conv,), 0, 0, 0
                    turns_digest, loss_digest = hashlib.sha256(), hashlib.sha256()
                for t in parse(text):
                    turns_digest.update(f"{t.role}\n{t.text}\n".encode())
                    n += 1
                for span in spans:
                    learnt = unescape(text[span["start"] : span["end"]])
                    loss_digest.update(learnt.encode())
                    loss += len(learnt)
                chars += len(text)
            if len(rows) >= 1000:
                yield out()
        if own is not None:
            rows.append((own[0], n, turns_digest.hexdigest(), loss, loss_digest.hexdigest(), chars))
            yield out()

    return masked.mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
