"""Packing documents into token sequences by order-preserving dynamic programming."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indexloom.llm.tokens import encoder

_SENTENCE_ENDS: dict[str, np.ndarray] = {}


@dataclass(frozen=True)
class Packing:
    """length: of a window; end_id: closes each document; sentence, word: what a cut inside a document costs, counted in
    padding; stride: a window may be cut at least every so many tokens; block: tokens that are cut together."""

    tokenizer: str
    length: int = 2048
    end_id: int = 1
    sentence: int = 4
    word: int = 24
    stride: int = 128
    block: int = 1 << 19
    id_col: str = "doc_id"
    text_col: str = "text"


def _sentence_ends(path: str) -> np.ndarray:
    """Which ids close a sentence."""
    if path not in _SENTENCE_ENDS:
        library = encoder(path).library
        vocab = library.get_vocab()
        ends = np.zeros(library.get_vocab_size(), dtype=bool)
        for token, i in vocab.items():
            ends[i] = token.removesuffix("</w>")[-1:] in (".", "!", "?")
        _SENTENCE_ENDS[path] = ends
    return _SENTENCE_ENDS[path]


def padding(length: int, window: int) -> int:
    """A sequence is padded to the window, except where its length is a power of two."""
    return 0 if length and length & (length - 1) == 0 else window - length


def cut_windows(places: np.ndarray, costs: np.ndarray, window: int) -> list[int]:
    """Ends of the windows that cut 0..places[-1] with the least padding and cost of cuts.

    `places` are the allowed ends in order, the last one is the end of all; no two are further apart than `window`.
    A window from i to j costs window - (place j - place i) and what the cut at j costs, so the best start for j is the
    one with the least cost so far plus its place, among those at most `window` before: a monotone queue holds them.
    Starts exactly a power of two before need no padding and are looked up.
    """
    all_places = np.concatenate([[0], places])
    at = all_places.tolist()
    best, came = [0] * len(at), [0] * len(at)
    ends, starts = [], []
    for power in (1 << k for k in range(window.bit_length()) if 1 << k <= window):
        start = np.searchsorted(all_places, all_places - power)
        found = np.flatnonzero(all_places[start] == all_places - power)
        ends.append(found)
        starts.append(start[found])
    at_end = np.concatenate(ends)
    exact = np.concatenate(starts)[np.argsort(at_end, kind="stable")].tolist()
    upto = np.cumsum(np.bincount(at_end, minlength=len(at))).tolist()  # of `exact`, those that end at each place or before
    queue = deque([(0, 0)])  # (cost + place, index), least first, newer ones after
    extra = [0, *costs.tolist()]
    for j in range(1, len(at)):
        place = at[j]
        while at[queue[0][1]] < place - window:
            queue.popleft()
        low, i = queue[0]
        cost = low + window - place
        for k in exact[upto[j - 1] : upto[j]]:
            if best[k] < cost:
                cost, i = best[k], k
        best[j] = cost + extra[j]
        came[j] = i
        key = best[j] + place
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    ends, j = [], len(at) - 1
    while j:
        ends.append(at[j])
        j = came[j]
    return ends[::-1]


def _places(ids: np.ndarray, ends: np.ndarray, how: Packing) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end in a run of documents that end at `ends`, and what each costs."""
    closing = np.flatnonzero(_sentence_ends(how.tokenizer)[np.minimum(ids, len(_sentence_ends(how.tokenizer)) - 1)]) + 1
    sure = np.union1d(closing, ends)
    gaps = np.diff(sure, prepend=0)
    long = np.flatnonzero(gaps > how.stride)
    begins = (sure - gaps)[long]
    more = [np.arange(b + how.stride, e, how.stride) for b, e in zip(begins, sure[long], strict=True)]
    places = np.union1d(sure, np.concatenate(more)) if more else sure
    costs = np.full(len(places), how.word)
    costs[np.searchsorted(places, closing)] = how.sentence
    costs[np.searchsorted(places, ends)] = 0
    return places, costs


PIECE = pa.schema(
    [
        ("doc", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("ids", pa.list_(pa.int32())),
    ]
)


def _pack_block(block: list[tuple[int, bytes]], how: Packing, first: int) -> tuple[dict[str, list], int]:
    """Pieces of a run of documents (number, ids) and how many sequences they fill, numbered from `first`."""
    sizes = [len(b) // 4 for _, b in block]
    ends = np.cumsum(sizes)
    raw = b"".join(b for _, b in block)
    places, costs = _places(np.frombuffer(raw, dtype="<u4"), ends, how)
    windows = cut_windows(places, costs, how.length)
    out: dict[str, list] = {name: [] for name in PIECE.names}
    k, begin = 0, 0
    for number, end in enumerate(windows):
        at = begin
        while at < end:
            doc_end = int(ends[k])
            stop = min(end, doc_end)
            data = raw[4 * at : 4 * stop]
            row = (block[k][0], at - doc_end + sizes[k], stop - at, zlib.crc32(data), sizes[k], first + number, at - begin, data)
            for name, value in zip(PIECE.names, row, strict=True):
                out[name].append(value)
            at = stop
            k += stop == doc_end
        begin = end
    return out, len(windows)


def pack(docs: DataFrame, how: Packing) -> DataFrame:
    """All documents as pieces of sequences of at most `length` tokens, in their order.

    Documents follow one another as they are stored, each closed by `end_id`; a partition is cut in blocks of whole
    documents of about `block` tokens, so a task holds one block at a time, and sequences are numbered by partition.
    Windows end at ends of documents or sentences, or inside sentences only for a price, so that padding and cuts are
    least in sum. A longer document simply goes on in the next window. Null and empty texts are the closing id alone;
    repeated rows are packed each; an empty table has no pieces. No shuffle.

    Columns: the id, start and length of the piece in its document, CRC-32 of its ids, the document's tokens, the
    sequence, the piece's offset in it, and the ids.
    """
    kind = docs.schema[how.id_col].dataType.simpleString()
    source = docs.select(F.col(f"`{how.id_col}`").alias("id"), F.coalesce(F.col(f"`{how.text_col}`"), F.lit("")).alias("text"))
    schema = f"id {kind}, " + ", ".join(f"{n} long" for n in PIECE.names[1:-1]) + ", ids array<int>"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, closing = encoder(how.tokenizer), np.array([how.end_id], dtype="<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        block: list[tuple[int, bytes]] = []
        held: list[pa.Array] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal first, tokens
            pieces, n = _pack_block(block, how, first)
            first += n
            ids = pa.concat_arrays(held).take(pa.array(pieces["doc"]))
            data = np.frombuffer(b"".join(pieces["ids"]), dtype="<i4")
            offsets = np.concatenate([[0], np.cumsum(pieces["length"])]).astype(np.int32)
            arrays = [ids, *[pa.array(pieces[n], pa.int64()) for n in PIECE.names[1:-1]]]
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(data)))
            block.clear()
            held.clear()
            tokens = 0
            return pa.RecordBatch.from_arrays(arrays, ["id", *PIECE.names[1:]])

        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                for k, ids in enumerate(own.batch_ids(part.column(1).to_pylist())):
                    held.append(part.column(0).slice(k, 1))
                    block.append((len(block), ids + closing))
                    tokens += len(ids) // 4 + 1
                    if tokens >= how.block:
                        yield flush()
        if block:
            yield flush()

    out = source.mapInArrow(packed, schema)
    return out.withColumnRenamed("id", how.id_col)
