"""Text to vectors.

A model is a map: rows go in, the same rows with a vector come out. Nothing is grouped or joined, so equal
keys stay separate rows and no text is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from indexloom.session import spread

KNOWN_TOKENS = 50_000  # whose slots a task remembers
BATCH_CHARS = 1 << 22  # of texts that are encoded at a time, but for a single longer one
Encoder = Callable[[list[str]], np.ndarray]
VECTOR = T.ArrayType(T.FloatType(), False)


@dataclass(frozen=True)
class Model:
    """A named embedder: `embed(rows, text_column)` gives the rows and their `vector`; NULL texts are left out."""

    name: str
    dim: int
    embed: Callable[[DataFrame, str], DataFrame]


_MODELS: dict[str, Model] = {}


def register_model(model: Model) -> None:
    _MODELS[model.name] = model


def get_model(name: str) -> Model:
    if name not in _MODELS:
        raise KeyError(f"unknown embedding model {name!r}; registered: {', '.join(sorted(_MODELS))}")
    return _MODELS[name]


def _stretches(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Slices of at most `most` texts, and of BATCH_CHARS bytes where they are more than one."""
    ends, lo = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
    while lo < len(texts):
        held = ends[lo - 1] if lo else 0
        hi = max(lo + 1, min(lo + most, int(np.searchsorted(ends, held + BATCH_CHARS, "right"))))
        yield texts.slice(lo, hi - lo)
        lo = hi


def _with_vectors(rows: DataFrame, text: Column, open_model: Callable[[], Callable[[pa.Array], np.ndarray]], batch_size: int) -> DataFrame:
    """The rows with a non-null text and the vectors of their texts, `batch_size` texts at a time.

    Only the texts go to Python and only the vectors come back; the rest of a row stays where it is.
    """

    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = open_model()
        for texts in batches:
            found = [np.asarray(encode(part), dtype="f4") for part in _stretches(texts, batch_size)]
            flat = pa.array(np.concatenate([x.ravel() for x in found]) if found else np.zeros(0, "f4"))
            ends = np.cumsum([0, *(x.shape[1] for x in found for _ in range(len(x)))], dtype="i4")
            yield pa.ListArray.from_arrays(pa.array(ends), flat)

    # not deterministic as far as the planner knows: it must not run the model again for a filter on what comes of a vector
    embed = F.arrow_udf(vectors, VECTOR).asNondeterministic()
    return spread(rows.drop("vector").filter(text.isNotNull())).withColumn("vector", embed(text))


def _hashing(dim: int) -> Callable[[pa.Array], np.ndarray]:
    known: dict[str, tuple[int, int]] = {}

    def slot(token: str) -> tuple[int, int]:
        if token not in known:
            digest = hashlib.md5(token.encode()).hexdigest()
            if len(known) >= KNOWN_TOKENS:
                known.clear()
            known[token] = int(digest[:8], 16) % dim, (-1 if digest[-1] >= "8" else 1) if token else 0
        return known[token]

    def encode(texts: pa.Array) -> np.ndarray:
        words = pc.ascii_split_whitespace(texts)  # at blanks, tabs, \n, \r, \f and \v; ends in an empty token after a last one
        tokens = words.flatten().dictionary_encode()
        slots = np.array([slot(t) for t in tokens.dictionary.to_pylist()], dtype="i8").reshape(-1, 2)
        rows = np.repeat(np.arange(len(texts)), words.value_lengths().to_numpy(zero_copy_only=False))
        at, sign = slots[tokens.indices.to_numpy(zero_copy_only=False)].T
        counts = np.bincount(rows * dim + at, weights=sign.astype("f8"), minlength=len(texts) * dim).astype("f8", copy=False).reshape(-1, dim)
        norms = np.sqrt((counts**2).sum(axis=1, keepdims=True))
        return np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)

    return encode


def hashed_vectors(rows: DataFrame, text: str, dim: int = 64) -> DataFrame:
    """Feature hashing (Weinberger et al. 2009): signed token counts in `dim` slots, L2-normalised.

    A text without tokens gets the zero vector. Texts are lower-cased by Spark, for the same result as its SQL.
    """
    return _with_vectors(rows, F.lower(text), lambda: _hashing(dim), 1024)


def hashing_model(dim: int = 64) -> Model:
    return Model(f"hash-{dim}", dim, lambda rows, text: hashed_vectors(rows, text, dim))


def batched_model(name: str, dim: int, open_model: Callable[[], Encoder], batch_size: int = 64) -> Model:
    """A model called from Python: `open_model` runs once per task and returns texts -> (n, dim) array."""

    def opened() -> Callable[[pa.Array], np.ndarray]:
        encode = open_model()
        return lambda texts: encode(texts.to_pylist())

    return Model(name, dim, lambda rows, text: _with_vectors(rows, F.col(text), opened, batch_size))


register_model(hashing_model(64))
