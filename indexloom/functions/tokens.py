"""Token counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_OR_MARK = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def word_token_count(text: Column) -> Column:
    """Words and single punctuation marks, counted natively."""
    return F.regexp_count(text, F.lit(WORD_OR_MARK)).cast("long")


def encoder_token_count(make_encoder: Callable[[], Callable[[str], list]]) -> Callable[[Column], Column]:
    """A counter around any tokenizer. `make_encoder` runs once per task and returns text -> tokens."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_encoder()
        for texts in batches:
            yield texts.map(lambda t: None if t is None else len(encode(t))).astype("Int64")

    return count
