"""Sub-word token counts.

The encoder is pluggable: a vocabulary file of ranks for a byte-level BPE. Without one the
word-like counter of functions.text is the count that SQL can express.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

_encoders: dict[str, object] = {}


def encoder(path: str, pattern: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def bpe_counter(path: str | None = None, pattern: str | None = None):
    """A column function: number of sub-word tokens, 0 for null or empty; Arrow batches, one
    encoder a worker."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path, pattern)
        for texts in batches:
            yield pd.Series([len(e.encode_ordinary(t)) if t else 0 for t in texts], dtype="int32")

    return count
