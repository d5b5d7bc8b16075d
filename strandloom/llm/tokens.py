"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The vocabulary: a file of the tokenizers' package that every node has, or a path.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str | None):
    import tiktoken

    if "/" not in path:
        from public_tokenizers import path as place

        path = place(path)
    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: str | Column, path: str = VOCABULARY, pattern: str | None = None) -> Column:
    """Number of tokens; a null or empty text has none."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path, pattern).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(F.col(text) if isinstance(text, str) else text)
