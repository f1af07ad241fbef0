"""Token counts with a public byte-level tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that belongs to this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, vocabulary: str = VOCABULARY) -> int:
    """Tokens of a whole text; 0 for null. Special tokens in the text are ordinary characters. Time is about linear, runs without blanks included."""
    return len(encoder(vocabulary).encode_ordinary(text)) if text else 0


def n_tokens(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """A column of token counts."""

    @F.pandas_udf("long")
    def counted(s: pd.Series) -> pd.Series:
        return pd.Series([count_tokens(x if isinstance(x, str) else None, vocabulary) for x in s], dtype="int64")

    return counted(text)
