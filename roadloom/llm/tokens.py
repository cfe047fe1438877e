"""Sizes of texts in tokens of a public tokenizer.

The vocabulary file is a parameter and stays outside the repository. Each Python worker loads it once; texts are
encoded whole, and only counts (or ids) leave the worker. Null texts count no tokens, empty texts none either.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("ROADLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pre-tokenizer pattern published with this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY) -> Callable[[str], list[int]]:
    """text -> token ids, for a .tiktoken rank file, a tokenizers .json file or a sentencepiece .model file."""
    if vocabulary.endswith(".tiktoken"):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if vocabulary.endswith(".json"):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.encode_special_tokens = True
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary).encode


def counts(texts: list[str | None], vocabulary: str = VOCABULARY) -> np.ndarray:
    encode = encoder(vocabulary)
    return np.fromiter((len(encode(t)) if t else 0 for t in texts), dtype=np.int64, count=len(texts))


def token_count(column: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens of each text."""

    def size(texts: pd.Series) -> pd.Series:
        return pd.Series(counts(texts.tolist(), vocabulary), index=texts.index)

    size.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(size, "bigint").asNondeterministic()(column)
