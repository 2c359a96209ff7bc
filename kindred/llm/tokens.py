"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a rank file of a byte-level vocabulary, and the public pattern that cuts texts before merging
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def with_tokens(documents: DataFrame, text: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """documents with a column n_tokens; 0 for a null or empty text. ranks is a path every executor can read; each task loads it once."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        for batch in batches:
            yield pd.Series([len(coder.encode_ordinary(t)) if t else 0 for t in batch], dtype="int64")

    return documents.withColumn("n_tokens", count(F.col(text)))
