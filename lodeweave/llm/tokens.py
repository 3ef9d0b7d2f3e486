"""Token counts of a public byte-level BPE, measured in Arrow batches."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str):
    """The encoder of a rank file, once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sent(path: str) -> str:
    """The rank file is sent to the executors with the job, so that it need not lie on each of them."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is not None and os.path.exists(path):
        spark.sparkContext.addFile(path)
    return path


def _here(path: str) -> str:
    """The file as sent, else the path itself."""
    from pyspark import SparkFiles

    sent = SparkFiles.get(os.path.basename(path)) if SparkFiles._root_directory or os.environ.get("SPARK_FILES") else path
    return sent if os.path.exists(sent) else path


def token_count(text: Column, path: str = RANKS) -> Column:
    """Number of tokens of the whole text; null and empty texts have 0. Special tokens are ordinary text."""

    where = _sent(path)

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(_here(where))
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int32")

    return count(text)
