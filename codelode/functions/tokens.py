"""Token counts with a public byte-level BPE vocabulary (NRM-9)."""

from __future__ import annotations

import base64
import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: By how much the counts of a family of models are raised (fixed values).
RAISED = {"gpt": 1.0, "generic": 1.1, "claude": 1.15}
DEFAULT = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(path: str | None):
    """The encoding of a vocabulary of ranks, whose path is a parameter; null: the installed public one."""
    import public_tokenizers
    import tiktoken

    with open(path or str(public_tokenizers.path(DEFAULT)), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, family: str = "generic", path: str | None = None) -> int:
    """0 for an empty text, else the tokens of the vocabulary, raised for the family and rounded up."""
    if not text:
        return 0
    return math.ceil(round(len(encoding(path).encode_ordinary(text)) * RAISED[family], 6))


def token_count(text: Column, family: str = "generic", path: str | None = None) -> Column:
    """Tokens of each text; null counts 0. The vocabulary lies at the same path on every executor."""

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: count(x, family, path)).astype("int32")

    return counted(text)
