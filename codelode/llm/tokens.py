"""Encoding of a corpus with a public byte-level BPE vocabulary by forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token is never merged over, so a
text may be cut there and the pieces encoded on their own: the concatenated ids are those of
the whole text. Cuts are kept between characters, never behind white space (the pre-tokeniser
looks ahead from white space) and never before an apostrophe (which may start a contraction),
so that the pieces are pre-tokenised as the whole text is. Pieces repeat very often; each
distinct one is encoded once per worker.

Defined results: a null and an empty text give an empty list; text that looks like a special
token is plain text; a very long text is one row of pieces and needs no special case; every
row comes out, repeated rows too; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces kept per worker; beyond that the memory starts afresh, results are the same.
KEPT_PIECES = 200_000
WHITE = np.array([*range(9, 14), *range(0x1C, 0x20), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)


def vocabulary_path(path: str | None = None) -> str:
    """`path`, or where the installed public vocabulary lies."""
    if path:
        return path
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def inner_pairs(ranks) -> np.ndarray:
    """inside[a, b]: bytes a and b stand side by side inside some token."""
    inside = np.zeros((256, 256), dtype=bool)
    for token in ranks:
        t = np.frombuffer(token, dtype=np.uint8)
        inside[t[:-1], t[1:]] = True
    return inside


class Encoder:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        ranks = read_ranks(path)
        self.inside = inner_pairs(ranks)
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kept: dict[str, list[int]] = {}

    def cuts(self, text: str) -> list[int]:
        """Character positions at which the text may be cut."""
        cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        if len(cp) < 2:
            return []
        last = np.where(cp < 0x80, cp, 0x80 | (cp & 0x3F))[:-1]
        right = cp[1:]
        first = np.where(right < 0x80, right, np.where(right < 0x800, 0xC0 | (right >> 6), np.where(right < 0x10000, 0xE0 | (right >> 12), 0xF0 | (right >> 18))))
        free = ~self.inside[last, first] & (right != 0x27) & ~np.isin(cp[:-1], WHITE)
        return (np.flatnonzero(free) + 1).tolist()

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        start, kept = 0, self.kept
        for end in [*self.cuts(text), len(text)]:
            piece = text[start:end]
            start = end
            got = kept.get(piece)
            if got is None:
                got = self.bpe.encode_ordinary(piece)
                if len(piece) <= 64:
                    if len(kept) >= KEPT_PIECES:
                        kept.clear()
                    kept[piece] = got
            ids += got
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_column(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids): the ids of every row's text; key may be any column that is to be kept. The vocabulary
    file must lie at the same path on every executor."""
    file = vocabulary_path(path)
    kind = df.schema[key].dataType

    def run(batches):
        enc = encoder(file)
        for b in batches:
            ids = [enc.encode(t) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind.simpleString()}, ids array<int>")
