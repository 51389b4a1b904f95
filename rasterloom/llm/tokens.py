"""Public byte-level BPE vocabularies, loaded once in each Python worker; the file is a parameter and is never copied."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: A tiktoken rank file and the pattern that its pre-tokenizer splits by.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts: pa.Array, path: str = VOCABULARY) -> list[list[int]]:
    """Token ids of every text, all of it ordinary text; none for a null."""
    e = encoding(path).encode_ordinary
    return [e(t) if t else [] for t in texts.to_pylist()]


def lengths(texts: pa.Array, path: str = VOCABULARY) -> np.ndarray:
    e = encoding(path).encode_ordinary
    return np.fromiter((len(e(t)) if t else 0 for t in texts.to_pylist()), np.int64, len(texts))
