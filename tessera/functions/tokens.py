"""Token counts of texts.

With a rank file (lines of base64 bytes and rank) the count is that vocabulary's; without one it is
a quarter of the bytes, rounded up, which needs no Python.  The file is named by its path, which
executors must see, and is loaded once in each Python worker.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.session import bound_batches

PATTERN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
# the local byte-level vocabulary and the pattern it is used with
RANKS = os.environ.get("TESSERA_BPE", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
RANKS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TokenCounter = Callable[[Column], Column]


@lru_cache(8)
def encoding(path: str, pattern: str = PATTERN, special: tuple[tuple[str, int], ...] = ()):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special))


def by_quarter_bytes(text: Column) -> Column:
    """Estimate: a token for every four bytes."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def by_ranks(path: str, pattern: str = PATTERN, special: dict[str, int] | None = None) -> TokenCounter:
    """Counter of a byte-level vocabulary; special strings in a text count as one token each."""
    extra = tuple(sorted((special or {}).items()))

    def count(texts: pa.Array) -> pa.Array:
        enc = encoding(path, pattern, extra)
        return pa.array([len(enc.encode(t.as_py(), allowed_special="all")) if t.is_valid else None for t in texts], pa.int64())  # one decoded at a time

    counted = F.arrow_udf(count, "long")

    def counter(text: Column) -> Column:
        if spark := SparkSession.getActiveSession():
            bound_batches(spark)
        return counted(text)

    return counter


def local(path: str = RANKS) -> TokenCounter:
    """Counter of the local rank file; a quarter of the bytes only where there is none."""
    return by_ranks(path, RANKS_PATTERN) if os.path.exists(path) else by_quarter_bytes
