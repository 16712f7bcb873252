"""Byte-level BPE encoding and decoding (operator 6).

A text is cut into pre-tokens by the tokenizer's pattern.  The bytes of a pre-token are mapped to
Latin-1 characters, so that one Aho-Corasick automaton over the vocabulary (pyahocorasick) finds the
longest entry at every byte.  The encoder walks left to right: it takes the longest entry, accepts
it if merging would leave it beside the entry before it, else tries the next shorter entry, and steps
back where none fits.  Compatibility of two neighbours is decided by undoing their merges along the
boundary and is memoised; a place that has failed is marked and never tried again, so the time is
linear.  The result is exactly what applying the merges in rank order gives.

The vocabulary file stays where it is; its path is a parameter.  The driver reads it, and its bytes (some
megabytes, MAX_VOCABULARY at most) are broadcast, so executors need no copy of it.  A vocabulary must hold every
single byte, else some texts couldn't be encoded; one that doesn't is refused.  Encodings of pre-tokens are kept
in a table of bounded size in each Python worker.

Defined cases: a null text gives null tokens, an empty one an empty list; null or repeated ids are
rows like others, one result for each row in any order; a pre-token may have any length; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import common as C

VOCABULARY = os.environ.get("TESSERA_BPE", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_VOCABULARY = 64 << 20
#: Pre-tokens and neighbouring pairs that each Python worker remembers: some 40 and 30 MB.
KEPT_WORDS, KEPT_PAIRS = 150_000, 250_000
_NONE = 1 << 60


class Codec:
    """Encoder and decoder of one vocabulary of (bytes, rank)."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes, the first is {missing[0]:#04x}")
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * self.size
        self.auto = ahocorasick.Automaton()
        for b, r in ranks.items():
            self.bytes[r] = b
            self.auto.add_word(b.decode("latin-1"), (len(b), r))
        self.auto.make_automaton()
        self.pairs: dict[tuple[int, int], int] = {}
        self.memo: dict[int, bool] = {}
        self.split: list[tuple[int, int]] = [(i, i) for i in range(self.size)]
        self.shorter: list[int] = [-1] * self.size
        for r in range(self.size):
            b = self.bytes[r]
            for n in range(len(b) - 1, 0, -1):
                if (s := ranks.get(b[:n])) is not None:
                    self.shorter[r] = s
                    break
        for r in range(self.size):
            b, left = self.bytes[r], self.shorter[r]
            while left >= 0:
                right = ranks.get(b[len(self.bytes[left]) :])
                if right is not None and left < r and right < r and self._fits(left, right):
                    self.pairs[left, right] = r
                    self.split[r] = (left, right)
                    break
                left = self.shorter[left]

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging leaves a and b beside each other: no merge across the boundary comes before one that made them."""
        pairs, split, limit = self.pairs, self.split, _NONE
        while True:
            if pairs.get((a, b), _NONE) < limit:
                return False
            if a > b:
                limit = a
                a = split[a][1]
                if a == limit:
                    limit = b + 1
                    b = split[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = split[b][0]
                if b + 1 == limit:
                    limit = a
                    a = split[a][1]
                    if a == limit:
                        return True

    def fits(self, a: int, b: int) -> bool:
        k = a * self.size + b
        v = self.memo.get(k)
        if v is None:
            if len(self.memo) >= KEPT_PAIRS:
                self.memo.clear()
            v = self.memo[k] = self._fits(a, b)
        return v

    def encode_bytes(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        longest = [-1] * n
        for end, (size, r) in self.auto.iter(raw.decode("latin-1")):
            longest[end - size + 1] = r  # ends ascend, so the last is the longest
        out: list[int] = []
        open_ = bytearray(b"\x01") * (n + 1)
        at, token, words, shorter = 0, longest[0] if n else -1, self.bytes, self.shorter
        while at < n:
            last = out[-1] if out else -1
            while True:
                end = at + len(words[token])
                if open_[end] and (last < 0 or self.fits(last, token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                token = shorter[token]
                if token < 0:
                    open_[at] = 0
                    token = out.pop()
                    at -= len(words[token])
                    token = shorter[token]
                    while token < 0:  # the entry before it has to change too
                        open_[at] = 0
                        token = out.pop()
                        at -= len(words[token])
                        token = shorter[token]
                    last = out[-1] if out else -1
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class _Words(dict):
    """Pre-token -> its ids as packed 32-bit integers."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        ids = self.codec.encode_bytes(word.encode("utf-8"))
        packed = np.array(ids, "<i4").tobytes()
        if len(word) <= 64:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = packed
        return packed


_loaded: dict[bytes, tuple[Codec, _Words]] = {}
_read: dict[str, bytes] = {}


def vocabulary(path: str) -> bytes:
    """Content of a rank file."""
    if path not in _read:
        if (size := os.path.getsize(path)) > MAX_VOCABULARY:
            raise ValueError(f"{path} has {size} bytes, more than a vocabulary may have")
        with open(path, "rb") as f:
            _read[path] = f.read()
    return _read[path]


def codec_of(raw: bytes) -> tuple[Codec, _Words]:
    """Codec of the content of a rank file, once in each Python process."""
    key = hashlib.sha256(raw).digest()
    if key not in _loaded:
        codec = Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())})
        _loaded[key] = codec, _Words(codec)
    return _loaded[key]


def load(path: str) -> tuple[Codec, _Words]:
    return codec_of(vocabulary(path))


def encode(text: str, path: str = VOCABULARY) -> list[int]:
    import regex

    words = load(path)[1]
    return np.frombuffer(b"".join([words[w] for w in regex.findall(PATTERN, text)]), "<i4").tolist()


def decode(ids: Iterable[int], path: str = VOCABULARY) -> str:
    return load(path)[0].decode(ids).decode("utf-8", "replace")


def _encode_batches(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        codec, words = codec_of(shared.value)
        find, get = regex.compile(PATTERN).findall, words.__getitem__
        lengths = np.array([len(b) for b in codec.bytes], np.int64)
        table = np.frombuffer(b"".join(codec.bytes), np.uint8)
        begin = np.cumsum(lengths) - lengths
        for batch in batches:
            data, off = C.buffers(batch.column(1))
            for i, j, d, o in C.pieces(data, off):
                texts = batch.column(1)[i:j]
                packed = [b"" if t is None else b"".join(map(get, find(t))) for t in texts.to_pylist()]
                offsets = np.zeros(j - i + 1, np.int32)
                np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
                ids = np.frombuffer(b"".join(packed), "<i4")
                # decoded again, all rows at once, and held against the input
                size = lengths[ids]
                into = np.repeat(begin[ids] - (np.cumsum(size) - size), size)
                back = table[into + np.arange(len(into))]
                ends = np.r_[0, np.cumsum(size)][offsets]
                same = len(back) == len(d) and (ends == o).all() and (back == d).all()
                ok = np.ones(j - i, bool) if same else np.array([back[ends[k] : ends[k + 1]].tobytes() == d[o[k] : o[k + 1]].tobytes() for k in range(j - i)])
                null = pc.is_null(texts)
                mask = null.to_numpy(zero_copy_only=False)
                starts = pa.array(offsets, mask=np.r_[mask, False]) if mask.any() else pa.array(offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j].cast(pa.int64()), pa.ListArray.from_arrays(starts, pa.array(ids)), pa.array(np.diff(offsets).astype(np.int64), mask=mask), pa.array(ok, mask=mask)], names=["doc_id", "tokens", "n_tokens", "round_trip"]
                )

    return run


def encode_documents(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip); round_trip: the ids decode to the very bytes of the text."""
    C.ship(docs.sparkSession)
    return C.require(docs, "doc_id", "text").mapInArrow(_encode_batches(docs.sparkSession.sparkContext.broadcast(vocabulary(path))), "doc_id long, tokens array<int>, n_tokens long, round_trip boolean")


def decode_documents(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, tokens); null tokens give a null text."""

    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared.value)[0]
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([None if t is None else codec.decode(t).decode("utf-8", "replace") for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    C.ship(encoded.sparkSession)
    return C.require(encoded, "doc_id", "tokens").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(C.read(spark, sf_dir, "documents"))
