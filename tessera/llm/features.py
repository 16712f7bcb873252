"""Per-document figures that the quality rules (5) and the labellers (8) share.

All are computed over the whole text from its bytes, many documents at a time.
"""

from __future__ import annotations

import numpy as np

from tessera.llm import common as C

#: Frequent short words of the languages in the tables; a public-knowledge list.
STOPWORDS = (
    "the of and to in is that it for was on with as be at by this from have or not are but had they you an his her "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er "
    "le la les de des et en un une du que qui dans pour pas sur au avec ce il est par "
    "el la los las de que y en un una por con para se no su al lo como más del"
).split()
_SYMBOLS = b"#$%&*|!@^~<>{}[]\\=+_`"
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(_SYMBOLS)] = 1
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = 3
_CLASS[128:] = 4  # bytes of letters outside ASCII, for the most part
_CLASS[list(b"0123456789")] = 5
NAMES = ("words", "symbols", "upper", "digits", "repeated_lines", "word_length", "stopwords", "repeated_words")


def _stop_hashes() -> np.ndarray:
    words = sorted(set(STOPWORDS))
    raw = " ".join(words).encode()
    return np.sort(C.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])


_STOP: list[np.ndarray] = []


def measure(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Figures of every row: word count, shares of symbols, capitals, digits, repeated lines, stopwords and repeated words, mean word length."""
    if not _STOP:
        _STOP.append(_stop_hashes())
    rows = len(off) - 1
    cls = _CLASS[data]

    def count(k: int) -> np.ndarray:
        return np.diff(np.r_[0, np.cumsum(cls == k)][off])

    h, s, e, row = C.word_hashes(data, off)
    words = np.bincount(row, minlength=rows)
    inside = np.bincount(row, weights=e - s, minlength=rows)
    some = np.maximum(words, 1)
    visible = np.maximum(inside, 1)
    upper, lower, other = count(2), count(3), count(4)
    place = np.searchsorted(_STOP[0], h)
    stop = _STOP[0][np.minimum(place, len(_STOP[0]) - 1)] == h
    ls, le, lrow = C.split_spans(data, off, data != 10)
    return {
        "words": words.astype(float),
        "symbols": count(1) / visible,
        "upper": upper / np.maximum(upper + lower + other / 2, 1),
        "digits": count(5) / visible,
        "repeated_lines": _repeats(C.span_hashes(C._BYTE[data], ls, le), lrow, rows),
        "word_length": inside / some,
        "stopwords": np.bincount(row[stop], minlength=rows) / some,
        "repeated_words": _repeats(h, row, rows),
    }


def _repeats(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Share of values that occurred before in their row."""
    total = np.bincount(row, minlength=rows)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    hs, rs = h[order], row[order]
    again = np.zeros(len(h), bool)
    again[1:] = (hs[1:] == hs[:-1]) & (rs[1:] == rs[:-1])
    return np.bincount(rs[again], minlength=rows) / np.maximum(total, 1)
