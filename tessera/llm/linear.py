"""Hashed character n-grams and a sparse linear model on them, shared by operators 4 and 8.

Features are the character 1- to 3-grams of the whole text, hashed to 2^16 columns; a feature's
value is (count / all counts) * idf * SCALE.  As this is linear in the counts, a text is scored by
adding up one row of weights for every gram, without building its vector.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common as C

BITS, ORDERS, SCALE = 16, (1, 2, 3), 20.0
DIM = 1 << BITS
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Lower case for letters, a space for everything else, of the basic plane."""
    if not _FOLD:
        t = np.arange(1 << 16, dtype=np.uint32)
        for c in range(1 << 16):
            ch = chr(c)
            low = ch.lower()
            t[c] = (ord(low) if len(low) == 1 else c) if ch.isalpha() else 32
        _FOLD.append(t)
    return _FOLD[0]


def codepoints(data: np.ndarray, off: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 rows and the rows' offsets among them."""
    n = len(data)
    p = np.flatnonzero((data & 0xC0) != 0x80)
    off = np.searchsorted(p, off)
    wide = np.zeros(n + 3, np.uint32)
    wide[:n] = data
    cp = wide[p]
    many = np.flatnonzero(cp >= 0xC0)
    if len(many):
        q, b = p[many], cp[many]
        c1, c2, c3 = (wide[q + k] & 0x3F for k in (1, 2, 3))
        cp[many] = np.where(b < 0xE0, (b & 0x1F) << 6 | c1, np.where(b < 0xF0, (b & 0x0F) << 12 | c1 << 6 | c2, (b & 7) << 18 | c1 << 12 | c2 << 6 | c3))
    if fold:
        cp = np.where(cp < 65536, _fold()[np.minimum(cp, 65535)], cp)
    return cp, off


def columns(cp: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the column of the gram that begins at each code point; DIM where it would leave its row."""
    n = len(cp)
    lengths = np.diff(off)
    h = np.zeros(n, np.uint32)
    for order in range(1, max(ORDERS) + 1):
        h = h * np.uint32(0x01000193) + np.r_[cp[order - 1 :], np.zeros(min(order - 1, n), np.uint32)][:n]
        if order not in ORDERS:
            continue
        col = ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(order * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS)
        for k in range(1, order):
            col[off[1:][lengths >= k] - k] = DIM
        yield col


def vectors(data: np.ndarray, off: np.ndarray, fold: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(columns, counts) of every row."""
    cp, o = codepoints(data, off, fold)
    cols = list(columns(cp, o))
    out = []
    for i in range(len(o) - 1):
        c = np.concatenate([x[o[i] : o[i + 1]] for x in cols])
        out.append(np.unique(c[c < DIM], return_counts=True))
    return out


def scores(data: np.ndarray, off: np.ndarray, weights: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Mean weight row over the grams of each text, and the number of grams. weights: (DIM + 1, classes), the last row zero."""
    rows, classes = len(off) - 1, weights.shape[1]
    cp, o = codepoints(data, off, fold)
    total = np.zeros((rows, classes))
    lengths = np.diff(o)
    grams = sum(np.maximum(lengths - (k - 1), 0) for k in ORDERS)
    full = np.flatnonzero(lengths)
    if len(full):
        for col in columns(cp, o):
            for c in range(classes):
                total[full, c] += np.add.reduceat(weights[:, c][col], o[full])
    return total / np.maximum(grams, 1)[:, None], grams


class Model:
    """Multinomial logistic regression; FTRL-proximal with elastic net; a temperature."""

    def __init__(self, classes: int, fold: bool):
        self.fold, self.temperature = fold, 1.0
        self.idf = np.zeros(DIM)
        self.w = np.zeros((classes, DIM))

    def value(self, v: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return v[1] / max(1, v[1].sum()) * self.idf[v[0]] * SCALE

    def fit(self, xs: list[tuple[np.ndarray, np.ndarray]], ys: np.ndarray, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, held_out: float = 0.2) -> Model:
        """ys: a row of class probabilities for each x. The last part is held out for the temperature."""
        cut = len(xs) - int(len(xs) * held_out)
        df = np.zeros(DIM)
        for v in xs[:cut]:
            df[v[0]] += 1
        self.idf = np.log((1 + cut) / (1 + df)) + 1
        z, n = np.zeros_like(self.w), np.zeros_like(self.w)
        for _ in range(epochs):
            for v, y in zip(xs[:cut], ys[:cut]):
                i, x = v[0], self.value(v)
                zi, ni = z[:, i], n[:, i]
                w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)
                g = (softmax((w @ x)[None])[0] - y)[:, None] * x
                s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
                z[:, i] += g - s * w
                n[:, i] += g * g
        self.w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
        held = [(self.w[:, v[0]] @ self.value(v), y) for v, y in zip(xs[cut:], ys[cut:])]
        if held:
            s, y = np.array([a for a, _ in held]), np.array([b for _, b in held])
            loss = lambda t: -(y * np.log(softmax(s / t) + 1e-12)).sum()
            self.temperature = float(min(np.geomspace(0.05, 20, 241), key=loss))
        return self

    def table(self) -> np.ndarray:
        out = np.zeros((DIM + 1, len(self.w)), np.float32)
        out[:DIM] = (self.w * self.idf * SCALE / self.temperature).T
        return np.asfortranarray(out)


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def shares(sizes: dict, rows: int) -> dict:
    """How many of ``rows`` each class gets: as evenly as their sizes allow."""
    out, left = {}, rows
    for k, (name, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], str(x[0])))):
        out[name] = min(n, left // (len(sizes) - k))
        left -= out[name]
    return out


def sample(docs: DataFrame, target: Column | None, rows: int, fold: bool, judge: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[list, list]:
    """Vectors and targets of at most ``rows`` labelled documents, evenly from all classes of the target: in each those with the least hash of their ids.

    Classes are counted and ids picked from the columns of ids and targets alone; then only the picked texts
    are read, and their vectors are built on the executors.  An id counts once for each target, with the least
    of its texts.  Instead of a target column, ``judge`` can give an integer target of each chosen text from
    its bytes.
    """
    spark = docs.sparkSession
    labelled = docs.select("doc_id", "text", (F.lit(0) if target is None else target).alias("y")).where("doc_id is not null and y is not null")
    ids = labelled.select("doc_id", "y")
    sizes = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.approx_count_distinct("doc_id").alias("n")).collect()}  # one row for each class
    if not sizes or rows <= 0:
        return [], []
    quota = shares(sizes, rows)
    y_type = labelled.schema["y"].dataType.simpleString()
    # a stretch of the hashes that is expected to hold twice as many as are wanted; the rest is cut off below
    stretch = spark.createDataFrame([(y, min(1.0, (2 * quota[y] + 64) / max(n, 1))) for y, n in sizes.items()], f"y {y_type}, upto double")
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    near = ids.join(F.broadcast(stretch), "y").where(place < F.col("upto")).select("y", "doc_id", place.alias("place")).distinct().collect()  # some 2 * rows + 64 for each class
    taken: dict = {}
    for r in sorted(near, key=lambda r: (r["place"], r["doc_id"])):
        mine = taken.setdefault(r["y"], [])
        if len(mine) < quota[r["y"]]:
            mine.append(r["doc_id"])
    chosen = [(y, i) for y, mine in taken.items() for i in mine]
    if not chosen:
        return [], []
    few = F.broadcast(spark.createDataFrame(chosen, f"y {y_type}, doc_id long"))
    one = labelled.join(few, ["y", "doc_id"]).groupBy("doc_id", "y").agg(F.min("text").alias("text")).where("text is not null")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = C.buffers(b.column("text"))
            vs = [v for _, _, d, o in C.pieces(data, off) for v in vectors(d, o, fold)]
            y = pa.array([int(c) for _, _, d, o in C.pieces(data, off) for c in judge(d, o)], pa.int32()) if judge else b.column("y")
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), y, pa.array([c.astype("<i4").tobytes() for c, _ in vs], pa.binary()), pa.array([n.astype("<i4").tobytes() for _, n in vs], pa.binary())], names=["doc_id", "y", "c", "n"])

    got = one.mapInArrow(run, f"doc_id long, y {y_type}, c binary, n binary").collect()
    got.sort(key=lambda r: (hash_of(r.doc_id), r.doc_id, str(r.y), bytes(r.c)))
    return [(np.frombuffer(r.c, "<i4"), np.frombuffer(r.n, "<i4")) for r in got], [r.y for r in got]


def hash_of(i: int) -> int:
    return int(C.mix(np.array([i], np.int64).view(np.uint64))[0])
