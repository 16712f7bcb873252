"""Shared plumbing: Arrow text buffers, vectorised hashing, lineage cuts and graph grouping.

A *word* throughout the subpackage is a maximal run of bytes above 0x20 inside one document, so
the definition is the same for every language and needs no decoding.  Null texts count as empty.
"""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_ROOT = Path(__file__).resolve().parents[2]


# ---------------------------------------------------------------- session

#: Bytes of an Arrow batch on its way to Python; Spark's own bound lets two batches of long texts fill a worker.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Make the package importable on executors whose PYTHONPATH lacks it, and bound the session's Arrow batches."""
    bound = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
    if not 0 < bound <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    on_path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if str(_ROOT) in on_path or getattr(sc, "_tessera_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((_ROOT / "tessera").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    before = list(sys.path)
    sc.addPyFile(target)  # served to the executors by the driver
    sys.path[:] = before
    sc._tessera_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of this machine only where it names none and all runs on this machine."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="tessera-shared-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Project onto the named columns, whatever else the table carries."""
    return df.select(*[df[c] for c in columns])


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't use yet (case-insensitively)."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = "_" + name
    return name


def rewritten(docs: DataFrame, change: Callable[[str], str], candidates: Callable[[pa.Array], pa.Array] | None = None) -> DataFrame:
    """All documents and columns with changed texts; n_chars, where it is a whole number, follows a text that has changed.

    ``candidates`` marks the texts of an array that may change at all; the others aren't decoded.
    """
    ship(docs.sparkSession)
    at = docs.columns.index("text")
    n = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("int", "bigint") else -1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            some = candidates(cols[at]) if candidates else pc.is_valid(cols[at])
            rows = np.flatnonzero(pc.fill_null(some, False).to_numpy(zero_copy_only=False))
            texts = cols[at]
            new = {i: y for i in rows.tolist() if (y := change(x := texts[i].as_py())) != x}  # one decoded at a time
            if new:
                mask = np.zeros(b.num_rows, bool)
                mask[list(new)] = True
                cols[at] = pc.replace_with_mask(cols[at], pa.array(mask), pa.array(list(new.values()), cols[at].type))
                if n >= 0:
                    cols[n] = pc.replace_with_mask(cols[n], pa.array(mask), pa.array([len(y) for y in new.values()], cols[n].type))
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


# ---------------------------------------------------------------- Arrow text

def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its n+1 offsets into them, without copying."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    raw = arr.buffers()
    off = np.frombuffer(raw[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(data: np.ndarray, off: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes: (first row, end row, bytes, offsets). A longer row is a run of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


# ---------------------------------------------------------------- hashing

def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (SplitMix64's constants)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_P = 0x9E3779B97F4A7C15
_IP = pow(_P, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_POW = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for k, base in ((0, _P), (1, _IP)):
            a = np.full(size, base, U64)
            a[0] = 1
            _POW[k] = np.multiply.accumulate(a)
    return _POW[0][:n], _POW[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent polynomial hash modulo 2^64 of values[start:end] for every span."""
    n = len(values)
    p, ip = _powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(values * p[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * ip[starts] + (ends - starts).astype(U64))


def split_spans(data: np.ndarray, off: np.ndarray, is_inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes that don't cross rows: starts, ends, row of each."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.zeros(n + 1, bool)
    before[1:] = is_inside
    after = np.zeros(n + 1, bool)
    after[:n] = is_inside
    starts = np.flatnonzero(after & (~before | edge))
    ends = np.flatnonzero(before & (~after | edge))
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and row of every word."""
    s, e, row = split_spans(data, off, data > 32)
    return span_hashes(_BYTE[data], s, e), s, e, row


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    g = np.zeros(n, U64)
    for j in range(k):
        g = g * U64(_P) + h[j : j + n]
    return mix(g)


# ---------------------------------------------------------------- grouping

def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) as (id, root) for every vertex but the roots; root is the least id.

    Alternates the large-star and small-star rewrites until the edges stop changing, in a number of
    rounds logarithmic in the number of vertices in practice.  Every round is cut by a checkpoint,
    so a lost executor costs one round at most.  Minima are aggregates with partial sums and joined back,
    so a vertex with a great many neighbours is no task of its own.
    """
    e = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    key = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = key(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", F.col("u")).alias("v")).where("u <> v").distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        e = checkpointed(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct())
        now = key(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("grouping did not converge")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
