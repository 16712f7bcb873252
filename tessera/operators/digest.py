"""SHA-256 of documents put together from many rows, none of which is ever in one task.

A hash is a chain over all bytes of a document, but its state between two bytes is 112 bytes long.  Rows are range-partitioned
and sorted; each partition hashes the documents that begin in it.  Of a document that began before it, it keeps
the bytes, and the state is handed from partition to partition, one job for each step of the longest document.
A task reads one partition, some PIECE_BYTES, however long a document is.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import struct
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.operators.lineage import shared_folder

PIECE_BYTES, CHUNK_BYTES = 64 << 20, 4 << 20
_STATE = struct.Struct("=8I2I64s2I")  # libcrypto's SHA256_CTX: chain, length in bits, what fills no block yet and its length, length of a digest


@lru_cache(1)
def _library():
    try:
        lib = ctypes.CDLL(ctypes.util.find_library("crypto") or "libcrypto.so.3")
        return lib if lib.SHA256_Init and lib.SHA256_Update and lib.SHA256_Final else None
    except (OSError, AttributeError):
        return None


class Sha256:
    """SHA-256 that can be left and taken up elsewhere by its ``state``; by libcrypto, else by some 1 MB a second of Python."""

    def __init__(self, state: bytes | None = None):
        self._lib = _library()
        start = _STATE.pack(*_roots(8, 2), 0, 0, b"", 0, 32)
        self._buffer = ctypes.create_string_buffer(state or start, _STATE.size)

    @property
    def state(self) -> bytes:
        return self._buffer.raw

    def update(self, data: bytes) -> None:
        if self._lib:
            self._lib.SHA256_Update(self._buffer, data, ctypes.c_size_t(len(data)))
            return
        *chain, low, high, pending, n, size = _STATE.unpack(self.state)
        bits, data = (low | high << 32) + 8 * len(data), pending[:n] + data
        whole = len(data) // 64 * 64
        for i in range(0, whole, 64):
            chain = _compressed(chain, data[i : i + 64])
        self._buffer.raw = _STATE.pack(*chain, bits & 0xFFFFFFFF, bits >> 32 & 0xFFFFFFFF, data[whole:], len(data) - whole, size)

    def hexdigest(self) -> str:
        end = Sha256(self.state)
        *_, low, high, _, n, _ = _STATE.unpack(self.state)
        end.update(b"\x80" + bytes((55 - n) % 64) + struct.pack(">Q", low | high << 32))
        return struct.pack(">8I", *_STATE.unpack(end.state)[:8]).hex()


@lru_cache(2)
def _roots(n: int, k: int) -> list[int]:
    """First 32 bits of the fractions of the k-th roots of the first n primes."""
    primes = [p for p in range(2, 312) if all(p % q for q in range(2, p))][:n]
    out = []
    for p in primes:
        wanted, low, high = p << 32 * k, 0, 1 << 40
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if middle**k <= wanted else (low, middle - 1)
        out.append(low & 0xFFFFFFFF)
    return out


def _compressed(chain: list[int], block: bytes) -> list[int]:
    mask, turn = 0xFFFFFFFF, lambda x, n: (x >> n | x << 32 - n) & 0xFFFFFFFF
    w = list(struct.unpack(">16I", block))
    for i in range(16, 64):
        x, y = w[i - 15], w[i - 2]
        w.append(w[i - 16] + (turn(x, 7) ^ turn(x, 18) ^ x >> 3) + w[i - 7] + (turn(y, 17) ^ turn(y, 19) ^ y >> 10) & mask)
    a, b, c, d, e, f, g, h = chain
    for k, x in zip(_roots(64, 3), w):
        one = h + (turn(e, 6) ^ turn(e, 11) ^ turn(e, 25)) + (e & f ^ ~e & g) + k + x
        two = (turn(a, 2) ^ turn(a, 13) ^ turn(a, 22)) + (a & b ^ a & c ^ b & c)
        a, b, c, d, e, f, g, h = one + two & mask, a, b, c, d + one & mask, e, f, g
    return [p + q & mask for p, q in zip(chain, (a, b, c, d, e, f, g, h))]


def document_hashes(rows: DataFrame, by: str, order: str, part: Column, size: Column, piece: int | None = None) -> DataFrame:
    """(by, hash): SHA-256 of one document for each group, the parts in their order put together.

    ``part`` is rendered after the rows have been sorted; ``size`` says about how many bytes a row has.  Null parts are left
    out; a group that has no others gets null.
    """
    spark = rows.sparkSession
    kind = rows.schema[by].dataType
    total = rows.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    n = max(1, -(-total // (piece or PIECE_BYTES)))
    ranged = rows.repartitionByRange(n, F.col(by), F.col(order)).sortWithinPartitions(by, order)
    schema = StructType([StructField("_by", kind)]).add("_at", "integer").add("_seq", "integer").add("_chunk", "binary").add("_state", "binary").add("_hash", "string")
    hashed = ranged.select(F.col(by).alias("_by"), F.spark_partition_id().alias("_at"), part.cast("binary").alias("_chunk")).mapInArrow(_begun(schema.names), schema)
    folder = f"{shared_folder(spark)}/pieces-{uuid.uuid4().hex}"
    hashed.withColumn("_part", F.col("_at")).write.partitionBy("_part").parquet(folder)
    ends = spark.read.schema(schema).parquet(folder).where("_seq = -1")
    # _hash is null in a partition where the group has no part that isn't null
    groups = ends.groupBy("_by").agg(F.min("_at").alias("low"), F.max("_at").alias("high"), F.min_by("_state", "_at").alias("state"), F.max("_hash").alias("hash"), F.count("_hash").alias("some"))
    long = groups.where("high > low").drop("hash").collect()  # fewer than n
    state = {g.low: bytes(g.state) for g in long}
    for k in range(1, max((g.high - g.low for g in long), default=0) + 1):
        now = {g.low + k: state[g.low] for g in long if g.high - g.low >= k}
        # what a partition keeps is its first group's, so it tells the group
        pieces = spark.read.schema(schema).parquet(*[f"{folder}/_part={p}" for p in now]).where("_seq >= 0").select("_at", "_seq", "_chunk")
        done = pieces.repartition(len(now), "_at").sortWithinPartitions("_at", "_seq").mapInArrow(_continued(now), "_at int, _state binary").collect()
        state |= {r._at - k: bytes(r._state) for r in done}
    whole = groups.where("high = low").select(F.col("_by").alias(by), "hash")
    rest = [(g["_by"], Sha256(state[g.low]).hexdigest() if g.some else None) for g in long]
    return whole.unionByName(spark.createDataFrame(rest, StructType([StructField(by, kind)]).add("hash", "string"))) if rest else whole


def _begun(names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, any_, key, at, seq = True, False, None, 0, 0
        sha, some, kept, size = Sha256(), False, [], 0
        kinds = None

        def row(*values):
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)

        for b in batches:
            kinds = kinds or [b.schema.field(0).type, pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string()]
            keys, places = b.column(0).to_pylist(), b.column(1)
            for i, k in enumerate(keys):
                if any_ and k != key:
                    if kept:
                        yield row(key, at, seq, b"".join(kept), None, None)
                    yield row(key, at, -1, None, sha.state, sha.hexdigest() if some else None)
                    first, sha, some, kept, size = False, Sha256(), False, [], 0
                if not any_:
                    at = places[0].as_py()
                any_, key = True, k
                data = b.column(2)[i].as_py()
                if data is None:
                    continue
                some = True
                sha.update(data)
                if first:
                    kept.append(data)
                    size += len(data)
                    if size >= CHUNK_BYTES:
                        yield row(key, at, seq, b"".join(kept), None, None)
                        seq, kept, size = seq + 1, [], 0
        if any_:
            if kept:
                yield row(key, at, seq, b"".join(kept), None, None)
            yield row(key, at, -1, None, sha.state, sha.hexdigest() if some else None)

    return run


def _continued(states: dict[int, bytes]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        out = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([sha.state], pa.binary())], names=["_at", "_state"])
        for b in batches:
            for i, k in enumerate(b.column(0).to_pylist()):
                if k != at:
                    if sha:
                        yield out()
                    at, sha = k, Sha256(states[k])
                sha.update(b.column(2)[i].as_py())
        if sha:
            yield out()

    return run
