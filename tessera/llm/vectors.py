"""Near-duplicate embeddings (operator 10).

Spherical k-means over all vectors (about sqrt(n) cells) assigns each to the cell of its nearest centre,
its home.  Pairs are sought inside cells by blocked cosine products.  So that a border between cells
doesn't part a pair, a vector also visits other cells, where it is compared with those at home.

Which cells it visits.  Let x and y be at home in the cells of centres c and d.  Then
(x.c - x.d) + (y.d - y.c) = (x - y).(c - d), and neither bracket is negative, so one of the two vectors
is nearer than half of that to the other's centre.  It is enough that this one visits.  The right side is
at most |x - y| |c - d|, and |x - y|^2 = 2 - 2 threshold at the threshold: a vector visits the cell of d
where x.c - x.d <= SIGMAS / sqrt(dimension) * |x - y| |c - d| / 2.  With SIGMAS = sqrt(dimension) (the
argument ``exact``) no pair is lost whatever the data.  The default of 3 is three deviations of the
projection of a difference without a preferred direction: one border in 700 loses a pair that lies at the
very threshold, and a closer pair less often; the tests hold recall against brute force.

Equal vectors are joined beforehand, so copies enter the cells once.  Cells of more than BLOCK vectors are
cut into blocks and every pair of blocks is compared, so memory is bounded whatever a cell holds.  Each pair
of blocks yields only the star edges of its groups; connected components of all edges give the groups and
the least vec_id of each is kept.

Defined cases: null ids, null or empty vectors, vectors of zero length or with a null, NaN or infinite entry
have no direction: they are kept and group with nothing (a null id stays null); vectors of different
dimensions never group, and each dimension has cells of its own (a single one up to BLOCK vectors); rows that
repeat an id are one vector if equal and are both compared if not; vectors may have any number of entries;
ties go to the least id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common as C

THRESHOLD, ROUNDS, BLOCK, SIGMAS = 0.95, 5, 4096, 3.0


def _unit(batch: pa.RecordBatch, column: str) -> np.ndarray:
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    x = flat.reshape(batch.num_rows, -1)
    return x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim) of the vectors that have a direction."""
    v = C.require(vectors, "vec_id", "embedding").select("vec_id", F.col("embedding").cast("array<float>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good).withColumn("dim", F.size("v"))


def centres(x: DataFrame, k: int, dim: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means on the sphere over all rows of (vec_id, v); centres start at the k rows with the least hash of their ids."""
    first = x.orderBy(F.xxhash64("vec_id"), "vec_id").limit(k).collect()
    c = np.array([r.v for r in first], np.float64).reshape(-1, dim)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    for _ in range(rounds):
        now = x.sparkSession.sparkContext.broadcast(c.astype(np.float32))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = now.value
            total, some = np.zeros(c.shape), np.zeros(len(c), bool)
            for b in batches:
                if b.num_rows:
                    u = _unit(b, "v")
                    for i in range(0, len(u), BLOCK):
                        near = (u[i : i + BLOCK] @ c.T).argmax(1)
                        np.add.at(total, near, u[i : i + BLOCK])
                        some[near] = True
            at = np.flatnonzero(some)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["cell", "total"])

        sums = x.select("v").mapInArrow(run, "cell long, total array<double>")
        # summed per cell on the executors; k rows come back
        added = sums.select("cell", F.posexplode("total")).groupBy("cell", "pos").agg(F.sum("col").alias("s")).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("t")).collect()
        for r in added:
            t = np.array([p.s for p in r.t])
            if (norm := np.linalg.norm(t)) > 0:
                c[r.cell] = t / norm
    return c.astype(np.float32)


def reach(threshold: float, dim: int, sigmas: float = SIGMAS) -> float:
    """How much nearer, for each unit of distance between centres, the own centre may be than one that is visited."""
    return min(sigmas / math.sqrt(dim), 1.0) * math.sqrt(2 - 2 * threshold) / 2


def _assign(c_shared, near: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = c_shared.value
        square = (c * c).sum(1)
        for b in batches:
            if not b.num_rows:
                continue
            u = _unit(b, "v")
            step = max(1, (1 << 22) // len(c))
            for i in range(0, len(u), step):
                part = u[i : i + step]
                sims = part @ c.T
                best = sims.argmax(1)
                apart = np.sqrt(np.maximum(square[best][:, None] + square[None] - 2 * (c[best] @ c.T), 0))
                row, cell = np.nonzero(sims >= sims.max(1)[:, None] - near * apart - 1e-6)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id")[i : i + step].cast(pa.int64()).take(take), pa.array(cell), pa.array(best[row] == cell), pa.array([v.tobytes() for v in part], pa.binary()).take(take)], names=["vec_id", "cell", "home", "v"]
                )

    return run


def _stars(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Star edges of the groups that the pairs between two blocks make."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (p := root.get(i, i)) != i:
            root[i] = root.get(p, p)
            i = p
        return i

    for i in range(0, len(a), 1024):
        r, c = np.nonzero(x[i : i + 1024] @ y.T >= threshold)
        for p, q in zip(a[i + r].tolist(), b[c].tolist()):
            p, q = find(p), find(q)
            if p != q:
                root[max(p, q)] = min(p, q)
    return [(i, find(i)) for i in list(root) if find(i) != i]


def _compare(threshold: float):
    def run(key, table):
        t = table.combine_chunks()
        ids = t.column("vec_id").to_numpy()
        x = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float32).reshape(len(ids), -1)
        left, right = t.column("left").to_numpy(zero_copy_only=False), t.column("right").to_numpy(zero_copy_only=False)
        edges = _stars(ids[left], ids[right], x[left], x[right], threshold)
        return pa.table([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    return run


def _block_pairs(placed: DataFrame) -> DataFrame:
    """Rows of (cell, home block, visiting block): home vectors on the left, all that came on the right."""
    sized = placed.groupBy("cell", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    x = placed.join(sized, ["cell", "dim"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    left = x.where("home").select("cell", "dim", F.col("block").alias("i"), F.explode(every).alias("j"), "vec_id", "v", F.lit(True).alias("left"))
    right = x.select("cell", "dim", F.explode(every).alias("i"), F.col("block").alias("j"), "vec_id", "v", F.lit(False).alias("left"))
    return left.unionByName(right).select("cell", "dim", "i", "j", "vec_id", "v", "left", (~F.col("left")).alias("right"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """(vec_id, keeper_id, keep) of every row; keep marks the representative of each group."""
    spark = vectors.sparkSession
    C.ship(spark)
    x = C.checkpointed(_usable(vectors))
    everything = C.require(vectors, "vec_id")
    # equal vectors are one, under their least id
    one = C.checkpointed(x.groupBy("v", "dim").agg(F.min("vec_id").alias("vec_id")))
    equal = x.join(one.withColumnRenamed("vec_id", "b"), ["v", "dim"]).where("vec_id <> b").select(F.col("vec_id").alias("a"), "b")
    dims = {r["dim"]: r["count"] for r in one.groupBy("dim").count().where(F.col("count") > BLOCK).collect()}  # only dimensions with many vectors
    few = one.where(~F.col("dim").isin(*dims)) if dims else one
    placed = few.mapInArrow(_single, "vec_id long, dim int, cell long, home boolean, v binary")
    for dim, n in sorted(dims.items()):
        own = one.where(F.col("dim") == dim).select("vec_id", "v")
        c = centres(own, math.ceil(math.sqrt(n)), dim)
        near = reach(threshold, dim, math.sqrt(dim) if exact else SIGMAS)
        part = own.mapInArrow(_assign(spark.sparkContext.broadcast(c), near), "vec_id long, cell long, home boolean, v binary")
        placed = placed.unionByName(part.withColumn("dim", F.lit(dim)))
    edges = _block_pairs(C.checkpointed(placed)).groupBy("cell", "dim", "i", "j").applyInArrow(_compare(threshold), "a long, b long")
    groups = C.components(edges.unionByName(equal))
    out = everything.join(groups, everything["vec_id"] == groups["id"], "left")
    return out.select("vec_id", F.coalesce("root", "vec_id").alias("keeper_id"), F.col("root").isNull().alias("keep"))


def _single(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All vectors of a dimension in one cell."""
    for b in batches:
        rows = [(np.asarray(v, np.float32) / np.linalg.norm(np.asarray(v, np.float32).astype(np.float64))).astype(np.float32).tobytes() for v in b.column("v").to_pylist()]
        n = b.num_rows
        yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), b.column("dim"), pa.array(np.zeros(n, np.int64)), pa.array(np.ones(n, bool)), pa.array(rows, pa.binary())], names=["vec_id", "dim", "cell", "home", "v"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.read(spark, sf_dir, "embeddings"))
