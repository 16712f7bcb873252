"""Near-duplicate documents by one-permutation hashing (operator 7).

Each document's set of word 3-grams is hashed once; the 64-bit hash picks one of 128 bins and the
least value of each bin is the sketch.  Empty bins are filled by optimal densification: bin i probes
bins h(i,1), h(i,2), ... until it meets one that was filled by a shingle.  Bands of 3 bins give
buckets; inside a bucket only star-shaped edges (member, hub) are made, so a bucket of n texts yields
n-1 pairs instead of n(n-1)/2.  Edges whose estimated Jaccard similarity reaches the threshold join
texts into groups.

Members that aren't near their hub (where texts of different kinds share a passage) get hubs among
themselves, in ROUNDS rounds: within classes of like size (texts at the threshold fall into a common
one), then within finer buckets of further bins, then once more.  Every round is linear in its members.

Exact copies are joined beforehand by a 128-bit digest of the text, so a text repeated a million
times enters the buckets once.  Hubs and counts are aggregates with partial sums before the shuffle, and
their joins can be split where a bucket is hot; nothing sorts a bucket in one task.

Defined cases: null ids or null texts take no part and are always kept; texts without words group
only with identical texts; texts of fewer than 3 words have one shingle, the whole text; very long texts
are sketched whole; where rows repeat a doc_id each distinct text of it is a document of its own, which is
dropped only as a copy, and is listed under its id; of rows that repeat id and text one is kept, the least
by its columns as JSON; a group is kept by its least doc_id (among several near texts of it, the least
digest); an empty table gives an empty result; other columns are ignored or, by the filter, kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common as C

BINS, ROWS, SHINGLE, THRESHOLD, ROUNDS = 128, 3, 3, 0.45, 4
#: Rows of (id, digest) that are sent to every executor (some 20 MB); with more, documents are joined by a shuffle.
BROADCAST_ROWS = 200_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SCHEMA = "doc_id long, digest binary, bands array<long>, sketch binary"


def shingles(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word k-gram; a row with 1 to k-1 words gives one shingle."""
    h, _, _, row = C.word_hashes(data, off)
    g = C.grams(h, k)
    inside = row[: len(g)] == row[k - 1 :] if len(g) else np.zeros(0, bool)
    count = np.bincount(row, minlength=len(off) - 1)
    short = np.flatnonzero((count > 0) & (count < k))
    first = np.searchsorted(row, short)
    return np.concatenate([g[inside], C.span_hashes(h, first, first + count[short])]), np.concatenate([row[: len(g)][inside], short])


def densify(sig: np.ndarray) -> np.ndarray:
    """Fill empty bins of the rows that have a filled one."""
    bins = sig.shape[1]
    out, empty = sig.copy(), sig == _EMPTY
    r, b = np.nonzero(empty & ~empty.all(1)[:, None])
    t = 0
    while len(r):
        t += 1
        j = (C.mix(b.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(t)) % np.uint64(bins)).astype(np.int64)
        v = sig[r, j]
        done = v != _EMPTY
        out[r[done], b[done]] = v[done]
        r, b = r[~done], b[~done]
    return out


def sketch(data: np.ndarray, off: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One row of bins for each text; all empty where the text has no word."""
    h, row = shingles(data, off)
    shift = np.uint64(64 - (bins.bit_length() - 1))
    sig = np.full((len(off) - 1) * bins, _EMPTY, np.uint64)
    np.minimum.at(sig, row * bins + (h >> shift).astype(np.int64), h & ((np.uint64(1) << shift) - np.uint64(1)))
    return densify(sig.reshape(-1, bins))


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = sig.shape[1] // rows
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        k = np.full(len(sig), b + 1, np.uint64)
        for j in range(rows):
            k = C.mix(k * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + j])
        out[:, b] = k
    return out.view(np.int64)


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sketch is 16 bits of every bin and the number of shingles, at most 65,535 of 16ths of its logarithm."""
    for batch in batches:
        ids = batch.column(0)
        data, off = C.buffers(batch.column(1))
        for i, j, d, o in C.pieces(data, off):
            sig = sketch(d, o)
            raw = d.tobytes()
            digests = [hashlib.md5(raw[o[k] : o[k + 1]]).digest() for k in range(j - i)]
            words = ~(sig == _EMPTY).all(1)
            keys = band_keys(sig)
            count = np.bincount(shingle_rows(d, o), minlength=j - i)
            size = np.floor(np.log(np.maximum(count, 1)) / math.log(1 / THRESHOLD) * 16)
            small = np.concatenate([sig & np.uint64(0xFFFF), size[:, None].astype(np.uint64)], 1).astype("<u2")
            offsets = np.concatenate([[0], np.cumsum(np.where(words, keys.shape[1], 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids[i:j].cast(pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[words].ravel())), pa.array([s.tobytes() for s in small], pa.binary())],
                names=["doc_id", "digest", "bands", "sketch"],
            )


def shingle_rows(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """The row of each word k-gram, as shingles() has them."""
    s, _, row = C.split_spans(data, off, data > 32)
    n = np.bincount(row, minlength=len(off) - 1)
    return np.repeat(np.arange(len(n)), np.where(n > 0, np.maximum(n - k + 1, 1), 0))


def _finer(keys: np.ndarray, own: np.ndarray, turn: int, threshold: float) -> list[np.ndarray]:
    """Keys of the buckets in which members that aren't near their hub meet again: after the first turn by size, then by further bins, then anew."""
    k = keys.view(np.uint64)
    salt = lambda x, n: C.mix(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))
    if turn == 1:
        c = np.floor(own[:, -1] / 16 * math.log(THRESHOLD) / math.log(threshold)).astype(np.uint64)
        return [salt(k ^ C.mix(c + np.uint64(1)), 1), salt(k ^ C.mix(c + np.uint64(2)), 1)]
    if turn == 2:
        out = []
        bins, r = own.shape[1] - 1, np.arange(len(k))
        for v in range(2):
            x = salt(k, 10 + v)
            for j in range(3):
                at = (salt(k, 20 + 3 * v + j) % np.uint64(bins)).astype(np.int64)
                x = C.mix(x * np.uint64(0x9E3779B97F4A7C15) + own[r, at].astype(np.uint64))
            out.append(x)
        return out
    return [salt(k, 100 + turn)]


def _verify(threshold: float, turn: int):
    """Pairs with the keys that they share and their sketches -> near or not, and the keys in which ``a`` is to meet others."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(b.num_rows, -1) for c in ("sa", "sb"))
            near = (x[:, :-1] == y[:, :-1]).mean(1) >= threshold
            lists = b.column("keys")
            of = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            keys = lists.flatten().to_numpy(zero_copy_only=False)
            open_ = ~near[of]
            found = _finer(keys[open_], x[of[open_]], turn, threshold) if turn < ROUNDS and open_.any() else []
            more, at = (np.concatenate(found), np.tile(of[open_], len(found))) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            order = np.argsort(at, kind="stable")
            offsets = np.searchsorted(at[order], np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(near), pa.ListArray.from_arrays(pa.array(offsets), pa.array(more[order].view(np.int64)))], names=["a", "b", "near", "more"])

    return run


def _edges(texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of nodes whose texts are near."""
    sketches = lambda n, c: texts.select(F.col("node").alias(n), F.col("sketch").alias(c))
    members, found = texts.select("node", F.explode("bands").alias("key")), []
    for turn in range(1, ROUNDS + 1):
        hubs = members.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
        stars = members.join(hubs.drop("n"), "key").where("node <> hub").groupBy(F.col("node").alias("a"), F.col("hub").alias("b")).agg(F.collect_list("key").alias("keys"))  # two texts share so many keys as there are bands at most
        pairs = stars.join(sketches("a", "sa"), "a").join(sketches("b", "sb"), "b")
        seen = C.checkpointed(pairs.mapInArrow(_verify(threshold, turn), "a long, b long, near boolean, more array<long>"))
        found.append(seen.where("near").select("a", "b"))
        if turn == ROUNDS or seen.where("not near").head() is None:
            break
        members = seen.where("not near").select(F.col("a").alias("node"), F.explode("more").alias("key")).distinct()
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _members(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, digest, keeper, kept_text, n): the ids and texts of all groups of more than one row, n the rows that repeat both."""
    C.ship(docs.sparkSession)
    base = C.require(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    s = C.checkpointed(base.mapInArrow(_sketches, _SCHEMA))
    # one node for each distinct text; its number is fixed by the checkpoint
    texts = C.checkpointed(s.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()))
    groups = C.components(_edges(texts, threshold))
    roots = groups.unionByName(groups.select(F.col("root").alias("id"), "root").distinct())
    some = texts.select("node", "digest", "doc", "copies").join(roots, F.col("node") == F.col("id"), "left").where("copies > 1 or root is not null").select("digest", "doc", F.coalesce("root", "node").alias("root"))
    kept = some.groupBy("root").agg(F.min(F.struct("doc", "digest")).alias("k"))
    tagged = some.join(kept, "root").select("digest", F.col("k.doc").alias("keeper"), F.col("k.digest").alias("kept_text"))
    return s.select("doc_id", "digest").join(tagged, "digest").groupBy("doc_id", "digest", "keeper", "kept_text").agg(F.count("*").alias("n"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, keeper_id) for every document that has a near copy with a lesser id in its group."""
    return _members(docs, threshold).where("doc_id <> keeper").select("doc_id", F.col("keeper").alias("keeper_id")).distinct()


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of the documents that are no copies, and one row of each group."""
    m = _members(docs, threshold)
    keeps = (F.col("doc_id") == F.col("keeper")) & (F.col("digest") == F.col("kept_text"))
    i, g, once = C.fresh(docs, "mark_id"), C.fresh(docs, "mark_text"), C.fresh(docs, "mark_once")
    marks = C.checkpointed(m.where(~keeps | (F.col("n") > 1)).select(F.col("doc_id").alias(i), F.col("digest").alias(g), keeps.alias(once)))
    few = F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks
    same = (docs["doc_id"] == F.col(i)) & (F.unhex(F.md5(docs["text"].cast("binary"))) == F.col(g))
    left = docs.join(few, same, "left_anti")
    if marks.where(once).head() is None:
        return left
    row = F.struct(*[docs[c] for c in docs.columns])
    repeated = docs.join(few.where(once), same).groupBy(i, g).agg(F.min_by(row, F.to_json(row)).alias("r")).select("r.*")
    return left.unionByName(repeated)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.read(spark, sf_dir, "documents"))
