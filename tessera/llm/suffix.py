"""Repeated passages by suffix sorting (operator 3).

Result: for every document the maximal word spans in which each window of 50 words occurs at least
twice in the table.  No document, window or occurrence is sampled or dropped, at any size; words, anchors and
snippets are told apart by 64-bit hashes (a snippet by its own and its anchor's), which is where the result
could differ from a comparison of the words.

How it is split over a cluster.  The least hash among the 10-word grams of a window is its anchor.
Equal windows have equal anchors, so only places with the same anchor hash can hold equal windows,
and each place needs just its own snippet: the words of the windows that chose it.  Places whose
anchor is unique end there: anchors are counted (with partial counts before the shuffle) and the places are
found again and joined to those that occur more than once, so a hot anchor is a join that can be split.
Places with the same anchor and the same snippet are repeated as a whole.  Only distinct snippets that share
an anchor need comparing; their words are fetched once and a suffix array of them is built on the executors,
many anchors to an array.

An anchor whose distinct snippets have more words than MOST is split before it reaches a task.  All its
snippets hold the anchor's words at a known place; a window that goes on for at least half of its remaining
words to the left goes to the group of those words, else to that of as many words to the right.  Equal windows
go the same way.  The known part grows at every turn until the groups are small enough or, after seven turns,
hold a single window each, which is repeated if two snippets have it.

The suffix array is built in linear time by grouping.  Suffixes start grouped by first symbol.
Groups are taken in descending order; when one is taken its members' Lyndon prefixes are complete.
Each member's pointer to the previous smaller suffix names the suffix whose prefix it extends, and
those suffixes move to new groups just above their old ones, the more extensions the higher.  Then
one ascending pass emits the order inside the groups: when a suffix is placed, the suffixes that it
follows (found along the same pointers) take the next free places of their groups.  Nothing is
renamed or sorted recursively.

Defined cases: null ids and null texts take no part; documents under 50 words have no spans; very long texts
are searched whole; rows that repeat a doc_id count as occurrences of their own and their spans are merged
under that id; a passage repeated inside one document counts; where least hashes tie the leftmost is the
anchor; an empty table gives an empty result; other columns are ignored.  Words are runs of bytes above 0x20.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import common as C

WINDOW, GRAM = 50, 10
#: Words of the distinct snippets of an anchor that go into one array (some 300 MB as Python's lists); more are split.
MOST = 1_000_000


# ---------------------------------------------------------------- suffix sorting

def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a list of non-negative integers."""
    n = len(text)
    if not n:
        return []
    order = np.argsort(np.asarray(text), kind="stable")
    arr: list[int] = order.tolist()
    ranked = np.asarray(text)[order]
    heads = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    sizes = np.diff(np.r_[heads, n])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    pos: list[int] = place.tolist()
    gs = np.empty(n, np.int64)
    gs[order] = np.repeat(heads, sizes)
    start: list[int] = gs.tolist()
    length = np.zeros(n, np.int64)
    length[heads] = sizes
    size: list[int] = length.tolist()
    before = list(range(n + 1))  # before[i + 1]: i + 1 where suffix i is still open, else a link to its left
    smaller = [-1] * n

    def raise_(s: int, members: list[int]) -> None:
        """Move members of the group at s to a new group at its upper end."""
        z, k = size[s], len(members)
        if k == z:
            return
        at = s + z
        for p in members:
            at -= 1
            q, o = pos[p], arr[at]
            arr[q], arr[at] = o, p
            pos[o], pos[p] = q, at
            start[p] = at
        size[s] = z - k
        size[at] = k
        for p in members:
            start[p] = at

    top = n - 1
    while top >= 0:
        s = start[arr[top]]
        if s == top:
            i = arr[top]
            before[i + 1] = i
            x = i
            while before[x] != x:
                before[x] = x = before[before[x]]
            before[i + 1] = x
            if x:
                smaller[i] = p = x - 1
                g = start[p]
                z = size[g]
                if z > 1:
                    at = g + z - 1
                    q, o = pos[p], arr[at]
                    arr[q], arr[at] = o, p
                    pos[o], pos[p] = q, at
                    start[p] = at
                    size[g] = z - 1
                    size[at] = 1
        else:
            group = arr[s : top + 1]
            for i in group:
                before[i + 1] = i
            count: dict[int, int] = {}
            for i in group:
                x = i
                while before[x] != x:
                    before[x] = x = before[before[x]]
                before[i + 1] = x
                if x:
                    smaller[i] = x - 1
                    count[x - 1] = count.get(x - 1, 0) + 1
            if count:
                most = max(count.values())
                levels: list[list[int]] = [[] for _ in range(most + 1)]
                for p, c in count.items():
                    levels[c].append(p)
                for c in range(most, 0, -1):
                    split: dict[int, list[int]] = {}
                    for p in levels[c]:
                        split.setdefault(start[p], []).append(p)
                    for g, members in split.items():
                        raise_(g, members)
        top = s - 1

    out, free = [0] * n, list(range(n))

    j = n - 1
    while j >= 0:  # the suffixes that are followed by nothing smaller
        g = start[j]
        out[free[g]] = j
        free[g] += 1
        j = smaller[j]
    for r in range(n):
        s = out[r]
        stop, j = smaller[s], s - 1
        while j != stop:
            g = start[j]
            out[free[g]] = j
            free[g] += 1
            j = smaller[j]
    return out


def neighbours(text: list[int], sa: list[int]) -> list[int]:
    """For each position the longest prefix that its suffix shares with an adjacent one in the array."""
    n = len(text)
    rank = [0] * n
    for r, i in enumerate(sa):
        rank[i] = r
    best, h = [0] * n, 0
    for i in range(n):
        r = rank[i]
        if r:
            j = sa[r - 1]
            m = n - (i if i > j else j)
            while h < m and text[i + h] == text[j + h]:
                h += 1
            if h > best[i]:
                best[i] = h
            if h > best[j]:
                best[j] = h
            if h:
                h -= 1
        else:
            h = 0
    return best


# ---------------------------------------------------------------- places

def _snippet_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, rel: np.ndarray) -> np.ndarray:
    """The place of the anchor in its snippet belongs to what is compared."""
    return C.mix(C.span_hashes(h, lo, hi) + rel.astype(np.int64).view(np.uint64))


def places(h: np.ndarray, row: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors chosen by the windows of a run of rows: hash, snippet hash, row, first window start, windows, the anchor's place in the snippet."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    n = len(h) - window + 1
    if n <= 0:
        return none
    g, width = C.grams(h, gram), window - gram + 1
    # leftmost least gram of each window: double the reach of (value, index) minima
    val, idx, reach = g, np.arange(len(g)), 1
    while reach < width:
        step = min(reach, width - reach)
        a, b, ia, ib = val[: len(val) - step], val[step:], idx[: len(idx) - step], idx[step:]
        left = a <= b
        val, idx, reach = np.where(left, a, b), np.where(left, ia, ib), reach + step
    ok = row[:n] == row[window - 1 :]
    anchor = np.where(ok, idx[:n], -1)
    cut = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:n] != row[: n - 1])])
    end = np.r_[cut[1:], n]
    live = anchor[cut] >= 0
    lo, count = cut[live], (end - cut)[live]
    rel = anchor[lo] - lo
    return val[:n][lo], _snippet_hash(h, lo, lo + count + window - 1, rel), row[lo], lo, count, rel


def _anchors(window: int, gram: int, only: bool = False):
    """The places of documents, or only their anchors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            data, off = C.buffers(batch.column(1))
            for i, j, d, o in C.pieces(data, off):
                h, _, _, row = C.word_hashes(d, o)
                a, snip, r, lo, count, rel = places(h, row, window, gram)
                if only:
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64))], names=["h"])
                    continue
                first = np.searchsorted(row, r)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(snip.view(np.int64)), ids[i:j].take(pa.array(r)), *(pa.array(x.astype(np.int32)) for x in (lo - first, count, rel))], names=["h", "snip", "doc_id", "lo", "n", "rel"]
                )

    return run


_WORDS = "h long, anchor long, snip long, c long, f int, rel int, left int, right int, words binary"
_FIELDS = ("h", "anchor", "snip", "c", "f", "rel", "left", "right", "words")


def _word_rows(h, anchor, snip, c, f, rel, left, right, words) -> pa.RecordBatch:
    """(group, anchor, snippet, its occurrences, its first window here, the anchor's place in the words here, words known to be common on either side of the anchor, words)."""
    long, short = (lambda x: pa.array(np.asarray(x, np.int64))), (lambda x: pa.array(np.asarray(x, np.int32)))
    return pa.RecordBatch.from_arrays([long(h), long(anchor), long(snip), long(c), short(f), short(rel), short(left), short(right), pa.array(words, pa.binary())], names=list(_FIELDS))


def _fetch(window: int):
    """Documents with the places wanted of them -> the words of each snippet."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = C.buffers(batch.column("text"))
            want = batch.column("want")
            for i, j, d, o in C.pieces(data, off):
                h, _, _, row = C.word_hashes(d, o)
                part = want[i:j]
                of = np.repeat(np.arange(j - i), part.value_lengths().to_numpy(zero_copy_only=False))
                flat = part.flatten()
                key, snip, lo, n, rel, c = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("h", "snip", "lo", "n", "rel", "c"))
                lo = np.searchsorted(row, of) + lo
                hi = lo + n + window - 1
                ok = hi <= np.searchsorted(row, of, side="right")
                # where rows repeat a doc_id with another text, the place is of the other one
                ok[ok] = _snippet_hash(h, lo[ok], hi[ok], rel[ok]).view(np.int64) == snip[ok]
                words = [h[x:y].tobytes() for x, y in zip(lo[ok].tolist(), hi[ok].tolist())]
                none = np.zeros(len(words))
                yield _word_rows(key[ok], key[ok], snip[ok], c[ok], none, rel[ok], none, none, words)

    return run


def _split(window: int, gram: int):
    """Snippets of groups that are too large -> their parts in finer groups; see the module's docstring."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for h, anchor, snip, c, f, rel, left, right, raw in zip(*(batch.column(k).to_pylist() for k in _FIELDS)):
                words = np.frombuffer(raw, np.uint64)
                n, half = len(words) - window + 1, (window - gram - left - right + 1) // 2
                turn = min(max(rel - left - half + 1, 0), n)  # the windows before it reach far enough to the left
                for x, y, to_left in ((0, turn, True), (turn, n, False)):
                    if y > x:
                        s = rel - left - half if to_left else rel + gram + right
                        known = C.span_hashes(words, np.array([s]), np.array([s + half]))
                        key = C.mix(C.mix(np.array([h], np.int64).view(np.uint64) + np.uint64(1 + to_left)) ^ known).view(np.int64)[0]
                        out.append((key, anchor, snip, c, f + x, rel - x, left + half * to_left, right + half * (not to_left), words[x : y + window - 1].tobytes()))
            yield _word_rows(*(zip(*out) if out else [[]] * 9))

    return run


def repeated_windows(snippets: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For each snippet, which of its windows occur again in these snippets."""
    lengths = np.array([len(x) for x in snippets])
    flat, rank = np.unique(np.concatenate(snippets), return_inverse=True)
    text = np.empty(int(lengths.sum()) + len(snippets), np.int64)
    ends = np.cumsum(lengths + 1) - 1
    text[ends] = len(flat) + np.arange(len(snippets))  # separators are unique, so no match crosses one
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = rank
    text_list = text.tolist()
    hit = np.array(neighbours(text_list, suffix_array(text_list))) >= window
    return [hit[e - n : e - window + 1] for e, n in zip(ends.tolist(), lengths.tolist())]


def _compare(window: int, block: int):
    """Snippets sorted by group -> ranges of repeated windows of those that occur once."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        marks = repeated_windows([np.frombuffer(r[4], np.uint64) for r in rows], window)
        h, s, f, t = [], [], [], []
        for r, m in zip(rows, marks):
            if r[2] > 1 or not m.any():
                continue
            d = np.flatnonzero(np.diff(np.r_[False, m, False].astype(np.int8)))
            for x, y in zip(d[::2].tolist(), d[1::2].tolist()):
                h.append(r[5]), s.append(r[1]), f.append(r[3] + x), t.append(r[3] + y)
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(s, pa.int64()), pa.array(f, pa.int32()), pa.array(t, pa.int32())], names=["h", "snip", "f", "t"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        symbols = 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("h", "snip", "c", "f", "words", "anchor"))):
                if group and group[0][0] != r[0]:
                    held += group
                    group = []
                    if symbols > block:
                        yield solve(held)
                        held, symbols = [], 0
                if not group or group[-1][1:4] != r[1:4]:
                    group.append(r)
                    symbols += len(r[4]) // 8
        if held + group:
            yield solve(held + group)

    return run


def _small_groups(words: DataFrame, window: int, gram: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of at most ``most`` words, and those of groups that hold one window each (None if there are none)."""
    ready, single = [], None
    for _ in range(window):  # seven turns at the usual sizes
        large = words.groupBy("h").agg(F.sum(F.octet_length("words") / 8).alias("n")).where(F.col("n") > most).select(F.col("h").alias("large"))
        large = C.checkpointed(large)  # at most one for every ``most`` words of the table
        if large.head() is None:
            ready.append(words)
            break
        same = F.col("h") == F.col("large")
        ready.append(words.join(large, same, "left_anti"))
        parts = C.checkpointed(words.join(large, same).select(*_FIELDS).mapInArrow(_split(window, gram), _WORDS))
        done = F.col("left") + F.col("right") + gram >= window
        if parts.where(done).head() is not None:
            ended = parts.where(done)
            single = ended if single is None else single.unionByName(ended)
        words = parts.where(~done)
    out = ready[0]
    for r in ready[1:]:
        out = out.unionByName(r)
    return out, single


def repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = 200_000, most: int = MOST) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): maximal spans whose every window of that many words is repeated."""
    C.ship(docs.sparkSession)
    base = C.require(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    found = base.mapInArrow(_anchors(window, gram), "h long, snip long, doc_id long, lo int, n int, rel int")
    often = base.mapInArrow(_anchors(window, gram, only=True), "h long").groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h")
    a = C.checkpointed(found.join(often, "h"))
    kinds = a.groupBy("h", "snip").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "lo", "n", "rel")).alias("r"))
    several = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h")
    want = kinds.join(several, "h").groupBy(F.col("r.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("h", "snip", "r.lo", "r.n", "r.rel", "c")).alias("want"))
    words = C.checkpointed(base.join(want, "doc_id").select("text", "want").mapInArrow(_fetch(window), _WORDS))
    small, single = _small_groups(words, window, gram, most)
    compared = small.select("h", "snip", "c", "f", "words", "anchor").repartition("h").sortWithinPartitions("h", "snip", "f").mapInArrow(_compare(window, block), "h long, snip long, f int, t int")
    if single is not None:
        # rows that repeat a doc_id may bring a snippet twice; its occurrences are in c
        met = single.select("h", "anchor", "snip", "c", "f").distinct()
        again = met.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
        compared = compared.unionByName(met.where("c = 1").join(again, "h").select(F.col("anchor").alias("h"), "snip", "f", (F.col("f") + 1).alias("t")))
    ranges = kinds.where("c > 1").select("h", "snip", F.lit(0).alias("f"), F.col("r.n").alias("t")).unionByName(compared)
    spans = a.select("h", "snip", "doc_id", "lo").join(ranges, ["h", "snip"]).groupBy("doc_id", (F.col("lo") + F.col("f")).alias("s")).agg(F.max(F.col("lo") + F.col("t") + window - 1).alias("e"))  # one row at most for each word of a document
    by_doc = Window.partitionBy("doc_id").orderBy("s", "e")
    reach = F.max("e").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("new", (reach.isNull() | (F.col("s") > reach)).cast("int")).withColumn("span", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "span").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word")).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(C.read(spark, sf_dir, "documents"))
