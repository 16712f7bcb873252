import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffix


@pytest.mark.parametrize("letters", [1, 2, 3, 20])
def test_suffix_array_equals_sorting(letters):
    rnd = random.Random(letters)
    for n in [0, 1, 2, 3, 7, 40, 200]:
        for _ in range(60):
            t = [rnd.randrange(letters) for _ in range(n)]
            sa = suffix.suffix_array(t)
            assert sa == sorted(range(n), key=lambda i: t[i:])
            best = suffix.neighbours(t, sa)
            for i in range(n):
                assert best[i] == max((next((k for k in range(n) if max(i, j) + k >= n or t[i + k] != t[j + k]), 0) for j in range(n) if j != i), default=0)


def brute(rows, window):
    words = [(d, t.split()) for d, t in rows if d is not None and t is not None]
    seen = Counter(tuple(w[i : i + window]) for _, w in words for i in range(len(w) - window + 1))
    cover = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                cover.setdefault(d, set()).add((i, i + window))
    out = set()
    for d, spans in cover.items():
        s = e = None
        for a, b in sorted(spans):
            if s is None or a > e:
                if s is not None:
                    out.add((d, s, e))
                s, e = a, b
            e = max(e, b)
        out.add((d, s, e))
    return out


def fixture_rows(seed, window):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passage = prose(window + 13)
    rows = []
    for i in range(60):
        w = prose(rnd.randrange(0, 4 * window))
        if i % 4 == 0:
            at = rnd.randrange(len(w) + 1)
            w[at:at] = passage
        if i % 7 == 0 and rows:
            w = rows[-1][1].split()
            for _ in range(2):
                if w:
                    w[rnd.randrange(len(w))] = "edited"
        rows.append((i, " ".join(w)))
    rows += [(100, "é " * (window + 5)), (101, ""), (102, None), (None, rows[0][1]), (103, " ".join(passage[:window])), (104, " ".join(passage[: window - 1])), (105, rows[4][1]), (105, rows[4][1]), (106, "\n".join(passage)), (7, "other text")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_equal_brute_force(spark, seed):
    rows = fixture_rows(seed, 50)
    df = spark.createDataFrame([(t, "x", i, d) for i, (d, t) in enumerate(rows)], "text string, source string, h long, doc_id long")
    got = {tuple(r)[:3] for r in suffix.repeated_passages(df).collect()}
    assert got == brute(rows, 50)


@pytest.mark.parametrize("block,most", [(1, 10**9), (1, 1), (10**6, 200)])
def test_small_blocks_and_split_anchors_agree(spark, block, most):
    rows = fixture_rows(3, 50)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {tuple(r)[:3] for r in suffix.repeated_passages(df, block=block, most=most).collect()} == brute(rows, 50)


def test_one_anchor_over_the_bound(spark):
    """A ten-word phrase in all documents: its snippets have more words than MOST and are split, not sampled."""
    rnd = random.Random(4)
    phrase = [f"p{i}" for i in range(10)]
    rows, seen = [], []
    for i in range(600):
        left, right = ([f"v{rnd.randrange(10**6)}" for _ in range(60)] for _ in range(2))
        if i % 3 == 0 and seen:
            left, right = (left, rnd.choice(seen)[1]) if i % 2 else (rnd.choice(seen)[0], right)
        seen.append((left, right))
        rows.append((i, " ".join(left + phrase + right)))
    rows += [(1000, "na " * 3000), (1001, "na " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r)[:3] for r in suffix.repeated_passages(df, most=1500).collect()} == brute(rows, 50)


def test_empty_table(spark):
    assert suffix.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_long_row_is_its_own_piece():
    from tessera.llm import common as C

    data = np.full(50, 97, np.uint8)
    assert [(i, j) for i, j, _, _ in C.pieces(data, np.array([0, 5, 45, 45, 50]), 10)] == [(0, 1), (1, 2), (2, 4)]
