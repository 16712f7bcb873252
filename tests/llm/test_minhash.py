import random
from functools import lru_cache

import numpy as np

from tessera.llm import common as C
from tessera.llm import minhash


@lru_cache(None)
def shingle_set(t):
    w = t.split()
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2)))


def jac(a, b):
    x, y = shingle_set(a), shingle_set(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def corpus(seed=5):
    rnd = random.Random(seed)
    prose = lambda n: [f"v{rnd.randrange(3000)}" for _ in range(n)]
    rows, n = [], 0
    for fam in range(40):
        base = prose(rnd.randrange(30, 300))
        for c in range(rnd.choice([1, 1, 2, 3, 12])):
            w = list(base)
            for k in range(len(w) * c // 60):
                w[rnd.randrange(len(w))] = f"e{rnd.random()}"
            rows.append((n, " ".join(w)))
            n += 1
    return rows


def components(pairs):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {x: find(x) for x in p}


def test_recall_and_precision_against_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r.keeper_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    root = lambda x: got.get(x, x)
    near = [(a, b) for i, (a, s) in enumerate(rows) for b, t in rows[:i] if jac(s, t) >= 0.55]
    assert len(near) > 100
    assert sum(root(a) == root(b) for a, b in near) >= 0.97 * len(near)
    loose = components([(a, b) for i, (a, s) in enumerate(rows) for b, t in rows[:i] if jac(s, t) >= 0.3])
    assert all(loose.get(a) == loose.get(b) for a, b in got.items())


def test_cases(spark):
    t = " ".join(f"q{i}" for i in range(80))
    rows = [(5, t, "a"), (3, t, "b"), (9, t + " end", "c"), (None, t, "d"), (11, None, "e"), (12, "", "f"), (13, "", "g"), (14, "one", "h"), (15, "one two", "i"), (16, "one two", "j"), (20, " ".join(f"z{i}" for i in range(60000)), "k"), (21, "zz yy xx ww", "l"), (21, "zz yy xx ww", "m"), (22, None, "n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, key int")
    got = {(r.doc_id, r.keeper_id) for r in minhash.near_duplicates(df).collect()}
    assert got == {(5, 3), (9, 3), (13, 12), (16, 15)}
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.source) for r in kept.collect() if r.doc_id != 21) == sorted([(3, "b"), (-1, "d"), (11, "e"), (12, "f"), (14, "h"), (15, "i"), (20, "k"), (22, "n")])
    assert kept.where("doc_id = 21").count() == 1
    none = df.limit(0)
    assert minhash.near_duplicates(none).count() == 0 and minhash.drop_near_duplicates(none).count() == 0


def test_densified_sketch_estimates_jaccard():
    texts = ["a b c d e f g", "a b c d e f g h"]
    raw = "".join(texts).encode()
    off = np.array([0, len(texts[0]), len(raw)])
    sig = minhash.sketch(np.frombuffer(raw, np.uint8), off)
    assert not (sig == minhash._EMPTY).any()
    assert abs((sig[0] == sig[1]).mean() - 5 / 6) < 0.25
    h, s, e, row = C.word_hashes(np.frombuffer(raw, np.uint8), off)
    assert len(h) == 15 and (h[:7] == h[7:14]).all()


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.id: r.root for r in C.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


def test_a_text_is_dropped_only_as_a_copy(spark):
    t, u, v = (" ".join(f"{k}{i}" for i in range(90)) for k in "tuv")
    rows = [(1, t, "b"), (1, t, "a"), (1, u, "c"), (2, u + " end", "d"), (3, v, "e"), (3, t + " end", "f"), (None, t, "g"), (None, t, "g"), (4, v, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark_id string").repartition(3)
    got = sorted(minhash.drop_near_duplicates(df).collect(), key=str)
    assert sorted((r.doc_id or 0, r.mark_id) for r in got) == [(0, "g"), (0, "g"), (1, "a"), (1, "c"), (3, "e")]
    assert {tuple(r) for r in minhash.near_duplicates(df).collect()} == {(2, 1), (3, 1), (4, 3)}
    monkey = minhash.BROADCAST_ROWS
    try:
        minhash.BROADCAST_ROWS = 0  # the same by a shuffle
        assert sorted(minhash.drop_near_duplicates(df).collect(), key=str) == got
    finally:
        minhash.BROADCAST_ROWS = monkey


def test_copies_of_a_passage_that_many_texts_quote(spark):
    rnd = random.Random(9)
    prose = lambda n: [f"v{rnd.randrange(100_000)}" for _ in range(n)]
    passage = prose(150)
    rows = [(i, " ".join(prose(200) + passage + prose(150))) for i in range(1500)]
    near = []
    for i in range(30):
        w = list(passage)
        for k in rnd.sample(range(150), 5):
            w[k] = f"e{rnd.random()}"
        near.append((10_000 + i, " ".join(w)))
    got = {r.doc_id: r.keeper_id for r in minhash.near_duplicates(spark.createDataFrame(rows + near, "doc_id long, text string")).collect()}
    assert all(got.get(10_000 + i) == 10_000 for i in range(1, 30)) and not any(i < 10_000 for i in got)
