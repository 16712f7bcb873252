import numpy as np

from tessera.llm import langid, linear

SCHEMA = "language string, doc_id long, lang string, text string, keep int"


def test_held_out_accuracy_and_calibration(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = docs.where("doc_id % 2 = 0")
    out = langid.identify(docs.where("doc_id % 2 = 1"), langid.train(train)).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    right = [r.language == r.lang for r in out]
    assert np.mean(right) > 0.98
    assert abs(np.mean([r.confidence for r in out]) - np.mean(right)) < 0.05
    assert np.mean([r.keep for r in out]) > 0.98


def test_cases(spark):
    rows = [(None, i, "ab"[i % 2], ("aa b " if i % 2 else "xyz zz ") * 20, 1) for i in range(60)]
    rows += [("q", 100, "a", None, 2), ("q", 101, "a", "", 2), ("q", 102, None, "12 34 %%", 3), ("q", None, None, "xyz zz xyz", 4), ("q", 103, None, "aa b " * 40000, 4), ("q", 3, "b", "aa b aa", 5), ("q", 3, "b", "aa b aa", 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.language, r.keep) for r in langid.identify(df).collect() if r.doc_id is None or r.doc_id >= 100 or r.doc_id == 3}
    assert got == {(100, None, False), (101, None, False), (102, None, False), (None, "a", True), (103, "b", True), (3, "b", True)}
    kept = langid.accepted(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert langid.identify(df).count() == len(rows)
    empty = df.limit(0)
    assert langid.identify(empty).collect() == [] and langid.accepted(empty).collect() == []
    assert {r.keep for r in langid.identify(df.where("lang is null")).collect()} == {False}
    one = langid.identify(df.where("lang = 'a'")).collect()
    assert {r.language for r in one} == {None, "a"}


def test_scores_equal_the_sum_over_the_vector():
    texts = ["Ärger über Öl", "", "x", "日本語 text", "a\U0001f600b"]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(b) for b in raw])]
    for fold in (True, False):
        cp, o = linear.codepoints(data, off, fold)
        assert [len(t) for t in texts] == np.diff(o).tolist()
        if not fold:
            assert cp.tolist() == [ord(c) for t in texts for c in t]
        w = np.zeros((linear.DIM + 1, 2), np.float32)
        w[:-1] = np.random.default_rng(1).normal(size=(linear.DIM, 2))
        s, n = linear.scores(data, off, w, fold)
        for i, (c, k) in enumerate(linear.vectors(data, off, fold)):
            assert n[i] == k.sum() and np.allclose(s[i], (w[c] * k[:, None]).sum(0) / max(1, k.sum()), atol=1e-5)


def test_a_rare_language_is_learned(spark):
    import random

    rnd = random.Random(1)
    say = lambda syllables: " ".join("".join(rnd.choice(syllables) for _ in range(3)) for _ in range(30))
    rows = [(i, say(["ka", "lo", "mi"]), "common") for i in range(3000)] + [(5000 + i, say(["sch", "zu", "ei"]), "rare") for i in range(12)] + [(9, say(["ka"]), "common")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    xs, ys = linear.sample(df, df["lang"], 100, fold=True)
    assert len(ys) == 100 and ys.count("rare") == 12
    out = langid.identify(spark.createDataFrame([(1, say(["sch", "zu", "ei"])), (2, say(["ka", "lo", "mi"]))], "doc_id long, text string"), langid.train(df, 100)).collect()
    assert {r.doc_id: r.language for r in out} == {1: "rare", 2: "common"}
    assert linear.shares({"a": 5, "b": 1000, "c": 1000}, 105) == {"a": 5, "b": 50, "c": 50}
