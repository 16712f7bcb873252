import random

import duckdb
import pytest

import corpus_pipeline as P
from tessera.llm import bpe, langid, mixing, secrets

from test_minhash import components, jac


def test_stages_and_rows(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    text = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "secret_scan", "mix_sources", "bpe"]
    at, seen = docs, []
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, at, d).write.parquet(out := str(tmp_path / name))
        at = spark.read.parquet(out)
        seen.append(at.collect())
        if k < 4:
            assert at.columns == docs.columns
    lang, near, masked, mixed, ids = seen
    assert len(lang) >= 0.98 * len(text)
    assert len({r.text for r in near}) == len(near) and {r.text for r in lang} >= {r.text for r in near}
    assert {r.doc_id: r.text for r in masked} == {r.doc_id: secrets.mask(text[r.doc_id].text) for r in near}
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near} and len(mixed) == len(near)
    full = {r.doc_id: r.text for r in masked}
    assert len(ids) == len(mixed) and all(r.tokens == bpe.encode(full[r.doc_id]) for r in ids)
    assert sorted(map(tuple, ((r.doc_id, r.tokens) for r in P.run(spark, d).collect())), key=str) == sorted(((r.doc_id, r.tokens) for r in ids), key=str)


def brute_stages(spark, lang, near, masked, mixed, ids, docs):
    """Each stage against a version without sketches, batches or joins, on what the stage before it kept."""
    tiktoken = pytest.importorskip("tiktoken")
    kept = {r.doc_id for r in langid.identify(docs).collect() if r.keep}
    assert {r.doc_id for r in lang} == kept
    texts = sorted({(r.text, min(x.doc_id for x in lang if x.text == r.text)) for r in lang}, key=lambda x: x[1])
    sure = components([(i, j) for k, (t, i) in enumerate(texts) for u, j in texts[:k] if jac(t, u) >= 0.6])
    loose = components([(i, j) for k, (t, i) in enumerate(texts) for u, j in texts[:k] if jac(t, u) >= 0.3])
    left = {r.doc_id for r in near}
    assert len(left) == len(near) and left <= {i for _, i in texts}
    for groups, least in ((sure, None), (loose, 1)):
        for root in set(groups.values()):
            n = sum(i in left for i, g in groups.items() if g == root)
            assert n <= 1 if least is None else n >= 1
    assert {i for _, i in texts} - set(loose) <= left  # what resembles nothing stays
    by = {r.doc_id: r.text for r in near}
    assert {r.doc_id: (r.text, r.n_chars) for r in masked} == {i: (secrets.mask(t), len(secrets.mask(t))) for i, t in by.items()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r.doc_id, r.text, r.source) for r in masked])
    want = {i: n for i, _, n in con.execute(mixing.SQL).fetchall() if n}
    got = {}
    for r in mixed:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load(bpe.VOCABULARY)[0].ranks, special_tokens={})
    text = {r.doc_id: r.text for r in masked}
    assert all(r.tokens == enc.encode_ordinary(text[r.doc_id]) and r.round_trip for r in ids) and len(ids) == len(mixed)


def staged(spark, docs, d, tmp_path):
    out, at = [], docs
    for name, stage in P.STAGES:
        stage(spark, at, d).write.parquet(p := str(tmp_path / name))
        at = spark.read.parquet(p)
        out.append(at.collect())
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    brute_stages(spark, *staged(spark, docs, d, tmp_path), docs)


def test_odd_documents(spark, tmp_path):
    rnd = random.Random(1)
    prose = lambda: " ".join("".join(rnd.choice(["ka", "lo", "mi", "ta"]) for _ in range(3)) for _ in range(60))
    key = "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    t = prose()
    rows = [(i, prose(), "xx", f"s{i % 3}", 1, i, "x") for i in range(40)]
    rows += [(100, None, "xx", "s0", 0, 1, "a"), (101, "", "xx", "s0", 0, 1, "b"), (102, "12 34 %", "xx", None, 7, 1, "c"), (103, f'{prose()} token = "{key}"', None, None, 5, 1, "d"), (None, prose(), "xx", "s1", None, None, None), (None, t, "xx", "s1", 1, 1, "n")]
    rows += [(104, t, "xx", "s2", len(t), 1, "e"), (104, t, "xx", "s2", len(t), 1, "f"), (105, t + " ende", "xx", "s2", 1, 1, "g"), (106, prose() * 300, "xx", "s0", 1, 1, "h")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, confidence int, copies_ string"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    lang, near, masked, mixed, ids = staged(spark, docs, "", tmp_path)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in lang} == {100, 101, 102}
    assert len(near) == len(lang) - 2 and {r.copies_ for r in near} >= {"e", "n", "h"}  # one row of 104, and 105 is its near copy
    assert [r.text.endswith('token = "<SECRET>"') and r.n_chars == len(r.text) for r in masked if r.doc_id == 103] == [True]
    assert len(mixed) == len(masked) == len(ids) and set(mixed[0].asDict()) == set(docs.columns)
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    assert P.run(spark, f"{tmp_path}/odd").count() == len(ids)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert P.run(spark, f"{tmp_path}/none").collect() == []
