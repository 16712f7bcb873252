import random

import pytest

from tessera.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k", "byte_bpe_50k"])
def pair(request):
    path = f"/opt/tokenizers/{request.param}.tiktoken"
    codec, _ = bpe.load(path)
    return path, codec, tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_random_bytes_and_words_give_the_exact_merges(pair):
    path, codec, enc = pair
    rnd = random.Random(3)
    alphabet = [b"a", b"b", b"th", b"er", b"\xc3\xa9", b"\xff", b" ", b"00", b"ing", b"\xe4\xbd\xa0", b"A", b"tion"]
    for n in [1, 2, 3, 5, 9, 30, 400]:
        for _ in range(60):
            raw = b"".join(rnd.choice(alphabet) for _ in range(n)) if rnd.random() < 0.7 else bytes(rnd.randrange(256) for _ in range(n))
            ids = codec.encode_bytes(raw)
            assert ids == enc._encode_single_piece(raw)
            assert codec.decode(ids) == raw
    for t in ["", " ", "naïve café — 你好 12345 don't\n\n  x", "a" * 5000, "ab" * 3000, "\u0000‍🙂🙂"]:
        assert bpe.encode(t, path) == enc.encode_ordinary(t) and bpe.decode(bpe.encode(t, path), path) == t


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load(bpe.VOCABULARY)[0].ranks, special_tokens={})
    text = {r.doc_id: r.text for r in docs.collect()}
    out = bpe.encode_documents(docs)
    rows = out.collect()
    assert len(rows) == len(text) and all(r.round_trip and r.tokens == enc.encode_ordinary(text[r.doc_id]) and r.n_tokens == len(r.tokens) for r in rows)
    assert {r.doc_id: r.text for r in bpe.decode_documents(out).collect()} == text


def test_cases(spark):
    rows = [("x" * 300_000, 1, "a"), ("", 2, "b"), (None, 3, None), ("hi", None, "c"), ("hi", 4, "d"), ("hi", 4, "d"), (None, None, "e")]
    df = spark.createDataFrame(rows, "text string, doc_id long, tokens string").coalesce(1)
    got = sorted(((r.doc_id, None if r.tokens is None else len(r.tokens), r.round_trip) for r in bpe.encode_documents(df).collect()), key=str)
    n = len(bpe.encode("x" * 300_000))
    assert got == sorted([(1, n, True), (2, 0, True), (3, None, None), (None, 1, True), (4, 1, True), (4, 1, True), (None, None, None)], key=str)
    assert sorted(str(r.text)[:3] for r in bpe.decode_documents(bpe.encode_documents(df)).collect()) == sorted(["xxx", "", "Non", "hi", "hi", "hi", "Non"])
    assert bpe.encode_documents(df.limit(0)).collect() == []


def test_a_vocabulary_without_some_byte_is_refused():
    with pytest.raises(ValueError, match="lacks 253"):
        bpe.Codec({b"a": 0, b"b": 1, b"c": 2})


def test_executors_need_no_file(spark, tmp_path):
    import shutil

    path = str(tmp_path / "ranks.tiktoken")
    shutil.copy(bpe.VOCABULARY, path)
    df = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    out = bpe.encode_documents(df, path)
    shutil.move(path, path + ".moved")
    assert out.head().tokens == bpe.encode("hello world")
