"""What a task holds doesn't grow with the table."""

import hashlib
import random

import pytest

from tessera.functions import tokens
from tessera.operators import digest, latch
from tessera.session import BATCH_BYTES


@pytest.mark.parametrize("library", [True, False])
def test_a_hash_is_taken_up_by_its_state(library, monkeypatch):
    if not library:
        monkeypatch.setattr(digest, "_library", lambda: None)
    rng = random.Random(1)
    for _ in range(20):
        cuts = [rng.randbytes(rng.choice((0, 1, 55, 56, 63, 64, 65, 200))) for _ in range(4)]
        sha = digest.Sha256()
        for c in cuts:
            sha = digest.Sha256(sha.state)
            sha.update(c)
        assert sha.hexdigest() == hashlib.sha256(b"".join(cuts)).hexdigest()


def test_documents_are_hashed_in_pieces(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(k, f"{i:04}", None if i % 7 == 0 else "é" * rng.randrange(200)) for k, n in (("a", 300), (None, 40), ("b", 3), ("z", 90)) for i in range(n)] + [("none", "1", None)]
    df = spark.createDataFrame(rows, "lang string, path string, text string").repartition(5)
    want = {k: hashlib.sha256("".join(t for g, _, t in sorted(r for r in rows if r[0] == k) if t).encode()).hexdigest() for k in ("a", None, "b", "z")} | {"none": None}
    for piece in (10**9, 20_000, 3_000):
        got = digest.document_hashes(df, "lang", "path", F.col("text"), F.octet_length("text"), piece).collect()
        assert len(got) == len(want) and {r.lang: r.hash for r in got} == want


def test_tokens_are_counted_in_small_batches_and_once(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(setting, "64m")
    log = tmp_path / "log"

    class Encoding:
        def encode(self, text, **_):
            with open(log, "a") as f:
                f.write(".")
            return text.split()

    monkeypatch.setattr(tokens, "encoding", lambda *_: Encoding())
    df = spark.range(300).select(F.format_string("%03d", "id").alias("path"), F.repeat(F.lit("a b "), 20).alias("text"))
    sized = df.select("path", tokens.by_ranks("none")(F.col("text")).alias("content_tokens")).withColumn("rendered_tokens", F.col("content_tokens") + 7)
    assert 0 < int(spark.conf.get(setting)) <= BATCH_BYTES
    assert [r.path for r in latch.degraded(sized, 4_000).where("not degraded").orderBy("path").collect()] == [f"{i:03}" for i in range(85)]
    assert len(log.read_text()) == 300


def test_parsing_takes_no_step_for_each_character():
    import sys

    from tessera.parsing import scanner
    from tessera.parsing.languages import BY_EXTENSION

    def calls(source):
        n = 0

        def count(frame, event, _):
            nonlocal n
            n += event in ("call", "c_call")

        sys.setprofile(count)
        try:
            found = scanner.parse(source.encode(), BY_EXTENSION["ts"])
        finally:
            sys.setprofile(None)
        return n, [s.qualified_name for s in found]

    short, long = (calls("class C {\n  method(%s: number): void { x(); }\n}\n" % ("a" * k)) for k in (1, 5_000))
    assert short[1] == long[1] == ["C", "C.method"] and long[0] < 1.5 * short[0]


def test_the_start_of_a_body_is_found_from_where_it_is():
    from tessera.parsing import scanner

    class Text(str):
        def __getitem__(self, at):
            assert not isinstance(at, slice) or at.start is not None, "the whole text before the body was copied"
            return str.__getitem__(self, at)

    assert scanner._body_start(Text("f()\n  {}"), 6) == 3 and scanner._body_start(Text("f() {}"), 4) == 4


def test_a_merge_stages_columns_and_writes_no_idle_paths(spark, tmp_path):
    import os

    from pyspark.sql import functions as F

    from tessera.functions import text
    from tessera.operators.store import IndexStore
    from tessera.parsing.tables import with_symbols

    def parsed(files):
        return with_symbols(spark.createDataFrame(files, "path string, content binary").select("path", text.sha256(F.col("content")).alias("hash"), "content"))

    def layers():
        return [sorted(os.listdir(tmp_path / "s/data" / f)) for f in sorted(os.listdir(tmp_path / "s/data"))]

    s = IndexStore(spark, str(tmp_path / "s"), 2)
    s.merge(parsed([(f"{i}.py", b"def f(): pass\n") for i in range(9)]))
    assert layers() == [["files", "symbols"]] and sorted(os.listdir(tmp_path / "s")) == ["data", "manifests"]
    s.merge(parsed([("1.py", b"def g(): pass\n"), ("x.py", b"def h(): pass\n")]), removed=spark.createDataFrame([("2.py",)], "path string"))
    assert layers()[1] == ["files", "paths", "symbols"]
    assert sorted(r.id for r in s.symbols().collect()) == sorted([f"{i}.py::f" for i in (0, 3, 4, 5, 6, 7, 8)] + ["1.py::g", "x.py::h"])


def test_outlines_spread_by_the_number_of_files(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tessera.operators import lookup
    from tessera.parsing.tables import exploded, with_symbols

    monkeypatch.setattr(lookup, "TASK_FILES", 10)
    files = spark.range(400).select(F.concat(F.col("id").cast("string"), F.lit(".py")).alias("path"), F.lit(b"def f(): pass\n").alias("content"))
    got = lookup.outlines(files, exploded(with_symbols(files))).withColumn("p", F.spark_partition_id()).collect()
    most = max(sum(r.p == p for r in got) for p in {r.p for r in got})
    assert len(got) == 400 and {r.outline for r in got} == {"def f():...\n"} and most < 40
