"""Source, store, entry points, packs, command line, streaming."""

import os

import pytest
from pyspark.sql import functions as F

from tessera import api, cli
from tessera.functions import paths, text, tokens
from tessera.operators import latch, lookup, store
from tessera.operators.pack import ContextPlugin, Packer
from tessera.operators.store import IndexStore
from tessera.parsing.languages import BY_EXTENSION
from tessera.parsing.tables import symbols_of, with_symbols
from tessera.sources import repo
from tessera.streaming.incremental import merge_batch


def write(root, files):
    for name, content in files.items():
        p = os.path.join(root, name)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(content.encode() if isinstance(content, str) else content)


def names(root, **o):
    return [p for p, _ in repo.walk(str(root), repo.Options(**o))]


# ---------------------------------------------------------------- source

def test_walk_leaves_out(tmp_path):
    write(tmp_path, {".env": "x", "id_rsa": "x", "config.pem": "x", "normal.txt": "x", "test.exe": "x", ".hid/a.txt": "x", "big.txt": "x" * 600_000, "__init__.py": "", "ignored_dir/a.txt": "x", ".gitignore": "ignored_dir/\n*.log\n!keep.log\n/top.txt\n", "a.log": "x", "sub/keep.log": "x", "top.txt": "x", "sub/top.txt": "x", "drafts/d.txt": "x", ".indexignore": "drafts/\n"})
    assert names(tmp_path) == ["__init__.py", "normal.txt", "sub/keep.log", "sub/top.txt"]
    assert "drafts/d.txt" in names(tmp_path, ignore_file=None) and "a.log" in names(tmp_path, respect_gitignore=False)


@pytest.mark.parametrize("rule,path,folder,hit", [("*.py", "a/b.py", False, True), ("a/*.py", "a/b.py", False, True), ("a/*.py", "a/c/b.py", False, False), ("a/**/b", "a/x/y/b", False, True), ("**/b", "b", False, True), ("x/", "x", False, False), ("x/", "d/x", True, True), ("[!a].c", "b.c", False, True), (r"\#x", "#x", False, True), ("a/**", "a/b/c", False, True)])
def test_ignore_rules(rule, path, folder, hit):
    assert repo._ignored(path, folder, [("", [repo._rule(rule)])]) is hit


def test_links_and_limits(tmp_path, spark):
    write(tmp_path, {"out.txt": "x", "tree/a.txt": "x"})
    os.symlink(tmp_path / "out.txt", tmp_path / "tree/link.txt")
    with pytest.raises(repo.PathTraversalError):
        repo.read_repo(spark, str(tmp_path / "tree"))
    assert names(tmp_path / "tree", on_escape="skip") == ["a.txt"]
    write(tmp_path, {f"many/{i}.txt": "x" for i in range(10)})
    with pytest.raises(repo.FileCountLimitExceeded):
        repo.read_repo(spark, str(tmp_path / "many"), repo.Options(max_file_count=5))
    assert repo.read_repo(spark, str(tmp_path / "many"), repo.Options(max_file_count=10), 3).count() == 10


def test_content_rules(tmp_path, spark):
    write(tmp_path, {"nul.txt": b"a\x00b", "ff.txt": b"a\xff", "h.txt": "hello world"})
    rows = {r.path: r for r in api.hashed(repo.read_repo(spark, str(tmp_path))).collect()}
    assert set(rows) == {"ff.txt", "h.txt"} and rows["h.txt"].hash == "b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9"


# ---------------------------------------------------------------- expressions

def test_expressions(spark):
    df = spark.createDataFrame([("a\n  \n\n\tb http://x\n/* c */<!-- d\n -->#e", b"h\xffw", "x" * 3)], "t string, b binary, s string")
    r = df.select(
        text.remove_empty_lines(F.col("t")).alias("r1"), text.strip_comments(F.col("t")).alias("r34"), text.decoded(F.col("b")).alias("d"), text.is_utf8(F.col("b")).alias("u"), text.truncate_base64(F.concat("s", F.repeat(F.lit("A"), 97))).alias("b64"),
        text.cdata(F.lit("a]]>b")).alias("c"), text.name_contains(F.lit("École_x"), "éCOLE").alias("n1"), text.name_contains(F.lit("École_x"), "COLE%X").alias("n2"), text.strip_line_comments(F.lit("a // b\r\nc")).alias("crlf"),
    ).head()
    assert r.r1 == "a\n\tb http://x\n/* c */<!-- d\n -->#e" and r.r34 == "a\n  \n\n\tb http:\n#e" and r.d == "h�w" and not r.u
    assert r.b64 == "[TRUNCATED_BASE64]" and r.c == "a]]]]><![CDATA[>b" and not r.n1 and r.n2 and r.crlf == "a \nc"


@pytest.mark.parametrize("glob,path,hit", [("**/*.toml", "x.toml", True), ("*.rs", "a/b.rs", True), ("{a,b}.c", "b.c", True), ("[!a]?.c", "bx.c", True), ("src/**", "src/a/b", True), ("a.c", "xa.c", False), ("A.c", "a.c", False), ("a/**/b", "a/b", True)])
def test_globs(spark, glob, path, hit):
    assert spark.range(1).select(paths.selected(F.lit(path), [glob])).head()[0] is hit
    assert paths.glob_regex("[z-a]") is None and paths.glob_regex("{a") is None


def test_latch_is_sticky_and_equals_a_loop(spark):
    sizes = [5, 9, 30, 1, 1, 40, 2] * 9
    df = spark.createDataFrame([(f"p{i:03}", n, n + 2) for i, n in enumerate(sizes)], "path string, content_tokens long, rendered_tokens long").repartition(3)
    for limit in (0, 17, 100, 500, 10**6):
        total, flag, want = 3, False, {}
        for i, n in enumerate(sizes):
            flag = flag or total + n > limit
            want[f"p{i:03}"] = flag
            total += n + 2
        assert {r.path: r.degraded for r in latch.degraded(df, limit, 3).collect()} == want
    assert latch.degraded(df.limit(0), 5).collect() == []


def test_token_counters(spark):
    tiktoken = pytest.importorskip("tiktoken")  # noqa: F841
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    df = spark.createDataFrame([("hello world <|end|>",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(tokens.by_ranks(path, special={"<|end|>": 50256})("t")).collect()]
    assert got == [4, 0, None] and [r[0] for r in df.select(tokens.by_quarter_bytes(F.col("t"))).collect()] == [5, 0, None]


# ---------------------------------------------------------------- store and entry points

def parsed(spark, files):
    df = spark.createDataFrame([(p, c.encode()) for p, c in files.items()], "path string, content binary")
    return with_symbols(df.withColumn("hash", text.sha256(F.col("content"))).select("path", "hash", "content"))


def test_store(spark, tmp_path):
    s = IndexStore(spark, str(tmp_path / "s"), 4)
    assert s.files().count() == 0 and s.file_hash("a.py") is None and s.symbol_content("a.py::x") is None
    s.merge(parsed(spark, {"a.py": "def one():\n    pass\ndef two():\n    pass\ndef two():\n    return 2\n", "b.txt": "é", "c.rs": "struct Foo;\nimpl Foo { fn x() {} }\n"}))
    assert s.symbol_content("a.py::two") == b"def two():\n    return 2" and [tuple(r) for r in s.file_symbols("a.py").collect()] == [("Function", "one"), ("Function", "two")]
    assert {r.id: r.kind for r in s.symbols().collect()}["c.rs::Foo"] == "Impl" and s.symbols().count() == 4
    before, v = s.file_hash("a.py"), s.version()
    s.merge(parsed(spark, {"a.py": "x = 1\n"}))
    assert s.file_hash("a.py") != before and s.symbols().where("path = 'a.py'").count() == 0 and s.files().count() == 3 and s.version() == v + 1
    s.delete(spark.createDataFrame([("c.rs",)], "path string"))
    assert s.symbols().count() == 0 and s.files().count() == 2
    s.upsert_file("d.py", b"def f(): pass\n", symbols=symbols_of("def f(): pass\n", BY_EXTENSION["py"]))
    s.insert_symbol("d.py", {"name": "g", "qualified_name": "g", "kind": "Function", "start": 4, "end": 7, "body_start": None, "body_end": None, "ord": 1})
    assert sorted(r.id for r in s.symbols().collect()) == ["d.py::f", "d.py::g"] and s.symbol_content("d.py::g") == b"f()"
    with pytest.raises(LookupError):
        s.insert_symbol("nope", {"qualified_name": "g"})


def test_layers_are_compacted_and_writers_collide(spark, tmp_path):
    s = IndexStore(spark, str(tmp_path / "s"), 1)
    for i in range(store.MAX_LAYERS + 3):
        s.merge(parsed(spark, {"a.py": f"def f{i}(): pass\n", f"b{i}.txt": "x"}), removed=spark.createDataFrame([(f"b{i - 2}.txt",)], "path string"))
        layers = s.manifest()["layers"]["0"]
        assert len(layers) <= store.MAX_LAYERS and [r.name for r in s.symbols().collect()] == [f"f{i}"]
        assert sorted(r.path for r in s.files().collect()) == sorted(["a.py", f"b{i}.txt"] + [f"b{i - 1}.txt"] * (i > 0))
    assert 1 < len(layers) < store.MAX_LAYERS
    v, m = s.version(), s.manifest()
    s._publish(m, v)
    with pytest.raises(RuntimeError):
        s._publish(m, v)  # another writer has published v + 1
    assert s.version() == v + 1


REPO = {"dummy.rs": "// a comment\n/* block */\npub fn hello_world() {\n    let x = 1;\n}\n\n\n\nstruct Unit;\n", "dummy.toml": '[a]\nb = "c"\n', "base64.txt": 'x = "' + "QUJD" * 32 + '"\n'}


def test_entry_points(spark, tmp_path, capsys, monkeypatch):
    write(tmp_path, REPO)
    root = str(tmp_path)
    s = api.index(spark, root)
    assert api.search(spark, root, "HELLO") == ["dummy.rs::hello_world"]
    assert api.get(spark, root, "dummy.rs::hello_world").startswith("pub fn hello_world()") and api.get(spark, root, "dummy.toml") == REPO["dummy.toml"]
    assert "pub fn hello_world() ..." in api.outline(spark, root, "dummy.rs") and api.outline(spark, root, "dummy.toml") == REPO["dummy.toml"]
    for call in (lambda: api.get(spark, root, "nope::x"), lambda: api.get(spark, root, "nope"), lambda: api.outline(spark, root, "src")):
        with pytest.raises(api.NotFound):
            call()
    v = s.version()
    assert api.index(spark, root).version() == v  # nothing has changed
    write(tmp_path, {"dummy.rs": "fn other() {}\n"})
    os.remove(tmp_path / "dummy.toml")
    api.index(spark, root)
    assert api.search(spark, root, "o") == ["dummy.rs::other"] and s.files().count() == 3
    assert "dummy.toml" not in api.pack(spark, root)
    api.index(spark, root, purge=True)
    assert s.files().count() == 2
    monkeypatch.chdir(tmp_path)
    assert cli.main(["search", "other"], spark) == 0 and capsys.readouterr().out == "dummy.rs::other\n"
    assert cli.main(["index"], spark) == 0 and cli.main(["get", "zz"], spark) == 1 and cli.main(["outline", "dummy.rs"], spark) == 0
    assert cli.main(["pack", "dummy.rs", "-f", "markdown"], spark) == 0
    assert "## ./dummy.rs\n\n```\nfn other() ..." in capsys.readouterr().out


class Injected(ContextPlugin):
    def detect(self, path):
        return path.endswith(".rs")

    def enrich(self, path, content, metadata):
        return F.create_map(F.lit("injected"), F.lit("true"))


def test_packs(spark):
    files = spark.createDataFrame([(p, c.encode()) for p, c in REPO.items()] + [("bad.txt", b"\xff")], "path string, content binary")
    xml = Packer("XML").register_plugin(Injected()).text(files)
    assert xml.startswith("<repository>\n  <skeleton_map>\n") and xml.endswith("</repository>\n") and "      <signature>Function hello_world</signature>\n" in xml and '<metadata key="injected">true</metadata>' in xml
    assert '\n  <file path="./bad.txt">' not in xml and '\n    <file path="./bad.txt">' in xml
    md = Packer("markdown").text(files)
    assert md.startswith("## Skeleton Map\n\n- ./bad.txt\n") and "- ./dummy.rs\n  - Function hello_world\n  - Struct Unit\n" in md and "## ./dummy.toml\n\n```\n" in md
    assert "skeleton_map" not in Packer(no_file_summary=True).text(files)
    bare = Packer(no_files=True).text(files)
    assert "CDATA" not in bare and bare.endswith("  </skeleton_map>\n</repository>\n")
    clean = Packer(remove_comments=True, remove_empty_lines=True, truncate_base64=True).text(files)
    assert "a comment" not in clean and "block" not in clean and "[TRUNCATED_BASE64]" in clean and "QUJD" not in clean
    small = Packer(max_tokens=10).text(files)
    assert "CDATA" not in small and '<file path="./dummy.rs">\n  </file>' in small
    assert "let x = 1" in Packer(full=True).text(files)
    assert Packer().text(files.limit(0)) == "<repository>\n  <skeleton_map>\n  </skeleton_map>\n</repository>\n"


def test_stream_batches(spark, tmp_path):
    s = IndexStore(spark, str(tmp_path / "s"), 2)
    batch = spark.createDataFrame([("a.py", b"def f(): pass\n", 1), ("a.py", b"def g(): pass\n", 2), ("b.py", b"x", 1)], "path string, content binary, at long")
    merge_batch(s, batch, "at")
    merge_batch(s, batch, "at")
    assert [r.id for r in s.symbols().collect()] == ["a.py::g"] and s.version() == 1
    merge_batch(s, spark.createDataFrame([("a.py", None, 3)], batch.schema), "at")
    assert s.symbols().count() == 0 and s.files().count() == 1


def test_containing_in_blocks_and_odd_rows(spark):
    texts = spark.createDataFrame([(1, "abcabd", "x"), (2, None, "y"), (3, "", "z"), (4, "abd abd", None)], "id int, t string, found_ string")
    parts = spark.createDataFrame([("abc", 1), ("abd", 2), ("abd", 3), ("", 4), (None, 5)], "p string, k int")
    want = {(i, k) for i, t in ((1, "abcabd"), (3, ""), (4, "abd abd")) for p, k in (("abc", 1), ("abd", 2), ("abd", 3), ("", 4)) if p in t}
    for most in (10**6, 4, 1):
        out = lookup.containing(texts, parts, texts["t"], parts["p"], most)
        assert out.columns == ["id", "t", "found_", "p", "k"] and {(r.id, r.k) for r in out.collect()} == want and out.count() == len(want)
    assert lookup.containing(texts.limit(0), parts, texts["t"], parts["p"]).collect() == [] and lookup.containing(texts, parts.limit(0), texts["t"], parts["p"]).collect() == []


def test_ignore_files_above_and_global(tmp_path, monkeypatch):
    home = tmp_path / "home"
    write(home, {".config/git/ignore": "*.bak\n"})
    monkeypatch.setenv("HOME", str(home))
    monkeypatch.delenv("XDG_CONFIG_HOME", raising=False)
    tree = tmp_path / "r"
    write(tree, {".git/HEAD": "x", ".gitignore": "*.log\n/sub/top.txt\n", ".ignore": "secret/\n", "sub/a.log": "x", "sub/top.txt": "x", "sub/deep/top.txt": "x", "sub/secret/x.txt": "x", "sub/b.bak": "x", "sub/k.txt": "x", "sub/.gitignore": "!keep.log\n", "sub/keep.log": "x"})
    write(tmp_path, {".gitignore": "k.txt\n"})  # above the repository: not its rule
    assert names(tree / "sub") == ["deep/top.txt", "k.txt", "keep.log"]
    assert names(tree / "sub", respect_gitignore=False) == ["a.log", "b.bak", "deep/top.txt", "k.txt", "keep.log", "secret/x.txt", "top.txt"]


def test_skipped_files_are_named(spark, caplog):
    files = spark.createDataFrame([("a.txt", b"ok"), ("b.txt", b"\xff"), ("c.txt", None)], "path string, content binary")
    with caplog.at_level("WARNING"):
        Packer().text(files)
    assert [r.getMessage() for r in caplog.records if "skipped" in r.getMessage()] == ["skipped b.txt: not UTF-8", "skipped c.txt: not UTF-8"]
    assert {r.path for r in Packer().unreadable(files).collect()} == {"b.txt", "c.txt"}


def test_skeletons_equal_the_expression(spark):
    from tessera.functions import skeleton
    from tessera.parsing.tables import with_skeletons

    files = spark.createDataFrame([("a.py", "class É:\n    def f(self):\n        return 1\n\ndef g(): pass\n".encode()), ("b.rs", b"fn f() { 1 }\nstruct U;\n"), ("c.txt", b"x"), ("d.py", b"\xff"), ("e.py", None), (None, b"x"), ("f.go", b"")], "path string, content binary")
    one = {r.path: None if r.skeleton is None else bytes(r.skeleton).decode() for r in with_skeletons(files).collect()}
    two = {r.path: r.s for r in with_symbols(files).select("path", F.when(F.col("symbols").isNotNull(), skeleton.elide(F.col("content"), F.col("symbols"))).alias("s")).collect()}
    assert one == two and one["a.py"] == "class É:...\n\ndef g():...\n" and one["d.py"] is None and one["f.go"] == ""
