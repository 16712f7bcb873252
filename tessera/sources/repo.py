"""A source tree as a table: ``spark.read.format("repo").load(root)`` gives (path, size, content).

The driver walks the tree once, applies the rules that need no content, and hands chunks of paths to the
executors, which read each file once.  Options: maxFileBytes, maxFileCount, followSymlinks,
respectGitignore, ignoreFile, onEscape ("error" or "skip") and filesPerPartition.

Hidden names are left out.  Ignore files have the syntax of Git's and hold for their folder and below;
a rule of a deeper folder wins over one of a higher, a later over an earlier, and the custom file over
.ignore over .gitignore over .git/info/exclude over the user's global file (core.excludesFile, else
$XDG_CONFIG_HOME/git/ignore).  Ignore files of the folders above the root hold too; .gitignore only up to
the repository that the root lies in.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions import paths as P

SCHEMA = "path string, size bigint, content binary"


class IndexerError(Exception):
    """A tree that can't be indexed."""


class PathTraversalError(IndexerError):
    pass


class FileCountLimitExceeded(IndexerError):
    pass


@dataclass(frozen=True)
class Options:
    max_file_bytes: int = P.MAX_FILE_BYTES
    max_file_count: int = 100_000
    follow_symlinks: bool = False
    respect_gitignore: bool = True
    ignore_file: str | None = ".indexignore"
    on_escape: str = "error"


# ---------------------------------------------------------------- ignore rules

def _rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern, negated, folders only) of a line of an ignore file."""
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    only_folders = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = [], 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        if line[i:] == "**" and i and line[i - 1] == "/":
            out.append(".+")
            break
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := line.find("]", i + 2)) > 0:
            inside = line[i + 1 : end]
            out.append("[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", r"\\") + "]")
            i = end
        elif c == "\\" and i + 1 < len(line):
            i += 1
            out.append(re.escape(line[i]))
        else:
            out.append(re.escape(c))
        i += 1
    try:
        return re.compile(("" if anchored else "(?:.*/)?") + "".join(out) + r"\Z", re.S), negated, only_folders
    except re.error:
        return None


def _rules(file: str) -> list[tuple[re.Pattern, bool, bool]]:
    try:
        with open(file, encoding="utf-8", errors="replace") as f:
            return [r for r in map(_rule, f) if r]
    except OSError:
        return []


def _ignored(rel: str, folder: bool, levels: list[tuple[str, list]]) -> bool:
    """``levels``: (folder with a slash at its end or nothing, rules), the strongest last; "^x/" is a folder above of which the root is x."""
    for base, rules in reversed(levels):
        below = base[1:] + rel if base.startswith("^") else rel[len(base) :]
        for pattern, negated, only_folders in reversed(rules):
            if (folder or not only_folders) and pattern.match(below):
                return not negated
    return False


def _global_rules() -> list[tuple[re.Pattern, bool, bool]]:
    """Rules of the user's global ignore file."""
    home = os.path.expanduser("~")
    configs = [os.path.join(os.environ.get("XDG_CONFIG_HOME") or os.path.join(home, ".config"), "git"), home]
    for config in (os.path.join(home, ".gitconfig"), os.path.join(configs[0], "config")):
        try:
            with open(config, encoding="utf-8", errors="replace") as f:
                if m := re.search(r"^\s*excludesfile\s*=\s*\"?([^\"\n]+?)\"?\s*$", f.read(), re.I | re.M):
                    return _rules(os.path.expanduser(m[1]))
        except OSError:
            continue
    return _rules(os.path.join(configs[0], "ignore"))


def _above(top: str, names: list[str], git: bool) -> list[list[tuple[str, list]]]:
    """For each kind of ignore file the rules of the folders above the root, as levels whose base is negative: the path from there to the root."""
    out: list[list[tuple[str, list]]] = [[] for _ in names]
    at, inside = top, True
    while (up := os.path.dirname(at)) != at:
        inside = inside and not os.path.exists(os.path.join(at, ".git"))
        for k, name in enumerate(names):
            if (name != ".gitignore" or (git and inside)) and (r := _rules(os.path.join(up, name))):
                out[k].insert(0, ("^" + os.path.relpath(top, up) + "/", r))
        at = up
    return out


# ---------------------------------------------------------------- walk

def walk(root: str, o: Options = Options()) -> list[tuple[str, int]]:
    """(path below root, bytes) of every file that is to be read, in the order of paths."""
    top = os.path.realpath(root)
    if not os.path.isdir(top):
        raise IndexerError(f"no such folder: {root}")
    sources = ([".gitignore", ".ignore"] if o.respect_gitignore else []) + ([o.ignore_file] if o.ignore_file else [])
    levels0 = [("", r) for r in (_global_rules(), _rules(os.path.join(top, ".git", "info", "exclude"))) if r] if o.respect_gitignore else []
    in_git = os.path.exists(os.path.join(top, ".git")) or any(os.path.exists(os.path.join(u, ".git")) for u in _parents(top))
    higher = _above(top, sources, in_git)
    found: list[tuple[str, int]] = []
    # every kind of ignore file has levels of its own, as the kind decides before the depth
    todo: list[tuple[str, str, list[list[tuple[str, list]]], frozenset[str]]] = [(top, "", [levels0] + higher, frozenset([top]))]
    while todo:
        folder, base, kinds, above = todo.pop()
        here = [kinds[0]] + [k + ([(base, r)] if (r := _rules(os.path.join(folder, name))) else []) for k, name in zip(kinds[1:], sources)]
        levels = [level for kind in here for level in kind]
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            rel = base + e.name
            if e.name.startswith("."):
                continue
            is_dir = e.is_dir(follow_symlinks=o.follow_symlinks)
            if _ignored(rel, is_dir, levels):
                continue
            if is_dir:
                real = os.path.realpath(e.path)
                if e.is_symlink() and not _below(real, top):
                    _escape(rel, o)
                elif real not in above:
                    todo.append((e.path, rel + "/", here, above | {real}))
                continue
            if e.is_symlink() and os.path.isdir(e.path):
                continue
            real = os.path.realpath(e.path)
            if not os.path.exists(real):
                continue
            if not _below(real, top):
                _escape(rel, o)
                continue
            if e.is_symlink() and not o.follow_symlinks:
                continue
            if _secret(e.name) or _binary(e.name):
                continue
            size = os.stat(real).st_size
            if size <= o.max_file_bytes:
                found.append((rel, size))
    return sorted(found)


def _parents(folder: str) -> Iterator[str]:
    while (up := os.path.dirname(folder)) != folder:
        yield up
        folder = up


def _below(real: str, top: str) -> bool:
    return real == top or real.startswith(top.rstrip("/") + "/")


def _escape(rel: str, o: Options) -> None:
    if o.on_escape != "skip":
        raise PathTraversalError(f"{rel} leads out of the tree")


def _secret(name: str) -> bool:
    return name in P.SECRET_NAMES or name.startswith(P.SECRET_PREFIXES) or name.endswith(P.SECRET_SUFFIXES)


def _binary(name: str) -> bool:
    stem, dot, ext = name.rpartition(".")
    return bool(stem and dot) and ext.lower() in P.BINARY_EXTENSIONS


# ---------------------------------------------------------------- data source

class _Chunk(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def read_files(root: str, files: list[tuple[str, int]]) -> Iterator[tuple[str, int, bytes]]:
    """(path, size, content) of those that hold no NUL; a file that can't be read is empty."""
    for rel, size in files:
        try:
            with open(os.path.join(root, rel), "rb") as f:
                content = f.read()
        except OSError:
            content = b""
        if b"\x00" not in content[: P.SNIFFED_BYTES]:
            yield rel, size, content


class _Reader(DataSourceReader):
    def __init__(self, root: str, options: Options, chunk: int):
        self.root, self.options, self.chunk = root, options, chunk

    def partitions(self) -> list[InputPartition]:
        files = walk(self.root, self.options)
        return [_Chunk(files[i : i + self.chunk]) for i in range(0, len(files), self.chunk)] or [_Chunk([])]

    def read(self, partition: _Chunk) -> Iterator[tuple]:
        yield from read_files(self.root, partition.files)


class RepoSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repo"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        get = {k.lower(): v for k, v in self.options.items()}
        flag = lambda k, d: str(get.get(k, d)).lower() == "true"
        o = Options(
            int(get.get("maxfilebytes", P.MAX_FILE_BYTES)), int(get.get("maxfilecount", 100_000)), flag("followsymlinks", False), flag("respectgitignore", True), get.get("ignorefile", ".indexignore") or None, get.get("onescape", "error")
        )
        return _Reader(get["path"], o, int(get.get("filesperpartition", 256)))


def read_repo(spark: SparkSession, root: str, o: Options = Options(), files_per_partition: int = 256) -> DataFrame:
    """The files of a tree; raises where it leads out of itself or holds too many files.

    The tree is walked here, once, and each file is read when the result is used.  Files are counted in the
    walk; only where that finds more than the limit are they read to tell how many of them are binary.
    """
    root = os.path.abspath(root)  # the processes that read have working folders of their own
    files = walk(root, o)
    df = _contents(spark, root, files, files_per_partition)
    if len(files) > o.max_file_count and df.select("path").limit(o.max_file_count + 1).count() > o.max_file_count:
        raise FileCountLimitExceeded(f"more than {o.max_file_count} files")
    return df


def list_repo(spark: SparkSession, root: str, o: Options = Options(), files_per_partition: int = 256) -> DataFrame:
    """(path, size) of the tree's files without reading them; binary ones are told by their names alone."""
    files = walk(os.path.abspath(root), o)
    return spark.createDataFrame(files, "path string, size bigint")


def _contents(spark: SparkSession, root: str, files: list[tuple[str, int]], chunk: int) -> DataFrame:
    rows = spark.createDataFrame(files, "path string, size bigint").repartition(max(1, -(-len(files) // chunk)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, held = [], 0
            for r in read_files(root, list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))):
                found.append(r)
                held += len(r[2])
                if held > 16 << 20:
                    yield _batch(found)
                    found, held = [], 0
            yield _batch(found)

    return rows.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    p, s, c = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(s, pa.int64()), pa.array(c, pa.binary())], names=["path", "size", "content"])
