"""The five entry points: index, get, outline, search, pack.

A tree's index lives in a folder of its own (``store``), by default ``.index`` inside the tree.
"""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths, text
from tessera.operators import changes, lookup
from tessera.operators.pack import Packer
from tessera.operators.store import IndexStore
from tessera.parsing.tables import with_symbols
from tessera.sources.repo import Options, list_repo, read_repo


class NotFound(LookupError):
    pass


def open_store(spark: SparkSession, root: str, store: str | None = None, buckets: int | None = None) -> IndexStore:
    return IndexStore(spark, store or os.path.join(os.path.abspath(root), ".index"), buckets)


def hashed(listing: DataFrame) -> DataFrame:
    return listing.select("path", text.sha256(F.col("content")).alias("hash"), "content")


def index(spark: SparkSession, root: str, store: str | None = None, options: Options = Options(), purge: bool = False, buckets: int | None = None) -> IndexStore:
    """Brings the index up to date: only new and changed files are parsed and written.

    Each file is read once.  Files that are gone stay in the index unless ``purge``, which reads the tree again.
    ``buckets`` counts for a new index.
    """
    into = open_store(spark, root, store, buckets)
    listing = hashed(read_repo(spark, root, options))
    fresh = changes.changed(listing, into.files().select("path", "hash"))
    into.merge(with_symbols(fresh))
    if purge:
        into.delete(into.files().select("path").join(listing.select("path"), "path", "left_anti"))
    return into


def get(spark: SparkSession, root: str, symbol_or_path: str, store: str | None = None) -> str:
    """Text of a symbol (``path::Qualified.name``) or of a file."""
    s = open_store(spark, root, store)
    if "::" in symbol_or_path:
        found = s.symbol_content(symbol_or_path)
    else:
        row = s.file(symbol_or_path).select("content").head()
        found = bytes(row.content) if row else None
    if found is None:
        raise NotFound(f"Symbol or path not found: {symbol_or_path}")
    return found.decode("utf-8", "replace")


def outline(spark: SparkSession, root: str, path: str, store: str | None = None) -> str:
    """A file's skeleton."""
    s = open_store(spark, root, store)
    row = lookup.outlines(s.file(path), s.symbols_of(path), few=True).head()
    if row is None:
        raise NotFound(f"Path not found: {path}")
    return row.outline


def search(spark: SparkSession, root: str, query: str, store: str | None = None) -> list[str]:
    """Ids of the symbols whose name contains the query."""
    return [r.id for r in lookup.search(open_store(spark, root, store).symbols(), query).orderBy("id").toLocalIterator()]


def pack(spark: SparkSession, target: str, packer: Packer | None = None, include: list[str] | None = None, ignore: list[str] | None = None, store: str | None = None, options: Options = Options()) -> str:
    """The document of a tree, or of one file; the index is brought up to date first."""
    single = os.path.isfile(target)
    root = (os.path.dirname(target) or ".") if single else target
    s = index(spark, root, store, options)
    files = s.files().select("path", "content")
    if single:
        files = files.where(F.col("path") == os.path.basename(target))
    else:
        files = files.where(paths.selected(F.col("path"), include, ignore))
    listing = list_repo(spark, root, options).select("path")
    packer = packer or Packer()
    return replace(packer, root=root).text(changes.present(files, listing), s.symbols())
