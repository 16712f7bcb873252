"""The parser as a table function: files in, their symbols out, in Arrow batches and without a shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tessera.functions.text import ELLIPSIS
from tessera.parsing import scanner
from tessera.parsing.languages import BY_EXTENSION, Language
from tessera.schema import SYMBOL_ARRAY
from tessera.session import bound_batches

_FIELDS = ("name", "qualified_name", "kind", "start", "end", "body_start", "body_end", "ord", "last")
_TYPES = {"ord": pa.int32(), "last": pa.bool_(), **dict.fromkeys(("name", "qualified_name", "kind"), pa.string())}


def _found(source: bytes, language: Language) -> list[tuple]:
    found = scanner.parse(source, language)
    last = {s.qualified_name: i for i, s in enumerate(found)}
    return [(s.name, s.qualified_name, s.kind, s.start, s.end, s.body_start, s.body_end, i, last[s.qualified_name] == i) for i, s in enumerate(found)]


def symbols_of(source: str | bytes | None, language: Language | None) -> list[dict]:
    """Symbols of one text as dictionaries, ``last`` marking the last declaration of each qualified name; none without a language."""
    if source is None or language is None:
        return []
    return [dict(zip(_FIELDS, s)) for s in _found(source.encode("utf-8") if isinstance(source, str) else source, language)]


def language_for(path: str | None, known: dict[str, Language]) -> Language | None:
    if path is None:
        return None
    stem, dot, extension = path.rpartition("/")[2].rpartition(".")
    return known.get(extension) if stem and dot else None


def _is_utf8(source: bytes) -> bool:
    try:
        source.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _column(found: list[list[tuple] | None]) -> pa.Array:
    """The arrays of symbols, built by columns."""
    flat = [s for f in found if f for s in f]
    fields = list(zip(*flat)) or [()] * len(_FIELDS)
    structs = pa.StructArray.from_arrays([pa.array(v, _TYPES.get(f, pa.int64())) for f, v in zip(_FIELDS, fields)], list(_FIELDS))
    sizes = np.array([len(f) if f else 0 for f in found], np.int32)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([f is None for f in found] + [False]))
    return pa.ListArray.from_arrays(offsets, structs)


def elided(source: bytes, found: list[tuple]) -> bytes:
    """The text with its outermost bodies replaced by an ellipsis, as skeleton.elide() has it."""
    out, last = [], 0
    for s in sorted(found, key=lambda s: (s[3], s[7])):
        if s[5] is not None and s[5] >= last:
            out += [source[last : s[5]], ELLIPSIS.encode()]
            last = s[6]
    return b"".join(out) + source[last:]


def _parsed(files: DataFrame, content: str, languages: dict[str, Language] | None, finish, schema: StructType) -> DataFrame:
    """One pass over the files: ``finish`` makes the columns that come after theirs, of the contents (where there is a language) and what was found in them."""
    bound_batches(files.sparkSession)
    known = dict(languages or BY_EXTENSION)
    at, path_at = files.columns.index(content), files.columns.index("path")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            named = [language_for(p, known) for p in b.column(path_at).to_pylist()]
            wanted = [i for i, lang in enumerate(named) if lang]
            texts = [t.encode("utf-8") if isinstance(t, str) else t for t in b.column(at).take(pa.array(wanted, pa.int64())).to_pylist()]
            sources = {i: t for i, t in zip(wanted, texts) if t is not None and _is_utf8(t)}
            found = [_found(sources[i], lang) if i in sources else None for i, lang in enumerate(named)]
            yield pa.RecordBatch.from_arrays([*b.columns, *finish(sources, found)], names=schema.names)

    return files.mapInArrow(run, schema)


def with_symbols(files: DataFrame, content: str = "content", into: str = "symbols", languages: dict[str, Language] | None = None) -> DataFrame:
    """The files with an array of symbols: empty where the text has none, null where nothing was parsed.

    Parsed are files of a known extension whose content is valid UTF-8.  The files are read once and travel
    as Arrow batches; the columns of the others are passed through as they are.
    """
    schema = StructType([*files.schema.fields, StructField(into, SYMBOL_ARRAY)])
    return _parsed(files, content, languages, lambda _, found: [_column(found)], schema)


def with_skeletons(files: DataFrame, content: str = "content", into: str = "skeleton", languages: dict[str, Language] | None = None) -> DataFrame:
    """The files with their texts elided, null where nothing was parsed, in the pass that parses them."""
    schema = StructType([*files.schema.fields, StructField(into, BinaryType())])
    return _parsed(files, content, languages, lambda sources, found: [pa.array([None if f is None else elided(sources[i], f) for i, f in enumerate(found)], pa.binary())], schema)


def exploded(files: DataFrame, symbols: str = "symbols") -> DataFrame:
    """One row for each symbol: (path, id, name, kind, byte_offset, byte_length, ord).

    Where a file declares a qualified name more than once the last declaration wins.  All declarations of
    an id are in one file and the parser has marked the last, so this needs no shuffle.
    """
    rows = files.select("path", F.explode(F.filter(symbols, lambda s: s["last"])).alias("s"))
    return rows.select(
        F.concat(F.col("path"), F.lit("::"), F.col("s.qualified_name")).alias("id"), "path", F.col("s.qualified_name").alias("name"), F.col("s.kind").alias("kind"),
        F.col("s.start").alias("byte_offset"), (F.col("s.end") - F.col("s.start")).alias("byte_length"), F.col("s.ord").alias("ord"),
        F.col("s.body_start").alias("body_start"), F.col("s.body_end").alias("body_end"),
    )
